"""Operators 11 to 13 against brute force and their SQL."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import filter_audit, mixing, queries, ranking, spans

from .fixtures import documents, nothing, rows

WORDS = re.compile("[^\x20\x09-\x0d]+")
TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
key = lambda r: tuple((x is not None, x) for x in r)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 0, 1), (3, 1, 1), (5, None, 1), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")


def by_sql(spark, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(sql).fetchall()


# 11


def raw(some):
    data = [t.encode("utf-8", "replace") for t in some]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\x0b\x1caabAB#|é語😀", max_size=40), max_size=8), st.integers(1, 30))
def test_counts_of_a_pass(some, size):
    data, bounds = raw(some)
    before, spans.CHUNK = spans.CHUNK, size
    try:
        got = filter_audit.counts(data, bounds).tolist()
    finally:
        spans.CHUNK = before
    words = [WORDS.findall(t) for t in some]
    assert got == [[len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))] for w, t in zip(words, some)]


def test_equal_hashes_make_no_equal_words(monkeypatch):
    r = random.Random(1)
    some = [" ".join("".join(r.choice("ab") for _ in range(r.choice((1, 3, 8, 9, 17, 70)))) for _ in range(200)) for _ in range(4)]
    monkeypatch.setattr(spans.Words, "hashes", lambda self, start, end: np.zeros(len(start), np.uint64))
    assert filter_audit.counts(*raw(some))[:, 1].tolist() == [len(set(t.split())) for t in some]


def test_long_words_and_texts():
    some = ["x" * 3_000_000 + " " + "x" * 3_000_000, "", "w " * 1_500_000 + "é" * 70 + " " + "é" * 70, " " * 2_000_000]
    assert filter_audit.counts(*raw(some))[:, :2].tolist() == [[2, 1], [0, 0], [1_500_002, 2], [0, 0]]


def expect_audit(some, labels):
    """Brute force: the filters applied in every order."""
    good, toxic = ({d for d, q, t in labels if x(q, t)} - {None} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    least = {}
    for d, t, _ in some:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts = defaultdict(list)
    for d, t, lang in some:
        t = t or ""
        w = WORDS.findall(t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t])) if bad}
        parts[lang or ""].append((fails, d in good, d in toxic))
    for part, own in parts.items():
        out, shares = {}, Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                before = set(order[:k])
                left = [x for x in left if f not in x[0]]
                out["".join(order), k + 1] = (len(left), len(gone), sum(f in x[0] and bool(x[0] & before) for x in own), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone))
                shares[f] += len(gone)
        for (order, step), x in out.items():
            yield part, order, step, *x, shares[order[step - 1]]


def test_filter_interactions_odd_texts(spark, docs, labels):
    own = [(r[0], r[1], r[2]) for r in rows()]
    expected = list(expect_audit(own, [tuple(r) for r in labels.collect()]))
    same(filter_audit.filter_interactions(docs, labels), expected)
    assert filter_audit.filter_interactions(docs, labels).count() == len(expected)
    assert filter_audit.filter_interactions(nothing(spark), labels).count() == 0
    same(filter_audit.filter_interactions(docs.limit(0).union(docs.where("doc_id IS NULL")), labels.limit(0)), list(expect_audit([x for x in own if x[0] is None], [])))


def test_filter_interactions_equal_their_sql(spark, sf, docs, labels):
    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels")}
    same(queries.op11_filter_interactions(spark, sf), by_sql(spark, queries.OP11_SQL, **tables))
    same(filter_audit.filter_interactions(docs, labels), by_sql(spark, queries.OP11_SQL, documents=docs, labels=labels))


# 12


def word_count(text):
    return len(WORDS.findall(text or ""))


def expect_targets(sizes):
    """By sharing again and again what the full ones leave."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return full | {s: left * weight[s] / total for s in free}
        for s in over:
            full[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(full.values())


def plain_rates(sizes, target):
    """exp(v * size), 2 at most, v found by halving."""
    if target >= 2 * sum(sizes):
        return [2.0] * len(sizes)
    rate = lambda v, s: min(2.0, math.exp(min(v * s, 1.0)))
    low, high = -50.0, 50.0
    for _ in range(200):
        v = (low + high) / 2
        low, high = (v, high) if sum(rate(v, s) * s for s in sizes) < target else (low, v)
    return [rate(low, s) for s in sizes]


def check_mix(got, some):
    """``some``: doc_id, text, source."""
    by_source = defaultdict(list)
    for d, t, s in some:
        by_source[s].append((d, word_count(t)))
    sizes = {s: sum(n for _, n in own) for s, own in by_source.items()}
    goals = expect_targets(sizes)
    assert len(got) == len(some)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((d is None, d or 0, word_count(t)) for d, t, _ in some)
    assert all(r["taken"] == r["size"] * r["copies"] and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    held = defaultdict(list)
    source = defaultdict(set)
    for d, t, s in some:
        source[d, word_count(t)].add(s)
    for r in got:
        if len(source[r["doc_id"], r["size"]]) == 1:
            held[next(iter(source[r["doc_id"], r["size"]]))].append(r)
    for s, own in held.items():
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - goals[s]) <= 1e-6 * max(1, goals[s]) for r in own)
        if len(own) == len(by_source[s]):
            longest = max(n for _, n in by_source[s])
            assert abs(sum(r["taken"] for r in own) - goals[s]) <= longest + 1e-3 * goals[s] + 1
        rates = dict(zip((n for _, n in by_source[s]), plain_rates([n for _, n in by_source[s]], goals[s])))
        for r in own:
            if r["size"] and goals[s]:
                assert math.floor(rates[r["size"]] - 1e-3) <= r["copies"] <= math.ceil(rates[r["size"]] + 1e-3)
            else:
                assert r["taken"] == 0


def test_mix(spark, sf):
    some = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op12_source_mix(spark, sf).collect()
    check_mix(got, some)
    assert sorted(got) == sorted(queries.op12_source_mix(spark, sf).collect())


def test_mix_of_skewed_sources(spark):
    """One source with most words gives less than it has, others more or all they can; sizes of one kind and of many."""
    r = random.Random(5)
    some = [(k, "w " * (r.choice((1, 5, 30, 400)) if s == "a" else 7 if s == "b" else r.randint(0, 60)), s) for k, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 40 + [None] * 500 + ["\U0001f600"] * 60 + ["￿"] * 3 + ["z"])]
    df = spark.createDataFrame(some, "doc_id long, text string, source string")
    got = mixing.mixed(df).collect()
    check_mix(got, some)
    assert sorted(got) == sorted(mixing.mixed(df.repartition(7)).collect())
    goals = expect_targets({s: sum(word_count(t) for _, t, x in some if x == s) for s in {x for _, _, x in some}})
    partial = [s for s in goals if 0 < goals[s] < 1.99 * sum(word_count(t) for _, t, x in some if x == s)]
    assert partial, "no source has a rate to solve for"


def test_mix_odd_texts(spark, docs):
    own = rows()
    some = [(r[0], r[1], r[3]) for r in own]
    check_mix(mixing.mixed(docs).collect(), some)
    assert mixing.mixed(docs).count() == len(own)
    assert mixing.mixed(docs).select("taken").count() == len(own)
    assert mixing.mixed(nothing(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "x"), (2, " \n", None), (None, "", "y")], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mixed(blank).collect()] == [(0, 0.0, 0)] * 3


def test_words_are_counted_without_lists(spark):
    some = ["", None, "  ", "a", " a", "a ", "a\x1cb c\x85d", "\t\x0b é\n語 ", "w " * 100_000, " " * 100_000 + "x"]
    df = spark.createDataFrame([(t,) for t in some], "text string").select(mixing.word_count(F.col("text")).alias("n"))
    assert [r["n"] for r in df.collect()] == [word_count(t) for t in some]


def test_mix_runs_no_python(spark, sf):
    plan = mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 13


def terms(text):
    return TERMS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def expect_ranks(some, items, k=10):
    """Brute force: every score."""
    held = [(d, Counter(terms(t))) for d, t in some if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(times * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if s:
                scores.append((-s, d is None, d or 0))
        for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1):
            yield item, rank, None if none else d, -s


def items_of(spark):
    some = [(1, "the the an é"), (2, None), (3, "--- "), (3, "THE erst, 日本語のテキスト"), (None, "st an"), (4, "nowhere"), (5, rows()[0][1]), (5, rows()[0][1]), (6, "a b c x y we ll 12"), (7, rows()[40][1])]
    return some, spark.createDataFrame([(i, t, 1) for i, t in some], "item_id long, text string, tf int")


@pytest.mark.parametrize("shard", [16_384, 3, 11])
def test_ranked_search_odd_texts(spark, docs, shard):
    some, items = items_of(spark)
    same(ranking.ranked(docs, items, shard=shard), list(expect_ranks([(r[0], r[1]) for r in rows()], some)))


def test_ranked_search_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 2)
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 20)
    some, items = items_of(spark)
    same(ranking.ranked(docs, items, k=3, shard=7), list(expect_ranks([(r[0], r[1]) for r in rows()], some, 3)))


def test_ranked_search_of_nothing(spark, docs):
    some, items = items_of(spark)
    assert ranking.ranked(nothing(spark), items).count() == 0
    assert ranking.ranked(docs, items.limit(0)).count() == 0
    assert ranking.ranked(docs.where("text IS NULL"), items).count() == 0
    assert ranking.ranked(docs, items).select("rank").count() == len(list(expect_ranks([(r[0], r[1]) for r in rows()], some)))


def test_ranked_search_equals_its_sql(spark, sf):
    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark")}
    got = queries.op13_ranked_search(spark, sf)
    same(got, by_sql(spark, queries.OP13_SQL, **tables))


def test_accumulators_are_limited():
    """Rare terms decide, so common terms make no accumulators; the results are those of all."""
    r = np.random.default_rng(3)
    n, k, limited = 4_000, 5, 0
    for _ in range(60):
        lengths = np.sort(r.integers(1, n // 2, 8))
        weights = np.maximum(1, 9000 - lengths * 4).astype(np.int64)
        doc = [np.sort(r.choice(n, m, replace=False)) for m in lengths]
        part = [w * r.integers(1, 1000, len(d)) for w, d in zip(weights, doc)]
        first = np.cumsum([0, *map(len, doc)])
        most = np.array([p.max() for p in part])
        full = np.zeros(n, np.int64)
        times = r.integers(1, 3, 8)
        for d, p, t in zip(doc, part, times):
            full[d] += p * t
        flat = np.concatenate(doc), np.concatenate(part)
        alive, score, made = ranking.search(np.arange(8), times, first, *flat, most, n, k, 0)
        best = lambda d, s: sorted(zip((-s).tolist(), d.tolist()))[:k]
        assert best(alive, score) == best(np.arange(n), full)
        assert all(full[alive] == score)
        least = int(np.sort(full)[-3])
        more, own, fewer = ranking.search(np.arange(8), times, first, *flat, most, n, k, least)
        assert {d for d in np.flatnonzero(full >= least)} <= set(more.tolist()) and fewer <= made
        limited += made < (full > 0).sum()
    assert limited > 30
