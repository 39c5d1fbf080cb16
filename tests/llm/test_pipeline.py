import random
import zlib
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import langid, quality, queries, similar, simhash
from quire.llm.common import written

from .fixtures import documents, nothing
from .test_operators import check_packing, repeats, split


def first_of_groups(some):
    """Of rows (doc_id, text), in this order, the first of each group of similar texts."""
    groups, seen, out = jaccard_groups([t for _, t in some]), set(), []
    for row, g in zip(some, groups):
        if g not in seen:
            seen.add(g)
            out.append(row)
    return out


def brute_force(rows, keep_language, keep_quality):
    """Stages on plain rows (doc_id, text): what goes on to packing."""
    kept = [r for r in rows if keep_language(r)]
    kept = [r for r in kept if keep_quality(r)]
    kept = first_of_groups(sorted(kept))
    data = [tuple(split(t)) for _, t in kept]
    return [(d, " ".join(w for w, g in zip(ws, gone) if not g) if any(gone) else t) for (d, t), ws, gone in zip(kept, data, repeats(data, 35))]


def fitting(docs):
    """doc_ids whose n-grams are about as likely as in their language, by plain sums: no more than 20 deviations or 4 nats below the training documents' mean."""
    langs, log = langid.train(docs)
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect() if r["text"] and langid.has_letter(r["text"])]
    best, value, grams = {}, {}, {}
    for d, _, t in rows:
        at = langid.score([t], log)[0]
        n = sum(len(t.lower()) + 2 - k for k in range(langid.ORDERS))
        best[d], value[d], grams[d] = langs[int(at.argmax())], at.max() / n, n
    limits = {}
    for lang in langs:
        own = [value[d] for d, x, _ in rows if x == lang == best[d] and grams[d] >= 1000 and zlib.crc32(str(d).encode()) % 4 != 2]
        limits[lang] = (np.mean(own), max(np.std(own), 0.1)) if own else None
    return {d for d, _, _ in rows if limits[best[d]] is None or value[d] >= limits[best[d]][0] - min(4.0, 20 * limits[best[d]][1] * (1 + 1000 / grams[d]) ** 0.5)}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    known = {r["doc_id"] for r in langid.identify(docs, langid.train(docs)).where("lang_pred <> 'und' AND score >= 0.5").collect()} & fitting(docs)
    left = docs.where(F.col("doc_id").isin(sorted(known)))
    good = {r["doc_id"] for r in quality.judged(docs, quality.train(left, spark.read.parquet(f"{sf}/labels.parquet"))).where("kept").collect()}
    expected = brute_force(rows, lambda r: r[0] in known, lambda r: r[0] in good)
    tokenizer = Tokenizer.from_file(queries.WORD_TOKENIZER)
    ids = {d: [tokenizer.encode(t, add_special_tokens=False).ids + [1]] for d, t in expected}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(ids)
    check_packing(got, ids)


@pytest.mark.parametrize("make", [documents, nothing])
def test_stages_return_the_columns_of_documents(spark, sf, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = written(stage(spark, docs, sf), "stage")
        assert got.columns == docs.columns
        assert got.count() <= docs.count()
        docs = got
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def shingles(text):
    ws = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def jaccard_groups(some, least=0.8):
    """The group of each text by brute force."""
    sets = [shingles(t) for t in some]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if len(a & b) >= least * len(a | b):
                root[find(j)] = find(i)
    return [find(k) for k in range(len(sets))]


def copies(r, word, n, edits):
    """A text of n words and near copies of it, the k-th with ``edits[k]`` words changed."""
    own = [word(r) for _ in range(n)]
    yield " ".join(own)
    for k in edits:
        new = list(own)
        for at in r.sample(range(n), k):
            new[at] = word(r)
        yield " ".join(new)


def test_near_dedup_finds_every_pair_of_similar_texts(spark):
    r = random.Random(8)
    word = lambda r: "w%d" % r.randrange(5000)
    some = [t for n in (60, 150, 400) for _ in range(6) for t in copies(r, word, n, [1, n // 60, n // 50, n // 45, n // 40, n // 10])]
    some += ["", None, " ", "one two", "One Two", "one two three"]
    groups = jaccard_groups(some)
    assert len(some) > len(set(groups)) > 24
    got = similar.keep_one(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in got) == sorted({min(k for k, h in enumerate(groups) if h == g) for g in groups})


def test_near_dedup_stage_of_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = sorted((x["doc_id"], x["text"]) for x in docs.collect())
    groups = jaccard_groups([t for _, t in some])
    first = {g: min(d for (d, _), h in zip(some, groups) if h == g) for g in set(groups)}
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == sorted(first.values())


def test_near_dedup_links_every_pair_past_the_first_pivots(spark, monkeypatch):
    """A chain of texts, each like its neighbours only, and blocks and hot keys of a few rows."""
    from quire.llm import common

    monkeypatch.setattr(similar, "BLOCK", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    own = [f"w{k}" for k in range(400)]
    some = []
    for k in range(30):
        some.append(" ".join(own))
        for at in range(6):
            own[(k * 13 + at * 2) % 400] = f"v{k}_{at}"
    groups = jaccard_groups(some)
    got = similar.keep_one(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in got) == sorted({min(k for k, h in enumerate(groups) if h == g) for g in groups})


def test_near_dedup_keeps_each_text_of_a_shared_doc_id(spark):
    x, y = " ".join(f"x{k}" for k in range(60)), " ".join(f"y{k}" for k in range(60))
    rows = [(3, x, "a"), (5, x, "b"), (5, y, "c"), (5, y, "c"), (None, y + " z", "d"), (None, None, "e"), (9, "", "f")]
    got = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, x, "a"), (5, y, "c"), (9, "", "f")], key=str)


def test_stages_of_odd_tables_by_value(spark, sf):
    """Every stage but the models' gives what brute force gives on nulls, empty and long texts, repeated rows and clashing columns."""
    docs = documents(spark)
    some = sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0], r[1] or 0, r[2] or ""))
    groups = jaccard_groups([t for *_, t in some])
    kept = {g: (d, t) for (_, d, t), g in reversed(list(zip(some, groups)))}
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(kept.values(), key=str)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    data = [tuple(split(t)) for _, t in rows]
    want = [(d, " ".join(w for w, g in zip(ws, gone) if not g) if any(gone) else t) for (d, t), ws, gone in zip(rows, data, repeats(data, 35))]
    assert sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.substring_dedup(spark, docs, sf).collect()), key=str) == sorted(want, key=str)


def near_copies(r, n=40):
    """Texts of 1,500 words and copies of them with a word or two changed: many fingerprints differ in 2 bits at most."""
    word = lambda r: "w%d" % r.randrange(50_000)
    return [t for _ in range(n // 4) for t in copies(r, word, 1500, [1, 1, 2])] + ["", None, "one two", "One Two"]


def test_near_dedup_links_by_simhash(spark, monkeypatch):
    """Without candidates from MinHash, the stage has the groups of operator 10's rule: fingerprints that differ in 2 bits at most."""
    some = near_copies(random.Random(3))
    sets = [similar.shingle_set(t or "", similar.SHINGLE) for t in some]
    fps = [simhash.majority(s) for s in sets]
    first = list(range(len(some)))
    for _ in some:  # the least number that can be reached
        for i in range(len(some)):
            for j in range(len(some)):
                if len(sets[i]) and len(sets[j]) and (fps[i] ^ fps[j]).bit_count() <= 2:
                    first[i] = min(first[i], first[j])
    empty = [k for k, s in enumerate(sets) if not len(s)]
    want = sorted({k for k, f in enumerate(first) if f == k} - set(empty[1:]))
    assert len(some) - len(want) > 10
    monkeypatch.setattr(similar, "first_pairs", lambda met, *_: met.select("pivot", "node").where("false"))
    got = similar.keep_one(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in got) == want


def test_near_dedup_past_simhash_takes_whole_groups(spark, monkeypatch):
    """What SimHash links, what MinHash adds, and few pairs where SimHash has linked all nodes of a pivot."""
    asked = []
    pairs = similar.first_pairs
    monkeypatch.setattr(similar, "first_pairs", lambda met, roots: asked.append((met, roots)) or pairs(met, roots))
    some = near_copies(random.Random(5))
    groups = jaccard_groups(some)
    got = similar.keep_one(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in got) == sorted({min(k for k, h in enumerate(groups) if h == g) for g in groups})
    met, roots = asked[0]
    every = pairs(met, roots.where("false")).count()
    assert 0 < pairs(met, roots).count() < every
