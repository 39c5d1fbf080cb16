import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import bytebpe, bytedup, langid, packing, pagetext, quality, queries, simhash, token_files, topk, worddup
from quire.llm.wordbpe import encoder

from .fixtures import documents, nothing, rows

WORDS = re.compile("[^\x20\x09-\x0d]+")
split = lambda t: WORDS.findall(t or "")
u32 = lambda ids: np.asarray(ids, "<u4").tobytes()
sha = lambda b: hashlib.sha256(b).hexdigest()
key = lambda r: tuple((x is not None, x) for x in r)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def given_texts(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(queries.WORD_TOKENIZER)


# 1


def test_language_id_finds_held_out_languages(spark, sf):
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, sf).collect()}
    known = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(got) == len(known)
    out = [r for r in known if got[r["doc_id"]]["held_out"]]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in known)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_odd_texts(spark, docs):
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == docs.count()
    by = {d: t for d, t, *_ in rows()}
    for r in got:
        if r["doc_id"] is not None and not any(c.isalpha() for c in by[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.identify(nothing(spark), langid.train(nothing(spark))).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(nothing(spark))).collect()} == {"und"}


def test_language_id_numbers_are_no_letters():
    assert not any(map(langid.has_letter, ("", "½ ² ٣ Ⅷ 7", "_-!", " \n")))
    assert all(map(langid.has_letter, ("7é", "語", "½a")))
    log = np.zeros((langid.ORDERS * langid.BUCKETS + 1, 2))
    assert langid.predicted(["½²", "x"], ["de", "en"], log) == (["und", "de"], [0.0, 0.5])


@pytest.mark.parametrize("block", [3, 7, 50])
def test_language_id_blocks_do_not_matter(monkeypatch, block):
    log = np.random.default_rng(0).normal(size=(langid.ORDERS * langid.BUCKETS + 1, 2))
    log[0] = 0
    some = ["the an" * 40, "", "ça va été " * 9, "x", "ab"]
    whole = langid.score(some, log)
    monkeypatch.setattr(langid, "BLOCK", block)
    assert np.allclose(langid.score(some, log), whole)
    assert np.allclose(langid.score(some[2:3], log), whole[2:3])


def plain_scores(text, log):
    """Brute force: n-gram by n-gram."""
    spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    total = np.zeros(log.shape[1])
    for n in range(1, langid.ORDERS + 1):
        for k in range(len(spaced) - n + 1):
            h = 0
            for c in spaced[k : k + n]:
                h = (h * 0x9E3779B1 + ord(c) * 0x85EBCA6B) & 0xFFFFFFFF
            total += log[(((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17) + (n - 1) * langid.BUCKETS + 1]
    return total


def test_language_id_scores_are_the_sums_of_all_ngrams(given_texts):
    log = np.random.default_rng(1).normal(size=(langid.ORDERS * langid.BUCKETS + 1, 3))
    log[0] = 0
    some = [t for _, t in given_texts[:4]] + ["", "a", "Été 7 ½ x"]
    assert np.allclose(langid.score(some, log), [plain_scores(t, log) for t in some])


def test_language_id_of_a_long_text_is_that_of_its_whole(spark):
    text = "der die und " * 125_000  # 1.5 million characters
    assert len(text) > 2 * langid.BLOCK
    model = ["de", "en"], np.random.default_rng(2).normal(size=(langid.ORDERS * langid.BUCKETS + 1, 2)).astype(np.float32)
    model[1][0] = 0
    got = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == model[0][int(np.argmax(langid.score([text], model[1])[0]))]
    period = (langid.score(["der die und " * 40], model[1]) - langid.score(["der die und " * 20], model[1]))[0] / 20
    assert np.allclose(langid.score([text], model[1])[0], langid.score(["der die und " * 20], model[1])[0] + period * (125_000 - 20))


# 2 and 7


def test_language_model_is_the_counted_one(spark, sf):
    """Training, by plain counting: every document of the training part, every n-gram."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    langs, log = langid.train(docs)
    counts = defaultdict(Counter)
    for r in docs.collect():
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            spaced = " " + "".join(c if c.isalpha() else " " for c in r["text"].lower()) + " "
            for n in range(1, langid.ORDERS + 1):
                for k in range(len(spaced) - n + 1):
                    h = 0
                    for c in spaced[k : k + n]:
                        h = (h * 0x9E3779B1 + ord(c) * 0x85EBCA6B) & 0xFFFFFFFF
                    counts[r["lang"]][(((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17) + (n - 1) * langid.BUCKETS + 1] += 1
    assert langs == sorted(counts)
    expected = np.zeros_like(log, dtype=float)
    for j, lang in enumerate(langs):
        for n in range(langid.ORDERS):
            own = np.array([counts[lang][k] for k in range(n * langid.BUCKETS + 1, (n + 1) * langid.BUCKETS + 1)]) + 0.1
            expected[n * langid.BUCKETS + 1 : (n + 1) * langid.BUCKETS + 1, j] = np.log(own / own.sum())
    assert np.allclose(log, expected, atol=1e-5)


@pytest.mark.parametrize("languages", [1, 2, 3])
def test_all_languages_are_scored_in_blocks(spark, docs, sf, monkeypatch, languages):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    whole = sorted(map(tuple, langid.identify(given, langid.train(given)).collect()))
    monkeypatch.setattr(langid, "LANGUAGES", languages)
    model = langid.train(given)
    assert len(model[0]) == 4
    blocks = sorted(map(tuple, langid.identify(given, model).collect()))
    assert [r[:3] for r in whole] == [r[:3] for r in blocks]
    assert np.allclose([r[3] for r in whole], [r[3] for r in blocks])


def test_texts_like_no_language_are_rejected(spark, sf):
    """Noise and other scripts have a posterior probability near 1, too; short ones are told as well as long ones."""
    given = spark.read.parquet(f"{sf}/documents.parquet").drop("n_chars")
    r = random.Random(1)
    noise = [" ".join("".join(r.choice("qxzkvwjpbf") for _ in range(r.randint(3, 9))) for _ in range(n)) for n in (10, 60, 400)]
    foreign = [t * k for t in ("これは日本語の文章です。今日は天気がいいので散歩に行きました。", "Это русский текст о погоде и о том, что мы делали вчера вечером. ") for k in (1, 10)]
    prose = ["This is ordinary English prose about the weather and what we did yesterday, with nothing odd in it. "]
    odd = spark.createDataFrame([(10_000 + k, t, None, "s") for k, t in enumerate(noise + foreign + prose)], given.schema)
    docs = given.union(odd)
    model = langid.train(docs)
    sure = {x["doc_id"] for x in langid.identify(docs, model).where("score > 0.5").collect()}
    kept = {x["doc_id"] for x in langid.keep_known(docs, model).collect()}
    assert sum(10_000 + k in sure for k in range(7)) >= 6
    assert {x["doc_id"] for x in given.collect()} | {10_007} == kept


def sentences(seed, words, n):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randint(6, 14))) for _ in range(n)]


def test_languages_of_short_documents_have_a_limit(spark):
    """No training document is long: what is like none of them goes all the same, and they stay; a language of numbers takes nothing in."""
    en, de = "the a weather house was good and we went there yesterday with friends".split(), "das ein wetter haus war gut und wir gingen gestern dorthin mit freunden".split()
    rows = [(t, lang) for lang, words in (("en", en), ("de", de)) for t in sentences(lang, words, 60)] + [("12 345", "no"), ("6 7", "no")] * 8
    odd = ["qxz vwk jpq zzx " * k for k in (3, 20)] + ["これは日本語の文章です。今日は天気がいい。" * k for k in (1, 8)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)] + [(1_000 + k, t, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string")
    for model in (langid.train(docs), langid.train(docs, None)):
        assert {x["lang"] for x in langid.usual(docs, model).collect()} == {"en", "de"}
        assert {x["doc_id"] for x in langid.keep_known(docs, model).collect()} == set(range(120))


def test_limits_equal_a_loop_over_all_training_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs, log = model = langid.train(docs, None)
    kept = {}
    for r in docs.collect():
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            (at,), (n,) = langid.scored([r["text"]], log)
            if langs[at.argmax()] == r["lang"]:
                kept.setdefault(r["lang"], []).append((n / (n + langid.GRAMS), at.max() / n))
    for r in langid.usual(docs, model).collect():
        w, v = np.array(kept.pop(r["lang"])).T
        mean = (w * v).sum() / w.sum()
        assert np.allclose((r["mean"], r["sd"]), (mean, np.sqrt((w * (v - mean) ** 2).mean())), atol=1e-6)
    assert not kept


def test_the_language_stage_learns_from_all_training_documents(spark, monkeypatch):
    """More documents of a language than operator 1's bound: models and limits read them all."""
    words = "the a weather house was good and we went there yesterday with friends".split()
    docs = spark.createDataFrame(list(enumerate(sentences(7, words, 8_000))), "doc_id long, text string").withColumn("lang", F.lit("en"))
    whole, sample, read = docs.where(~langid.held_out(F.col("doc_id"))).count(), langid.sample_of, []
    monkeypatch.setattr(langid, "sample_of", lambda *a: read.append(sample(*a)) or read[-1])
    assert corpus_pipeline.language_id(spark, docs, None).count() == 8_000
    assert whole > langid.PER_LANGUAGE and [r.count() for r in read] == [whole] * 2


def test_word_encoder_is_the_library(given_texts, word_tokenizer):
    own = encoder(open(queries.WORD_TOKENIZER, "rb").read())
    for t in [t for _, t in given_texts[:60]] + [r[1] or "" for r in rows()]:
        assert own.encode(t) == u32(word_tokenizer.encode(t, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40) | st.text(alphabet="aB'srelvmdt 1.!<|>é\ń", max_size=40))
def test_encoders_on_any_text(text):
    own = encoder(open(queries.WORD_TOKENIZER, "rb").read())
    library = Tokenizer.from_file(queries.WORD_TOKENIZER) if not hasattr(test_encoders_on_any_text, "t") else test_encoders_on_any_text.t
    test_encoders_on_any_text.t = library
    assert own.encode(text) == u32(library.encode(text, add_special_tokens=False).ids)
    mine = bytebpe.coder(open(queries.BYTE_RANKS, "rb").read(), public_tokenizers.PATTERN)
    assert mine.encode(text) == u32(tik().encode_ordinary(text))


_tik = []


def tik():
    if not _tik:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_RANKS, "rb"))}
        _tik.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _tik[0]


def expected_tokens(word_tokenizer, some, end):
    out, start = [], 0
    for d, t in sorted(some, key=lambda x: (x[0] is not None, x[0])):
        ids = word_tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, start, len(ids), zlib.crc32(u32(ids))))
        start += len(ids)
    return out


def test_token_files(spark, sf, given_texts, word_tokenizer):
    same(queries.op2_token_files(spark, sf), expected_tokens(word_tokenizer, given_texts, 2))


def test_token_files_odd_texts(spark, docs, word_tokenizer, tmp_path):
    path = f"{tmp_path}/tokens"
    got = token_files.token_files(docs, queries.WORD_TOKENIZER, 2, path=path)
    same(got, expected_tokens(word_tokenizer, [(r[0], r[1]) for r in rows()], 2))
    plan = token_files.read_metadata(spark, path).where("doc_id = 3")._jdf.queryExecution().toString()
    assert "ids" not in plan[plan.index("== Physical Plan") :] and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)" in plan
    assert token_files.token_files(nothing(spark), queries.WORD_TOKENIZER).count() == 0


def check_packing(got, expected):
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for d, own in expected.items():
        pieces = sorted(by[d], key=lambda r: (r["piece"], r["sequence_id"]))
        times = len(pieces) // max(1, -(-len(own[0]) // 4096))
        assert times == len(own)
        for r in pieces:
            part = own[0][4096 * r["piece"] : 4096 * r["piece"] + 4096]
            assert (r["start"], r["length"], r["ids_crc32"]) == (4096 * r["piece"], len(part), zlib.crc32(u32(part)))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences)


def test_packing(spark, sf, given_texts, word_tokenizer):
    ids = {d: [word_tokenizer.encode(t, add_special_tokens=False).ids + [1]] for d, t in given_texts}
    got = queries.op7_best_fit_packing(spark, sf).collect()
    total = sum(len(x[0]) for x in ids.values())
    assert check_packing(got, ids) <= -(-total // 4096) * 1.05 + 2


def test_packing_odd_texts(spark, docs, word_tokenizer):
    ids = defaultdict(list)
    for d, t, *_ in rows():
        ids[d].append(word_tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    check_packing(packing.packed_documents(docs, queries.WORD_TOKENIZER).collect(), ids)
    assert packing.packed_documents(nothing(spark), queries.WORD_TOKENIZER).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_packing_holds_every_capacity(by):
    lengths = np.random.default_rng(1).integers(1, 70, 500)
    which, offset = packing.best_fit(lengths, 100, 4, 6000, by=by)
    for b in set(which.tolist()):
        own = lengths[which == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 6000
        assert sorted(offset[which == b].tolist()) == np.concatenate([[0], np.cumsum(lengths[which == b][np.argsort(offset[which == b])])[:-1]]).tolist()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), 100, 4, 6000)


def test_packing_weighs_every_capacity():
    lengths = np.random.default_rng(3).integers(1, 900, 2000)
    by_tokens, by_all = (packing.best_fit(lengths, 4096, 4096, 4096**2, w, "dot")[0] for w in ((1.0, 0.0, 0.0), (1.0, 1.0, 1.0)))
    best = packing.best_fit(lengths, 4096, 4096, 4096**2, (1.0, 0.0, 0.0), "norm")[0]
    assert (best != by_all).mean() > 0.05 and max(by_all) <= max(by_tokens) + 1 <= -(-lengths.sum() // 4096) + 2
    assert max(packing.best_fit(lengths, 4096, 6, 4096**2)[0]) > max(by_all)  # six documents a sequence bind


def test_token_files_have_dictionaries_set_row_groups_and_page_indexes(spark, sf, tmp_path):
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), path, queries.WORD_TOKENIZER, 2)
    files = sorted(x for x in __import__("pathlib").Path(path).iterdir() if x.suffix == ".parquet")
    last = -1
    for file in files:
        meta = pq.ParquetFile(file).metadata
        for k in range(meta.num_row_groups):
            group = meta.row_group(k)
            columns = {group.column(c).path_in_schema.split(".")[0]: group.column(c) for c in range(group.num_columns)}
            assert {"RLE_DICTIONARY"} & set(columns["ids"].encodings) or {"DELTA_BINARY_PACKED"} & set(columns["ids"].encodings)
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            assert columns["doc_id"].statistics.min > last  # ranges of doc_id follow each other
            last = columns["doc_id"].statistics.max


# 3


def test_top_k(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    same(queries.op3_exact_top_k(spark, sf), [tuple(r) for r in con.sql(queries.OP3_SQL).fetchall()])


def best_of(usable, k=5):
    """Brute force over (vec_id, integers): every row but the query's own is a candidate."""
    out = []
    for n, (i, q) in enumerate(usable):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(usable) if m != n)[:k]
            out += [(i, rank + 1, j, max(min(-s, (1 << 63) - 1), -(1 << 63))) for rank, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("shard, block", [(32_768, 32_768), (16, 3)])
def test_top_k_odd_vectors(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    r = random.Random(3)
    vectors = [(k, [r.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(6)], "x") for k in range(0, 110)]
    odd = [(200, None, ""), (250, [1.0, None], ""), (251, [float("nan")] * 6, ""), (300, [float("inf")] * 6, ""), (301, [-float("inf")], ""), (None, [1.0] * 6, ""), (350, [], ""), (400, [2.0], ""), vectors[0], vectors[1], vectors[1]]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, rank string")
    usable = vectors + [(350, [], ""), (400, [2.0], ""), vectors[0], vectors[1], vectors[1]]
    same(topk.top_k(df), best_of([(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in usable]))
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [2e6, 3e9, 1e30])
def test_top_k_of_large_components(spark, size):
    r = random.Random(5)
    vectors = [(k, [r.choice([-1, 1]) * r.random() * size for _ in range(4)]) for k in range(90)] + [(0, [size, 1.0]), (1, [size, 1.0]), (2, [size, 1.0])]
    exact = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (4 - len(v))) for i, v in vectors]
    same(topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")), best_of(exact))


@pytest.mark.parametrize("copies", [0, 3, 4, 5, 6])
def test_top_k_of_near_copies(spark, tmp_path, copies):
    r = np.random.default_rng(copies)
    vectors = r.normal(size=(400, 16))
    for q in range(0, 400, 50):
        for c in range(1, copies + 1):
            vectors[q + c] = vectors[q] * (1 - 0.01 * c) + r.normal(size=16) / 200
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
    same(topk.top_k(df), con.sql(queries.OP3_SQL).fetchall())


# 4


def test_byte_bpe(spark, sf, given_texts):
    same(queries.op4_byte_bpe(spark, sf), [(d, len(ids := tik().encode_ordinary(t)), sha(u32(ids)), sha(t.encode())) for d, t in given_texts])


def test_byte_bpe_odd_texts(spark, docs):
    same(bytebpe.digests(docs, queries.BYTE_RANKS, public_tokenizers.PATTERN), [(d, len(ids := tik().encode_ordinary(t or "")), sha(u32(ids)), sha((t or "").encode())) for d, t, *_ in rows()])
    assert bytebpe.digests(nothing(spark), queries.BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_long_pre_token():
    own = bytebpe.coder(open(queries.BYTE_RANKS, "rb").read(), public_tokenizers.PATTERN)
    r = random.Random(0)
    for text in ("".join(r.choice("abehnost") for _ in range(50_000)), "a" * 30_000, "é" * 9_999):
        assert own.merge(text.encode()) == tik().encode_ordinary(text)


# 5


def base(text):
    ws = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    times = Counter(zip(ws, ws[1:], ws[2:]))
    inside = {j for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if times[w] > 1 for j in (i, i + 1, i + 2)}
    failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def test_quality_rules(spark, sf, given_texts):
    got = {r["doc_id"]: r for r in queries.op5_quality_rules(spark, sf).collect()}
    for d, t in given_texts:
        assert tuple(got[d])[1:7] == base(t)
        assert not (got[d]["kept"] and got[d]["base_failed"])
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(got[d]["kept"], q) for d, q in truth.items() if not got[d]["base_failed"]]
    assert all(kept for kept, q in judged if q) and sum(kept for kept, q in judged if not q) <= 1


def test_quality_rules_odd_texts(spark, docs):
    got = quality.judged(docs, quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(((d, *base(t)) for d, t, *_ in rows()), key=key)
    assert quality.judged(nothing(spark), (quality.PRIOR, quality.PRIOR_STAY)).count() == 0


def test_viterbi_is_the_best_labelling():
    r = np.random.default_rng(0)
    for n in range(1, 9):
        gain, stay = r.normal(size=n), float(r.normal())
        value = lambda y: float(np.dot(gain, y)) + stay * sum(a == b for a, b in zip(y, y[1:]))
        best = max(value([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert abs(value(quality.viterbi(gain, stay).tolist()) - best) < 1e-9


def plain_features(text):
    """The features of each line with a word, from their definitions, over code points."""
    out, sizes, seen = [], [], set()
    for line in text.split("\n"):
        ws = split(line)
        if not ws:
            continue
        joined = "".join(ws)
        rate = sum(c in "#*$%&|<>" for c in joined) / len(joined)
        letters = sum(c.isalpha() for c in line)
        out.append((len(ws), rate, line == line.upper() and letters > 5, line.count("!"), [a == b for a, b in zip(ws, ws[1:])], line in seen, len(set(ws)), ws[-1][-1], len(joined)))
        sizes.append(len(joined))
        seen.add(line)
    return out, sizes


def plain_share(text, model):
    """Share of the code points in content lines by trying every labelling of the lines."""
    lines, sizes = plain_features(text)
    gain = []
    for n, rate, shout, marks, same_, again, different, end, _ in lines:
        x = [1, rate > 0.02, rate > 0.15, shout and n > 1, marks > 0.2 * n, sum(same_) / n > 0.2, again or (different < 0.4 * n and n > 20), end in '."?' and rate <= 0.02, n < 4]
        gain.append(float(np.dot(np.array(x, float), model[0])))
    value = lambda y: float(np.dot(gain, y)) + model[1] * sum(a == b for a, b in zip(y, y[1:]))
    best = max(([m >> k & 1 for k in range(len(gain))] for m in range(1 << len(gain))), key=value)
    return float(np.dot(best, sizes) / sum(sizes))


def test_kept_is_the_verdict_of_the_best_labelling(spark, sf, given_texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    checked = 0
    for _, t in given_texts:
        lines, _ = plain_features(t)
        if 0 < len(lines) <= 9:
            got = quality.verdict(t, model)
            assert abs(got[6] - plain_share(t, model)) < 1e-9
            assert got[7] == (not base(t)[5] and plain_share(t, model) >= quality.SHARE)
            checked += 1
    assert checked > 50
    assert quality.text_features(("é" * 40 + "\nok.").encode())[1].tolist() == [40.0, 3.0]


def test_training_sequences_hold_both_labels():
    docs = [(np.full((n, 2), float(n)), q) for n, q in ((1, 0), (2, 0), (3, 1), (4, 1), (5, 1))]
    xs, ys = quality.mixed_sequences(docs)
    assert [y.tolist() for y in ys] == [[1, 1, 1, 0], [0, 0, 1, 1, 1, 1], [1, 1, 1, 1, 1]]
    assert [x[:, 0].tolist() for x in xs] == [[3, 3, 3, 1], [2, 2, 4, 4, 4, 4], [5] * 5]


def test_a_fit_learns_where_labels_change(spark, sf):
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert model[1] != quality.PRIOR_STAY and not np.allclose(model[0], quality.PRIOR)


def test_gradient_is_the_slope_of_the_likelihood():
    r = np.random.default_rng(1)
    x, y, w, stay = r.normal(size=(5, 3)), np.array([1.0, 0, 1, 1, 0]), r.normal(size=3), 0.4

    def likelihood(w, stay):
        value = lambda y: float(x @ w @ y) + stay * sum(a == b for a, b in zip(y, y[1:]))
        return value(y) - np.log(sum(np.exp(value(np.array([m >> k & 1 for k in range(5)], float))) for m in range(32)))

    g, s = quality.gradient(x, y, w, stay)
    e = 1e-6
    assert np.allclose(g, [(likelihood(w + e * d, stay) - likelihood(w - e * d, stay)) / (2 * e) for d in np.eye(3)], atol=1e-5)
    assert abs(s - (likelihood(w, stay + e) - likelihood(w, stay - e)) / (2 * e)) < 1e-5


# 6

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article class=post><h2>Head &amp;  line</h2><p>First <b>bold</b>ly\n told&nbsp;tale.<br>More</p><div class="ad">Buy now</div>
<p>Second &lt;one&gt; 1 < 2<form><input>Name</form><p>Third<aside>Also read</aside></article>
<section id="comments"><p>Nice!</p></section></main><div class=sidebar><p>Side words here</div><footer>&copy; me</footer></body>"""


def test_page_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 0), (3, "", "", 0), (4, "x", "<p>", 0), (5, "y", "plain words only", 0), (None, "n", "<div><p>a b<p>c", 1)] * 2, "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in pagetext.page_texts(pages, pagetext.train(pages)).collect()}
    assert got[1]["text"] == "Head & line\n\nFirst boldly told tale. More\n\nSecond <one> 1 < 2\n\nThird"
    assert [got[k]["text"] for k in (2, 3, 4, 5, None)] == ["", "", "", "plain words only", "a b\n\nc"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert pagetext.page_texts(pages.limit(0), pagetext.train(pages.limit(0))).count() == 0


def test_page_text_of_given_pages(spark, sf):
    got = {r["page_id"]: r["text"] for r in queries.op6_page_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert not re.search(r"<(?!/?(?:p|b|br|h1)>)", inner)
        blocks = [" ".join(__import__("html").unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n\n".join(x for x in blocks if x)


def test_region_has_the_greatest_sum():
    r = random.Random(2)
    weights = pagetext.Weights({"p": 0.3, "div": 2.0, "li": 4.0, ".x": 1.5}, {".x": 9.0})
    for _ in range(300):
        parts = [r.choice(["w ", "two words ", "<p>", "</p>", "<div>", "<div class=x>", "</div>", "<li>", "<a>", "</a>", "<article>", "</article>"]) for _ in range(14)]
        found = list(pagetext.walk("".join(parts), weights))
        value = pagetext.scores(found, weights)
        best = max([0.0] + [sum(value[a:b]) for a in range(len(value)) for b in range(a, len(value) + 1)])
        first, end = pagetext.region(found, weights)
        assert abs(sum(value[first:end]) - best) < 1e-9


@pytest.fixture(scope="module")
def page_weights(spark, sf):
    return pagetext.train(spark.read.parquet(f"{sf}/pages.parquet"))


WORDS_40, WORDS_45 = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("w", 40), ("v", 45)))
LIST = "<ul>" + "".join(f"<li>item{k}</li>" for k in range(6)) + "</ul>"
MENU = "<ul>" + "".join(f"<li><a href=x>menu{k}</a></li>" for k in range(6)) + "</ul>"
#: Bodies that the given pages don't show: lists, tables, quotes, figures, links, nested blocks.
BODIES = [
    f"<h1>Head</h1><p>{WORDS_40}</p>{LIST}<p>{WORDS_45}</p>",
    f"<h2>Short</h2>{LIST}",
    "<p>See <a>this link here</a> now.</p>",
    f"<p>one two three four five</p><table><thead><tr><th>a</th><th>b</th></tr></thead><tr><td>1</td><td>2</td></tr></table><p>{WORDS_40}</p><ol><li>x</li><li>y</li></ol>",
    f"<p>{WORDS_45}</p>" + "<div>" * 6 + f"<p>{WORDS_40}</p>" + "</div>" * 6 + "<blockquote>quoted <q>twice</q></blockquote>",
    f"<section><h2>A</h2><figure><img src=x><figcaption>caption here</figcaption></figure><p>{WORDS_40}</p></section><section><h2>B</h2><pre>code x</pre><dl><dt>t</dt><dd>d e</dd></dl></section>",
    f"<div class=intro><p>{WORDS_40}</p></div><div class=more><p>five words at the end</p></div>",
    f"<p>{WORDS_40}</p><ul><li><a>Term</a> what it means</li><li><a>Other</a> is another thing</li></ul>",
]
AROUND = [
    "<body><nav>{m}</nav><article>{b}</article><footer>foot words</footer></body>",
    "<body><header>top</header><main class=wide>{b}</main><aside>side words here</aside></body>",
    "<body>{m}<div>{b}</div>{m}</body>",
    "<div><div>{m}</div></div><div><div>{b}</div></div><div class=ad>Buy it now please</div>",
    "<table><tr><td>{m}</td><td>{b}</td></tr></table>",
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("body", BODIES)
def test_no_word_of_an_article_is_lost(page_weights, body, around):
    text = pagetext.main_text(around.format(m=MENU, b=body), page_weights)
    assert text.split() == re.sub("<[^>]*>", " ", body.replace("</a>", "").replace("<a>", "").replace("<q>", "").replace("</q>", "")).split()


def test_learned_costs_decide(page_weights):
    """With the costs at zero and all else as it was, menus of pages without an article stay."""
    none = pagetext.Weights(dict.fromkeys(page_weights.cost, 0.0), page_weights.odds)
    for around in AROUND[2:]:
        for body in BODIES:
            text = pagetext.main_text(around.format(m=MENU, b=body), none)
            assert "menu5" in text and "menu5" not in pagetext.main_text(around.format(m=MENU, b=body), page_weights)


def test_learned_marks_decide(spark, sf, page_weights, monkeypatch):
    monkeypatch.setattr(pagetext.Weights, "prior_odds", lambda self, token: 0.0)
    none = pagetext.Weights(page_weights.cost, dict.fromkeys(page_weights.odds, 0.0))
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert all(pagetext.main_text(h, page_weights) != pagetext.main_text(h, none) for h in pages)


def test_links_of_two_words_leave_without_labelled_pages():
    menu = "<div><a href=x>Home page</a> <a href=y>About us</a></div>"
    assert pagetext.main_text(f"<body>{menu}<h1>Head of</h1><p>{WORDS_40}</p>{menu}", pagetext.Weights({}, {})) == f"Head of\n\n{WORDS_40}"


def test_costs_end_a_region():
    page = "<div><p>one two three four<hr><hr><hr><p>five six"
    free, dear = ({"hr": c, "p": 0.02} for c in (0.1, 3.0))
    assert pagetext.main_text(page, pagetext.Weights(free, {})) == "one two three four\n\nfive six"
    assert pagetext.main_text(page, pagetext.Weights(dear, {})) == "one two three four"


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, "<div>" * 100_000 + "</p>" * 100_000, "<!--" * 250_000, "<script>" * 100_000, "<" * 1_000_000, "<p class='a b" * 80_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    pagetext.main_text(page, pagetext.Weights({}, {}))
    assert time.process_time() - began < 5


# 8 and 9


def repeats(tokens_by_row, length):
    """Brute force: covered positions per row."""
    times = Counter(t[i : i + length] for t in tokens_by_row for i in range(len(t) - length + 1))
    out = []
    for t in tokens_by_row:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def expect_bytes(some):
    data = [(t or "").encode() for _, t in some]
    for (d, _), b, gone in zip(some, data, repeats(data, 200)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield d, len(b), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])), sha(kept)


def expect_words(some):
    data = [tuple(split(t)) for _, t in some]
    for (d, _), ws, gone in zip(some, data, repeats(data, 35)):
        yield d, len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone) if not g).encode())


def test_byte_repeats(spark, sf, given_texts):
    same(queries.op8_byte_repeats(spark, sf), list(expect_bytes(given_texts)))


def test_word_repeats(spark, sf, given_texts):
    same(queries.op9_word_repeats(spark, sf), list(expect_words(given_texts)))


def test_word_repeats_equal_their_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    same(queries.op9_word_repeats(spark, sf), con.sql(queries.OP9_SQL).fetchall())


@pytest.mark.parametrize("large", [20_000, 2])
def test_byte_repeats_odd_texts(spark, docs, monkeypatch, large):
    from quire.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", large)
    same(bytedup.without_repeats(docs, large=large), list(expect_bytes([(r[0], r[1]) for r in rows()])))
    assert bytedup.without_repeats(nothing(spark)).count() == 0


@pytest.mark.parametrize("hot", [10_000, 1])
def test_word_repeats_odd_texts(spark, docs, monkeypatch, hot):
    from quire.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    same(worddup.without_repeats(docs), list(expect_words([(r[0], r[1]) for r in rows()])))
    assert worddup.without_repeats(nothing(spark)).count() == 0


def test_chunked_texts_give_the_same(spark, docs, monkeypatch):
    from quire.llm import windows

    monkeypatch.setattr(windows, "CHUNK", 300)  # of the driver only: the functions are called here
    tokens = worddup.word_tokens(" ".join(f"w{k % 97}" for k in range(2000)))
    assert len(tokens) == 2000
    seen = set()
    for _, first, part, bounds in windows.token_rows([tokens], 35):
        for s, c in zip(*windows.anchored_runs(part, bounds, 35, 5)[2:4]):
            seen |= set(range(first[0] + s, first[0] + s + c))
    assert seen == set(range(2000 - 34))


def test_merged_transforms_order_all_suffixes():
    r = random.Random(4)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(1, 60))).encode() for _ in range(25)]
    for length in (1, 3, 8):
        times = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        for s, own in zip(strings, bytedup.repeated_starts(strings, length, shard=100)):
            assert own.tolist() == [i for i in range(len(s) - length + 1) if times[s[i : i + length]] > 1]


# 10


def fingerprint(text):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = split(ws)
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps):
    """{doc_id: smallest reachable} by brute force over (doc_id, fingerprint)."""
    nodes = sorted({f for _, f in fps})
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for _, f in fps}


def expect_groups(some):
    fps = [(d, fingerprint(t)) for d, t in some]
    by = components(fps)
    return [(d, f"{f:016x}", by[f]) for d, f in fps]


def test_simhash(spark, sf, given_texts):
    same(queries.op10_simhash_groups(spark, sf), expect_groups(given_texts))


def test_simhash_odd_texts(spark, docs):
    same(simhash.near_duplicates(docs), expect_groups([(r[0], r[1]) for r in rows()]))
    assert simhash.near_duplicates(nothing(spark)).count() == 0


@pytest.mark.parametrize("cell", [2048, 12, 1])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, cell):
    from quire.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 4 if cell < 99 else 10_000)
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(6)}
    for _ in range(150):
        fps.add(r.choice(sorted(fps)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), cell=cell)
    got = simhash.components(edges).collect()
    by = components([(k, f) for k, f in enumerate(sorted(fps))])
    groups = defaultdict(set)
    for f, c in by.items():
        groups[c].add(f - (1 << 64) if f >> 63 else f)
    found = defaultdict(set)
    for node, root in got:
        found[root].add(node)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert all(min(g) == root for root, g in found.items())
