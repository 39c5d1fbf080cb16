"""Tables of empty texts alone, readers that need one column, columns that Spark can't hash, tables left by errors."""

import pytest
from pyspark.sql import functions as F

from quire.llm import bytedup, similar, topk, windows, worddup
from quire.llm.common import scratch, written

from .fixtures import SCHEMA


def empties(spark, some):
    return spark.createDataFrame([(k, t, "en", "s", 0, "w", "f", "0") for k, t in enumerate(some)], SCHEMA)


def test_powers_of_nothing(monkeypatch):
    monkeypatch.setattr(windows, "_powers", {})
    assert len(windows.powers(0)) == 0 and len(windows.powers(0, "down")) == 0
    assert windows.powers(3).tolist()[:2] == [1, windows.MULTIPLIER]


@pytest.mark.parametrize("some", [[None], [""], [" \n"], [None, "", "  \t"]])
def test_texts_without_a_token(spark, some):
    docs = empties(spark, some)
    assert [(r["n_removed"], r["n_spans"]) for r in bytedup.without_repeats(docs).collect()] == [(0, 0)] * len(some)
    assert [(r["n_words"], r["n_removed"]) for r in worddup.without_repeats(docs).collect()] == [(0, 0)] * len(some)
    assert sorted(map(str, (r["text"] for r in worddup.cut_texts(docs).collect()))) == sorted(map(str, some))


def test_results_of_a_search_can_be_counted(spark):
    vectors = spark.createDataFrame([(k, [k / 7, 1.0]) for k in range(120)], "vec_id long, embedding array<float>")
    found = topk.top_k(vectors)
    assert found.count() == 15 == found.select("score").count()
    assert found.groupBy("rank").count().count() == 5


def test_near_duplicates_with_a_map(spark):
    docs = empties(spark, ["a b c d e f g"] * 3 + ["x"]).withColumn("more", F.create_map(F.lit("k"), "doc_id"))
    assert sorted(r["doc_id"] for r in similar.keep_one(docs).collect()) == [0, 3]


def test_scratch_deletes_after_an_error(spark):
    kept = written(spark.range(3), "kept")
    with pytest.raises(ValueError):
        with scratch(spark):
            gone = written(spark.range(4), "gone")
            raise ValueError
    with scratch(spark):
        first, last = written(spark.range(5), "first"), written(spark.range(6), "last")
    assert kept.count() == 3 and last.count() == 6
    with pytest.raises(Exception):
        gone.count()
    with pytest.raises(Exception):
        first.count()
