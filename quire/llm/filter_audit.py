"""Operator 11: how the filters of a corpus interact, in every order.

A pass of the byte transducer of ``spans`` over each whole text counts words, capitals, code points and symbols and puts
the words into a verified hash table, which counts the different ones. A document's failures are a set of filters, a
number of five bits; the last filter, a copy of a smaller doc_id's text anywhere in the table, comes from an aggregation by the
text's SHA-256 digest. All orders, steps and Shapley shares then follow from the number of documents by part and set: the counts
that leave the tasks are pre-aggregated, a text's copies in a task are one row, and no order filters the documents again.

Null texts are empty: they fail A and no other filter but E. A null doc_id is neither smaller than another nor has smaller ones, so
its row never fails E. Repeated rows have one doc_id, so none of them fails E for the others; they count each. A doc_id's labels count as 1 where any row of ``labels`` says so. Long
texts are read whole, in chunks of 1 MB. Other columns are ignored; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import by_slice
from .spans import CAPITAL, GAP, INNER, SYMBOL, Table, Words, chunks, classes, raw_texts

FILTERS = "ABCDE"
WORDS, DIFFERENT, CAPITALS = 200, 50, 3
#: What separates words, what filter D looks for.
BLANK, SYMBOLS = b" \t\n\x0b\x0c\r", b"#$%&*|"
TABLE = classes(BLANK, SYMBOLS)
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")


def counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row for each text: words, different words, characters A-Z, code points, symbols."""
    out = np.zeros((len(bounds) - 1, 5), np.int64)
    words = Words(data)
    table = Table(words)

    def by_text(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, bounds))

    for at, kind, start, end in chunks(data, bounds, TABLE):
        owner = np.searchsorted(bounds, start, side="right") - 1
        table.insert(owner, words.hashes(start, end), start, end)
        marks = (start, *(at + np.flatnonzero(x) for x in (kind == CAPITAL, kind != INNER, kind == SYMBOL)))
        out[:, [0, 2, 3, 4]] += np.stack([by_text(m) for m in marks], 1)
    out[:, 1] = np.bincount(table.owner, minlength=len(out))
    return out


def failed(found: np.ndarray) -> np.ndarray:
    """The filters A to D that fail, as bits."""
    words, different, capitals, chars, symbols = found.T
    return (words < WORDS) * 1 + (100 * different < DIFFERENT * words) * 2 + (100 * capitals > CAPITALS * chars) * 4 + (symbols > 0) * 8


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, fails (bits of A to D) and the counts of every row of ``docs`` (doc_id, text, lang)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = raw_texts(batch.column("text"))
        found = counts(data, bounds)
        digest = [hashlib.sha256(data[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        columns = [batch.column("doc_id"), batch.column("part"), pa.array(digest, pa.binary()), pa.array(failed(found).astype(np.int32)), *(pa.array(c) for c in found.T)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "digest", "fails", *COUNTS])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(by_slice(run), f"doc_id {kind}, part string, digest binary, fails int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), n, good, toxic: documents by the set of filters that they fail."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = measured(docs).groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    # rows without a doc_id have no label: dealt by their digests, so that they don't meet in one task
    key = lambda spread: F.struct(F.col("doc_id").cast("bigint").alias("id"), spread.alias("spread")).alias("key")
    keyed = rows.select("*", key(F.when(F.col("doc_id").isNull(), F.xxhash64("digest"))))
    labelled = one.select(key(F.lit(None).cast("bigint")), "good", "toxic")
    joined = keyed.join(labelled, "key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # a text's rows by part and labels: how many, and of those how many have the smallest doc_id there
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = joined.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("nameless"))
    own = Window.partitionBy("digest")
    marked = texts.withColumn("smallest", F.min("first.doc_id").over(own))
    unique = F.coalesce(F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")), F.lit(0)) + F.coalesce("nameless", F.lit(0))
    both = F.array(F.struct(F.col("fails"), unique.alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - unique).alias("n")))
    split = marked.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.fails", "x.n").where("n > 0")
    return split.groupBy("part", "fails").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step of every order, from a row for each part and set of failures (``failure_counts``)."""
    sets = counted.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))  # 32 at most
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = sets.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda k: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substr("filter_order", k, F.lit(1))) - 1)
    through = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda acc, k: acc.bitwiseOR(bit(k)))
    rows = rows.withColumn("own", bit(F.col("step"))).withColumn("before", through - F.col("own"))

    def total(test, value):
        return F.aggregate("sets", F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(test(x), value(x)).otherwise(F.lit(0).cast("bigint")))

    fails = lambda x: x["fails"].bitwiseAND(F.col("own")) != 0
    earlier = lambda x: x["fails"].bitwiseAND(F.col("before")) != 0
    removed = lambda x: fails(x) & ~earlier(x)
    many = lambda x: F.bit_count(x["fails"]).cast("int")
    # a filter comes first among the failures of a document in an equal share of all orders
    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x) & ~earlier(x), lambda x: x["n"]).alias("kept"),
        total(removed, lambda x: x["n"]).alias("removed"),
        total(lambda x: fails(x) & earlier(x), lambda x: x["n"]).alias("redundant"),
        total(lambda x: x["fails"] == F.col("own"), lambda x: x["n"]).alias("unique_fails"),
        total(removed, lambda x: x["good"]).alias("good_lost"),
        total(removed, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: (x["n"] * len(orders) / many(x)).cast("bigint")).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failure_counts(docs, labels))
