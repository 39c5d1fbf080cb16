"""Operator 13: ranked lexical search, term at a time with a limit on accumulators.

Every item of a query table is matched against all documents. One pass over the texts (the byte transducer and hash table of
``spans``) leaves a compact index, written where it was made: a row for each document with its length and its frequencies of the terms
that some item may ask for. These are told by a bitmap of fixed size, so what is broadcast doesn't grow with the queries. The
index gives the number of documents, the number of terms and each term's document frequency, pre-aggregated in the tasks.

The items, in blocks of bounded size, then go to the tasks that read the index. A task takes documents in shards and turns each shard
into postings. An item's terms are taken rarest first. As long as the terms that are left could lift a new document to the k-th best
partial score, every document of a posting list gets an accumulator; from then on none is created, the surviving ones are updated
exactly, by looking their documents up in the longer lists, and those that can't reach the k-th best go. The k-th best score of earlier
shards of the task holds for later ones. Scores are whole numbers, so bounds are exact, and a document that ties is never lost. A task
sends on k rows for each item at most, which a window merges. Terms are compared by 64-bit hashes.

Null texts, and texts without a term, are no documents and match nothing; an item without a term has no rows. Every row stands for
itself: repeated rows of documents are ranked beside each other, repeated items get their own ranks. A null doc_id stands behind all others of its score,
a null item_id is an item. Long texts are read whole, in chunks of 1 MB; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import slices, written
from .spans import Table, Words, chunks, classes, raw_texts

#: Bits of the bitmap of asked terms; documents of a shard; items and different terms of a block (one larger item makes a block of its own).
BITS, SHARD, BLOCK, BLOCK_TERMS = 24, 16_384, 4_096, 1 << 18
#: What separates terms, and the numbers of the score.
BREAKS = bytes(c for c in range(128) if not chr(c).isalnum())
SCALE, SHIFT, RISE, LENGTH = 1_000_000_000, 1000, 8, 75
TABLE = classes(BREAKS)
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
INDEX = "doc_id bigint, n bigint, terms array<bigint>, tf array<bigint>"


def term_counts(data: np.ndarray, bounds: np.ndarray, asked: np.ndarray | None = None):
    """For each text the number of its terms, with repeats; and, by text, the different terms' hashes and frequencies (text, term, tf): all, or those whose bit of ``asked`` is set."""
    data = _lower[data]
    words, n = Words(data), np.zeros(len(bounds) - 1, np.int64)
    table, times = Table(words), np.zeros(0, np.int64)
    for _, _, start, end in chunks(data, bounds, TABLE):
        n += np.diff(np.searchsorted(start, bounds))
        hashed = words.hashes(start, end)
        if asked is not None:
            some = bit_of(asked, hashed)
            start, end, hashed = start[some], end[some], hashed[some]
        entry = table.insert(np.searchsorted(bounds, start, side="right") - 1, hashed, start, end)
        times = np.concatenate([times, np.zeros(len(table.owner) - len(times), np.int64)])
        times += np.bincount(entry, minlength=len(times))
    order = np.argsort(table.owner, kind="stable")
    return n, table.owner[order], table.hash[order].view(np.int64), times[order]


def bit_of(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    place = hashed >> np.uint64(64 - BITS)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def asked_terms(items: DataFrame) -> DataFrame:
    """key (of the row), item_id, terms, tf of every item that has a term."""

    def run(batches):
        for batch in batches:
            for piece in slices([batch], "text"):
                n, owner, terms, tf = term_counts(*raw_texts(piece.column("text")))
                yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("item_id"), lists(owner, terms, len(n)), lists(owner, tf, len(n))], ["key", "item_id", "terms", "tf"])

    rows = items.select(F.monotonically_increasing_id().alias("key"), F.col("item_id").cast("bigint").alias("item_id"), "text")
    return rows.mapInArrow(run, "key bigint, item_id bigint, terms array<bigint>, tf array<bigint>").where(F.size("terms") > 0)


def bitmap(terms: DataFrame) -> np.ndarray:
    """The bitmap of the first ``BITS`` bits of the terms: 4 KB for each 32,768 bits, put together by Spark."""
    bit = F.shiftrightunsigned("term", 64 - BITS)
    parts = terms.select(bit.alias("bit")).groupBy((F.col("bit").bitwiseAND(F.lit(~32767))).alias("first")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("part"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in parts.toLocalIterator():
        at = r["first"] >> 3
        out[at : at + 4096] = np.frombuffer(bytes(r["part"]), np.uint8)
    return out


def index_of(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """doc_id, n, terms, tf of every document that has a term; written by the tasks that read the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for piece in slices(batches, "text"):
            n, owner, terms, tf = term_counts(*raw_texts(piece.column("text")), sent.value)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), lists(owner, terms, len(n)), lists(owner, tf, len(n))], ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, INDEX)
    return written(rows.where("n > 0"), "index")


class Items:
    """A block of items: their terms, rarest first, with the number of times each is asked for."""

    def __init__(self, rows: list, terms: np.ndarray, weights: np.ndarray):
        self.terms, self.weights = terms, weights
        self.keys = np.array([r["key"] for r in rows], np.int64)
        self.ids = [r["item_id"] for r in rows]
        self.asked = []
        for r in rows:
            place = np.searchsorted(terms, np.array(r["terms"], np.int64))
            times = np.array(r["tf"], np.int64)
            order = np.lexsort((place, -weights[place]))
            self.asked.append((place[order], times[order]))


def postings(block: Items, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, norm: np.ndarray):
    """Of a shard's documents (``sizes``: how many terms each) the postings by term of the block: first of each term, document, part of the score for one time asked."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.minimum(np.searchsorted(block.terms, terms), len(block.terms) - 1)
    here = np.flatnonzero(block.terms[place] == terms)
    here = here[np.argsort(place[here], kind="stable")]
    place, doc, tf = place[here], doc[here], tf[here]
    part = block.weights[place] * ((SCALE * tf) // (SHIFT * tf + RISE * norm[doc]))
    return np.searchsorted(place, np.arange(len(block.terms) + 1)), doc, part


def search(place: np.ndarray, times: np.ndarray, first: np.ndarray, doc: np.ndarray, part: np.ndarray, most: np.ndarray, n: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores among which are the k best of the shard with ``least`` or more, and how many accumulators were made.

    ``most`` is each term's greatest part; ``least`` a score that k documents of other shards have."""
    bound = most[place] * times
    left = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what the terms from here on can add
    score, alive, threshold, made = np.zeros(n, np.int64), None, least, 0
    for j, (t, many) in enumerate(zip(place.tolist(), times.tolist())):
        a, b = first[t], first[t + 1]
        if alive is None and left[j] < threshold:
            alive = np.flatnonzero(score)
            made = len(alive)
        if alive is None:
            score[doc[a:b]] += part[a:b] * many
            if b > a:
                some = score[score > 0]
                if len(some) >= k:
                    threshold = max(threshold, int(np.partition(some, len(some) - k)[-k]))
            continue
        alive = alive[score[alive] + left[j] >= threshold]
        if not len(alive):
            break
        if b - a:
            at = np.minimum(a + np.searchsorted(doc[a:b], alive), b - 1)
            hit = doc[at] == alive
            score[alive[hit]] += part[at[hit]] * many
            if len(alive) >= k:
                own = score[alive]
                threshold = max(threshold, int(np.partition(own, len(own) - k)[-k]))
    if alive is None:
        alive = np.flatnonzero(score)
        made = len(alive)
    alive = alive[score[alive] >= max(threshold, 1)]
    return alive, score[alive], made


def best_of(index: DataFrame, block: Items, n_docs: int, n_terms: int, k: int, shard: int) -> DataFrame:
    """key, item_id, doc_id, score: of each task's documents the k best for every item of the block."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        items = sent.value
        held: list[list[tuple[int, bool, int]]] = [[] for _ in items.keys]  # (-score, no doc_id, doc_id), best first

        def take(ids, n, sizes, terms, tf):
            norm = 100 - LENGTH + (LENGTH * n * n_docs // n_terms if LENGTH * int(n.max()) * n_docs < 1 << 63 else np.array([LENGTH * int(x) * n_docs // n_terms for x in n], np.int64))
            first, doc, part = postings(items, sizes, terms, tf, norm)
            most = np.zeros(len(items.terms), np.int64)
            some = np.flatnonzero(np.diff(first))
            most[some] = np.maximum.reduceat(part, first[some]) if len(some) else 0
            for j, (place, times) in enumerate(items.asked):
                own = held[j]
                alive, score, _ = search(place, times, first, doc, part, most, len(n), k, -own[-1][0] if len(own) == k else 0)
                if len(alive):
                    held[j] = sorted(own + [(-s, ids[d] is None, ids[d] or 0) for d, s in zip(alive.tolist(), score.tolist())])[:k]

        rows, size = [], 0

        def flush():
            ids, n, sizes, terms, tf = zip(*rows)
            take([x for own in ids for x in own], *(np.concatenate(c) for c in (n, sizes, terms, tf)))

        for batch in batches:
            for at in range(0, batch.num_rows, shard):
                piece = batch.slice(at, shard)
                terms, tf = piece.column("terms"), piece.column("tf")
                rows.append((piece.column("doc_id").to_pylist(), piece.column("n").to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), tf.flatten().to_numpy()))
                size += piece.num_rows
                if size >= shard:
                    flush()
                    rows, size = [], 0
        if rows:
            flush()
        out = [(key, item, None if none else d, -s) for key, item, own in zip(items.keys.tolist(), items.ids, held) for s, none, d in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "item_id", "doc_id", "score"])

    return index.select("doc_id", "n", "terms", "tf").mapInArrow(run, "key bigint, item_id bigint, doc_id bigint, score bigint")


def blocks(asked: DataFrame) -> list[DataFrame]:
    """The items in blocks: as many as hold ``BLOCK`` items and ``BLOCK_TERMS`` terms on average, by a hash of the key, halved until none holds twice as much (or it is one item)."""
    total = asked.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    many = max(1, -(-total["n"] // BLOCK), -(-(total["terms"] or 0) // BLOCK_TERMS))
    while True:
        block = F.pmod(F.xxhash64("key"), F.lit(many))
        sizes = asked.groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms"))
        if sizes.where((F.col("n") > 1) & ((F.col("n") > 2 * BLOCK) | (F.col("terms") > 2 * BLOCK_TERMS))).isEmpty():
            return [asked.where(block == b) for b in range(many)] if total["n"] else []
        many *= 2


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text) its k best of ``docs`` (doc_id, text) with a score above 0."""
    asked = written(asked_terms(items), "items")
    terms = asked.select(F.explode("terms").alias("term"))
    index = index_of(docs, bitmap(terms))
    sums = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"]
    shape = "key bigint, item_id bigint, doc_id bigint, score bigint"
    if not n_docs:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    frequencies = written(index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("bigint")
    found = []
    for block in blocks(asked):
        items_here = block.collect()
        if not items_here:
            continue
        own = block.select(F.explode("terms").alias("term")).distinct().join(frequencies, "term", "left")
        known = own.select("term", F.coalesce(weight, F.lit(0)).alias("weight")).orderBy("term").toPandas()
        found.append(best_of(index, Items(items_here, known["term"].to_numpy(np.int64), known["weight"].to_numpy(np.int64)), n_docs, n_terms, k, shard))
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rows = written(reduce(DataFrame.union, found), "found") if found else docs.sparkSession.createDataFrame([], shape)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
