"""Near-duplicate groups by SimHash and by the exact Jaccard similarity of word shingles: operator 10 where the limit is a similarity.

Texts of equal shingle sets are one node. The first links are operator 10's: nodes whose SimHash fingerprints (of their
sets) differ in 2 bits at most, from its grid join on segment bit counts under the Manhattan distance. Each is
compared by the whole shingle sets, so that no pair below the limit is linked.

64 SimHash bits do not tell all texts of a similarity of 0.8 from others: such pairs differ in 9 bits in the median
and in 14 at the 95th percentile, and a grid that holds 14 differing bits apart holds nothing apart. So the
candidates that SimHash leaves out come from MinHash: ``BANDS`` bands of ``ROWS`` minima, one of which two texts of a similarity of 0.8
have in common with a probability of 0.9995. They are compared by their whole sets, too.

The first of these candidates of a node are the pivots of its bands, one each, so their number grows linearly; a pivot whose nodes
SimHash has all linked is done. A pivot is the
node of the band whose own bands are the fullest: in a group of copies that is the text they were made from, or one
near it. Links to pivots make components. What is left are pairs of nodes below one pivot, in different components,
not both in the pivot's largest one. Two such sets are similar only if they share a shingle that the pivot lacks, or if
their sizes and common shingles with the pivot allow it without one (both are about the same part of the pivot). So these
pairs are found through the shingles outside the pivot, which are rare, and through the numbers; then all are compared
exactly. Nothing is capped: links that stay unchecked lie inside a component, and a group of many copies of one text
makes no pairs but those with its pivots.

Texts without words (null, empty, blank) have the same, empty set and are copies of each other. A null doc_id stands
behind all others. Repeated rows are one row; long texts are read whole; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import by_slice, salted, salted_join, texts, written
from .components import components
from .simhash import DISTANCE, SEED, links, majority
from .windows import CHUNK, Rolling, mix
from .worddup import word_tokens

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 6
#: Nodes of a band that one task pairs with each other at a time.
BLOCK = 2_000
_random = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32)
_band_factors = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted different 64-bit hashes of the shingles (fewer words: the whole sequence) of a text, A-Z in lower case."""
    tokens = word_tokens(text.encode().lower())
    n = len(tokens)
    if n < size:
        return mix(Rolling(tokens).raw(np.array([0]), np.array([n])) + np.uint64(n)) if n else tokens
    step = CHUNK - size + 1
    return np.unique(np.concatenate([Rolling(tokens[a : a + CHUNK]).fixed(size) for a in range(0, n - size + 1, step)]))


def node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; empty sets have none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 256):
        least = np.minimum(least, ((short[at : at + 256] ^ _random[0]) * (_random[1] | np.uint32(1))).min(0))
    return mix((least.reshape(BANDS, ROWS).astype(np.uint64) * _band_factors).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, node, the size of its set, its fingerprint and the band keys of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, size) for t in texts(batch)]
        nodes = np.array([node(s) for s in sets], np.uint64).view(np.int64)
        fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "n_shingles", "fp", "bands"])

    return rows.select("doc_id", "text_hash", "text").mapInArrow(by_slice(run), "doc_id bigint, text_hash bigint, node bigint, n_shingles bigint, fp bigint, bands array<bigint>")


def simhash_pairs(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (pivot, node) whose components are those of all nodes (node, n_shingles, fp) with fingerprints that differ in ``distance`` bits at most: operator 10's links, and one for each further node of a fingerprint."""
    known = nodes.where("n_shingles > 0").select("node", "fp")
    fps = written(known.groupBy("fp").agg(F.min("node").alias("pivot"), F.count("*").alias("n")), "fingerprints")
    equal = salted_join(known, written(fps.where("n > 1"), "equal"), ["fp"], ["node"]).where("node <> pivot").select("pivot", "node")
    near = links(fps.select("fp"), distance)  # a fingerprint has no more links than there are others within the distance
    near = near.join(fps.select(F.col("fp").alias("a"), "pivot"), "a").join(fps.select(F.col("fp").alias("b"), F.col("pivot").alias("node")), "b").select("pivot", "node")
    return equal.union(near).distinct()


def met_nodes(nodes: DataFrame) -> DataFrame:
    """A row for each node and band that it shares with another: node, n_shingles, band, in_band (nodes in the band), pivot."""
    keys = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = written(keys.groupBy("band").agg(F.count("*").alias("n"), F.count("*").alias("in_band")).where("n > 1"), "shared")
    met = written(salted_join(keys, shared, ["band"], ["node"]), "bands")
    crowd = met.groupBy("node").agg(F.sum("in_band").alias("crowd"))
    pivots = met.join(crowd, "node").groupBy("band").agg(F.max_by("node", F.struct("crowd", "node")).alias("pivot"), F.count("*").alias("n"))
    return written(salted_join(met, written(pivots, "pivots"), ["band"], ["node"]), "bands")


def first_pairs(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of each node with the pivots of its bands, but for pivots whose nodes are all in one component of ``roots`` (node, root)."""
    pairs = met.select("pivot", "node").distinct().join(roots, "node", "left").select("pivot", "node", F.coalesce("root", "node").alias("root"))
    pairs = written(pairs, "pairs")
    apart = pairs.groupBy("pivot").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("pivot", "n")
    return salted_join(pairs, written(apart, "apart"), ["pivot"], ["node"]).where("pivot <> node").select("pivot", "node")


def other_pairs(met: DataFrame, roots: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs of nodes below one pivot, in different components, that may be similar: ``known`` has each node's sizes and the shingles outside its pivot."""
    own = met.where("node = pivot").select("pivot", "node", F.col("n_shingles").alias("common"), F.lit(0).cast("bigint").alias("more"), F.lit(0).cast("bigint").alias("less")).distinct()
    below = known.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "common", F.size("outside").cast("bigint").alias("more"), (F.col("n_pivot") - F.col("common")).alias("less"))
    rows = below.union(own).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = rows.groupBy("pivot", "root").agg(F.count("*").alias("c"))
    largest = by_root.groupBy("pivot").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.count("*").alias("roots"), F.sum("c").alias("n")).where("roots > 1 AND n > 2").drop("roots")
    rows = written(salted_join(rows, written(largest.withColumn("below", F.col("n")), "largest"), ["pivot"], ["node"]), "rest")
    x, y, s = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}")), F.lit(similarity)
    side = lambda df, name, *keys: df.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in ("node", "root", "common", "more", "less")))
    apart = (x("root") != y("root")) & ((x("root") == F.col("largest")) | (x("node") < y("node")))
    size = x("common") + x("less")  # of the pivot

    # without a shingle outside the pivot in common: at best the smaller set's part of the pivot lies in the larger's
    alone = size - F.greatest(x("less"), y("less")) >= s * (size - F.least(x("less"), y("less")) + x("more") + y("more"))
    slim = rows.where(F.col("more") <= (1 / similarity - 1) * F.col("common")).withColumn("blocks", F.ceil(F.col("below") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    every = side(slim.select("*", block), "x", "pivot", "block")
    minor = side(slim.where("root <> largest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "y", "pivot", "block", "largest")
    parts = every.join(minor, ["pivot", "block"]).where(apart & alone)

    # with one: at best all outside shingles of one are the other's
    best = size - F.greatest(x("less"), y("less")) + F.least(x("more"), y("more")) >= s * (size - F.least(x("less"), y("less")) + F.greatest(x("more"), y("more")))
    outside = known.select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.explode("outside").alias("shingle")).join(rows, ["pivot", "node"])
    outside = written(outside, "outside")
    shared = outside.groupBy("pivot", "shingle").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").drop("low", "high")
    outside = written(salted_join(outside, written(shared, "shared"), ["pivot", "shingle"], ["node"]), "outside")
    some = side(outside, "x", "pivot", "shingle").join(side(outside.where("root <> largest"), "y", "pivot", "shingle", "largest"), ["pivot", "shingle"]).where(apart & best)
    return parts.union(some.select(parts.columns[0], F.lit(0).alias("block"), *parts.columns[2:])).select(y("node").alias("pivot"), x("node").alias("node")).distinct()


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (pivot, node) as (a, b) with ``sim``, the Jaccard similarity of their sets (node, hashes), n_pivot, common, and ``outside``, the shingles of b that a lacks.

    A pivot's set goes once to each task that has nodes of it, and is compared with theirs one by one."""
    counts = written(pairs.groupBy("pivot").agg(F.count("*").alias("n")), "pivots")
    dealt, held = salted(pairs, counts, ["pivot"], ["node"])
    members = dealt.join(sets, "node").select("pivot", "salt_", "node", "hashes")
    own = held.join(sets.withColumnRenamed("node", "pivot"), "pivot").select("pivot", "salt_", F.lit(None).cast("bigint").alias("node"), "hashes")
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches):
        pivot = hashes = None
        for batch in batches:
            found = []
            for p, n, h in zip(*(batch.column(c) for c in ("pivot", "node", "hashes"))):
                if not n.is_valid:
                    pivot, hashes = p.as_py(), np.frombuffer(h.as_buffer(), np.uint64)
                    continue
                other = np.frombuffer(h.as_buffer(), np.uint64)
                outside = np.setdiff1d(other, hashes, assume_unique=True)
                common = len(other) - len(outside)
                found.append((pivot, n.as_py(), common / (len(hashes) + len(outside)), len(hashes), common, outside.view(np.int64)))
            if found:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["a", "b", "sim", "n_pivot", "common", "outside"])

    ordered = members.union(own).repartition(spread, "pivot", "salt_").sortWithinPartitions("pivot", "salt_", F.asc_nulls_first("node"))
    return ordered.select("pivot", "node", "hashes").mapInArrow(compare, "a bigint, b bigint, sim double, n_pivot bigint, common bigint, outside array<bigint>")


def groups(rows: DataFrame, signed: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """node, root for the nodes that are linked, the components being those of SimHash's similar pairs and all similar pairs that share a band."""
    nodes = signed.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    met = met_nodes(nodes)
    alike = written(simhash_pairs(signed.select("node", "n_shingles", "fp").distinct()), "alike")
    asked = met.select("node").union(alike.select("node")).union(alike.select("pivot")).distinct()
    one = signed.join(asked, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, size) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([pa.array(np.array([node(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    texts_asked = rows.join(one, ["doc_id", "text_hash"], "left_semi").select("text").mapInArrow(by_slice(run), "node bigint, hashes binary")
    sets = written(texts_asked.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
    linked = components(similarities(alike, sets).where(F.col("sim") >= similarity).select("a", "b"))
    known = written(similarities(written(first_pairs(met, linked), "pairs"), sets), "known")
    near = known.where(F.col("sim") >= similarity).select("a", "b")
    first = components(near.union(linked))
    more = similarities(written(other_pairs(met, first, known, similarity), "pairs"), sets).where(F.col("sim") >= similarity)
    for side in ("a", "b"):  # links between the components of the first ones: a much smaller graph
        more = more.join(first.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    last = components(more.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    alone = last.join(first.select("node"), "node", "left_anti")
    joined = first.join(last.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return joined.union(alone.select("node", "root"))


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id (of equal ones the smallest hash), with all its columns."""
    numbered = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), numbered.alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    odd = [c for c, kind in docs.dtypes if re.search(r"\b(map|variant)\b", kind)]  # Spark hashes neither
    order = F.xxhash64(*(F.to_json(F.struct(f"row.`{c}`")) if c in odd else F.col(f"row.`{c}`") for c in docs.columns))
    signed = written(signatures(rows, size), "signatures")
    found = groups(rows, signed, size, similarity)
    nodes = signed.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    best = nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k")).select("k.*")
    kept = rows.select("row", "doc_id", "text_hash", order.alias("order_")).join(best, ["doc_id", "text_hash"], "left_semi")
    first = Window.partitionBy("doc_id", "text_hash").orderBy("order_")
    return kept.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
