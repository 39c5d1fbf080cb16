"""Operator 10: near-duplicate groups by SimHash, found through segment bit counts.

A text's fingerprint has a bit set where over half its shingles' hashes have it. Equal fingerprints are
one node. A fingerprint is mapped to the bit counts of its ``SEGMENTS`` segments; the Manhattan
distance of two such vectors never exceeds the number of differing bits. The grid join on it: the
vector is dealt into ``PARTS`` parts, and of two vectors at a distance of d at most, ``PARTS - d`` parts
are equal, so both meet in a cell named by these parts. In a cell, pairs are first held to the
Manhattan bound, then to the exact count of differing bits, block by block; only the links of a
spanning forest leave it. A cell of more than ``CELL`` different fingerprints is dealt again by the same rule, over
the segments that it leaves free. Fingerprints with equal counts in all but a few segments can still be
many: those of a cell that stays too large meet, by a Spark aggregation, at the values one bit away (two that
differ in two bits have such a value in common), which is exact and grows linearly.

Null and empty texts have fingerprint zero and link to each other as any others do; repeated rows stay. A null doc_id is never the smallest: a
component of such rows alone has a null component_id. Long texts are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slice, salted_join, texts, written
from .components import components

SHINGLE, DISTANCE, SEED = 3, 2, 42
SEGMENTS, PARTS, CELL = 32, 5, 2_048


def shingle_hashes(ws: list[bytes], size: int = SHINGLE) -> np.ndarray:
    if not ws:
        return np.zeros(0, np.uint64)
    hashed, n = xxhash.xxh64_intdigest, max(1, len(ws) - size + 1)
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[size - 1 :] if len(ws) >= size else ends[-1:]).tolist()
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half the hashes have set."""
    n = len(h)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        counts += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(ws: list[bytes], size: int = SHINGLE) -> int:
    return majority(shingle_hashes(ws, size))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed number) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.encode().lower().split(), size) for t in texts(batch)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(by_slice(run), f"doc_id {kind}, fp bigint")


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, two bits each."""
    low, high = (x.bitwiseAND(F.lit(0x5555555555555555)) for x in (fp, F.shiftrightunsigned(fp, 1)))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def part_masks(segments: list[int], distance: int) -> list[int]:
    """The segments dealt into ``PARTS`` parts: a signed mask for each choice of parts that ``distance`` differences leave equal."""
    parts = [sum(3 << 2 * int(s) for s in own) for own in np.array_split(np.array(segments), PARTS)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(parts, PARTS - distance))]


def cells(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, parts (the mask), cell: a row for each fingerprint and each choice of parts that may be equal."""
    keys = F.array(*[F.struct(F.lit(m).alias("parts"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell")) for m in part_masks(list(range(SEGMENTS)), distance)])
    return fps.withColumn("counts", segment_counts(F.col("fp"))).select("fp", F.explode(keys).alias("k")).select("fp", "k.parts", "k.cell")


def finer_cells(placed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows of ``cells`` dealt again over the segments that their masks leave free; ``parts`` and ``cell`` name both steps."""
    free = lambda m: [s for s in range(SEGMENTS) if not m >> 2 * s & 3]
    masks = F.create_map(*[F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for m in part_masks(list(range(SEGMENTS)), distance) for x in (m, [m | f for f in part_masks(free(m), distance)])])
    return placed.select("fp", "parts", F.explode(masks[F.col("parts")]).alias("mask")).select("fp", F.xxhash64("parts", "mask").alias("parts"), segment_counts(F.col("fp")).bitwiseAND(F.col("mask")).alias("cell"))


def spanning_links(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of pairs that differ in ``distance`` bits at most."""
    fp = np.sort(fp)
    bits = fp.view(np.uint64)
    low = np.uint64(0x5555555555555555)
    counts = np.stack([((bits & low) + ((bits >> np.uint64(1)) & low)) >> np.uint64(2 * s) & np.uint64(3) for s in range(SEGMENTS)], 1).astype(np.int8)
    root = list(range(len(fp)))
    links = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fp) - 1):
        near = np.arange(i + 1, len(fp))
        if len(near) > 16:
            near = near[np.abs(counts[i + 1 :] - counts[i]).sum(1, dtype=np.int16) <= distance]
        for j in near[np.bitwise_count(bits[near] ^ bits[i]) <= distance].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(fp[i]), int(fp[j])))
    return links


def links(fps: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``fps`` that differ in ``distance`` (2 at most) bits."""
    if distance not in (0, 2):
        raise ValueError("cells of many fingerprints are joined exactly for 0 and 2 bits only")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(spanning_links(rows["fp"].to_numpy(np.int64), distance), columns=["a", "b"], dtype="int64")

    step = cells(fps, distance)
    found, crowded = [], None
    for finer in (False, True):
        if finer:
            step = finer_cells(crowded, distance)
        sizes = written(step.groupBy("parts", "cell").agg(F.count("*").alias("n"), F.count("*").alias("size")).where("n > 1"), "sizes")
        met = written(salted_join(step, sizes, ["parts", "cell"], ["fp"]), "cells")
        found.append(met.where(F.col("size") <= cell).groupBy("parts", "cell").applyInPandas(compare, "a bigint, b bigint"))
        crowded = met.where(F.col("size") > cell).drop("size")
        if crowded.isEmpty():
            break
    else:
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
        value = F.array(F.col("fp")) if distance == 0 else F.concat(F.array("fp"), flips)
        near = crowded.select("fp").distinct().select("fp", F.explode(value).alias("near"))
        centre = written(near.groupBy("near").agg(F.count("*").alias("n"), F.min("fp").alias("b")).where("n > 1"), "near")
        found.append(salted_join(near, centre, ["near"], ["fp"]).select(F.col("fp").alias("a"), "b").where("a != b"))
    return reduce(DataFrame.union, found).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that can be reached) per row of ``docs``."""
    rows = written(fingerprints(docs, size), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    found = components(links(nodes.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = written(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    named = written(salted_join(placed.select("root", "fp", F.col("n").alias("rows")), least, ["root"], ["fp"]).select("fp", "component_id", F.col("rows").alias("n")), "named")
    return salted_join(rows, named, ["fp"], ["doc_id"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
