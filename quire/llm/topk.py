"""Operator 3: exact top-k inner-product search with MaxScore.

Vectors of integers are documents, their components the terms. For a query, the contribution of a term
to the score of a vector lies between a least and a greatest value of the shard; above the least it is
not negative, which gives MaxScore its bounds. Terms are taken by falling bound: those whose postings
alone can lift a vector over the k-th best score are essential and traversed; the others are probed
while a vector is still competitive (what it has, and the bounds of what is left, reach the threshold).

The quantized rows are written once. Candidates lie in shards of up to ``SHARD`` rows and queries in blocks of
up to ``BLOCK``; a task gets one of each, so that memory is bounded whatever the sizes, and the shards' best
k are merged with a window. Where products could pass 64 bits, a shard computes with whole numbers of any size.

Vectors that are null, hold a null or non-finite component, or have no vec_id take no part; a missing
component counts as 0. Every row stands for itself: a repeated row is a candidate for its copies, and each
row with a query's id gets its own ranks. Scores beyond 64 bits are ranked exactly and shown as the nearest long.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

SHARD, BLOCK = 32_768, 32_768
#: Candidates for which a shard of its own pays where there are idle cores.
FEW = 2_048
LONG = np.iinfo(np.int64)


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


def matrix(vectors, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), of 64-bit integers or, where these do not hold them, of Python's."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    out = np.floor(out * scale)
    if np.abs(out).max(initial=0) < 2.0**62:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out.tolist()], object)


def fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products of rows of a and b stay far from 64 bits."""
    most = lambda m: int(np.abs(m).max(initial=0))
    return a.dtype != object and b.dtype != object and 4 * a.shape[1] * most(a) * most(b) < 1 << 62


class Shard:
    """Postings of a shard, term by term, with the extremes of each term."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.keys, self.ids, self.terms = keys, ids, np.ascontiguousarray(rows.T)
        self.least, self.most = rows.min(0), rows.max(0)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best vectors (ties to smaller ids) whose key is not ``own``."""
        ends = np.stack([query * self.least, query * self.most])
        base, bound = ends.min(0), np.abs(ends[1] - ends[0])
        order = np.argsort(-bound, kind="stable")
        left = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # bound of the terms from here on
        floor = base.sum()
        alive = np.flatnonzero(self.keys != own)
        essential, threshold = len(order), None
        if len(alive) > 4 * k:  # a first threshold: exact scores of those that lead after the strongest terms
            lead = order[:4]
            rough = query[lead] @ self.terms[lead]
            some = alive[np.argpartition(-rough[alive], 4 * k)[: 4 * k]]
            threshold = np.sort(query @ self.terms[:, some])[-k]
            # Essential: the fewest strongest terms without which the others cannot reach the threshold.
            essential = min(int((floor + left >= threshold).sum()), len(order))
        gained, touched = np.zeros(len(self.ids), self.terms.dtype), np.zeros(len(self.ids), bool)
        for t in order[:essential]:
            value = self.terms[t] * query[t] - base[t]
            gained += value
            touched |= (value > 0).astype(bool)
        if essential < len(order):
            alive = alive[touched[alive]]
        gained = gained[alive]
        for n in range(essential, len(order)):
            keep = (floor + gained + left[n] >= threshold).astype(bool)
            alive, gained = alive[keep], gained[keep]
            gained = gained + self.terms[order[n]][alive] * query[order[n]] - base[order[n]]
        total = gained + floor
        if total.dtype == object:
            best = np.array(sorted(range(len(alive)), key=lambda i: (-total[i], self.ids[alive[i]]))[:k], np.int64)
        else:
            best = np.lexsort((self.ids[alive], -total))[:k]
        return alive[best], total[best]


def shown(score: int) -> tuple[int, str | None]:
    """A score as the nearest long and, where that is another number, a text that sorts as the score does."""
    if LONG.min <= score <= LONG.max:
        return int(score), None
    size = len(str(abs(score)))
    if score > 0:
        return LONG.max, f"1{size:06d}{score}"
    return LONG.min, f"0{999_999 - size:06d}" + "".join(str(9 - int(c)) for c in str(-score))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) whose id ``every`` divides, its k best others."""
    spark = vectors.sparkSession
    usable_rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = written(usable_rows.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.size("v")).alias("width")).first()
    width = max(size["width"] or 0, 1)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, blocks = max(1, -(-size["n"] // SHARD), min(spread, -(-size["n"] // FEW))), max(1, -(-size["q"] // BLOCK))
    everyone = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = F.xxhash64("key")
    candidates = rows.withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("int")).withColumn("block", everyone(blocks))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(hashed, F.lit(blocks)).cast("int")).withColumn("shard", everyone(shards))

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asked):
            mine, theirs = matrix(own["v"], width, scale), matrix(asked["v"], width, scale)
            if not fits(mine, theirs):
                mine, theirs = mine.astype(object), theirs.astype(object)
            shard = Shard(own["key"].to_numpy(np.int64), own["vec_id"].to_numpy(np.int64), mine)
            for key, query_id, q in zip(asked["key"], asked["vec_id"], theirs):
                at, scores = shard.search(key, q, k)
                found += [(key, query_id, vec_id, *shown(s)) for vec_id, s in zip(shard.ids[at].tolist(), scores.tolist())]
        return pd.DataFrame(found, columns=["key", "query_id", "vec_id", "score", "beyond"]).astype({"beyond": "object"})

    found = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(search, "key bigint, query_id bigint, vec_id bigint, score bigint, beyond string")
    found = written(found, "found")  # k rows for each query and shard; a reader that needs fewer columns must not prune those of the search
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
