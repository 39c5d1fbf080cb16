"""Operator 2: token ids in Parquet list columns.

Documents are dealt into ranges of ``doc_id``, encoded range by range and written in that order: file
k holds smaller ids than file k + 1. Ids are dictionary encoded (a vocabulary of 49k ids takes 16 bits
an id at most; where the dictionary gets too large, Parquet's second format falls back to delta
encoding). Row groups and pages have set sizes and page indexes, so a filter on ``doc_id`` reads a few
pages, and a query about lengths or offsets reads no ids.

Null texts count as empty; repeated rows each get their own place; null ``doc_id`` come first.
Long texts are encoded whole, each in one row; an empty table writes no ids and gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import by_slice, shared_dir, slices, texts
from .wordbpe import encoder

SCHEMA = "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, ids array<int>"
#: Fixed layout of the files: row groups of 32 MB, pages of 256 kB and 1,000 documents at most.
LAYOUT = {
    "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "1000",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of ``docs`` (doc_id, text; other columns are ignored) to ``path`` in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
    end = np.uint32(end_id).tobytes()

    def encode(batches):
        own, shard, start = encoder(vocabulary.value), TaskContext.get().partitionId(), 0
        for piece in slices(batches, "text"):
            ids = [own.encode(t) + end for t in texts(piece)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            flat = np.frombuffer(b"".join(ids), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + ends - n), pa.array(n), lists], ["doc_id", "shard", "start_in_shard", "n_tokens", "ids"])
            start += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, start_in_shard, n_tokens, start: no ids are read. ``start`` counts the ids of all documents before."""
    files = spark.read.schema(SCHEMA).parquet(path)
    return _placed(files.drop("ids"), files)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents with ``start`` and ids; a filter on doc_id is pushed down to row groups and pages."""
    files = spark.read.schema(SCHEMA).parquet(path)
    return _placed(files, files)


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """One row per written partition is summed up and broadcast: their number is the number of tasks that wrote."""
    totals = files.groupBy("shard").agg(F.max(F.col("start_in_shard") + F.col("n_tokens")).alias("total"))
    base = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("start_in_shard")).drop("base")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids that were read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids")
        flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def batches(them):
        yield from map(run, them)

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(batches, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write, read back, digest."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return digests(read_tokens(spark, path))
