"""Operator 7: best-fit packing of documents into sequences under several capacities.

Documents are encoded where they are read; only (doc_id, piece, start, length, crc32) goes on, about 40
bytes a piece. Pieces are dealt at random to groups of about ``GROUP`` pieces, and each group is packed
by itself in falling length: among the open sequences with room in every capacity (tokens, documents,
attention cost as the sum of squared lengths) the one with the largest weighted dot product of need and
room, or the smallest weighted norm of what remains, takes the piece. All three weigh alike by default: about 29 of
100 pieces then lie elsewhere than by tokens alone, in no more sequences. A group loses a sequence or two
at its end, some hundredths of a percent of the thousands that it fills.

Null texts count as empty (they still hold the end id); repeated rows are packed once each; longer texts are cut
into pieces; an empty table gives no rows; columns but doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, texts, written
from .wordbpe import encoder

#: Pieces that one task packs at a time.
GROUP = 32_768
#: Pieces of text that a worker keeps encoded: half of what token files keep, as other stages share the executor's memory.
KEPT = 200_000


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, longest: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids, cut into pieces of ``longest`` ids."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    end = np.uint32(end_id).tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rows = encoder(vocabulary.value, KEPT), []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            ids = own.encode(text) + end
            for k, at in enumerate(range(0, len(ids), 4 * longest)):
                part = ids[at : at + 4 * longest]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(by_slice(cut), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, weights=(1.0, 1.0, 1.0), by: str = "dot") -> tuple[np.ndarray, np.ndarray]:
    """For each piece its bin and its offset in it. No bin exceeds ``tokens``, ``documents`` pieces, or ``attention`` as the sum of squared lengths."""
    capacity = np.array([tokens, documents, attention], float)
    need = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1).astype(float)
    if len(need) and (need > capacity).any():
        raise ValueError("a piece alone exceeds a capacity")
    share, w = need / capacity, np.asarray(weights, float)
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min() if len(lengths) else 0
    room, ids, bins, made = np.empty((1024, 3)), np.empty(1024, np.int64), 0, 0
    for i in order:
        pick = -1
        if bins:
            left = room[:bins] - need[i]
            ok = np.flatnonzero(left.min(axis=1) >= 0)
            if len(ok):
                if by == "norm":
                    pick = ok[np.argmin(((left[ok] / capacity) ** 2) @ w)]
                else:
                    pick = ok[np.argmax((room[ok] / capacity) @ (w * share[i]))]
        if pick < 0:
            if bins == len(room):
                room, ids = np.concatenate([room, room]), np.concatenate([ids, ids])
            room[bins], ids[bins] = capacity, made
            pick, bins, made = bins, bins + 1, made + 1
        which[i], offset[i] = ids[pick], tokens - room[pick, 0]
        room[pick] -= need[i]
        if room[pick, 0] < least or room[pick, 1] < 1:  # nothing fits any more: the last open bin takes its place
            bins -= 1
            room[pick], ids[pick] = room[bins], ids[bins]
    return which, offset


def pack(pieces: DataFrame, tokens: int = 4096, documents: int | None = None, attention: int | None = None, weights=(1.0, 1.0, 1.0), by: str = "dot", group: int = GROUP) -> DataFrame:
    """``pieces`` (with a ``length`` of ``tokens`` at most) with ``sequence_id`` and ``offset``. Without them, the other two capacities are those that no full sequence exceeds."""
    documents, attention = documents or tokens, attention or tokens * tokens
    pieces = written(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group))
    names = pieces.columns

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
        which, offset = best_fit(rows["length"].to_numpy(np.int64), tokens, documents, attention, weights, by)
        return rows.assign(sequence_id=rows["packing_group"].astype(np.int64) * (1 << 32) + which, offset=offset)[[*names, "sequence_id", "offset"]]

    dealt = pieces.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("packing_group").applyInPandas(fill, schema)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tokens: int = 4096, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, tokenizer, end_id, tokens), tokens, **options)
