"""Operator 9: words covered by a 35-word window that also starts elsewhere, by level-wise doubling.

Level one is the anchors of ``windows``, windows of ``BASE`` words: those that occur once can't be part
of a repeated window and go with all their text. Runs that occur twice as a whole are settled. In the
others, each window's part of twice the length around the anchor is counted; windows whose part occurs
in one run alone go, the others are extended to twice that length, and so on up to the full length.
Every level is a Spark aggregation by hash, pre-aggregated, with a semi join back.

Words are ``[^\\x20\\x09-\\x0D]+``, compared by 64-bit hashes. Null and empty texts have no words;
identical rows are copies of each other. A null doc_id is kept as it is. Long texts are hashed in chunks of 2**20 words that overlap by a window, up to 2**30 words (more is an
error); ``without_repeats`` ignores other columns, ``cut_texts`` keeps them; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, salted_join, texts, words, written
from .windows import CHUNK, Rolling, anchored_runs, covered, distinct_runs, find_runs, keyed, live_runs, mix, spans, token_rows, with_texts

LENGTH, BASE = 35, 5
_table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_space = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def word_tokens(text: str | bytes) -> np.ndarray:
    """A hash of each word."""
    data, out, at = text if isinstance(text, bytes) else text.encode(), [], 0
    while at < len(data):
        end = len(data)
        if end - at > CHUNK:  # cut at white space
            end = next((k for k in range(at + CHUNK, end) if _space[data[k]]), end)
        codes = np.frombuffer(data, np.uint8)[at:end]
        gap = _space[codes]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        out.append(mix(Rolling(_table[codes]).raw(starts, ends) + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def levels(length: int, base: int) -> list[int]:
    """Lengths after the anchor's: doubled up to the full length."""
    out = [base]
    while out[-1] < length:
        out.append(min(length, 2 * out[-1]))
    return out[1:]


def repeated_spans(docs: DataFrame, length: int = LENGTH, base: int = BASE) -> DataFrame:
    """text_key, text_tag, spans: where, in each text that has any, repeated windows start."""
    live = live_runs(find_runs(docs, word_tokens, length, base))
    runs = written(distinct_runs(live), "distinct")
    steps = levels(length, base)

    def extend(batch: pa.RecordBatch):
        """For each window of the wanted runs the hashes of its parts at every level."""
        out = []
        for text, wants in zip(texts(batch), batch.column("wants").to_pylist()):
            by_start = {w["start"]: w for w in wants}
            tokens = word_tokens(text)
            for _, first, part, bounds in token_rows([tokens], length):
                rolling, _, start, count, anchor, _, _ = anchored_runs(part, bounds, length, base)
                for s, c, p in zip(start.tolist(), count.tolist(), anchor.tolist()):
                    w = by_start.get(s + first[0])
                    if w is None or w["count"] != c:
                        continue
                    window = np.arange(s, s + c)
                    hashes = []
                    for n in steps:
                        q = np.maximum(window, p + base - n)
                        hashes.append(mix(rolling.raw(q, q + n) + np.uint64(n)).view(np.int64))
                    out.append((np.full(c, w["anchor"]), np.full(c, w["run"]), np.arange(c), *hashes))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64, copy=False)) for c in zip(*out)], ["anchor", "run", "window", *(f"part_{n}" for n in steps)]) if out else None

    wanted = runs.where("several").select("anchor", "run", "at", F.lit(False).alias("large"))
    schema = "anchor bigint, run bigint, window bigint, " + ", ".join(f"part_{n} bigint" for n in steps)
    left = written(with_texts(docs, wanted).mapInArrow(by_slice(extend), schema), "level")
    for n in steps:
        twice = written(left.groupBy("anchor", f"part_{n}").agg(F.count("*").alias("n"), F.min("run").alias("low"), F.max("run").alias("high")).where("low < high").drop("low", "high"), "twice")
        left = salted_join(left, twice, ["anchor", f"part_{n}"], ["run", "window"], "left_semi")
        if n != steps[-1]:
            left = written(left, "level")
    parts = left.select("anchor", "run", F.col("window").alias("first"), (F.col("window") + 1).alias("end"))
    return spans(live, runs, parts)


def _cut(docs: DataFrame, carried: list[str], row, fields: dict, length: int, **options) -> DataFrame:
    """``carried`` columns of every row, and ``row(text, words, kept words, spans)``."""
    found = repeated_spans(docs, length, **options)
    rows = keyed(docs, carried).join(found, ["text_key", "text_tag"], "left").select("row", "text", "spans")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, own in zip(texts(batch), batch.column("spans").to_pylist()):
            ws = words(text)
            kept = [w for w, gone in zip(ws, covered(len(ws), own, length).tolist()) if not gone] if own else ws
            out.append(row(text, ws, kept, own))
        return pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, t) for c, t in zip(zip(*out), fields.values()))], ["row", *fields])

    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'bigint'}" for n, t in fields.items())
    return rows.mapInArrow(by_slice(cut), f"row {rows.schema['row'].dataType.simpleString()}, {schema}")


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs``."""
    fields = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
    return _cut(docs, ["doc_id"], lambda _, ws, kept, own: (len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), fields, length, **options).select("row.doc_id", *fields)


def cut_texts(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with all its columns, each text that holds repeated windows replaced by its other words, joined by one space."""
    others = [c for c in docs.columns if c != "text"]
    marked = docs.withColumn("no_text_", F.col("text").isNull())
    rows = _cut(marked, [*others, "no_text_"], lambda text, ws, kept, own: (b" ".join(kept).decode() if own else text,), {"kept": pa.string()}, length, **options)
    return rows.select(*(F.when(~F.col("row.no_text_"), F.col("kept")).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
