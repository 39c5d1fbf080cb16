"""Operator 8: bytes covered by a 200-byte string that also starts elsewhere, by merging Burrows-Wheeler transforms.

``windows`` finds the runs of windows that can repeat; runs that occur twice are settled there. What is
left, different runs of one anchor, is dealt by anchor to tasks. A task takes them in batches, cuts
each batch into shards and sorts the suffixes of every shard for itself, which gives its transform; a
symbol is 25 bytes, so that 200 bytes are 8 symbols. The transforms are merged by interleave
refinement: the interleave starts shard after shard; a round puts each place behind the symbol before
it, stably, so that after h rounds suffixes are ordered by their first h symbols. Borders between
blocks of equal prefixes come with each round, and a block of two or more without a border after the
last round is an interval of a repeated string. No suffix of the merged text is sorted again.

An anchor with more than ``LARGE`` different runs is not given to one task: the hashes of its windows
are counted by Spark instead, pre-aggregated. Matches never cross documents; null and empty texts
count as empty; identical rows are copies of each other. A null doc_id is kept as it is. Long texts are hashed in chunks of 2**20 bytes that overlap by a
window, up to 2**30 bytes (more is an error); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, salted_join, texts, written
from .windows import Rolling, covered, distinct_runs, find_runs, keyed, live_runs, mix, spans, with_texts

LENGTH, BASE = 200, 32
LARGE, BATCH, SHARD = 20_000, 1 << 20, 1 << 18
_table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_tokens(text: str) -> np.ndarray:
    return _table[np.frombuffer(text.encode(), np.uint8)]


def step_of(length: int) -> int:
    """Bytes to a symbol: the largest divisor of the length up to 25."""
    return max(k for k in range(1, 26) if length % k == 0)


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """A stable sort, as one or two radix passes."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if len(symbols) and int(symbols.max()) > 0xFFFF:
        order = order[np.argsort((symbols[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def named(strings: list[bytes], step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings behind each other, each with an end mark: string and offset of each place, and the name (from 1) of the ``step`` bytes at it; 0 where fewer are left."""
    sizes = np.array([len(s) + 1 for s in strings])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    string = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(data)) - starts[string]
    name = np.zeros(len(data), np.int64)
    full = np.flatnonzero(offset + step < sizes[string])
    name[full] = np.unique(Rolling(_table[data]).fixed(step)[full], return_inverse=True)[1] + 1
    return string, offset, name


def shard_transform(string: np.ndarray, offset: np.ndarray, name: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of a shard in the order of the first ``length`` bytes that follow them, the symbol before each (0: fewer than ``step`` bytes), and the number of short suffixes.

    Suffixes shorter than a symbol are in no repeated string: they come first, each different from all."""
    short = np.flatnonzero(name == 0)
    rank = name + len(short)
    rank[short] = np.arange(len(short))
    h = step
    while h < length:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-h] = rank[h:]
        ahead[rank < len(short)] = 0  # settled, whatever follows
        rank = np.unique(rank * (ahead.max(initial=0) + 1) + ahead, return_inverse=True)[1]
        h *= 2
    order = np.argsort(rank, kind="stable")
    before = np.zeros(len(name), np.int64)
    before[step:] = name[:-step]
    before[offset < step] = 0
    return order, before[order], len(short)


def merge_transforms(shards: list[np.ndarray], short: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave (shard of each place) of the merged transform and, for each place, whether its first ``rounds`` symbols differ from those of the place before.

    ``shards``: the symbol before each of a shard's sorted suffixes (0: none). ``short``: how many of each shard's first places are short suffixes."""
    first = np.concatenate([np.full(n, k, np.int16) for k, n in enumerate(short)])
    interleave = np.concatenate([np.full(len(s), k, np.int16) for k, s in enumerate(shards)])
    n, m = len(interleave), len(first)
    border = np.zeros(n, bool)
    border[0] = True
    for _ in range(rounds):
        symbol = np.empty(n, np.int64)
        for k, s in enumerate(shards):
            symbol[interleave == k] = s
        block = np.cumsum(border)
        order = stable_order(symbol)[m:]  # places with no symbol before them give way to the short suffixes
        last, own = symbol[order], block[order]
        border = np.concatenate([np.ones(m, bool), np.ones(1, bool)[: n - m], (last[1:] != last[:-1]) | (own[1:] != own[:-1])])
        interleave = np.concatenate([first, interleave[order]])
    return interleave, border


def repeated_starts(strings: list[bytes], length: int = LENGTH, shard: int = SHARD) -> list[np.ndarray]:
    """For each string the offsets at which a string of ``length`` bytes starts that also starts elsewhere among them."""
    step = step_of(length)
    string, offset, name = named(strings, step)
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes)
    cuts = [0, *(int(x) for x in np.unique(ends[np.searchsorted(ends, np.arange(shard, ends[-1] + shard, shard)).clip(max=len(ends) - 1)]))]
    parts = [shard_transform(string[a:b], offset[a:b], name[a:b], length, step) for a, b in zip(cuts, cuts[1:])]
    interleave, border = merge_transforms([p[1] for p in parts], [p[2] for p in parts], length // step)
    alone = border & np.append(border[1:], True)
    places = np.concatenate([order[~alone[interleave == j]] + a for j, ((order, _, _), a) in enumerate(zip(parts, cuts))])
    places.sort()
    found = [np.zeros(0, np.int64)] * len(strings)
    for k, own in zip(*_grouped(string[places], offset[places])):
        found[k] = own
    return found


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return (keys[np.concatenate([[0], cuts])].tolist(), np.split(values, cuts)) if len(keys) else ([], [])


def _ranges(offsets: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(offsets) > 1) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(offsets, cuts)] if len(offsets) else []


def repeated_spans(docs: DataFrame, length: int = LENGTH, base: int = BASE, large: int = LARGE) -> DataFrame:
    """text_key, text_tag, spans: where, in each text that has any, repeated strings start."""
    live = live_runs(find_runs(docs, byte_tokens, length, base))
    runs = written(distinct_runs(live), "distinct")
    sizes = runs.where("several").groupBy("anchor").agg((F.count("*") > large).alias("large"))
    wanted = runs.join(sizes, "anchor").select("anchor", "run", "at", "large")

    def cut(batch: pa.RecordBatch):
        rows = []
        for text, wants in zip(texts(batch), batch.column("wants").to_pylist()):
            data = text.encode()
            for w in wants:
                part = data[w["start"] : w["start"] + w["count"] + length - 1]
                hashes = window_hashes(part) if w["large"] else None
                rows.append((w["anchor"], w["run"], None if w["large"] else part, hashes))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], ["anchor", "run", "part", "hashes"]) if rows else None

    def window_hashes(part: bytes) -> list[int]:
        return Rolling(_table[np.frombuffer(part, np.uint8)]).fixed(length).view(np.int64).tolist()

    parts = written(with_texts(docs, wanted).mapInArrow(by_slice(cut), "anchor bigint, run bigint, part binary, hashes array<bigint>"), "parts")

    def settle(batches):
        """Batches end where an anchor does."""
        held, size, last = [], 0, None

        def flush():
            rows = [(a, r, *x) for (a, r, _), own in zip(held, repeated_starts([h[2] for h in held], length)) for x in _ranges(own)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["anchor", "run", "first", "end"]) if rows else None

        for batch in batches:
            for a, r, part in zip(*(batch.column(c).to_pylist() for c in ("anchor", "run", "part"))):
                if size >= BATCH and a != last:
                    if (out := flush()) is not None:
                        yield out
                    held, size = [], 0
                held.append((a, r, part))
                size, last = size + len(part), a
        if held and (out := flush()) is not None:
            yield out

    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = parts.where("part is not null").select("anchor", "run", "part").repartition(spread, "anchor").sortWithinPartitions("anchor", "run").mapInArrow(settle, "anchor bigint, run bigint, first bigint, end bigint")
    hot = parts.where("part is null").select("anchor", "run", F.posexplode("hashes").alias("first", "window"))
    twice = written(hot.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("run").alias("low"), F.max("run").alias("high")).where("low < high").drop("low", "high"), "twice")
    counted = salted_join(hot, twice, ["anchor", "window"], ["run"]).select("anchor", "run", F.col("first").cast("bigint").alias("first"), (F.col("first") + 1).cast("bigint").alias("end"))
    return spans(live, runs, merged.union(counted))


def without_repeats(docs: DataFrame, length: int = LENGTH, texts_too: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes, with ``texts_too``) per row of ``docs``."""
    found = repeated_spans(docs, length, **options)
    rows = keyed(docs).join(found, ["text_key", "text_tag"], "left").select("row.doc_id", "text", "spans")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, own in zip(texts(batch), batch.column("spans").to_pylist()):
            data = text.encode()
            gone = covered(len(data), own, length) if own else np.zeros(0, bool)
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if own else data
            starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((len(data), len(data) - len(kept), starts, hashlib.sha256(kept).hexdigest(), *([kept] if texts_too else [])))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts_too else [])])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(by_slice(cut), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts_too)
