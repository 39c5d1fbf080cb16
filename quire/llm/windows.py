"""Windows of a fixed length that occur twice: the part that bytes (operator 8) and words (operator 9) share.

Every window belongs to its anchor, the base window inside it with the smallest hash (the leftmost of
equal ones), so equal windows have equal anchors at equal places. Consecutive windows with one anchor
make a run. Runs, not windows, are shuffled: there is one for every ``(length - base) / 2`` tokens.

A run whose anchor's hash occurs once in the corpus holds no repeated window. If the same run (by the
hashes of anchor and content, 128 bits together) occurs twice, all its windows are repeated. Different
runs of one anchor are left to the operator, one representative for each distinct run; however many
documents share a passage, equal runs are one. Sums by anchor and run are pre-aggregated in the tasks
that find them, and joins deal the rows of a hot anchor or run over many tasks, so a run shared by a third
of all documents doesn't gather anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, salted_join, texts, written

#: Tokens that are hashed at a time, places that an anchor's key can tell apart.
CHUNK, PLACES = 1 << 20, 22
RUNS = "anchor bigint, run bigint, text_key bigint, place bigint"
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, name: str = "up") -> np.ndarray:
    """The first n powers of the multiplier, or of its inverse, modulo 2**64."""
    if name not in _powers or len(_powers[name]) < n:
        base = MULTIPLIER if name == "up" else pow(MULTIPLIER, -1, 1 << 64)
        steps = np.full(max(n, CHUNK + 4096), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


class Rolling:
    """Hashes of any stretch of a row of 64-bit tokens, from sums of tokens times powers."""

    def __init__(self, tokens: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * powers(len(tokens)), dtype=np.uint64)])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(len(self.sums), "down")
        return (self.sums[end] - self.sums[start]) * back[start]

    def fixed(self, length: int) -> np.ndarray:
        """Of every stretch of ``length`` tokens."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * powers(len(self.sums), "down")[:n]) if n > 0 else np.zeros(0, np.uint64)


def anchored_runs(tokens: np.ndarray, bounds: np.ndarray, length: int, base: int):
    """Runs in a row of texts, whose borders are ``bounds`` (first 0, last the number of tokens).

    Gives a Rolling, and for each run: text, first window, number of windows, anchor's place, anchor's hash, run's hash."""
    rolling = Rolling(tokens)
    width = length - base + 1
    hashed = rolling.fixed(base)
    none = np.zeros(0, np.int64)
    n = len(hashed) - width + 1
    if n <= 0:
        return rolling, none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    low = np.uint64((1 << PLACES) - 1)
    key = (mix(hashed + np.uint64(1)) & ~low) | (np.arange(len(hashed), dtype=np.uint64) & low)
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: n], key[width - size : width - size + n])
    sizes = np.diff(bounds)
    inside = np.zeros(n, bool)
    for a, b in zip(bounds[:-1][sizes >= length].tolist(), (bounds[1:][sizes >= length] - length + 1).tolist()):
        inside[a:b] = True
    at = np.flatnonzero(inside)
    if not len(at):
        return rolling, none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = (key[at] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(first, len(at)))
    start, anchor = at[first], anchor[first]
    run = mix(rolling.raw(start, start + count + length - 1) + (count.astype(np.uint64) << np.uint64(40)))
    return rolling, np.searchsorted(bounds, start, side="right") - 1, start, count, anchor, hashed[anchor], run


def token_rows(rows: list[np.ndarray], length: int):
    """Texts as rows of tokens, joined, in chunks of bounded size: (text of each, first token of each in its text, tokens, bounds)."""
    held, which, first, size = [], [], [], 0
    for k, tokens in enumerate(rows):
        for a in range(0, max(1, len(tokens) - length + 1), CHUNK - length + 1) if len(tokens) > CHUNK else (0,):
            part = tokens[a : a + CHUNK] if len(tokens) > CHUNK else tokens
            if size and size + len(part) > CHUNK:
                yield which, first, np.concatenate(held), np.cumsum([0, *map(len, held)])
                held, which, first, size = [], [], [], 0
            held.append(part)
            which.append(k)
            first.append(a)
            size += len(part)
    if held:
        yield which, first, np.concatenate(held), np.cumsum([0, *map(len, held)])


def keyed(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """row (a struct of ``carried`` columns), text and 64 + 24 bits of the text's hashes: which windows repeat depends on the text alone."""
    rows = docs.select(F.struct(*(carried or ["doc_id"])).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"text_key": F.xxhash64("text"), "text_tag": F.hash("text").bitwiseAND(F.lit(0xFFFFFF))})


def place(tag, start, count):
    """One number for a text's tag (24 bits), a run's first window (30 bits) and its number of windows (9 bits)."""
    if len(start) and (int(start.max()) >> 30 or int(count.max()) >> 9):
        raise ValueError("a text of 2**30 tokens or a run of 512 windows has no place")
    return tag | (start << 24) | (count << 54)


def find_runs(docs: DataFrame, tokens_of, length: int, base: int) -> DataFrame:
    """The runs of all texts, a row each."""

    def run(batch: pa.RecordBatch):
        keys, tags = (batch.column(c).to_numpy() for c in ("text_key", "text_tag"))
        out = []
        for which, first, tokens, bounds in token_rows([tokens_of(t) for t in texts(batch)], length):
            _, text, start, count, _, anchor, own = anchored_runs(tokens, bounds, length, base)
            k = np.asarray(which)[text] if len(text) else text
            out.append((anchor, own, keys[k], place(tags[k].astype(np.int64), start - bounds[text] + np.asarray(first)[text] if len(text) else start, count)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64, copy=False).view(np.int64)) for c in zip(*out)], ["anchor", "run", "text_key", "place"]) if out else None

    return keyed(docs).select("text_key", "text_tag", "text").mapInArrow(by_slice(run), RUNS)


def live_runs(runs: DataFrame) -> DataFrame:
    """Of the runs, those whose anchor occurs twice, with ``several`` where it has different runs; written."""
    anchors = written(runs.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("run") != F.max("run")).alias("several")).where("n > 1"), "anchors")
    return written(salted_join(runs, anchors, ["anchor"], ["text_key", "place"]), "runs")


def distinct_runs(live: DataFrame) -> DataFrame:
    """A row for each distinct run, with its number and one place of it; a text's copies count, but have one place."""
    return live.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.first("several").alias("several"), F.min(F.struct("text_key", "place")).alias("at"))


def start_of(place_) -> F.Column:
    return F.shiftright(place_, 24).bitwiseAND(F.lit((1 << 30) - 1))


def count_of(place_) -> F.Column:
    return F.shiftrightunsigned(place_, 54)


def tag_of(place_) -> F.Column:
    return place_.bitwiseAND(F.lit(0xFFFFFF)).cast("int")


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text for each of ``wanted`` (anchor, run, at) with the list of what is wanted of it."""
    by_text = wanted.select(F.col("at.text_key").alias("text_key"), tag_of(F.col("at.place")).alias("text_tag"), F.struct(start_of(F.col("at.place")).alias("start"), count_of(F.col("at.place")).alias("count"), "anchor", "run", "large").alias("want"))
    lists = by_text.groupBy("text_key", "text_tag").agg(F.collect_list("want").alias("wants"))
    one = keyed(docs).select("text_key", "text_tag", "text").dropDuplicates(["text_key", "text_tag"])
    return one.join(lists, ["text_key", "text_tag"]).select("text", "wants")


def spans(live: DataFrame, runs: DataFrame, parts: DataFrame) -> DataFrame:
    """text_key, text_tag, spans (first, end of repeated windows' starts).

    Of runs that occur twice (``n`` of ``runs``, written) every window is repeated, wherever they are; of those that occur once the ``parts`` (anchor, run, first, end)."""
    twice = runs.where("n > 1").select("anchor", "run", "n")
    begin = start_of(F.col("place"))
    rows = salted_join(live, twice, ["anchor", "run"], ["text_key", "place"]).select("text_key", "place", begin.alias("first"), (begin + count_of(F.col("place"))).alias("end"))
    once = runs.where("n = 1").select("anchor", "run", "at.text_key", "at.place").join(parts, ["anchor", "run"])
    more = once.select("text_key", "place", (begin + F.col("first")).alias("first"), (begin + F.col("end")).alias("end"))
    return rows.union(more).groupBy("text_key", tag_of(F.col("place")).alias("text_tag")).agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def covered(n: int, found, length: int) -> np.ndarray:
    """Which of n tokens lie in a window that starts in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    for s in found or ():
        edge[s["first"]] += 1
        edge[s["end"] + length - 1] -= 1
    return np.cumsum(edge[:n]) > 0
