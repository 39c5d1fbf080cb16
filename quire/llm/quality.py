"""Operator 5: quality rules, with a linear-chain conditional random field over lines.

Base rules count words, symbols, repeated lines and repeated three-word windows of the whole text. The
lines of a text that passes them are then labelled content or boilerplate by Viterbi decoding; a text is
kept if at least ``SHARE`` of the code points of its words lie in content lines. Weights are learned by
gradient ascent on the log likelihood (forward-backward) from a bounded sample of labelled documents,
whose lines take their document's quality as label, joined in pairs of both labels, starting from and held near a fixed prior.

Null and empty texts have no words and fail; ties go to content. Repeated rows are judged once each and all
kept or all rejected; long texts are judged whole; an empty table gives no rows. Labels of a document that
contradict each other count as bad. ``judged`` ignores extra columns, ``keep_good`` keeps them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, texts

SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
MIN_WORDS, REPEATED, SHARE = 50, 0.5, 0.5
#: Bound of the training sample: about so many documents of each label, chosen by a hash of doc_id.
PER_LABEL, STEPS, RATE, NEAR = 300, 30, 0.5, 0.02
FEATURES = ("bias", "symbols", "many_symbols", "shouts", "marks", "stutters", "repeats", "plain_end", "short")
#: Fixed prior: weight of each feature for the label content, less that for boilerplate; and of two equal neighbours.
PRIOR, PRIOR_STAY = np.array([1.0, -2.0, -2.0, -1.5, -1.5, -2.5, -2.0, 1.0, 0.0]), 1.0


def base_counts(ws: list[bytes], data: bytes) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = sum(map(len, ws))
    if not data.isascii():
        chars = len(data.translate(None, SPACE).decode())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)] if b"\n" in data else []
    repeated = 0
    windows = list(zip(ws, ws[1:], ws[2:]))
    times = Counter(windows)
    if len(times) < len(windows):
        until = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return chars, symbols, len(lines) - len(set(lines)), repeated


def line_features(line: bytes, seen: bool) -> tuple[list[float], int]:
    """Values of ``FEATURES`` of a line with a word, and the code points of its words."""
    ws = line.split()
    data = b"".join(ws)
    n, size, text = len(ws), len(data.decode()), line.decode()
    rate = (len(data) - len(data.translate(None, SYMBOLS))) / size
    shout = n > 1 and text == text.upper() and sum(map(str.isalpha, text)) > 5
    stutter = sum(map(bytes.__eq__, ws, ws[1:])) / n
    return [1.0, float(rate > 0.02), float(rate > 0.15), float(shout), float(line.count(b"!") > 0.2 * n), float(stutter > 0.2), float(seen or len(set(ws)) < 0.4 * n and n > 20), float(ws[-1][-1:] in b".?\"" and rate <= 0.02), float(n < 4)], size


def text_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, sizes, seen = [], [], set()
    for line in data.split(b"\n"):
        if line.strip(SPACE):
            row, size = line_features(line, line in seen)
            rows.append(row)
            sizes.append(size)
            seen.add(line)
    return np.array(rows).reshape(-1, len(FEATURES)), np.array(sizes, float)


def viterbi(gain: np.ndarray, stay: float) -> np.ndarray:
    """The best labels (1: content) where ``gain`` is the score of content less that of boilerplate, and two equal neighbours add ``stay``."""
    out, back = np.zeros(len(gain), np.int8), []
    no = yes = 0.0
    for k, g in enumerate(gain.tolist()):
        if k:
            back.append((yes >= no + stay, yes + stay >= no))
            no, yes = max(no + stay, yes), max(yes + stay, no)
        yes += g
    label = int(yes >= no)
    for k in range(len(gain) - 1, -1, -1):
        out[k] = label
        if k:
            label = int(back[k - 1][label])
    return out


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, stay: float) -> tuple[np.ndarray, float]:
    """Of the log likelihood of the labels ``y``, by forward-backward."""
    n, gain = len(y), x @ w
    move = np.exp(np.array([[stay, 0.0], [0.0, stay]]) - max(stay, 0.0))
    emit = np.stack([np.exp(np.minimum(0, -gain)), np.exp(np.minimum(0, gain))], 1)
    ahead, behind = np.empty((n, 2)), np.ones((n, 2))
    ahead[0] = emit[0] / emit[0].sum()
    for k in range(1, n):
        a = (ahead[k - 1] @ move) * emit[k]
        ahead[k] = a / a.sum()
    for k in range(n - 2, -1, -1):
        b = move @ (emit[k + 1] * behind[k + 1])
        behind[k] = b / b.sum()
    p = ahead * behind
    p /= p.sum(1, keepdims=True)
    pair = ahead[:-1, :, None] * move[None] * (emit[1:] * behind[1:])[:, None, :]
    same = (pair[:, 0, 0] + pair[:, 1, 1]) / pair.sum((1, 2))
    return x.T @ (y - p[:, 1]), float((y[1:] == y[:-1]).sum() - same.sum())


def mixed_sequences(found: list[tuple[np.ndarray, int]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Documents of both labels joined in pairs, now one and now the other first, so that changes of label are learned too; those left over of one label stay alone."""
    poor, good = ([x for x, q in found if q == label] for label in (0, 1))
    xs, ys = [], []
    for k in range(max(len(poor), len(good))):
        own = [(x[k], q) for x, q in ((poor, 0.0), (good, 1.0)) if k < len(x)][:: 1 if k % 2 else -1]
        xs.append(np.concatenate([x for x, _ in own]))
        ys.append(np.concatenate([np.full(len(x), q) for x, q in own]))
    return xs, ys


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[np.ndarray, float]:
    """Weights of ``FEATURES`` and of equal neighbours. The driver gets two counts; one task fits the bounded sample."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    few = lambda q: min(1.0, per_label / sizes[q]) if q in sizes else 0.0
    sample = known.where(chance < F.when(F.col("quality") == 1, few(1)).otherwise(few(0)))
    rows = docs.join(F.broadcast(sample), "doc_id").where(F.col("text").isNotNull())  # about 2 * per_label ids

    def extract(batches):
        for batch in batches:
            for text, q in zip(texts(batch), batch.column("quality").to_pylist()):
                x, _ = text_features(text.encode())
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([q], pa.int32()), pa.array([x.ravel().tolist()])], ["one", "quality", "x"])

    def fit(found: pd.DataFrame) -> pd.DataFrame:
        w, stay = PRIOR.copy(), PRIOR_STAY
        found = found.assign(size=found["x"].map(len), key=found["x"].map(lambda x: np.asarray(x).tobytes())).sort_values(["quality", "size", "key"], kind="stable")  # sums of the same order in each run
        xs, ys = mixed_sequences([(np.asarray(x, float).reshape(-1, len(FEATURES)), q) for x, q in zip(found["x"], found["quality"])])
        total = sum(map(len, xs))
        for _ in range(STEPS):
            g, s = zip(*(gradient(x, y, w, stay) for x, y in zip(xs, ys)))
            w = w + RATE * (np.sum(g, 0) / total * len(FEATURES) - NEAR * (w - PRIOR))
            stay = max(0.0, stay + RATE * (sum(s) / total - NEAR * (stay - PRIOR_STAY)))
        return pd.DataFrame({"w": [[*w, stay]]})

    found = rows.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(extract, "one int, quality int, x array<double>")
    got = found.groupBy("one").applyInPandas(fit, "w array<double>").first()
    return (np.array(got["w"][:-1]), got["w"][-1]) if got else (PRIOR.copy(), PRIOR_STAY)


def content_share(data: bytes, model: tuple[np.ndarray, float]) -> float:
    x, sizes = text_features(data)
    return float(sizes @ viterbi(x @ model[0], model[1]) / sizes.sum()) if len(x) else 0.0


def verdict(text: str, model: tuple[np.ndarray, float], share: float = SHARE) -> tuple:
    data = text.encode()
    ws = data.split()
    chars, symbols, lines, repeated = base_counts(ws, data)
    failed = len(ws) < MIN_WORDS or 100 * repeated > 100 * REPEATED * len(ws)
    content = content_share(data, model)
    return len(ws), chars, symbols, lines, repeated, failed, content, not failed and content >= share


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return docs.mapInArrow(by_slice(lambda batch: batch.filter(pa.array([verdict(t, model, share)[-1] for t in texts(batch)]))), docs.schema)


def judged(docs: DataFrame, model: tuple[np.ndarray, float], share: float = SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept; extra columns of ``docs`` are ignored."""

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*(verdict(t, model, share) for t in texts(batch)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(by_slice(run), f"doc_id {kind}, " + ", ".join(f"{n} {'bigint' if k == pa.int64() else 'boolean' if k == pa.bool_() else 'double'}" for n, k in zip(names, kinds)))
