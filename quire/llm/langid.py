"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of 1 to ``ORDERS`` characters
are hashed into ``BUCKETS`` buckets each. Training sums the counts of each language in the tasks; the
log-probability matrix (its size does not depend on the corpus) is broadcast, and whole texts are scored
in numpy as a sparse product: the n-grams of many texts are looked up at once and summed by text.

Null texts and texts without a letter are ``und`` with score 0, as is everything when nothing was
learned. Rows with a null ``doc_id`` count as held out; repeated rows are judged once each, long texts whole. All languages are learned; more than
``LANGUAGES`` are scored in blocks, with a running best. Ties go to the first in alphabetical order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slice, texts, written

ORDERS, BUCKETS = 3, 1 << 15
#: Bound of the training sample: of each language about so many documents, chosen by a hash of doc_id.
PER_LANGUAGE = 4_000
#: Languages that are scored at a time. More take more passes over the texts; all are learned.
LANGUAGES = 256
#: Which texts are too unlike their language: deviations and at most what difference, the least deviation of an n-gram's log likelihood, and n-grams of a text whose mean varies twice as much as that of a very long one.
FAR, FARTHEST, SPREAD, GRAMS = 20.0, 4.0, 0.1, 1_000
#: Characters that are scored at a time.
BLOCK = 1 << 19
UNKNOWN = "und"
_letters = None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def has_letter(text: str) -> bool:
    """Numbers beside the decimal digits (fractions, superscripts) are no letters."""
    return any(map(str.isalpha, text))


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 32 for all that is no letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(1 << 16)])
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    known = _letters[np.minimum(codes, 65535)] | (codes > 65535)
    return np.where(known, codes, np.uint32(32))


def features(codes: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each place; 0 where it holds a text's border (code 0)."""
    out, mixed, inside = [], np.zeros(len(codes), np.uint32), np.ones(len(codes), bool)
    for n in range(ORDERS):
        shifted = codes[n:] if n else codes
        m = len(shifted)
        mixed, inside = mixed[:m] * np.uint32(0x9E3779B1) + shifted * np.uint32(0x85EBCA6B), inside[:m] & (shifted != 0)
        bucket = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)
        out.append(np.where(inside, bucket.astype(np.int32) + np.int32(n * BUCKETS + 1), np.int32(0)))
    return out


def joined(some: list[str]):
    """The texts' codes in blocks, each text between spaces and a border: (text and offset of its parts, codes).

    A part of a longer text brings the ``ORDERS - 1`` codes that follow it, so that each n-gram starts in one part alone;
    ``lap`` says how many codes at a part's end only end n-grams."""
    border, space, end = np.zeros(1, np.uint32), np.full(1, 32, np.uint32), np.zeros(ORDERS, np.uint32)
    held, at, size = [], [], 0
    for k, text in enumerate(some):
        codes = np.concatenate([space, letter_codes(text), space])
        for cut in range(0, len(codes), BLOCK):
            part = codes[cut : cut + BLOCK + ORDERS - 1]
            at.append((k, size, max(0, len(part) - BLOCK)))
            held += [part, border]
            size += len(part) + 1
            if size >= BLOCK:
                yield at, np.concatenate([*held, end])
                held, at, size = [], [], 0
    if at:
        yield at, np.concatenate([*held, end])


def bucket_rows(at: list[tuple], codes: np.ndarray) -> list[np.ndarray]:
    """``features`` of joined texts, those that start in a part's lap left out (0)."""
    found = features(codes)
    for _, start, lap in at:
        if lap:
            for f in found:
                f[start + BLOCK : start + BLOCK + lap] = 0
    return found


def sample_of(docs: DataFrame, per_language: int | None = PER_LANGUAGE) -> DataFrame:
    """lang, text of the bounded training sample; of all training documents, if there is no bound."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    if per_language is None:
        return rows.select("lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("docs"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return rows.select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang").where(chance < F.lit(float(per_language)) / F.col("docs")).select("lang", "text")


def train(docs: DataFrame, per_language: int | None = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (a row per bucket; row 0 is zero) from rows of (doc_id, text, lang). Languages have equal prior probabilities, however many documents they have.

    The driver gets the languages and ``ORDERS * BUCKETS`` sums for each of a block of them at a time, however many documents there are."""
    sample = sample_of(docs, per_language).select("lang", "text")
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((ORDERS * BUCKETS + 1, 0), np.float32)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            some = texts(batch)
            for lang in set(langs := batch.column("lang").to_pylist()):
                own = sums.setdefault(lang, np.zeros(ORDERS * BUCKETS + 1, np.int64))
                for at, codes in joined([t for t, x in zip(some, langs) if x == lang]):
                    for f in bucket_rows(at, codes):
                        own += np.bincount(f, minlength=len(own))
        for lang, own in sums.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(own[some])], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts") if len(langs) > LANGUAGES else counts
    log = np.zeros((ORDERS * BUCKETS + 1, len(langs)), np.float32)
    for a in range(0, len(langs), LANGUAGES):
        place = {x: k for k, x in enumerate(langs[a : a + LANGUAGES])}
        own = counts.where(F.col("lang").isin(list(place))).toPandas()
        n = np.zeros((len(log), len(place)))
        n[own["bucket"].to_numpy(np.int64), [place[x] for x in own["lang"]]] = own["n"].to_numpy(float)
        for k in range(ORDERS):
            part = slice(k * BUCKETS + 1, (k + 1) * BUCKETS + 1)
            log[part, a : a + len(place)] = np.log((n[part] + 0.1) / (n[part] + 0.1).sum(0))
    return langs, log


def scored(some: list[str], log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text under each language, and the number of n-grams it sums up."""
    out, n = np.zeros((len(some), log.shape[1])), np.zeros(len(some), np.int64)
    for at, codes in joined(some):
        which, starts, _ = zip(*at)
        for f in bucket_rows(at, codes):
            inside = np.minimum(starts, len(f) - 1)
            np.add.at(out, list(which), np.add.reduceat(log[f], inside, axis=0, dtype=np.float64))
            np.add.at(n, list(which), np.add.reduceat((f > 0).astype(np.int64), inside))
    return out, n


def score(some: list[str], log: np.ndarray) -> np.ndarray:
    return scored(some, log)[0]


def best_of(some: list[str], langs: list[str], log: np.ndarray, best: list, top: np.ndarray, mass: np.ndarray, n: np.ndarray) -> None:
    """Updates, for each text with a letter, its best language so far, that one's log likelihood, the sum of all likelihoods in units of it, and the number of n-grams."""
    known = [k for k, t in enumerate(some) if langs and has_letter(t)]
    if not known:
        return
    at, grams = scored([some[k] for k in known], log)
    own = at.max(1)
    higher = np.maximum(top[known], own)
    mass[known] = mass[known] * np.exp(np.where(np.isinf(top[known]), -np.inf, top[known] - higher)) + np.exp(at - higher[:, None]).sum(1)
    for k, j, better in zip(known, at.argmax(1).tolist(), (own > top[known]).tolist()):
        if better:
            best[k] = langs[j]
    top[known], n[known] = higher, grams


def predicted(some: list[str], langs: list[str], log: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and posterior probability of each text."""
    best, top, mass, n = [UNKNOWN] * len(some), np.full(len(some), -np.inf), np.zeros(len(some)), np.zeros(len(some), np.int64)
    best_of(some, langs, log, best, top, mass, n)
    return best, [float(1 / m) if m else 0.0 for m in mass]


def judged(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``rows`` (row, text) as row, best, top, mass, n (see ``best_of``): a pass for each block of ``LANGUAGES`` languages, so that a worker holds one block's matrix."""
    langs, log = model
    names = ("best", "top", "mass", "n")
    rows = rows.select("row", "text", F.lit(UNKNOWN).alias("best"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("mass"), F.lit(0).cast("bigint").alias("n"))
    for a in range(0, len(langs), LANGUAGES):
        own = langs[a : a + LANGUAGES]
        sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(log[:, a : a + LANGUAGES]))

        def run(batch: pa.RecordBatch, own=own, sent=sent) -> pa.RecordBatch:
            best, (top, mass, n) = batch.column("best").to_pylist(), (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in names[1:])
            best_of(texts(batch), own, sent.value, best, top, mass, n)
            return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(best, pa.string()), pa.array(top), pa.array(mass), pa.array(n)], ["row", "text", *names])

        rows = rows.mapInArrow(by_slice(run), rows.schema)
    return rows.drop("text")


def posterior() -> Column:
    return F.when(F.col("mass") > 0, 1 / F.col("mass")).otherwise(0.0)


def usual(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """lang, mean, sd of the log likelihood of an n-gram in all training documents of each language that the model takes for that language or, if there is none, in all that have a letter.

    The mean of n n-grams varies by ``sd`` times the root of 1 + ``GRAMS`` / n, so short documents weigh less; sd is that of very long ones."""
    known = sample_of(docs, None).select(F.struct("lang").alias("row"), "text")
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    value = F.col("top") / n
    weight = n / (n + GRAMS)
    sums = judged(known, model).where("n > 0").groupBy("row.lang", (F.col("best") == F.col("row.lang")).alias("fits")).agg(
        F.sum(weight).alias("w"), F.sum(weight * value).alias("wv"), F.sum(weight * value * value).alias("wvv"), F.count("*").alias("docs"))
    best = sums.groupBy("lang").agg(F.max_by(F.struct("w", "wv", "wvv", "docs"), "fits").alias("s"))
    return best.select("lang", (F.col("s.wv") / F.col("s.w")).alias("mean"), F.sqrt(F.greatest(F.col("s.wvv") - F.col("s.wv") * F.col("s.wv") / F.col("s.w"), F.lit(0.0)) / F.col("s.docs")).alias("sd"))


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5, far: float = FAR) -> DataFrame:
    """The rows of ``docs`` whose text has a language: a posterior probability of ``least`` or more, and n-grams about as likely as in that language's training documents.

    The posterior alone tells nothing of noise and of languages that were not learned: over all n-grams of a text it is next to 1 for some language always. So
    the mean log likelihood of an n-gram may lie at most ``far`` deviations (``SPREAD`` at least) below the training documents' mean, and ``FARTHEST`` in any case; a
    deviation grows as texts get shorter (see ``usual``). Every language has such a limit; nothing is like one that was learned from texts without a letter."""
    found = judged(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    limits = written(usual(docs, model), "languages")  # one row a language
    grams = F.nullif(F.col("n"), F.lit(0))
    deviation = F.greatest("sd", F.lit(SPREAD)) * F.sqrt(1 + F.lit(float(GRAMS)) / grams)
    near = F.col("top") / grams >= F.col("mean") - F.least(far * deviation, F.lit(FARTHEST))
    joined_ = found.join(limits.withColumnRenamed("lang", "best"), "best", "left")
    return joined_.where((F.col("best") != UNKNOWN) & (posterior() >= least) & near).select("row.*")


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's posterior probability) per document, read from the text alone."""
    found = judged(docs.select(F.struct("doc_id", held_out(F.col("doc_id")).alias("held_out")).alias("row"), "text"), model)
    return found.select("row.doc_id", "row.held_out", F.col("best").alias("lang_pred"), posterior().alias("score"))
