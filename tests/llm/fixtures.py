"""Small documents with nulls, empty and long texts, ties and repeated rows, and extra columns with clashing names."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("n_words", T.StringType()), ("fp", T.StringType()), ("start", T.StringType()))]
)


def rows(seed=0):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["the", "an", "er", "ou", "é", "ß", "st", "."]) for _ in range(r.randint(1, 3))) for _ in range(80)]
    make = lambda n: " ".join(r.choice(vocabulary) + ("\n" if r.random() < 0.05 else "") for _ in range(n))
    shared, long = make(60), make(6000)
    texts = [make(r.randint(1, 200)) for _ in range(30)]
    texts += [make(20) + " " + shared + " " + make(15) for _ in range(6)] + [shared + make(3), "x" + shared]
    texts += [texts[0]] * 3 + [texts[1] + " end", long, long[5:], "a" * 700, "ab" * 400, "a" * 450 + "b"]
    texts += [None, "", None, " \n\t ", "1234 !!! ...", "日本語のテキスト です", "a b c  d", "<|endoftext|> it's we'll 12  x\t\ty", "é İ Σ ς", "\x1c x\x85y"]
    out = [(k, t, ["en", "fr", None][k % 3], "s", 1, "w", "f", "0") for k, t in enumerate(texts)]
    return out + [out[0], out[-1], (None, make(70), "en", None, None, None, None, None)]


def documents(spark, seed=0):
    return spark.createDataFrame(rows(seed), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
