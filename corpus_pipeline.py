"""A corpus pipeline of five of the operators: each stage's result is written as Parquet and read again.

Languages are learned from the labels of all documents that operator 1 may learn from; documents that are like none of them (noise, other scripts) go; quality rules reject
the next; of each group of near-duplicates one document stays; passages that occur twice are cut out
(a document may become empty but stays); what is left is packed into sequences.

Null, empty and blank texts have no language and go with the first stage, as do texts without a letter; long texts
are read whole in each stage; repeated rows are near-duplicates, of which one stays; extra columns go on to the
last stage; an empty table gives an empty result. What a stage makes besides its result is deleted after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, packing, quality, similar, worddup
from quire.llm.common import scratch, table, written
from quire.llm.queries import WORD_TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.train(docs, None))  # rejects what is like no learned language, too


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = worddup.cut_texts(docs)
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, WORD_TOKENIZER, end_id=1, tokens=4096)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]

#: No stage but the first is plain SQL: models, hashes over shingles and a tokenizer decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name)
    return docs
