"""The training-corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe_prefix, decontamination, near_groups, recompression, toxicity_ordinal
from corpusloom.llm.common import SCRATCH, clear_scratch, remove, table
from corpusloom.session import shared_dir

#: Words in a repeat that the substring stage removes.
REPEAT_WORDS = 25
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: No stage but the last can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression doesn't reject."""
    model = toxicity_ordinal.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity_ordinal.score(docs, model).where("toxic = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return near_groups.keep_one_of_each(docs, width=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a repeat from an earlier document covers; one that loses all its words goes.

    A text that loses nothing stays as it is; of others the words that are left are joined by one space.
    """
    judged = recompression.remove_repeats(docs, width=REPEAT_WORDS, keep_text=True)
    out = judged.where("n_removed = 0 or n_removed < n_words").withColumn("text", F.col("kept"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, whole or edited."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests."""
    return bpe_prefix.encode_documents(docs, VOCABULARY, keep_ids=True)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path, since = f"{shared_dir(spark)}/corpusloom/pipeline-{name}-{uuid.uuid4().hex}", len(SCRATCH)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        # what the stage has written on its way, and its input, are done with
        clear_scratch(spark, since)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
