"""The corpus pipeline: five stages over documents, each written as Parquet and read again for the next.

toxicity drops documents predicted toxic; line dedup takes repeated lines out of texts; near-dedup (the stage named
simhash) keeps the document with the smallest doc_id of each group; benchmark decontamination drops documents with a benchmark passage; BPE
encodes and decodes what is left. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoked.llm import bpe_automaton, line_dedup, near_copies, positional_index, toxic_crf
from evoked.llm.common import remove, shared_dir, table

#: Near copies share 4 / 5 of their five-word shingles (Jaccard) or more.
SHINGLE, SIMILARITY = 5, (4, 5)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_crf.keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs).drop("_n_lines", "_n_dropped")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_copies(docs, SHINGLE, *SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return positional_index.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(docs, bpe_automaton.default_path())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup_stage), ("simhash", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: SQL cannot express the field, the fingerprints or the automaton.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if k:
            remove(spark, f"{home}/{STAGES[k - 1][0]}")
    return docs
