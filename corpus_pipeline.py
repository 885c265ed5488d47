"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.

Defined cases: null and empty texts score as texts without features, are near-duplicates of nothing, hold no passage
and have no ids; very long texts are
treated whole in every stage; a null doc_id is a document of its own that is no near-duplicate, and comes before all
others where passages are cut; rows that share a doc_id are one document: they stay or go together as near-duplicates
(also equal ones, which both stay) and lose passages to smaller ids only; a toxicity score of exactly 0.5 goes; of
near-duplicates the least doc_id stays; extra columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostrata.llm import decontaminate, merge_replay, minhash, quality_qda, run_index, toxicity
from hydrostrata.llm.common import crc_mod, stored

#: A stage that SQL can't express is tested against brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go; the model learns from the training fold of labels."""
    labels = quality_qda.clean_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic").where(crc_mod("doc_id", 5) != 0)
    scored = toxicity.with_toxicity(docs, toxicity.fit(docs, labels), docs.columns, "__toxicity")
    return scored.where("__toxicity < 0.5").drop("__toxicity")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays."""
    gone = minhash.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a document with a smaller doc_id has in a 50-byte string go; n_chars follows the text."""
    return run_index.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage within its edit budget go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids' digest, decoded digest and token count of each document that is left."""
    return merge_replay.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_copy),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
