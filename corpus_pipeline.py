"""A training-data pipeline: each stage is one operator over all that the last one kept.

Stages: toxicity filter, n-gram Jaccard join (one document of each group stays), benchmark
decontamination, mixing sources to target weights, sharding. Every stage takes the session,
the documents and the folder of the tables; what it returns is written as Parquet in the
shared folder of ``spark.checkpoint.dir`` and read again as the next one's documents. All
but the last return the columns they were given; the last tells each document's shard.

Defined results, of every stage: an empty table gives an empty one; a null or empty text is no
toxic document (it scores the model's leak), is similar to nothing, holds no benchmark item,
has no words to be served in the mix, so it ends there, and has size 1 as a shard's row; a
null id links nothing, is no loser of a group and is offered like the empty id; rows that
repeat an id are judged alike, and stay or go together; very long texts are taken whole;
other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common, decontamination, mixing, ngram_join, sharding, toxicity


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_toxic(docs, model)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_corpus(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("n-gram Jaccard join", stage_ngram_join),
    ("benchmark decontamination", stage_decontamination),
    ("mixing sources", stage_mixing),
    ("sharding", stage_sharding),
]

#: The toxicity model's scores can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir))
    return docs
