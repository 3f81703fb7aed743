"""Small pieces shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is unset, and all runs on one machine (tests), one is made."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it names a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*cuts: DataFrame) -> None:
    """Deletes the files of cuts that nothing reads any more."""
    for df in cuts:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int, seed: int = 7) -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents, drawn by a hash of doc_id.

    Several labels of one document count as their largest; null labels and ids are left
    out. The ids (at most ``limit``) are the broadcast side, so only their texts are moved:
    of rows that repeat an id the least text counts, once, so ``limit`` bounds rows too."""
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(limit)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")
