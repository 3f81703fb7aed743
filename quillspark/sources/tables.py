"""Readers and writers of page rows, specifications and search logs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_ROWS = "product string, url string, final_url string, http_status int, html_sha256 string, fail_reason string, prefix string"
#: What a line of the log holds. Lines carry no number: their order is their place in the file.
LOG_ROWS = (
    "ts timestamp, kind string, query string, filters struct<source: string, method: string, tag: string, include_deprecated: boolean, limit: int>, "
    "query_tokens array<string>, alias_tokens array<string>, exact_match boolean, total_matches long, top array<struct<key: string, score: double>>, "
    "intelligence_fingerprint string, actionable boolean, recommended_operation string, abstain_reason string, method_intent_consistent boolean, "
    "server_session_id string, call_seq long, tool string, key string"
)


def read_page_rows(spark: SparkSession, path: str) -> DataFrame:
    """Acquired pages as JSON lines; the schema is fixed, so nothing is inferred."""
    return spark.read.schema(PAGE_ROWS).json(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(name, body) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("body"))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """(source, spec_json) of ``<source>.json`` files; text that isn't JSON becomes null."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("source"), "value")
    return files.select("source", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("spec_json"))


def write_changed(tracked: DataFrame, specs: DataFrame, spec_path: str, metadata_path: str) -> None:
    """Writes specifications of changed sources, each in its partition, then all metadata.

    Partitions of other sources stay as they are."""
    changed = specs.join(tracked.where("changed").select("source"), "source", "left_semi")
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(spec_path)
    tracked.drop("changed").write.mode("overwrite").parquet(metadata_path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of text files: lines numbered from 1 over all files, blank ones too.

    Files follow each other by path, a rotated ``x.prev`` before its ``x``. Large files are read
    in splits: a first pass counts the lines of each, running sums over the splits (as many
    rows as splits) say where each begins, and within a split lines keep the order they are
    read in. No task sees more than a split's lines."""
    where = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select("value", *where, F.monotonically_increasing_id().alias("_read"))
    counts = spark.read.text(path).groupBy(*where).agg(F.count("*").alias("n"))
    rotated = F.col("file_path").endswith(".prev")
    by_file = counts.groupBy("file_path").agg(F.sum("n").alias("n"))
    files = Window.orderBy(F.regexp_replace("file_path", r"\.prev$", ""), F.when(rotated, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    splits = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    before_file = by_file.select("file_path", F.coalesce(F.sum("n").over(files), F.lit(0)).alias("_file"))
    start = counts.withColumn("_split", F.coalesce(F.sum("n").over(splits), F.lit(0))).join(before_file, "file_path").select("file_path", "file_block_start", (F.col("_file") + F.col("_split")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("file_path", "file_block_start").orderBy("_read"))
    return lines.withColumn("_own", own).join(start, ["file_path", "file_block_start"]).select((F.col("_before") + F.col("_own")).alias("line_no"), "value")


def log_row(value):
    """A line's fields; null where it is no JSON object. A line without a kind is a search."""
    row = F.from_json(value, LOG_ROWS)
    is_object = F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT")
    return F.when(is_object, row.withField("kind", F.coalesce(row["kind"], F.lit("search"))))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Search log lines with their ``line_no``; lines that are no JSON objects are left out,
    but counted."""
    return numbered_lines(spark, path).select("line_no", log_row(F.col("value")).alias("r")).where("r is not null").select("line_no", "r.*")


def write_log(log: DataFrame, path: str) -> None:
    """Appends log lines in the order of their ``line_no``, which isn't written itself: each
    append is a folder of part files whose names follow that order."""
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = log.repartitionByRange(n, "line_no").sortWithinPartitions("line_no").drop("line_no")
    rows.write.json(f"{path}/append={time.time_ns():020d}")


def attribution_rows(log: DataFrame) -> DataFrame:
    """Log lines in the shape that ``operators.logs.attribute`` takes."""
    return log.select("line_no", "kind", F.col("server_session_id").alias("session"), "call_seq", "key", F.transform("top", lambda t: t["key"]).alias("top"), F.col("recommended_operation").alias("recommended"))
