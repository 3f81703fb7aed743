"""Readers and writers over files that Spark derives from the tables, labels applied to records,
and parameter rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import lexicon as X
from quillspark.operators import requests as R
from quillspark.plans.search_queries import OPS, operations, read
from quillspark.sources import tables as S
from quillspark.sources.stages import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquired pages written as JSON lines and read with the fixed schema; every ninth failed."""
    p = read(spark, sf_dir, "pages")
    failed = F.col("page_id") % 9 == 0
    rows = p.select(
        F.regexp_extract("url", r"://([^/?#]*)", 1).alias("product"), "url", F.when(~failed, F.col("url")).alias("final_url"), F.when(~failed, 200).alias("http_status"),
        F.when(~failed, F.sha2("html", 256)).alias("html_sha256"), F.when(failed, "timeout").alias("fail_reason"), F.col("page_id").alias("extra"),
    )
    path = _folder(spark, "pages")
    rows.write.json(path)
    return S.read_page_rows(spark, path).select("product", "url", "final_url", "http_status", "html_sha256", "fail_reason")


def changed_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications of each brand stored twice: the second time only those that changed."""
    ops = operations(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    path = _folder(spark, "specs")
    for version, changed in (("3.0.1", F.lit(True)), ("3.1.0", F.col("n") % 2 == 0)):
        text = F.concat(F.lit(f'{{"openapi":"{version}","paths":'), F.col("n").cast("string"), F.lit("}"))
        tracked = ops.select("source", changed.alias("changed"), F.sha2(text, 256).alias("sha256"))
        S.write_changed(tracked, ops.select("source", text.alias("spec_json")), f"{path}/specs", f"{path}/metadata")
    return spark.read.parquet(f"{path}/specs").join(spark.read.parquet(f"{path}/metadata"), "source").select("source", "spec_json", "sha256")


def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that forbid their document's language and source, split by its label."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    y = read(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("answerable"))
    labels = d.join(y, "id").select("id", "answerable", F.when(F.col("answerable"), F.array("lang")).otherwise(F.array().cast("array<string>")).alias("keys"))
    out = X.apply_labels(d.select("id", F.array("lang", "source").alias("forbidden")), labels)
    return out.select("id", "section", *[F.array_join(c, ",").alias(c) for c in ("expected", "forbidden", "legacy_forbidden")])


def closed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that expect their own operation, one that is gone, or both."""
    ops, n = operations(spark, sf_dir), F.length("path") % 3
    recs = ops.select(F.col("key").alias("id"), F.when(n == 0, F.array("key")).when(n == 1, F.array(F.concat("key", F.lit("/gone")))).otherwise(F.array(F.concat("key", F.lit("/gone")), F.col("key"))).alias("expected"))
    return X.catalog_closure(recs, ops).select("id", F.array_join("expected", ",").alias("expected"), F.array_join("missing", ",").alias("missing"), "stop")


#: A parameter's schema and the value it is given, by the length of the path.
SCHEMAS = ('{"type":"integer"}', '{"type":"string","enum":["a","b"]}', '{"type":["boolean","null"]}', '{"type":"number","nullable":true}')
VALUES = ('"7"', "7.5", '"a"', '"c"', "true", "null", "7")


def parameter_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, rule): a query parameter of four schemas, given one of seven values."""
    ops, n = operations(spark, sf_dir), F.length("path")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    params = ops.select("key", F.lit("query").alias("location"), F.lit("size").alias("name"), (n % 2 == 0).alias("required"), pick(SCHEMAS, n).alias("schema_json"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    asked = ops.select(F.col("key").alias("request_id"), "key", none.alias("path_params"), F.when(n % 11 != 0, F.create_map(F.lit("size"), pick(VALUES, n))).otherwise(none).alias("query"), none.alias("headers"))
    no_credentials = ops.select("source", F.lit("authorization").alias("header")).where("false")
    return R.check_parameters(asked, params, ops, no_credentials).select("request_id", "severity", "rule", "location")


QUERIES = {
    "io_page_rows": page_rows, "io_changed_specs": changed_specs, "lexicon_labelled_records": labelled_records, "lexicon_closed_records": closed_records, "request_parameter_errors": parameter_errors,
}

# ---- SQL ------------------------------------------------------------------------------------

_N = "length(path)"
# by schema, the values that have another type: an integer in a string is one, "a" is no number
_WRONG = f"""CASE {_N} % 4 WHEN 0 THEN {_N} % 7 IN (1, 2, 3, 4, 5) WHEN 1 THEN {_N} % 7 IN (1, 4, 5, 6) WHEN 2 THEN {_N} % 7 IN (0, 1, 2, 3, 6) ELSE {_N} % 7 IN (2, 3, 4) END"""

SQL = {
    "io_page_rows": r"""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS product, url, CASE WHEN page_id % 9 <> 0 THEN url END AS final_url, CASE WHEN page_id % 9 <> 0 THEN 200 END AS http_status,
  CASE WHEN page_id % 9 <> 0 THEN sha256(html) END AS html_sha256, CASE WHEN page_id % 9 = 0 THEN 'timeout' END AS fail_reason FROM pages""",
    "io_changed_specs": f"""WITH {OPS}, c AS (SELECT source, count(*) AS n FROM ops GROUP BY source)
SELECT source, '{{"openapi":"' || CASE WHEN n % 2 = 0 THEN '3.1.0' ELSE '3.0.1' END || '","paths":' || n || '}}' AS spec_json, sha256('{{"openapi":"3.1.0","paths":' || n || '}}') AS sha256 FROM c""",
    "lexicon_labelled_records": """SELECT d.doc_id AS id, CASE WHEN quality = 1 THEN 'regression_positive' ELSE 'regression_negative' END AS section, CASE WHEN quality = 1 THEN lang ELSE '' END AS expected,
  CASE WHEN quality = 1 THEN CASE WHEN source = lang THEN '' ELSE source END WHEN lang < source THEN lang || ',' || source ELSE source || ',' || lang END AS forbidden, CASE WHEN quality = 1 THEN lang ELSE '' END AS legacy_forbidden
FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL""",
    "lexicon_closed_records": f"WITH {OPS} SELECT key AS id, CASE WHEN {_N} % 3 = 1 THEN '' ELSE key END AS expected, CASE WHEN {_N} % 3 = 0 THEN '' ELSE key || '/gone' END AS missing, {_N} % 3 = 1 AS stop FROM ops",
    "request_parameter_errors": f"""WITH {OPS}
SELECT key AS request_id, 'error' AS severity, 'required' AS rule, 'query.size' AS location FROM ops WHERE {_N} % 2 = 0 AND {_N} % 11 = 0 UNION ALL
SELECT key, 'error', 'type', 'query.size' FROM ops WHERE {_N} % 11 <> 0 AND {_WRONG} UNION ALL
SELECT key, 'error', 'enum', 'query.size' FROM ops WHERE {_N} % 11 <> 0 AND {_N} % 4 = 1 AND {_N} % 7 IN (0, 3)""",
}
