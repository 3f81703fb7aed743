"""From acquired pages to specifications, and how these change over time.

``now`` is always a parameter, so a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import jsonwalk

TTL_SECONDS = 86400
# Fixed values.
MARKER = r"window\.__DATA__\s*=\s*"
VERSION_PATTERN = r"/rest/(v\d+)(/|$)"
DIALECTS = ("3.0.", "3.1.")
HTTP_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def url_path(url: Column) -> Column:
    """The path of a url, without query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def api_version(url: Column | str, pattern: str = VERSION_PATTERN) -> Column:
    """First version segment of the url's path; null without one."""
    u = F.col(url) if isinstance(url, str) else url
    return F.nullif(F.regexp_extract(url_path(u), pattern, 1), F.lit(""))


def extract_specs(pages: DataFrame, marker: str = MARKER, version_pattern: str = VERSION_PATTERN) -> DataFrame:
    """source, url, status, counts, spec_json, its canonical sha256, api_version and its source."""
    got = pages.withColumn("_x", jsonwalk.extract_spec(F.col("html"), marker))
    version = api_version(F.coalesce("final_url", "url"), version_pattern)
    return got.select("source", "url", "_x.status", "_x.n_markers", "_x.n_candidates", "_x.spec_json", jsonwalk.canonical_sha256(F.col("_x.spec_json")).alias("sha256"), version.alias("api_version"), F.when(version.isNotNull(), "documentation_url").alias("api_version_source"))


def needs_check(sources: DataFrame, now: Column, force: bool = False, ttl: int = TTL_SECONDS) -> DataFrame:
    """Adds ``skip``: stored content is valid, agrees with the metadata, and is young enough.

    ``sources``: source, content_valid, content_sha256, sha256, last_checked."""
    fresh = F.col("content_valid") & (F.col("content_sha256") == F.col("sha256")) & ((F.unix_timestamp(now) - F.unix_timestamp("last_checked")) < ttl)
    return sources.withColumn("skip", F.coalesce(fresh, F.lit(False)) & F.lit(not force))


def track_changes(extracted: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """Status and new metadata of each successfully extracted source.

    ``previous``: source, api_version, last_updated, content_sha256 (of the stored content,
    whatever the metadata say)."""
    p = previous.select("source", F.col("api_version").alias("previous_api_version"), F.col("last_updated").alias("_updated"), "content_sha256")
    j = extracted.join(p, "source", "left")
    changed = ~F.col("sha256").eqNullSafe(F.col("content_sha256"))
    moved = F.coalesce(F.col("previous_api_version") != F.col("api_version"), F.lit(False))
    return j.select(
        "source", F.when(moved, "version_changed").when(changed, "updated").otherwise("ok").alias("status"), "api_version",
        F.when(moved, F.col("previous_api_version")).alias("previous_api_version"), "sha256", now.alias("last_checked"),
        F.when(changed, now).otherwise(F.coalesce("_updated", now)).alias("last_updated"), changed.alias("changed"),
    )


def with_fallback(extracted: DataFrame, stored: DataFrame) -> DataFrame:
    """(source, status) of every source: ok, or where extraction failed warn_fallback if valid
    content is stored and error_unavailable if not. ``stored``: source, content_valid."""
    s = stored.select("source", F.col("content_valid").alias("_v"))
    return extracted.join(s, "source", "left").select("source", F.when(F.col("status") == "ok", "ok").when(F.coalesce("_v", F.lit(False)), "warn_fallback").otherwise("error_unavailable").alias("status"))


def run_code(statuses: DataFrame) -> DataFrame:
    """One row: 2 if a source is unavailable, 1 if one fell back, else 0."""
    code = F.when(F.col("status") == "error_unavailable", 2).when(F.col("status") == "warn_fallback", 1).otherwise(0)
    return statuses.agg(F.coalesce(F.max(code), F.lit(0)).alias("code"))


def _json_kind(text: Column) -> Column:
    c = F.substring(F.ltrim(text), 1, 1)
    return F.when(c == "{", "object").when(c == "[", "array").when(c == '"', "string").when(text.isNull(), "missing").otherwise("other")


def compatibility(specs: DataFrame) -> DataFrame:
    """Adds ``gate``: the first reason why a specification can't be used, null if it can.

    ``specs``: source, spec_json."""
    top = F.from_json("spec_json", "struct<openapi: string, info: string, paths: string, components: string>")
    s = specs.withColumn("_t", top).withColumn("_items", F.from_json("_t.paths", "map<string,string>"))
    # a string and a number look alike once read as text, so the kind of the top-level member is asked for
    openapi_is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json("spec_json"), "$.openapi", "variant")) == "STRING"
    shaped = openapi_is_text & (_json_kind(F.col("_t.info")) == "object") & (_json_kind(F.col("_t.paths")) == "object")
    dialect = F.lit(False)
    for d in DIALECTS:
        dialect = dialect | F.col("_t.openapi").startswith(d)
    has_op = F.exists(F.map_values("_items"), lambda item: F.exists(F.coalesce(F.map_keys(F.from_json(item, "map<string,string>")), F.array().cast("array<string>")), lambda k: k.isin(*HTTP_METHODS)))
    comps = F.col("_t.components")
    schemas = F.get_json_object(comps, "$.schemas")
    bad_comps = comps.isNotNull() & (_json_kind(comps) != "object") | schemas.isNotNull() & (_json_kind(schemas) != "object")
    gate = (
        F.when(~F.coalesce(shaped, F.lit(False)), "invalid_structure")
        .when(~dialect, "incompatible_dialect")
        .when(~F.coalesce(has_op, F.lit(False)), "no_operations")
        .when(F.coalesce(bad_comps, F.lit(False)), "invalid_components")
    )
    return s.withColumn("gate", gate).drop("_t", "_items")


def integrity(sources: DataFrame, operations: DataFrame) -> DataFrame:
    """(source, gate): empty_registry or duplicate_keys, null if neither."""
    n = operations.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("key").alias("d"))
    return sources.select("source").join(n, "source", "left").select("source", F.when(F.coalesce("n", F.lit(0)) == 0, "empty_registry").when(F.col("n") != F.col("d"), "duplicate_keys").alias("gate"))


def choose_active(accepted: DataFrame, previous: DataFrame, last_good: DataFrame) -> DataFrame:
    """Per source the newly accepted specification, else the active one, else the last good."""
    cols = ["source", "spec_json", "sha256"]
    every = accepted.select(*cols, F.lit(1).alias("priority")).union(previous.select(*cols, F.lit(2).alias("priority"))).union(last_good.select(*cols, F.lit(3).alias("priority")))
    first = every.groupBy("source").agg(F.min_by(F.struct("spec_json", "sha256", "priority"), F.struct("priority", "sha256")).alias("a"))
    return first.select("source", "a.spec_json", "a.sha256", (F.col("a.priority") == 3).alias("served_from_last_good"))


def provenance(sources: DataFrame, active: DataFrame, observed: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """One row for every configured source: status, reason, counts, api_version.

    ``active``: source, sha256, operation_count, schema_count, skipped; ``observed``: source,
    metadata_sha256, api_version, last_checked, served_from_last_good, rejected_reason,
    refresh_failed."""
    no = F.lit(False)
    j = sources.select("source").join(active, "source", "left").join(observed, "source", "left")
    same = F.col("metadata_sha256").eqNullSafe(F.col("sha256"))
    young = F.coalesce((F.unix_timestamp(now) - F.unix_timestamp("last_checked")) < ttl, no)
    missing = F.col("sha256").isNull()
    reason = (
        F.when(missing, F.coalesce("rejected_reason", F.lit("no_cache")))
        .when(F.coalesce("served_from_last_good", no), "served_from_last_good")
        .when(F.col("rejected_reason").isNotNull(), F.col("rejected_reason"))
        .when(F.coalesce("refresh_failed", no), "refresh_failed")
        .when(~same, "metadata_mismatch")
        .when(~young, "ttl_expired")
    )
    return j.withColumn("reason", reason).select(
        "source", F.when(missing, "unavailable").when(F.col("reason").isNull(), "fresh").otherwise("stale").alias("status"), "reason",
        F.when(~missing & same, F.col("api_version")).alias("api_version"), F.coalesce("operation_count", F.lit(0)).alias("operation_count"),
        F.coalesce("schema_count", F.lit(0)).alias("schema_count"), F.coalesce("skipped", F.lit(0)).alias("skipped"),
    )


def fingerprint(shas: DataFrame) -> DataFrame:
    """One row: sha256 over the lines ``source:sha`` (``-`` if null), in order of source."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("source", F.coalesce("sha256", F.lit("-")).alias("sha")))), lambda x: F.concat_ws(":", x["source"], x["sha"]))
    return shas.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))
