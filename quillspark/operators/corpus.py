"""Documentation titles: sitemaps, acquired pages, title snapshots, titles of concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import jsonwalk

MAX_FAILED_PERCENT = 5
TITLES_PER_CONCEPT = 5

_LOC = r"<loc>\s*([^<]*?)\s*</loc>"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def sitemap_rows(sitemaps: DataFrame) -> DataFrame:
    """(source, kind, loc): kind is urlset, sitemapindex or invalid; from (source, xml)."""
    root = F.regexp_extract("xml", r"<(?:[A-Za-z0-9]+:)?(urlset|sitemapindex)[\s>]", 1)
    kind = F.when(root != "", root).otherwise("invalid")
    return sitemaps.select("source", kind.alias("kind"), F.explode_outer(F.regexp_extract_all("xml", F.lit(_LOC), 1)).alias("loc"))


def preflight(sitemaps: DataFrame, rules: DataFrame) -> DataFrame:
    """Per source how many urls stay and how many are discarded, and the first problem.

    ``rules``: source, host, prefix. A url of another host is a problem; one of a urlset
    outside the prefix is discarded; keeping none is a problem. A source may have several
    sitemaps; one that is invalid makes it so."""
    j = sitemap_rows(sitemaps).join(rules, "source")
    here = F.coalesce(host(F.col("loc")) == F.col("host"), F.lit(False))
    inside = F.col("loc").startswith(F.col("prefix"))
    per = j.groupBy("source").agg(
        F.min("kind").alias("kind"), F.count_if(F.col("loc").isNotNull() & ~here).alias("foreign"),
        F.count_if(here & ((F.col("kind") == "sitemapindex") | inside)).alias("kept"), F.count_if(here & (F.col("kind") == "urlset") & ~inside).alias("discarded"),
    )
    return per.withColumn("problem", F.when(F.col("kind") == "invalid", "invalid_root").when(F.col("foreign") > 0, "foreign_host").when(F.col("kept") == 0, "nothing_kept"))


def classify_acquired(rows: DataFrame) -> DataFrame:
    """Adds ``outcome``: ok, http-N or redirect-outside-prefix.

    ``rows``: product, url, final_url, http_status, prefix."""
    out = F.when(F.col("http_status") != 200, F.concat(F.lit("http-"), F.col("http_status").cast("string"))).when(~F.col("final_url").startswith(F.col("prefix")), "redirect-outside-prefix").otherwise("ok")
    return rows.withColumn("outcome", out)


def acquisition_summary(classified: DataFrame, most: int = MAX_FAILED_PERCENT) -> DataFrame:
    per = classified.groupBy("product").agg(F.count("*").alias("rows"), F.count_if(F.col("outcome") != "ok").alias("failed"))
    return per.withColumn("too_many_failed", 100 * F.col("failed") > most * F.col("rows"))


def content_mismatches(bodies: DataFrame) -> DataFrame:
    """Urls whose body doesn't have the recorded sha256; from (url, body, html_sha256)."""
    return bodies.where(F.sha2(F.col("body").cast("binary"), 256) != F.col("html_sha256")).select("url")


def titles(pages: DataFrame) -> DataFrame:
    """(product, title, url) of pages (product, url, html) whose title has a token."""
    got = pages.select("product", jsonwalk.page_title(F.col("html")).alias("title"), "url")
    return got.where((F.col("title") != "") & (F.size(T.title_tokens("title")) > 0))


def titles_for(snapshot: DataFrame, concepts: DataFrame, limit: int = TITLES_PER_CONCEPT) -> DataFrame:
    """(concept, place, product, title): the first titles by (product, title) that hold each
    concept; one row with title ``-`` where none does."""
    tokens = snapshot.select("product", "title", F.explode(T.title_tokens("title")).alias("concept")).distinct()
    w = Window.partitionBy("concept").orderBy("product", "title")
    top = tokens.join(concepts, "concept", "left_semi").withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return concepts.select("concept").distinct().join(top, "concept", "left").select("concept", F.coalesce("place", F.lit(1)).alias("place"), "product", F.coalesce("title", F.lit("-")).alias("title"))


def title_list(snapshot: DataFrame) -> DataFrame:
    """Distinct (product, title), in order."""
    return snapshot.select("product", "title").distinct().orderBy("product", "title")
