from pyspark.sql import functions as F

from quillspark.operators import corpus as D
from quillspark.plans import catalog_queries as Q


def test_several_sitemaps_of_a_source(spark):
    loc = "<loc>https://h.a/en/{}</loc>"
    maps = [("a", f"<urlset>{loc.format(1)}</urlset>"), ("a", f"<urlset>{loc.format(2)}<loc>https://h.a/x</loc></urlset>"), ("b", f"<urlset>{loc.format(1)}</urlset>"), ("b", "<html/>")]
    rules = spark.createDataFrame([("a", "h.a", "https://h.a/en/"), ("b", "h.a", "https://h.a/en/")], "source string, host string, prefix string")
    for order in (maps, maps[::-1]):
        got = {r["source"]: (r["kept"], r["discarded"], r["problem"]) for r in D.preflight(spark.createDataFrame(order, "source string, xml string"), rules).collect()}
        assert got == {"a": (2, 1, None), "b": (1, 0, "invalid_root")}


def test_sitemaps_are_bounded(spark, tmp_path, monkeypatch):
    """No sitemap holds more than its number of pages, and all pages are judged."""
    seen = {}
    monkeypatch.setattr(Q.D, "preflight", lambda maps, rules: seen.setdefault("maps", maps).withColumn("kind", F.lit("")))
    pages = spark.range(2500).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h.example.org/en/"), "id").alias("url"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    Q.preflight(spark, str(tmp_path))
    sizes = [r["xml"].count("<loc>") for r in seen["maps"].collect()]
    assert max(sizes) <= Q.SITEMAP_PAGES and sum(sizes) == 2500
