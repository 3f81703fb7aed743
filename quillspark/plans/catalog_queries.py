"""Harvest, documentation, lexicon and catalog queries over ``pages``, ``documents`` and
``part``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import catalog as C
from quillspark.operators import corpus as D
from quillspark.operators import harvest as V
from quillspark.operators import lexicon as X
from quillspark.operators import refs as R
from quillspark.plans import sqltext as Q
from quillspark.plans.search_queries import OPS, RANKING, operations, read
from quillspark.sources.stages import written

NOW = "2024-06-01 00:00:00"
VERSION = r"/([a-z][a-z])/(\d+)"


def _now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an extracted source: its language segment is the version."""
    p = read(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("string").alias("source"), "url", F.lit("ok").alias("status"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), V.api_version(F.col("url"), VERSION).alias("api_version"), F.length("html").alias("n"))


def _previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was stored before: other content for odd lengths, none for every fifth."""
    p = _pages(spark, sf_dir).where("n % 5 <> 0")
    return p.select("source", F.when(F.col("n") % 7 == 0, "zz").otherwise(F.col("api_version")).alias("api_version"), F.timestamp_seconds(1700000000 + F.col("n") * 300).alias("last_updated"), F.when(F.col("n") % 2 == 0, F.col("sha256")).otherwise("0").alias("content_sha256"), (F.col("n") % 11 != 0).alias("content_valid"), F.when(F.col("n") % 3 != 0, F.col("sha256")).otherwise("0").alias("sha256"), F.timestamp_seconds(1717113600 + F.col("n") * 17).alias("last_checked"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = V.track_changes(_pages(spark, sf_dir), _previous(spark, sf_dir).select("source", "api_version", "last_updated", "content_sha256"), _now())
    return got.select("source", "status", "api_version", "previous_api_version", "sha256", F.unix_timestamp("last_checked").alias("last_checked"), F.unix_timestamp("last_updated").alias("last_updated"), "changed")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.needs_check(_previous(spark, sf_dir), _now()).select("source", "skip")


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _pages(spark, sf_dir).withColumn("status", F.when(F.col("n") % 13 == 0, "error").otherwise("ok"))
    return V.with_fallback(e, _previous(spark, sf_dir))


def run_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.run_code(fallback(spark, sf_dir))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("source", F.col("url").alias("spec_json"), "sha256", "n")
    got = V.choose_active(p.where("n % 2 = 0"), p.where("n % 3 = 0").withColumn("sha256", F.lit("previous")), p.withColumn("sha256", F.lit("last")))
    return got.drop("spec_json")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    act = p.where("n % 4 <> 0").select("source", "sha256", F.col("n").alias("operation_count"), (F.col("n") % 10).alias("schema_count"), (F.col("n") % 2).alias("skipped"))
    n = F.col("n")
    obs = p.where("n % 9 <> 0").select("source", F.when(n % 5 == 0, "0").otherwise(F.col("sha256")).alias("metadata_sha256"), "api_version", F.timestamp_seconds(1717113600 + n * 17).alias("last_checked"), (n % 6 == 1).alias("served_from_last_good"), F.when(n % 7 == 2, "no_operations").alias("rejected_reason"), (n % 8 == 3).alias("refresh_failed"))
    return V.provenance(p, act, obs, _now())


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.fingerprint(_pages(spark, sf_dir).select("source", F.when(F.col("n") % 10 != 0, F.col("sha256")).alias("sha256")))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy("api_version").agg(F.count("*").alias("n"))


# ---- documentation titles -------------------------------------------------------------------


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(D.host(F.col("url")).alias("product"), "url", "html")


#: Pages whose urls are in one sitemap at most.
SITEMAP_PAGES = 1000


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps of each top-level domain, with every page's url in them; as sitemaps do, each
    holds a bounded number of urls."""
    p = read(spark, sf_dir, "pages").select("url", F.floor(F.col("page_id") / SITEMAP_PAGES).alias("file"), F.regexp_extract("url", r"://[^/]*\.([a-z]+)/", 1).alias("source"))
    url = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    maps = p.groupBy("source", "file").agg(F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join(F.transform(F.array_sort(F.collect_list(url)), lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    rules = p.groupBy("source").agg(D.host(F.max("url")).alias("host")).withColumn("prefix", F.concat(F.lit("https://"), F.col("host"), F.lit("/en/")))
    return D.preflight(maps, rules).drop("kind")


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _doc_pages(spark, sf_dir)
    rows = p.select("product", "url", F.col("url").alias("final_url"), F.when(F.length("html") % 12 == 0, 404).otherwise(200).alias("http_status"), F.concat(F.regexp_extract("url", "^([a-z]+://)", 1), F.col("product"), F.lit("/e")).alias("prefix"))
    return D.acquisition_summary(D.classify_acquired(rows))


def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return D.content_mismatches(p.select("url", F.col("html").alias("body"), F.when(F.length("html") % 3 == 0, "0").otherwise(F.sha2(F.col("html").cast("binary"), 256)).alias("html_sha256"))).groupBy("url").agg(F.count("*").alias("n"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.titles(_doc_pages(spark, sf_dir))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir)


def titles_for_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first titles of every token of the benchmark texts."""
    concepts = read(spark, sf_dir, "benchmark").select(F.explode(T.title_tokens("text")).alias("concept")).distinct()
    return D.titles_for(_titles(spark, sf_dir), concepts).withColumn("place", F.col("place").cast("int"))


def title_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.title_list(_titles(spark, sf_dir))


# ---- lexicon --------------------------------------------------------------------------------


def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.raw_tokens("text")).cast("long").alias("n_tokens"), F.size(T.unigrams("text")).cast("long").alias("n_unigrams"), F.size(T.singular_tokens("text")).cast("long").alias("n_singular"), F.size(T.token_set("text")).cast("long").alias("n_forms"), T.excerpt("text").alias("excerpt"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each singular token."""
    d = read(spark, sf_dir, "documents").select(F.explode(T.singular_tokens("text")).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("df"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.concepts(operations(spark, sf_dir), RANKING.noise)
    return c.select("token", "count", F.array_join("sources", ",").alias("sources"))


def vocabulary_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.document_frequency(operations(spark, sf_dir))


def verb_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.verb_report(operations(spark, sf_dir), RANKING.__class__(verbs={"get": ["GET"], "post": ["POST"], "put": ["POST"], "ring": ["GET", "PUT"]}))
    return r.select("verb", F.array_join("outside", ",").alias("outside"), "review")


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir).withColumn("description", F.concat(F.initcap("summary"), F.lit(" of  "), F.col("source"), F.lit(". More text.")))
    g = X.grounding(ops, RANKING.noise)
    return g.select("token", "count", F.array_join("sources", ",").alias("sources"), "excerpt")


def _lexicon(spark: SparkSession, sf_dir: str, targets: Column) -> DataFrame:
    """Tokens of whole texts as synonyms of their source; of every other document neighbouring
    ones as phrases. They repeat."""
    d = read(spark, sf_dir, "documents").select("doc_id", targets.alias("targets"), T.unigrams("text").alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return d.select(F.explode(F.when(F.col("doc_id") % 2 == 0, F.col("w")).otherwise(pairs)).alias("key"), "targets")


def cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cap_per_concept(_lexicon(spark, sf_dir, F.array("source")).distinct()).select("key", F.get("targets", F.lit(0)).alias("target"), "kept")


def merge_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.Targets(read(spark, sf_dir, "documents").select(F.col("source").alias("target")))
    lex = written(_lexicon(spark, sf_dir, t.value("source")).groupBy("key").agg(t.collected("targets").alias("targets")))
    have = lex.where("length(key) % 3 = 0")
    out = X.merge_aliases(lex, have.select(F.col("key").alias("word")), have.select(F.split("key", " ").alias("words")))
    return out.select("key", "kind", F.array_join(t.array("targets"), ",").alias("targets"), "skipped")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviews, made of the two labels, of each source's documents."""
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    key, targets = F.concat("source", F.lit("-"), (F.col("doc_id") % 50).cast("string")), F.array("lang")
    hist = j.select(key.alias("key"), targets.alias("targets"), (F.col("quality") == 1).alias("verdict"))
    fresh = j.where("doc_id % 3 = 0").select(key.alias("key"), targets.alias("targets"), (F.col("toxic") == 1).alias("verdict"))
    return X.merge_verdicts(hist, fresh).select("key", F.array_join("targets", ",").alias("targets"), "verdict", "conflict")


def adjudicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as two reviewers, quality and toxicity, settled by the document's language."""
    lab = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    row = lambda c: lab.select(F.col("doc_id").alias("id"), (c == 1).alias("answerable"), F.when(c == 1, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("keys"))
    third = lab.select(F.col("doc_id").alias("id"), (F.col("lang") == "en").alias("answerable"), F.array("lang").alias("keys"))
    return X.adjudicate(row(F.col("quality")), row(F.col("toxic")), third).select("id", "answerable", F.array_join("keys", ",").alias("keys"), "disputed")


# ---- catalog --------------------------------------------------------------------------------


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One specification for each brand, with an operation for each of its parts."""
    ops = operations(spark, sf_dir).withColumn("n", F.length("path"))
    q = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    odd = F.col("n") % 2 == 1
    body = F.concat(
        F.lit('{"operationId":'), q(F.col("operation_id")), F.lit(',"summary":'), q(F.col("summary")), F.lit(',"tags":'), F.to_json("tags"), F.lit(',"deprecated":'), F.col("deprecated").cast("string"),
        F.when(odd, ',"security":[]').otherwise(""), F.when(F.col("n") % 5 == 0, ',"x-experimental":"yes"').otherwise(""),
        F.lit(',"parameters":[{"name":"q","in":"query","required":'), odd.cast("string"), F.lit('},{"$ref":"#/components/parameters/page"}],"responses":{"200":{"description":"ok","content":{"application/json":{"schema":{"$ref":"#/components/schemas/Part"}}}}}}'),
    )
    item = F.concat(q(F.col("path")), F.lit(':{"parameters":[{"name":"q","in":"query"},{"name":"id","in":"path"}],"'), F.lower("method"), F.lit('":'), body, F.lit("}"))
    text = F.concat(F.lit('{"openapi":"3.0.1","info":{"title":"'), F.col("source"), F.lit('"},"security":[{"key":["read","write"]},{}],"components":{"parameters":{"page":{"name":"page","in":"query","deprecated":true}},"schemas":{"Part":{"type":"object","properties":{"owner":{"$ref":"#/components/schemas/Owner"},"next":{"$ref":"#/components/schemas/Part"}}},"Owner":{"type":"object"}}},"paths":{'), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("}}"))
    return ops.groupBy("source").agg(text.alias("spec_json"))


def catalog_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C.normalize(specs(spark, sf_dir))["operations"]
    return o.select("source", "key", "method", "path", "operation_id", "summary", F.array_join("tags", ",").alias("tags"), "deprecated", "experimental")


def catalog_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalize(specs(spark, sf_dir))["parameters"].select("key", F.col("pos").cast("int").alias("pos"), "name", "location", "required", "deprecated")


def catalog_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalize(specs(spark, sf_dir))["security"].select("key", F.col("alternative").cast("int").alias("alternative"), "scheme", F.array_join("scopes", ",").alias("scopes"))


def catalog_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalize(specs(spark, sf_dir))["warnings"].groupBy("source", "kind").agg(F.count("*").alias("n"))


def catalog_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.profile(specs(spark, sf_dir))


def catalog_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.compatibility(specs(spark, sf_dir)).select("source", "gate")


def ref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.edges(C.components(specs(spark, sf_dir)))


def ref_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = C.components(specs(spark, sf_dir))
    return R.closure(R.edges(comps), comps.where("section = 'schemas'").select("source", "section", "name"), 3).withColumn("depth", F.col("depth").cast("int"))


QUERIES = {
    "harvest_changes": changes, "harvest_freshness": freshness, "harvest_fallback": fallback, "harvest_run_code": run_code, "harvest_active": active,
    "harvest_provenance": provenance, "harvest_fingerprint": fingerprint, "harvest_versions": versions,
    "doc_preflight": preflight, "doc_acquisition": classify, "doc_content_mismatches": mismatches, "doc_titles": titles, "doc_titles_for_concepts": titles_for_concepts, "doc_title_list": title_list,
    "text_token_features": token_features, "lexicon_document_frequency": document_frequency, "lexicon_concepts": concepts, "lexicon_vocabulary_frequency": vocabulary_frequency,
    "lexicon_verb_report": verb_report, "lexicon_grounding": grounding, "lexicon_cap": cap, "lexicon_merge_aliases": merge_aliases, "lexicon_verdicts": verdicts, "lexicon_adjudicate": adjudicate,
    "catalog_operations": catalog_operations, "catalog_parameters": catalog_parameters, "catalog_security": catalog_security, "catalog_warnings": catalog_warnings, "catalog_profile": catalog_profile,
    "catalog_gate": catalog_gate, "refs_edges": ref_edges, "refs_closure": ref_closure,
}

# ---- SQL ------------------------------------------------------------------------------------

_P = r"""
pg AS (SELECT page_id::VARCHAR AS source, url, sha256(html) AS sha256, nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/([a-z][a-z])/(\d+)', 1), '') AS api_version, length(html) AS n FROM pages),
pv AS (
  SELECT source, CASE WHEN n % 7 = 0 THEN 'zz' ELSE api_version END AS api_version, 1700000000 + n * 300 AS last_updated, CASE WHEN n % 2 = 0 THEN sha256 ELSE '0' END AS content_sha256, n % 11 <> 0 AS content_valid,
         CASE WHEN n % 3 <> 0 THEN sha256 ELSE '0' END AS sha256, 1717113600 + n * 17 AS last_checked FROM pg WHERE n % 5 <> 0)"""
_FB = "fb AS (SELECT g.source, CASE WHEN g.n % 13 <> 0 THEN 'ok' WHEN coalesce(content_valid, false) THEN 'warn_fallback' ELSE 'error_unavailable' END AS status FROM pg g LEFT JOIN pv USING (source))"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_NOW = "1717200000"
_ENT = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_FLAT = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_TITLES = f"""
raw AS (
  SELECT {_HOST} AS product, url, {_FLAT(_ENT("regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g')"))} AS h1, {_FLAT(_ENT("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's')"))} AS t FROM pages),
titles AS (
  SELECT * FROM (SELECT product, CASE WHEN h1 <> '' THEN h1 ELSE trim(string_split(t, ' | ')[1]) END AS title, url FROM raw)
  WHERE title <> '' AND len(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: x <> '')) > 0)"""
_TTOK = lambda x: f"list_distinct(list_transform(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> ''), lambda t: {Q.singular('t')}))"
_EXC = lambda x: f"(CASE WHEN {x} = '' THEN '-' ELSE left(CASE WHEN string_split({x}, '. ')[1] = {x} OR string_split({x}, '. ')[1] LIKE '%.' THEN string_split({x}, '. ')[1] ELSE string_split({x}, '. ')[1] || '.' END, 160) END)"
_RES = f"""list_distinct(list_filter(list_transform(list_filter(flatten(list_transform({Q.segments('path')}, lambda s: {Q.unigrams('s')})), lambda t: NOT regexp_matches(t, '^[0-9]+$')), lambda t: {Q.singular('t')}), lambda t: t <> 'rest')
  || list_transform({Q.unigrams('tags[1]')}, lambda t: {Q.singular('t')}))"""
_VOC = f"list_distinct({Q.singulars(Q.unigrams('operation_id'))} || {Q.singulars(Q.unigrams('summary'))} || {_RES.replace(chr(39) + 'rest' + chr(39), chr(39) + chr(39))})"
# distinct tokens in the order in which they come first
_LEX = f"""
lx0 AS (SELECT doc_id, source, {Q.raw_tokens('text')} AS w FROM documents),
lx1 AS (SELECT doc_id, source, t, min(i) AS i FROM (SELECT doc_id, source, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM lx0) WHERE t NOT IN {Q.words(T.STOPWORDS)} GROUP BY ALL),
lx2 AS (SELECT doc_id, source, t, lead(t) OVER (PARTITION BY doc_id, source ORDER BY i) AS u FROM lx1),
lx AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN t ELSE t || ' ' || u END AS key, source AS target FROM lx2 WHERE doc_id % 2 = 0 OR u IS NOT NULL)"""

SQL = {
    "harvest_changes": f"""WITH {_P} SELECT g.source, CASE WHEN v.api_version <> g.api_version THEN 'version_changed' WHEN g.sha256 IS DISTINCT FROM content_sha256 THEN 'updated' ELSE 'ok' END AS status, g.api_version,
  CASE WHEN v.api_version <> g.api_version THEN v.api_version END AS previous_api_version, g.sha256, {_NOW}::BIGINT AS last_checked,
  CASE WHEN g.sha256 IS DISTINCT FROM content_sha256 THEN {_NOW} ELSE coalesce(last_updated, {_NOW}) END::BIGINT AS last_updated, g.sha256 IS DISTINCT FROM content_sha256 AS changed FROM pg g LEFT JOIN pv v USING (source)""",
    "harvest_freshness": f"WITH {_P} SELECT source, content_valid AND content_sha256 = sha256 AND {_NOW} - last_checked < 86400 AS skip FROM pv",
    "harvest_fallback": f"WITH {_P}, {_FB} SELECT * FROM fb",
    "harvest_run_code": f"WITH {_P}, {_FB} SELECT max(CASE status WHEN 'error_unavailable' THEN 2 WHEN 'warn_fallback' THEN 1 ELSE 0 END)::INT AS code FROM fb",
    "harvest_active": f"WITH {_P} SELECT source, CASE WHEN n % 2 = 0 THEN sha256 WHEN n % 3 = 0 THEN 'previous' ELSE 'last' END AS sha256, n % 2 <> 0 AND n % 3 <> 0 AS served_from_last_good FROM pg",
    "harvest_provenance": f"""WITH {_P}, j AS (
  SELECT source, sha256, api_version, n, n % 4 = 0 AS missing, n % 9 <> 0 AS seen FROM pg),
r AS (SELECT *, seen AND n % 5 <> 0 AS same, CASE WHEN missing THEN CASE WHEN seen AND n % 7 = 2 THEN 'no_operations' ELSE 'no_cache' END WHEN seen AND n % 6 = 1 THEN 'served_from_last_good' WHEN seen AND n % 7 = 2 THEN 'no_operations'
  WHEN seen AND n % 8 = 3 THEN 'refresh_failed' WHEN NOT (seen AND n % 5 <> 0) THEN 'metadata_mismatch' WHEN {_NOW} - (1717113600 + n * 17) >= 86400 THEN 'ttl_expired' END AS reason FROM j)
SELECT source, CASE WHEN missing THEN 'unavailable' WHEN reason IS NULL THEN 'fresh' ELSE 'stale' END AS status, reason, CASE WHEN NOT missing AND same THEN api_version END AS api_version,
  CASE WHEN missing THEN 0 ELSE n END::INT AS operation_count, CASE WHEN missing THEN 0 ELSE n % 10 END::INT AS schema_count, CASE WHEN missing THEN 0 ELSE n % 2 END::INT AS skipped FROM r""",
    "harvest_fingerprint": f"WITH {_P} SELECT sha256(string_agg(source || ':' || CASE WHEN n % 10 <> 0 THEN sha256 ELSE '-' END, chr(10) ORDER BY source)) AS fingerprint FROM pg",
    "harvest_versions": f"WITH {_P} SELECT api_version, count(*) AS n FROM pg GROUP BY 1",
    "doc_preflight": rf"""WITH p AS (SELECT replace(url, '&', '&amp;') AS loc, {_HOST} AS h, regexp_extract(url, '://[^/]*\.([a-z]+)/', 1) AS source, url FROM pages),
r AS (SELECT source, {_HOST.replace('url', 'max(url)')} AS host FROM p GROUP BY 1),
c AS (SELECT p.source, count(*) FILTER (h <> host) AS "foreign", count(*) FILTER (h = host AND starts_with(loc, 'https://' || host || '/en/')) AS kept, count(*) FILTER (h = host AND NOT starts_with(loc, 'https://' || host || '/en/')) AS discarded FROM p JOIN r USING (source) GROUP BY 1)
SELECT *, CASE WHEN "foreign" > 0 THEN 'foreign_host' WHEN kept = 0 THEN 'nothing_kept' END AS problem FROM c""",
    "doc_acquisition": f"""WITH c AS (SELECT {_HOST} AS product, length(html) % 12 <> 0 AND starts_with(url, regexp_extract(url, '^([a-z]+://)', 1) || {_HOST} || '/e') AS ok FROM pages)
SELECT product, count(*) AS rows, count(*) FILTER (NOT ok) AS failed, 100 * count(*) FILTER (NOT ok) > 5 * count(*) AS too_many_failed FROM c GROUP BY 1""",
    "doc_content_mismatches": "SELECT url, count(*) AS n FROM pages WHERE length(html) % 3 = 0 GROUP BY 1",
    "doc_titles": f"WITH {_TITLES} SELECT product, title, url FROM titles",
    "doc_titles_for_concepts": f"""WITH {_TITLES}, c AS (SELECT DISTINCT unnest({_TTOK('text')}) AS concept FROM benchmark),
t AS (SELECT DISTINCT product, title, unnest({_TTOK('title')}) AS concept FROM titles),
k AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY product, title)::INT AS place FROM t)
SELECT concept, coalesce(place, 1)::INT AS place, product, coalesce(title, '-') AS title FROM c LEFT JOIN (SELECT * FROM k WHERE place <= 5) USING (concept)""",
    "doc_title_list": f"WITH {_TITLES} SELECT DISTINCT product, title FROM titles",
    "text_token_features": rf"""WITH d AS (SELECT doc_id, {_FLAT('text')} AS f, {Q.raw_tokens('text')} AS r, {Q.unigrams('text')} AS u FROM documents)
SELECT doc_id, len(r)::BIGINT AS n_tokens, len(u)::BIGINT AS n_unigrams, len({Q.singulars('u')})::BIGINT AS n_singular, len({Q.forms('u')})::BIGINT AS n_forms, {_EXC('f')} AS excerpt FROM d""",
    "lexicon_document_frequency": f"SELECT token, count(*) AS df FROM (SELECT unnest({Q.singulars(Q.unigrams('text'))}) AS token FROM documents) GROUP BY token",
    "lexicon_concepts": f"WITH {OPS} SELECT token, count(*) AS count, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM (SELECT source, unnest({_RES}) AS token FROM ops) GROUP BY token",
    "lexicon_vocabulary_frequency": f"WITH {OPS} SELECT token, count(*) AS df FROM (SELECT unnest({_VOC}) AS token FROM ops) GROUP BY token",
    "lexicon_verb_report": f"""WITH {OPS}, v AS (SELECT * FROM (VALUES ('get', ['GET']), ('post', ['POST']), ('put', ['POST']), ('ring', ['GET', 'PUT'])) t(verb, allowed)),
s AS (SELECT DISTINCT method, unnest({Q.singulars(Q.unigrams('operation_id'))} || {Q.singulars(Q.unigrams('summary'))}) AS verb FROM ops)
SELECT verb, coalesce(string_agg(method, ',' ORDER BY method) FILTER (NOT list_contains(allowed, method)), '') AS outside, count(*) FILTER (NOT list_contains(allowed, method)) > 0 AS review FROM v LEFT JOIN s USING (verb) GROUP BY verb""",
    "lexicon_grounding": f"""WITH {OPS}, d AS (SELECT key, list_transform(flatten(list_transform({Q.segments('path')}, lambda s: {Q.unigrams('s')})), lambda t: {Q.singular('t')})[-1] AS token,
  array_to_string(list_transform(string_split(summary, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') || ' of ' || source || '.' AS x FROM ops),
c AS (SELECT token, count(*) AS count, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM (SELECT source, unnest({_RES}) AS token FROM ops) GROUP BY token)
SELECT token, count, sources, coalesce(x, '-') AS excerpt FROM c LEFT JOIN (SELECT token, arg_min(x, key) AS x FROM d GROUP BY token) USING (token)""",
    "lexicon_cap": f"WITH {_LEX} SELECT key, target, row_number() OVER (PARTITION BY target, contains(key, ' ') ORDER BY key) <= 5 AS kept FROM lx",
    "lexicon_merge_aliases": f"""WITH {_LEX}, m AS (SELECT key, array_to_string(list_sort(list(DISTINCT target)), ',') AS targets, array_to_string(list_sort(string_split(key, ' ')), ' ') AS w FROM lx GROUP BY key)
SELECT m.key, CASE WHEN contains(m.key, ' ') THEN 'rule' ELSE 'alias' END AS kind, targets, CASE WHEN contains(m.key, ' ') THEN r.w IS NOT NULL ELSE length(m.key) % 3 = 0 END AS skipped
FROM m LEFT JOIN (SELECT DISTINCT w FROM m WHERE length(key) % 3 = 0) r ON m.w = r.w""",
    "lexicon_verdicts": """WITH j AS (SELECT source || '-' || (doc_id % 50) AS key, lang AS targets, quality = 1 AS q, toxic = 1 AS t, doc_id FROM documents JOIN labels USING (doc_id)),
h AS (SELECT key, targets, CASE WHEN count(DISTINCT q) = 1 THEN any_value(q) END AS v FROM j GROUP BY ALL), f AS (SELECT key, targets, CASE WHEN count(DISTINCT t) = 1 THEN any_value(t) END AS v FROM j WHERE doc_id % 3 = 0 GROUP BY ALL)
SELECT key, targets, coalesce(h.v, f.v) AS verdict, coalesce(h.v, f.v) IS NULL AS conflict FROM h FULL JOIN f USING (key, targets)""",
    "lexicon_adjudicate": """SELECT doc_id AS id, CASE WHEN quality = toxic THEN quality = 1 ELSE lang = 'en' END AS answerable, CASE WHEN quality = toxic AND quality = 0 THEN '' ELSE lang END AS keys, quality <> toxic AS disputed
FROM labels JOIN documents USING (doc_id)""",
    "catalog_operations": f"WITH {OPS} SELECT source, key, method, path, operation_id, summary, p_type AS tags, deprecated, false AS experimental FROM ops",
    "catalog_parameters": f"""WITH {OPS} SELECT key, pos, name, location, required, deprecated FROM ops, LATERAL (
  SELECT unnest([0, 1, 2])::INT AS pos, unnest(['q', 'id', 'page']) AS name, unnest(['query', 'path', 'query']) AS location, unnest([length(path) % 2 = 1, true, false]) AS required, unnest([false, false, true]) AS deprecated) p""".replace("SELECT key, pos, name, location, required, deprecated", "SELECT key, pos, name, p.location, p.required, p.deprecated"),
    "catalog_security": f"WITH {OPS} SELECT key, a::INT AS alternative, CASE WHEN a = 0 THEN 'key' END AS scheme, CASE WHEN a = 0 THEN 'read,write' END AS scopes FROM ops, unnest([0, 1]) AS t(a) WHERE length(path) % 2 = 0",
    "catalog_warnings": f"WITH {OPS} SELECT source, 'experimental_value_ignored' AS kind, count(*) AS n FROM ops WHERE length(path) % 5 = 0 GROUP BY 1",
    "catalog_profile": f"""WITH {OPS} SELECT source, count(*) AS paths, count(*) AS paths_with_parameters, count(*) AS operations, 0::BIGINT AS missing_ids, count(*) - count(DISTINCT operation_id) AS duplicate_ids,
  count(*) FILTER (deprecated) AS deprecated, 2::BIGINT AS schemas FROM ops GROUP BY source""",
    "catalog_gate": f"WITH {OPS} SELECT DISTINCT source, NULL::VARCHAR AS gate FROM ops",
    "refs_edges": f"""WITH {OPS} SELECT source, 'schemas' AS section, 'Part' AS name, '#/components/schemas/' || t AS ref, 'schemas' AS to_section, t AS to_name, 'ok' AS state FROM (SELECT DISTINCT source FROM ops), unnest(['Owner', 'Part']) AS x(t)""",
    "refs_closure": f"""WITH {OPS} SELECT source, 'schemas/' || r AS root, 'schemas' AS section, n AS name, d::INT AS depth FROM (SELECT DISTINCT source FROM ops), (VALUES ('Part', 'Part', 0), ('Part', 'Owner', 1), ('Owner', 'Owner', 0)) t(r, n, d)""",
}
