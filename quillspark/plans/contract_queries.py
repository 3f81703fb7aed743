"""Queries over richer specifications made of ``part``: bodies, responses, scopes, tags,
broken specifications, look-ups, requests with bodies, policy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import catalog as C
from quillspark.operators import harvest as V
from quillspark.operators import lexicon as X
from quillspark.operators import quirks as K
from quillspark.operators import requests as N
from quillspark.plans.search_queries import OPS, operations, read
from quillspark.sources import policies as P
from quillspark.sources.stages import written

#: The body that operations of odd path length declare.
BODY = (
    '{"type":"object","required":["name","made"],"additionalProperties":false,"example":{"a":1},"properties":{"name":{"type":"string"},"kind":{"enum":["a","b"]},'
    '"made":{"type":"string","readOnly":true},"example":{"type":"array","items":{"type":"object","properties":{"id":{"type":"integer","readOnly":true}}}}},'
    '"allOf":[{"required":["size"],"properties":{"size":{"type":"integer"},"name":{"type":"string"},"kind":{"enum":["a","c"]}}}]}'
)
CREATE = '{"$ref":"#/components/requestBodies/create"}'


def _n() -> Column:
    return F.length("path")


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One specification for each brand. Parts are operations: of odd path lengths with a body
    of two content types by reference; scopes of three shapes; responses of two kinds."""
    n = _n()
    body = F.when(n % 2 == 1, f',"requestBody":{CREATE}').otherwise("")
    scopes = F.when(n % 3 == 0, ',"x-oauth2-scopes":["read",{"scopes":["write","read"]},{"scopes":"all"}]').when(n % 3 == 1, ',"x-oauth2-scopes":"read"').otherwise("")
    answers = F.when(n % 4 == 0, ',"responses":{"404":{"$ref":"#/components/responses/gone"},"200":{"description":"ok","content":{"text/z":{},"application/a":{}}}}').otherwise(',"responses":{"204":{"description":"none"}}')
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    op = F.concat(F.lit('{"operationId":'), quoted("operation_id"), F.lit(',"description":'), quoted(F.repeat("summary", n)), F.lit(',"tags":'), F.to_json("tags"), body, scopes, answers, F.lit("}"))
    item = F.concat(quoted("path"), F.lit(':{"'), F.lower("method"), F.lit('":'), op, F.lit("}"))
    head = (
        '{"openapi":"3.1.0","info":{"title":"t"},"tags":[{"name":"Declared"},{"name":""}],"components":{"requestBodies":{"create":{"required":true,"content":{"application/json":{"schema":'
        + BODY
        + '},"text/plain":{"schema":{"type":"string"}}}}},"responses":{"gone":{"description":"no","content":{"application/problem":{"schema":{"$ref":"#/components/schemas/Problem"}}}}},'
        '"schemas":{"Problem":{"type":"object","examples":[1],"properties":{"examples":{"type":"string"},"cause":{"$ref":"#/components/schemas/Cause"}}},"Cause":{"example":2,"type":"string"},"Unused":{"type":"string"}},'
        '"securitySchemes":{"key":{"type":"apiKey","in":"header","name":"X-Part-Key"},"other":{"type":"apiKey","in":"query","name":"q"}}},"paths":{'
    )
    return operations(spark, sf_dir).groupBy("source").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("}}")).alias("spec_json"))


def _catalog(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return C.normalize(specs(spark, sf_dir))[name]


# ---- catalog ----------------------------------------------------------------------------------


def body_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir, "body_media").select("key", "body_required", F.col("pos").cast("int").alias("pos"), "content_type", F.length("schema_json").alias("n"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir, "responses").select("key", F.col("pos").cast("int").alias("pos"), "status", "description")


def response_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir, "response_media").select("key", "status", F.col("pos").cast("int").alias("pos"), "content_type", "schema_json")


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = C.normalize(specs(spark, sf_dir))
    n = cat["warnings"].where("kind = 'oauth2_scopes_shape_ignored'").groupBy("source").agg(F.count("*").alias("ignored"))
    return cat["operations"].select("source", "key", F.array_join("oauth2_scopes", ",").alias("scopes")).join(n, "source", "left").select("key", "scopes", "ignored")


def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir, "components").where("section in ('schemas', 'responses')").select("source", "section", "name", "node")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir, "tags").select("source", "tag")


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = specs(spark, sf_dir)
    return K.credential_headers(s.select("source"), C.components(s))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by source, method in lower case and tag, with and without deprecated ones."""
    from quillspark.operators.search import filter_operations

    ops = operations(spark, sf_dir)
    tag = ops.agg(F.min(F.get("tags", F.lit(0)))).first()[0]  # one row
    some = {"source": filter_operations(ops, source="brand11"), "method": filter_operations(ops, method="get", include_deprecated=False), "tag": filter_operations(ops, tag=tag)}
    out = None
    for name, rows in some.items():
        one = rows.select(F.lit(name).alias("filter"), "key")
        out = one if out is None else out.union(one)
    return out


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by key, by a lost key, by operation id with and without its source."""
    ops, n = operations(spark, sf_dir), _n()
    r = ops.select(
        F.col("key").alias("request_id"), F.when(n % 4 == 0, F.col("key")).when(n % 4 == 1, F.concat("key", F.lit("/gone"))).alias("key"), F.when(n % 4 >= 2, F.col("operation_id")).alias("operation_id"), F.when(n % 4 == 3, F.col("source")).alias("source")
    )
    return C.resolve(r, ops, lambda c: F.array_join(c, ","))


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = C.normalize(specs(spark, sf_dir))
    types = F.array_join(F.transform("response_types", lambda x: F.concat_ws(" ", x["status"], x["content_type"])), ",")
    return C.compact(cat["operations"], cat["response_media"], 300).select("key", F.length("description").alias("n"), "truncated", types.alias("types"))


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the specifications need for their paths of lengths that 4 divides."""
    s = specs(spark, sf_dir)
    wanted = operations(spark, sf_dir).where(_n() % 4 == 0).select("source", "path")
    return C.trimmed_specs(s, wanted).select("source", F.size(F.json_object_keys(F.get_json_object("spec_json", "$.paths"))).alias("n_paths"), F.get_json_object("spec_json", "$.components.schemas").alias("schemas"), F.get_json_object("spec_json", "$.openapi").alias("openapi"))


# ---- gates ------------------------------------------------------------------------------------


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a specification of its own, sound or broken in one of the known ways."""
    n = F.col("p_partkey") % 8  # 6 and 7: a member of the same name, but another kind, inside another
    ops = F.concat(F.lit('{"/a":{"'), F.when(n == 4, "parameters").otherwise("get"), F.lit('":{}}}'))
    text = F.concat(
        F.lit('{"openapi":'), F.when(n == 1, "3").when(n == 3, '"4.0.0"').when(n == 6, "3.1").otherwise('"3.0.1"'), F.when(n == 6, ',"info":{"openapi":"3.0.1"},"paths":').when(n == 7, ',"info":{"openapi": 3},"paths":').otherwise(',"info":{},"paths":'), F.when(n == 2, "[]").otherwise(ops),
        F.when(n == 5, ',"components":{"schemas":[]}').otherwise(""), F.lit("}"),
    )
    return V.compatibility(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), text.alias("spec_json"))).select("source", "gate")


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registries of parts by brand: some without operations, some with two of one key."""
    ops = operations(spark, sf_dir)
    brand = F.ascii(F.substring("source", -1, 1)) % 3
    kept = ops.where(brand != 0).select("source", F.when((brand == 1) & (_n() % 2 == 0), "same").otherwise(F.col("key")).alias("key"))
    return V.integrity(ops.select("source").distinct(), kept)


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    return K.orphans(ops.select(F.when(_n() % 2 == 0, F.concat("key", F.lit("/gone"))).otherwise(F.col("key")).alias("key")), ops)


# ---- requests ---------------------------------------------------------------------------------

#: Bodies by path length modulo 7; null: none is sent.
BODIES = ('{"name":"n","size":1}', '{"name":3,"size":"x","other":1,"kind":"z"}', "[]", '{"made":"m","example":[{"id":1},{"id":2},{}]}', "null", None, '{"name":"n","size":2,"made":"x"}')


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n()
    body = F.get(F.array(*[F.lit(b) for b in BODIES]), n % 7)
    asked = F.when(n % 5 == 0, "Application/JSON; charset=x").when(n % 5 == 1, "text/odd").when(n % 5 == 2, "application/json")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return operations(spark, sf_dir).select(F.col("key").alias("request_id"), "key", none.alias("path_params"), none.alias("query"), F.when(n % 5 == 3, F.create_map(F.lit("content-type"), F.lit('"text/plain"'))).otherwise(none).alias("headers"), asked.alias("content_type"), body.isNotNull().alias("body_present"), body.alias("body_json"))


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.content_types(_requests(spark, sf_dir), _catalog(spark, sf_dir, "body_media")).select("request_id", "requested", "selected", F.col("n_declared").cast("long").alias("n_declared"), "error")


def body_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on bodies that the requests break: presence, type, structure, read-only values."""
    cat = C.normalize(specs(spark, sf_dir))
    r, media = _requests(spark, sf_dir), written(cat["body_media"])
    found = N.check_body_presence(r, media).union(N.check_body(r, media, N.body_rules(media, cat["components"])))
    return found.select("request_id", "severity", "rule", "location").distinct()


def multipart(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = operations(spark, sf_dir).where(_n() % 2 == 0).select("key", F.explode(F.array(F.lit("name"), F.lit("file"))).alias("name"), (_n() % 3 != 0).alias("required"))
    return N.check_multipart(_requests(spark, sf_dir), hints).select("request_id", "rule", "location")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with an id in place of the parameter; every third request lacks it."""
    ops, n = operations(spark, sf_dir), _n()
    ids = F.when(n % 3 != 0, F.create_map(F.lit("partId"), F.concat(F.lit('"a b/'), F.col("method"), F.lit('~*é"')))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    params = ops.where(F.col("path").contains("{")).select("key", F.lit("path").alias("location"), F.lit("partId").alias("name"))
    return N.render_paths(ops.select(F.col("key").alias("request_id"), "key", ids.alias("path_params")), ops, params)


# ---- lexicon and policies -----------------------------------------------------------------------


def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents as ranked candidates of a source's word; labels approve them."""
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    key = F.concat("source", F.lit("-"), (F.col("doc_id") % 50).cast("string"))
    e = j.select(key.alias("canonical"), F.concat(key, F.lit("/"), "lang").alias("key"), F.array("lang").alias("targets"), F.when(F.col("lang") == "fr", "shape").alias("reason")).distinct()
    e = e.withColumn("rank", F.ascii("key") + F.ascii(F.reverse("key")))
    v = j.where("quality + toxic > 0").groupBy(key.alias("key"), F.array("lang").alias("targets")).agg(F.bool_and(F.col("quality") == 1).alias("verdict"))
    return X.resolve(e, v).select("key", "state", F.array_join("targets", ",").alias("targets"), F.col("rank").cast("int").alias("rank"))


def alias_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types and names as aliases and rules: names aren't tokens, some rules lack a side."""
    p = read(spark, sf_dir, "part")
    words = p.select(F.col("p_partkey").cast("int").alias("rule_id"), F.lower("p_type").alias("word")).where("rule_id % 3 <> 0")
    adds = p.select(F.col("p_partkey").cast("int").alias("rule_id"), F.col("p_name").alias("target")).where("rule_id % 3 <> 1")
    damping = p.select((F.col("p_size") % 4 / 2.0).alias("value"), F.col("p_size").cast("string").alias("item")).distinct()
    return P.alias_problems(p.select(F.lower("p_type").alias("word"), F.lower("p_type").alias("target")).distinct(), words, adds, damping)


def override_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n()
    pick = lambda good, bad, k: F.when(n % k == 0, bad).otherwise(good)
    over = operations(spark, sf_dir).select(
        F.when(n % 2 == 0, F.lower("key")).otherwise(F.col("key")).alias("key"), pick("X-One", "Cookie", 3).alias("name"), pick("set", "drop", 5).alias("action"), pick("required", "maybe", 7).alias("enforcement"), pick("literal", "loose", 11).alias("value_policy")
    )
    return P.override_problems(over.union(over.where("name = 'X-One'").withColumn("name", F.lit("x-one"))).distinct())


QUERIES = {
    "catalog_body_media": body_media, "catalog_responses": responses, "catalog_response_media": response_media, "catalog_scopes": scopes, "catalog_stripped": stripped, "catalog_tags": tags,
    "catalog_filter": filtered, "catalog_resolve": resolved, "catalog_compact": compact, "catalog_trim": trimmed, "quirks_credentials": credentials, "quirks_orphans": orphans,
    "harvest_gates": gates, "harvest_integrity": integrity, "request_content_types": content_types, "request_body_findings": body_findings, "request_multipart": multipart, "request_paths": rendered,
    "lexicon_resolve": resolved_sources, "policy_alias_problems": alias_problems, "policy_override_problems": override_problems,
}

# ---- SQL ----------------------------------------------------------------------------------------

_SRC = "(SELECT DISTINCT source FROM ops)"
_B7 = "[" + ", ".join("NULL" if b is None else f"'{b}'" for b in BODIES) + "]"
_REQ = f"""
rq AS (
  SELECT key, length(path) AS n, length(path) % 2 = 1 AS has, {_B7}[length(path) % 7 + 1] AS body,
         CASE length(path) % 5 WHEN 0 THEN 'Application/JSON; charset=x' WHEN 1 THEN 'text/odd' WHEN 2 THEN 'application/json' WHEN 3 THEN 'text/plain' END AS asked FROM ops),
ct AS (
  SELECT *, CASE WHEN has THEN CASE n % 5 WHEN 0 THEN 'application/json' WHEN 1 THEN NULL WHEN 3 THEN 'text/plain' ELSE 'application/json' END END AS selected, has AND n % 5 = 1 AS wrong FROM rq),
js AS (SELECT *, n % 7 AS b FROM ct WHERE selected = 'application/json' AND asked IS NOT NULL)"""
_PROBLEM = '{"type":"object","properties":{"examples":{"type":"string"},"cause":{"$ref":"#/components/schemas/Cause"}}}'
_GONE = '{"description":"no","content":{"application/problem":{"schema":{"$ref":"#/components/schemas/Problem"}}}}'
_RAW_PROBLEM = '{"type":"object","examples":[1],"properties":{"examples":{"type":"string"},"cause":{"$ref":"#/components/schemas/Cause"}}}'
_STRIPPED_BODY = len(BODY) - len('"example":{"a":1},')

SQL = {
    "catalog_body_media": f"WITH {OPS} SELECT key, true AS body_required, pos::INT AS pos, ct AS content_type, n::INT AS n FROM ops, (VALUES (0, 'application/json', {_STRIPPED_BODY}), (1, 'text/plain', 17)) t(pos, ct, n) WHERE length(path) % 2 = 1",
    "catalog_responses": f"WITH {OPS} SELECT key, pos::INT AS pos, status, d AS description FROM ops, (VALUES (0, '404', 'no'), (1, '200', 'ok')) t(pos, status, d) WHERE length(path) % 4 = 0 UNION ALL SELECT key, 0, '204', 'none' FROM ops WHERE length(path) % 4 <> 0",
    "catalog_response_media": f"""WITH {OPS} SELECT key, status, pos::INT AS pos, ct AS content_type, s AS schema_json FROM ops,
  (VALUES ('404', 0, 'application/problem', '{{"$ref":"#/components/schemas/Problem"}}'), ('200', 0, 'text/z', NULL), ('200', 1, 'application/a', NULL)) t(status, pos, ct, s) WHERE length(path) % 4 = 0""",
    "catalog_scopes": f"WITH {OPS}, w AS (SELECT source, count(*) AS ignored FROM ops WHERE length(path) % 3 = 1 GROUP BY 1) SELECT key, CASE WHEN length(path) % 3 = 0 THEN 'read,write,all' ELSE '' END AS scopes, ignored FROM ops LEFT JOIN w USING (source)",
    "catalog_stripped": f"""WITH {OPS} SELECT source, section, name, node FROM {_SRC},
  (VALUES ('schemas', 'Problem', '{_PROBLEM}'), ('schemas', 'Cause', '{{"type":"string"}}'), ('schemas', 'Unused', '{{"type":"string"}}'), ('responses', 'gone', '{_GONE}')) t(section, name, node)""",
    "catalog_tags": f"WITH {OPS} SELECT source, 'Declared' AS tag FROM {_SRC} UNION SELECT DISTINCT source, tags[1] FROM ops",
    "catalog_filter": f"""WITH {OPS} SELECT 'source' AS filter, key FROM ops WHERE source = 'brand11' UNION ALL SELECT 'method', key FROM ops WHERE method = 'GET' AND NOT deprecated
UNION ALL SELECT 'tag', key FROM ops WHERE tags[1] = (SELECT min(tags[1]) FROM ops)""",
    "catalog_resolve": f"""WITH {OPS}, a AS (SELECT key AS request_id, length(path) % 4 AS m, operation_id, source FROM ops),
c AS (SELECT a.request_id, list_sort(list(DISTINCT o.key)) AS c FROM a JOIN ops o USING (operation_id) WHERE m = 2 OR (m = 3 AND a.source = o.source) GROUP BY 1)
SELECT request_id, CASE WHEN m = 0 THEN request_id WHEN m >= 2 AND len(c) = 1 THEN c[1] END AS key, CASE WHEN m = 1 THEN 'operation_not_found' WHEN m >= 2 AND len(c) > 1 THEN 'ambiguous' END AS error,
  CASE WHEN m >= 2 AND len(c) > 1 THEN array_to_string(c, ',') END AS candidates FROM a LEFT JOIN c USING (request_id)""",
    "catalog_compact": f"WITH {OPS} SELECT key, least(300, length(summary) * length(path))::INT AS n, length(summary) * length(path) > 300 AS truncated, CASE WHEN length(path) % 4 = 0 THEN '200 application/a,200 text/z,404 application/problem' END AS types FROM ops",
    "catalog_trim": f"""WITH {OPS} SELECT source, count(*)::INT AS n_paths, '{{"Cause":{{"example":2,"type":"string"}},"Problem":{_RAW_PROBLEM}}}' AS schemas, '3.1.0' AS openapi FROM ops WHERE length(path) % 4 = 0 GROUP BY source""",
    "quirks_credentials": f"WITH {OPS} SELECT source, h AS header FROM {_SRC}, unnest({list(K.CREDENTIAL_HEADERS) + ['x-part-key']!r}) AS t(h)",
    "quirks_orphans": f"WITH {OPS} SELECT key || '/gone' AS key FROM ops WHERE length(path) % 2 = 0",
    "harvest_gates": "SELECT p_partkey AS source, [NULL, 'invalid_structure', 'invalid_structure', 'incompatible_dialect', 'no_operations', 'invalid_components', 'invalid_structure', NULL][p_partkey % 8 + 1] AS gate FROM part",
    "harvest_integrity": f"""WITH {OPS}, b AS (SELECT source, ascii(right(source, 1)) % 3 AS b, count(*) FILTER (length(path) % 2 = 0) AS same FROM ops GROUP BY 1)
SELECT source, CASE WHEN b = 0 THEN 'empty_registry' WHEN b = 1 AND same > 1 THEN 'duplicate_keys' END AS gate FROM b""",
    "request_content_types": f"WITH {OPS}, {_REQ} SELECT key AS request_id, asked AS requested, selected, CASE WHEN has THEN 2 ELSE 0 END::BIGINT AS n_declared, asked IS NOT NULL AND selected IS NULL AS error FROM ct",
    "request_body_findings": f"""WITH {OPS}, {_REQ}
SELECT key AS request_id, 'error' AS severity, 'body_required' AS rule, 'body' AS location FROM ct WHERE has AND body IS NULL UNION ALL
SELECT key, 'error', 'content_type', 'content_type' FROM ct WHERE wrong UNION ALL
SELECT key, 'warning', 'content_type_ambiguous', 'content_type' FROM ct WHERE has AND asked IS NULL AND body IS NOT NULL UNION ALL
SELECT key, 'warning', 'structure_not_checked', 'body' FROM ct WHERE has AND asked IS NULL AND body IS NOT NULL UNION ALL
SELECT key, 'warning', 'body_not_declared', 'body' FROM ct WHERE NOT has AND body IS NOT NULL UNION ALL
SELECT key, 'error', 'body_root_type', 'body' FROM js WHERE b IN (2, 4) UNION ALL
SELECT key, 'error', 'body_root_type', 'body' FROM ct WHERE selected = 'text/plain' AND body IS NOT NULL UNION ALL
SELECT key, 'warning', 'conflicting_allof_property', 'body.kind' FROM js WHERE b IN (0, 1, 3, 6) UNION ALL
SELECT key, 'error', 'body_required_properties', 'body.' || p FROM js, unnest(['name', 'size']) t(p) WHERE b = 3 UNION ALL
SELECT key, 'error', 'body_unknown_property', 'body.other' FROM js WHERE b = 1 UNION ALL
SELECT key, 'error', 'body_property_type', 'body.' || p FROM js, unnest(['name', 'size']) t(p) WHERE b = 1 UNION ALL
SELECT key, 'warning', 'readonly_property_present', l FROM js, unnest(['body.made', 'body.example[0].id', 'body.example[1].id']) t(l) WHERE b = 3 UNION ALL
SELECT key, 'warning', 'readonly_property_present', 'body.made' FROM js WHERE b = 6""",
    "request_multipart": f"""WITH {OPS}, {_REQ} SELECT key AS request_id, 'multipart_field_missing' AS rule, 'body.' || f AS location FROM rq, unnest(['name', 'file']) t(f)
WHERE NOT has AND n % 3 <> 0 AND n % 7 NOT IN (2, 4, 5) AND NOT (f = 'name' AND n % 7 IN (0, 1, 6))""",
    "request_paths": f"""WITH {OPS} SELECT key AS request_id, CASE WHEN NOT contains(path, '{{') THEN path WHEN length(path) % 3 <> 0 THEN replace(path, '{{partId}}', 'a%20b%2F' || method || '~%2A%C3%A9') END AS path FROM ops""",
    "lexicon_resolve": """WITH j AS (SELECT source || '-' || (doc_id % 50) AS c, lang, quality, toxic FROM documents JOIN labels USING (doc_id)),
e AS (SELECT DISTINCT c, c || '/' || lang AS key, lang, ascii(c) + ascii(right(lang, 1)) AS rank, lang <> 'fr' AS sound FROM j),
v AS (SELECT c, lang, bool_and(quality = 1) AS verdict FROM j WHERE quality + toxic > 0 GROUP BY ALL),
r AS (SELECT e.*, sound AND coalesce(verdict, false) AS good, sound AND verdict IS NULL AS open FROM e LEFT JOIN v USING (c, lang)),
p AS (SELECT c, bool_or(good) AS found, bool_or(open) AS open, max(CASE WHEN good THEN rank END) AS best, max(rank) AS last FROM r GROUP BY c)
SELECT key, CASE WHEN found THEN 'selected' WHEN p.open THEN 'pending' ELSE 'rejected' END AS state, lang AS targets, rank::INT AS rank FROM p JOIN r USING (c) WHERE CASE WHEN found THEN good AND rank = best ELSE rank = last END""",
    "policy_alias_problems": """SELECT DISTINCT p_name AS item, 'not_a_token' AS problem FROM part WHERE p_partkey % 3 <> 1 UNION ALL
SELECT p_partkey::VARCHAR, 'rule_adds_nothing' FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey::VARCHAR, 'rule_without_words' FROM part WHERE p_partkey % 3 = 0 UNION ALL
SELECT DISTINCT p_size::VARCHAR, 'damping_out_of_range' FROM part WHERE p_size % 4 = 3""",
    "policy_override_problems": f"""WITH {OPS}, o AS (SELECT *, length(path) AS n, CASE WHEN length(path) % 2 = 0 THEN lower(key) ELSE key END AS k FROM ops),
f AS (SELECT k AS key, nm AS name, CASE WHEN n % 2 = 0 THEN 'bad_key' WHEN n % 3 = 0 THEN 'credential_header' WHEN n % 5 = 0 THEN 'bad_action' WHEN n % 7 = 0 THEN 'bad_enforcement' WHEN n % 11 = 0 THEN 'bad_value_policy' END AS problem
  FROM o, unnest(CASE WHEN n % 3 = 0 THEN ['Cookie'] ELSE ['X-One', 'x-one'] END) t(nm))
SELECT * FROM f WHERE problem IS NOT NULL UNION ALL SELECT k, 'x-one', 'duplicate_header' FROM o WHERE n % 3 <> 0""",
}
