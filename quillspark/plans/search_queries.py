"""Search queries over a catalog made of ``part``: each part is an operation, each distinct
name and type asks one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import search as S
from quillspark.plans import sqltext as Q
from quillspark.sources.stages import written

RANKING = S.Ranking(
    verbs={"list": ["GET"], "create": ["POST"], "update": ["PUT", "PATCH"], "delete": ["DELETE"]},
    noise=("rest",),
    hints={"ring": ["brand1", "brand2", "brand3"], "bolt": ["brand4"]},
    product_names=("brand1", "brand2"),
    singular_collection_tiebreak=False,
)
ALIASES = [("ring", "bolt"), ("blue", "red"), ("small", "promo")]
RULE_WORDS = [(0, "red"), (0, "widget")]
RULE_ADDS = [(0, "ring")]
VERBS = ["list", "create", "update", "delete"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    source = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    n = F.col("p_size") % 4
    method = F.when(n == 0, "GET").when(n == 1, "POST").when(n == 2, "PUT").otherwise("DELETE")
    path = F.concat(F.lit("/rest/"), F.lower("p_type"), F.lit("/parts/p"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, "/{partId}").otherwise(""))
    rows = p.select(source.alias("source"), method.alias("method"), path.alias("path"), F.concat(F.lower(method), F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("operation_id"), F.col("p_name").alias("summary"), F.lit(None).cast("string").alias("description"), F.array("p_type").alias("tags"), (F.col("p_size") % 10 == 0).alias("deprecated"), F.array().cast("array<string>").alias("schema_names"))
    return rows.withColumn("key", F.concat_ws(":", "source", "method", "path"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    verb = F.element_at(F.array(*map(F.lit, VERBS)), F.length("p_name") % 4 + 1)
    return p.select(F.concat_ws("/", "p_name", "p_type").alias("query_id"), F.concat_ws(" ", verb, F.col("p_name"), F.lower("p_type")).alias("query"))


def aliases(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    values = lambda rows, names: spark.sql("SELECT * FROM VALUES " + ", ".join(f"({', '.join(repr(v) for v in r)})" for r in rows) + f" AS t({names})")
    return values(ALIASES, "word, target"), values(RULE_WORDS, "rule_id, word"), values(RULE_ADDS, "rule_id, target")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(operations(spark, sf_dir)).select("token", "key", F.col("weight").cast("long").alias("weight"), "terminal")


def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.expand(queries(spark, sf_dir), *aliases(spark))


def grouped_lexical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, S.Alike, DataFrame]:
    """Queries, their tokens, groups of operations, and the lexical scores of their heads."""
    q = written(queries(spark, sf_dir))
    tokens = written(S.expand(q, *aliases(spark)))
    groups = S.alike(operations(spark, sf_dir), tokens, RANKING)
    return q, tokens, groups, S.lexical(q, tokens, groups.index, RANKING)


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, groups, lex = grouped_lexical(spark, sf_dir)
    return S.of_members(lex, groups).select("query_id", "key", "lexical")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, tokens, groups, lex = grouped_lexical(spark, sf_dir)
    s = S.of_members(S.score(lex, S.query_features(q, tokens, RANKING), groups.heads, RANKING).drop("signals"), groups)
    return s.select("query_id", "key", "lexical", "structural", "final", F.col("tier").cast("int").alias("tier"), F.col("tie").cast("int").alias("tie"))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.search(queries(spark, sf_dir), operations(spark, sf_dir), RANKING, 10, *aliases(spark))
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "key", "score", F.col("total_matches").cast("long").alias("total_matches"))


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation's key and id as a query of its own; ids in upper case for odd parts."""
    ops = operations(spark, sf_dir)
    odd = F.length("path") % 2 == 1
    q = ops.select(F.concat(F.lit("k:"), F.col("key")).alias("query_id"), F.col("key").alias("query")).union(ops.select(F.concat(F.lit("o:"), F.when(odd, F.upper("operation_id")).otherwise(F.col("operation_id"))), F.when(odd, F.upper("operation_id")).otherwise(F.col("operation_id"))).distinct())
    return S.exact_pins(q, S.features(ops, RANKING.noise)).groupBy("query_id", "match").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def concept_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.concept_vocabulary(operations(spark, sf_dir), RANKING.noise)


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    concepts = S.concept_vocabulary(ops, RANKING.noise)
    return S.query_heads(queries(spark, sf_dir), concepts, RANKING)


def abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, ops = queries(spark, sf_dir), operations(spark, sf_dir)
    top = S.search(q, ops, RANKING, 1, *aliases(spark))
    return S.abstain(top, q, ops, RANKING, aliases(spark)[0])


QUERIES = {
    "search_top_k": top_k, "search_postings": postings, "search_expand": expand, "search_lexical": lexical, "search_scores": scores,
    "search_exact_pins": pins, "search_concepts": concept_words, "search_heads": heads, "search_abstain": abstain,
}

# ---- SQL ------------------------------------------------------------------------------------

_VALUES = lambda rows: ", ".join(f"({', '.join(repr(v) for v in r)})" for r in rows)

OPS = """
ops AS (
  SELECT source || ':' || method || ':' || path AS key, * FROM (
    SELECT lower(replace(p_brand, '#', '')) AS source, m.method,
           '/rest/' || lower(p_type) || '/parts/p' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '/{partId}' ELSE '' END AS path,
           lower(m.method) || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') AS operation_id,
           p_name AS summary, [p_type] AS tags, p_type, p_name, p_size % 10 = 0 AS deprecated
    FROM part, LATERAL (SELECT ['GET', 'POST', 'PUT', 'DELETE'][p_size % 4 + 1] AS method) m))"""

QS = f"""
qs AS (
  SELECT DISTINCT p_name || '/' || p_type AS query_id,
         {VERBS!r}[length(p_name) % 4 + 1] || ' ' || p_name || ' ' || lower(p_type) AS query FROM part)"""

_LAST = f"list_filter({Q.unigrams('''list_extract(''' + Q.segments('path') + ''', -1)''')}, lambda t: NOT regexp_matches(t, '^[0-9]+$'))"

POSTINGS = f"""
fields AS (
  SELECT key, unnest({Q.token_set('operation_id')}) AS token, 5 AS w FROM ops UNION ALL
  SELECT key, unnest({Q.token_set('summary')}), 4 FROM ops UNION ALL
  SELECT key, unnest({Q.token_set('tags[1]')}), 3 FROM ops UNION ALL
  SELECT key, unnest({Q.token_set('path')}), 3 FROM ops UNION ALL
  SELECT key, lower(method), 1 FROM ops),
lasts AS (SELECT key, {Q.forms(_LAST)} AS last_forms FROM ops),
post AS (
  SELECT token, key, sum(w)::BIGINT AS weight, any_value(list_contains(last_forms, token)) AS terminal
  FROM fields JOIN lasts USING (key) GROUP BY token, key)"""

EXPAND = f"""
alias(word, target) AS (VALUES {_VALUES(ALIASES)}), rule_word(rule_id, word) AS (VALUES {_VALUES(RULE_WORDS)}), rule_add(rule_id, target) AS (VALUES {_VALUES(RULE_ADDS)}),
base AS (SELECT query_id, unnest({Q.token_set('query')}) AS token FROM qs),
direct AS (
  SELECT DISTINCT query_id, unnest({Q.forms('[target]')}) AS token FROM base JOIN alias ON token = word EXCEPT SELECT query_id, token FROM base),
seen AS (SELECT * FROM base UNION SELECT * FROM direct),
fired AS (
  SELECT query_id, rule_id FROM (SELECT query_id, rule_id, count(DISTINCT word) AS got FROM seen JOIN rule_word ON token = word GROUP BY query_id, rule_id)
  JOIN (SELECT rule_id, count(DISTINCT word) AS size FROM rule_word GROUP BY rule_id) USING (rule_id) WHERE got = size),
cond AS (SELECT DISTINCT query_id, unnest({Q.forms('[target]')}) AS token FROM fired JOIN rule_add USING (rule_id) EXCEPT SELECT * FROM seen),
toks AS (
  SELECT *, 'base' AS kind FROM base UNION ALL SELECT *, 'direct' FROM direct UNION ALL SELECT *, 'cond' FROM cond)"""

LEXICAL = f"""
hits AS (SELECT query_id, key, token, kind, weight, terminal FROM toks JOIN post USING (token)),
sums AS (
  SELECT query_id, key, sum(CASE WHEN kind = 'base' OR terminal THEN weight ELSE 0 END) AS whole,
         sum(CASE WHEN kind = 'direct' AND NOT terminal THEN weight ELSE 0 END) AS direct,
         sum(CASE WHEN kind = 'cond' AND NOT terminal THEN weight ELSE 0 END) AS cond FROM hits GROUP BY ALL),
qwords AS (SELECT query_id, unnest({Q.unigrams('query')}) AS w FROM qs),
n_words AS (SELECT query_id, count(*) AS n FROM qwords GROUP BY ALL),
met AS (
  SELECT h.query_id, h.key, count(DISTINCT w) AS n FROM hits h JOIN qwords q ON h.query_id = q.query_id AND (token = w OR token = {Q.singular('w')})
  WHERE kind = 'base' GROUP BY ALL),
lex AS (
  SELECT query_id, key, whole + 0.5::DOUBLE * direct + 1.0::DOUBLE * cond + CASE WHEN m.n = n_words.n THEN 2 ELSE 0 END AS lexical
  FROM sums LEFT JOIN met m USING (query_id, key) JOIN n_words USING (query_id) WHERE whole + direct + cond > 0)"""

_MET = lambda o: f"list_has_any([{o}, {Q.singular(o)}], expanded)"
_HINTS = "CASE WHEN list_contains(ws, 'ring') THEN ['brand1', 'brand2', 'brand3'] ELSE [] END || CASE WHEN list_contains(ws, 'bolt') THEN ['brand4'] ELSE [] END"
SCORES = f"""
qf AS (
  SELECT query_id, ws, expanded, {_HINTS} AS hinted,
         CASE WHEN list_contains(ws, 'list') THEN ['GET'] WHEN list_contains(ws, 'create') THEN ['POST'] WHEN list_contains(ws, 'update') THEN ['PUT', 'PATCH'] ELSE ['DELETE'] END AS allowed
  FROM (SELECT query_id, {Q.unigrams('query')} AS ws FROM qs) JOIN (SELECT query_id, list(DISTINCT token) AS expanded FROM toks GROUP BY ALL) USING (query_id)),
of AS (
  SELECT key, source, method, deprecated, {_LAST} AS last,
         list_filter(list_distinct(flatten(list_transform({Q.segments('path')}, lambda s: {Q.unigrams('s')}))), lambda t: t <> 'rest') AS origins FROM ops),
signal AS (
  SELECT query_id, key, lexical, deprecated, method, allowed,
         CASE WHEN list_contains(allowed, method) THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END
         - least(len(list_filter(origins, lambda o: NOT {_MET('o')})), 3) * 1.0::DOUBLE
         + CASE WHEN list_contains(hinted, source) THEN 3.0::DOUBLE ELSE 0 END
         + CASE WHEN len(last) > 0 AND len(list_filter(last, lambda o: {_MET('o')})) = len(last) THEN 10.0::DOUBLE ELSE 0 END AS structural
  FROM lex JOIN of USING (key) JOIN qf USING (query_id)),
scored AS (
  SELECT query_id, key, lexical::DOUBLE AS lexical, structural::DOUBLE AS structural, deprecated,
         greatest(lexical + structural, 0) * CASE WHEN deprecated THEN 0.7::DOUBLE ELSE 1 END AS final,
         CASE WHEN list_contains(allowed, method) THEN 0 ELSE 1 END AS tier, CASE WHEN method <> allowed[1] THEN 1 ELSE 0 END AS tie FROM signal
  WHERE greatest(lexical + structural, 0) > 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, final DESC, tie, deprecated, key)::INT AS rank, key, final AS score,
         count(*) OVER (PARTITION BY query_id) AS total_matches FROM scored)"""

_ALL = f"WITH {OPS}, {QS}, {POSTINGS}, {EXPAND}, {LEXICAL}, {SCORES}"
RANKED = _ALL


def RANKED_OF(ops: str, qs: str = QS, expand: str = EXPAND, lexical: str = LEXICAL, scores: str = SCORES) -> str:
    """The same with other parts: ends in ``scored`` and ``ranked``."""
    return f"WITH {ops}, {qs}, {POSTINGS}, {expand}, {lexical}, {scores}"

_VOCAB = f"list_distinct({Q.token_set('operation_id')} || {Q.token_set('summary')} || {Q.forms('''list_filter(flatten(list_transform(''' + Q.segments('path') + ''', lambda s: ''' + Q.unigrams('s') + ''')), lambda t: NOT regexp_matches(t, '^[0-9]+$'))''')} || {Q.token_set('tags[1]')})"
_CONCEPTS = f"""
concept AS (
  SELECT DISTINCT {Q.singular('t')} AS concept FROM (
    SELECT unnest(flatten(list_transform({Q.segments('path')}, lambda s: {Q.unigrams('s')}))) AS t FROM ops) WHERE t <> 'rest' AND NOT regexp_matches(t, '^[0-9]+$')
  UNION SELECT {Q.singular('t')} FROM (SELECT unnest({Q.unigrams('tags[1]')}) AS t FROM ops))"""
_NAMES = Q.words([*RANKING.verbs, *RANKING.product_names])
_HEADS = f"""
qpos AS (
  SELECT query_id, unnest(string_split(query, ' ')) AS token, generate_subscripts(string_split(query, ' '), 1) AS pos FROM qs),
head AS (
  SELECT query_id, arg_max(concept, pos) AS concept, arg_max(token, pos) AS token FROM (
    SELECT query_id, pos, token, {Q.singular('token')} AS concept FROM qpos WHERE token NOT IN {_NAMES} AND token NOT IN {Q.words(Q.STOPWORDS)} AND length(token) >= 2)
  JOIN concept USING (concept) GROUP BY query_id)"""

SQL = {
    "search_top_k": f"{_ALL} SELECT * FROM ranked WHERE rank <= 10",
    "search_postings": f"WITH {OPS}, {POSTINGS} SELECT * FROM post",
    "search_expand": f"WITH {QS}, {EXPAND} SELECT * FROM toks",
    "search_lexical": f"WITH {OPS}, {QS}, {POSTINGS}, {EXPAND}, {LEXICAL} SELECT query_id, key, lexical::DOUBLE AS lexical FROM lex",
    "search_scores": f"{_ALL} SELECT query_id, key, lexical, structural, final, tier, tie FROM scored",
    "search_exact_pins": f"""
WITH {OPS}, q AS (
  SELECT 'k:' || key AS query_id, key AS q FROM ops UNION
  SELECT DISTINCT 'o:' || o, o FROM (SELECT CASE WHEN length(path) % 2 = 1 THEN upper(operation_id) ELSE operation_id END AS o FROM ops)),
hit AS (
  SELECT query_id, key, min(m) AS match FROM (
    SELECT query_id, key, 'exact_key' AS m FROM q JOIN ops ON q = key UNION ALL
    SELECT query_id, key, 'exact_operation_id' FROM q JOIN ops ON q = operation_id) GROUP BY ALL),
loose AS (
  SELECT query_id, key, 'exact_operation_id_ci' AS match FROM q JOIN ops ON lower(q) = lower(operation_id) WHERE query_id NOT IN (SELECT query_id FROM hit))
SELECT query_id, match, count(*) AS n, min(key) AS first_key FROM (SELECT * FROM hit UNION ALL SELECT * FROM loose) GROUP BY query_id, match""",
    "search_concepts": f"WITH {OPS}, {_CONCEPTS} SELECT concept FROM concept",
    "search_heads": f"""WITH {OPS}, {QS}, {_CONCEPTS}, {_HEADS}
SELECT query_id, concept, token, CASE WHEN token = concept THEN 'singular' WHEN token IN (concept || 's', concept || 'es') THEN 'plural' ELSE 'unknown' END AS number FROM head""",
    "search_abstain": f"""{_ALL}, {_CONCEPTS}, {_HEADS},
top AS (SELECT query_id, key FROM ranked WHERE rank = 1),
vocab AS (SELECT key, source, method, {_VOCAB} AS v FROM ops),
part1 AS (
  SELECT query_id, t, role FROM (
    SELECT query_id, unnest(list_filter({Q.unigrams('query')}, lambda t: t NOT IN {_NAMES})) AS t, 'content' AS role FROM qs UNION ALL SELECT query_id, concept, 'object' FROM head)),
form AS (SELECT query_id, role, unnest({Q.forms('[t]')}) AS f FROM part1),
form2 AS (SELECT * FROM form UNION SELECT query_id, role, unnest({Q.forms('[target]')}) FROM form JOIN alias ON f = word),
have AS (
  SELECT query_id, bool_or(role = 'content' AND list_contains(v, f)) AS evidence, bool_or(role = 'object' AND list_contains(v, f)) AS object_covered
  FROM form2 JOIN top USING (query_id) JOIN vocab USING (key) GROUP BY ALL),
joined AS (
  SELECT qs.query_id, top.key, evidence, object_covered, hinted, source, method, head.concept
  FROM qs LEFT JOIN top USING (query_id) LEFT JOIN have USING (query_id) LEFT JOIN vocab USING (key) LEFT JOIN qf USING (query_id) LEFT JOIN head ON head.query_id = qs.query_id),
why AS (
  SELECT *, CASE WHEN key IS NULL THEN NULL WHEN NOT coalesce(evidence, false) THEN 'no_resource_evidence' WHEN len(hinted) > 0 AND NOT list_contains(hinted, source) THEN 'product_conflict'
            WHEN method <> 'GET' AND concept IS NOT NULL AND NOT coalesce(object_covered, false) THEN 'uncovered_head_resource' END AS abstain_reason FROM joined)
SELECT query_id, abstain_reason, abstain_reason IS NULL AS actionable, CASE WHEN abstain_reason IS NULL THEN key END AS recommended_operation FROM why""",
}
