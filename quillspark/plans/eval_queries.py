"""Evaluation queries: records made of parts, judged by the search over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import counterfactual as C
from quillspark.operators import evaluation as E
from quillspark.operators import lexicon as X
from quillspark.operators import search as S
from quillspark.operators import tuning as N
from quillspark.plans import search_queries as B
from quillspark.sources.stages import written

SECTIONS = ["held_out", "negative", "seed", "regression_positive", "regression_negative"]
WRITES = B.Q.words(E.WRITE_METHODS)
AXES = {
    "method_match_bonus": [1.0, 2.0], "method_mismatch_penalty": [2.0, 4.0], "path_unmatched_penalty": [0.5, 1.0], "path_unmatched_cap": [2.0, 3.0],
    "product_hint_bonus": [2.0, 3.0], "resource_match_bonus": [5.0, 10.0], "method_order_bonus": [0.0, 1.0], "path_coverage_bonus": [0.0, 0.5],
}
BASELINE = {"method_match_bonus": 2.0, "method_mismatch_penalty": 2.0, "path_unmatched_penalty": 1.0, "path_unmatched_cap": 3.0, "product_hint_bonus": 3.0, "resource_match_bonus": 10.0, "method_order_bonus": 0.0, "path_coverage_bonus": 0.0}
BASE_POINT = "|".join(map(str, BASELINE.values()))


def records(spark: SparkSession, sf_dir: str, shown: DataFrame | None = None) -> DataFrame:
    """One record for each query: it expects the parts of its name whose method fits its verb,
    and forbids the others; negatives expect nothing.

    With ``shown`` (key) a list holds its smallest key and those of ``shown``, which is all that
    a judgement of shown keys looks at: whether a list has any, and whether it has these."""
    q = B.queries(spark, sf_dir).select("query_id", "query", F.split("query_id", "/")[0].alias("summary"), F.split("query", " ")[0].alias("verb"))
    ops = B.operations(spark, sf_dir).select("summary", "key", "method")
    fits = F.element_at(F.create_map(*[x for v, m in B.RANKING.verbs.items() for x in (F.lit(v), F.lit(m[0]))]), F.col("verb")) == F.col("method")
    listed = F.collect_list("key")
    if shown is not None:
        ops = ops.join(shown.select("key", F.lit(True).alias("_shown")).distinct(), "key", "left")
        listed = F.array_distinct(F.array_append(F.collect_list(F.when(F.col("_shown"), F.col("key"))), F.min("key")))
    ops = ops.groupBy("summary", "method").agg(listed.alias("keys"))
    keys = lambda c: F.array_sort(F.flatten(F.collect_list(F.when(c, F.col("keys")))))
    per = q.join(ops, "summary").groupBy("query_id", "query", "summary").agg(keys(fits).alias("expected"), keys(~fits).alias("forbidden"))
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), F.length("query_id") % 5 + 1)
    negative = section.isin(*E.NEGATIVE_SECTIONS)
    return per.select(section.alias("section"), F.col("query_id").alias("id"), "query", F.when(negative, F.array().cast("array<string>")).otherwise(F.col("expected")).alias("expected"), F.when(negative, F.col("expected")).otherwise(F.col("forbidden")).alias("forbidden"), F.lit("seed-r1").alias("origin"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(B.queries(spark, sf_dir), B.operations(spark, sf_dir), B.RANKING, 3, *B.aliases(spark))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key is recommended unless its score is below 30; short queries aren't eligible."""
    r = written(_ranked(spark, sf_dir).select("query_id", "rank", "key", "score"))
    top = r.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key", "score"))), lambda x: F.struct(x["key"].alias("key"), x["score"].alias("score"))).alias("t"))
    shown = top.select("id", F.transform("t", lambda x: x["key"]).alias("keys"), F.when(F.get("t", F.lit(0))["score"] >= 30, F.get("t", F.lit(0))["key"]).alias("recommended"), (F.length("id") >= 14).alias("eligible"))
    return E.usage(records(spark, sf_dir, r), shown)


def invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.invalid_records(records(spark, sf_dir)).groupBy("section", "problem").agg(F.count("*").alias("n"))


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    top1 = written(_ranked(spark, sf_dir).where("rank = 1").select(F.col("query_id").alias("id"), "key", (F.col("score") >= 30).alias("actionable")))
    return E.judge_totals(E.judge(records(spark, sf_dir, top1), top1))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir)


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gate(_usage(spark, sf_dir))


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.training_vector(_usage(spark, sf_dir)).withColumn("accepted", E.accepted())


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _usage(spark, sf_dir).where(F.col("section").isin("seed", "regression_positive", "regression_negative"))
    return u.groupBy("section").agg(F.count_if(E.violation()).alias("violations"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, key, features): everything a grid point needs, made once; of operations that no
    query tells apart the smallest key."""
    q, tokens, groups, lex = B.grouped_lexical(spark, sf_dir)
    return S.grid_features(lex, S.query_features(q, tokens, B.RANKING), groups.heads, B.RANKING)


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = {k: spark.sql(f"SELECT * FROM VALUES {', '.join(f'(double({v}))' for v in vs)} AS t({k})") for k, vs in AXES.items()}
    points = E.grid_points(axes).withColumn("point_id", F.concat_ws("|", *AXES))
    return E.sweep(_candidates(spark, sf_dir), points)


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


def select_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the points that keep the fixtures (seeds that are right at the baseline),
    each query's best key taken as its recommendation; the choice."""
    chosen = written(_best(spark, sf_dir))
    every = written(chosen.join(records(spark, sf_dir, chosen), F.col("query_id") == F.col("id")))
    no = F.lit(False)
    hit = F.coalesce(F.array_contains("expected", F.col("key")), no)
    fixtures = every.where((F.col("section") == "seed") & (F.col("point_id") == BASE_POINT) & hit).select("query_id", F.col("expected").alias("keys"))
    best = every.join(E.passing_points(every, fixtures), "point_id", "left_semi")
    rows = best.select("point_id", "section", hit.alias("top3"), F.lit(False).alias("abstained"), hit.alias("rec_correct"), (~hit & F.split("key", ":")[1].isin(*E.WRITE_METHODS)).alias("wrong_write"), F.coalesce(F.array_contains("forbidden", F.col("key")), no).alias("forbidden_recommended"), F.lit(True).alias("eligible"))
    v = E.training_vector(rows, ["point_id"])
    for i, k in enumerate(AXES):
        v = v.withColumn(k, F.split("point_id", r"\|")[i].cast("double"))
    return E.select_point(v, AXES, BASELINE).select("point_id", "wv", "fr", "sr3", "accepted")


def _self_search(spark: SparkSession, sf_dir: str, ranking: S.Ranking, variant: str) -> DataFrame:
    ops = B.operations(spark, sf_dir)
    q = ops.groupBy("summary", "method").agg(F.min("key").alias("expected")).select(F.concat_ws("/", "summary", "method").alias("query_id"), "expected", F.concat_ws(" ", F.lower("method"), F.lower("summary")).alias("query"))
    top = S.search(q, ops, ranking, 1, *B.aliases(spark)).select("query_id", "key")
    return q.join(top, "query_id", "left").select(F.lit(variant).alias("variant"), "query_id", "expected", "key")


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {"verbs": {"get": ["GET"], "post": ["POST"], "put": ["PUT"], "delete": ["DELETE"]}, "noise": ("rest",), "singular_collection_tiebreak": False}
    off = S.Ranking(**base, intent_tier=False, preferred_method_tiebreak=False, terminal_alias_full_weight=False)
    on = _self_search(spark, sf_dir, S.Ranking(**base), "all").union(_self_search(spark, sf_dir, S.Ranking(**base, intent_tier=False), "no_tier"))
    return E.compare_runs(_self_search(spark, sf_dir, off, "off"), on)


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings with and without aliases compared."""
    q, ops = B.queries(spark, sf_dir), B.operations(spark, sf_dir)
    run = lambda a: S.search(q, ops, B.RANKING, 3, *a).select("query_id", F.col("rank").cast("int").alias("rank"), "key", "score")
    return E.ranking_differences(run(B.aliases(spark)), run(()))


def _base(spark: SparkSession, sf_dir: str, targets: DataFrame, limit: int) -> C.Base:
    return C.store(B.queries(spark, sf_dir), B.operations(spark, sf_dir), B.RANKING, *B.aliases(spark), targets, limit)


def _shown(tops: DataFrame) -> DataFrame:
    """As in ``_usage``: the first key is recommended unless its score is below 30."""
    top = tops.groupBy("trial_id", F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "key", "score"))).alias("t"))
    return top.select("trial_id", "id", F.transform("t", lambda x: x["key"]).alias("keys"), F.when(F.get("t", F.lit(0))["score"] >= 30, F.get("t", F.lit(0))["key"]).alias("recommended"), (F.length("id") >= 14).alias("eligible"))


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, reason): a word of part names as a synonym of the first word that follows it in
    one; whether records that hold it lack the target, and whether merging it alone turns a
    right first result wrong."""
    words = B.read(spark, sf_dir, "part").select(T.singular_tokens("p_name").alias("w"))
    pairs = words.select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("key"), F.get("w", i + 1).alias("target")))).alias("p")).select("p.*").where("target is not null")
    lex = pairs.groupBy("key").agg(F.array(F.min("target")).alias("targets"))
    lex = written(lex)
    base = _base(spark, sf_dir, lex.select(F.explode("targets").alias("target")), 1)
    # a first result is the head of its group, or a pin, which is one
    flips = C.flipped(base, lex, records(spark, sf_dir, base.op_rows))
    return X.benchmark_gate(lex, records(spark, sf_dir), B.operations(spark, sf_dir), B.RANKING.noise, flips.select("key").distinct())


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases for records that call for a change: a word of the part's name may stand for the
    part itself, as its path names it; the first that helps and harms nothing is accepted."""
    least = records(spark, sf_dir, spark.createDataFrame([], "key string"))
    word = F.explode(T.singular_tokens(F.split("id", "/")[0])).alias("word")
    acts = written(least.where(F.size("expected") > 0).select("id", word, F.regexp_extract(F.col("expected")[0], "/(p[0-9]+)", 1).alias("target")))
    base = _base(spark, sf_dir, acts.select("target"), 3)
    shown = base.groups.firsts.select(F.explode("first.key").alias("key"))
    return N.propose_over(base, written(records(spark, sf_dir, shown)), acts, _shown, budget=1, per_record=1)


QUERIES = {
    "lexicon_regressions": regressions, "eval_alias_proposals": proposals,
    "eval_invalid_records": invalid, "eval_judge": judge, "eval_usage": usage, "eval_gate": gate, "eval_training_vector": vector, "eval_violations": violations,
    "eval_grid_sweep": sweep, "eval_select_point": select_point, "eval_ablation": ablation, "eval_ranking_differences": regression,
}

_REC = f"""
er AS (
  SELECT query_id AS id, query, {SECTIONS!r}[length(query_id) % 5 + 1] AS section, expected0, forbidden0 FROM (
    SELECT query_id, query, coalesce(list_sort(list(key) FILTER (method = verb)), []) AS expected0, coalesce(list_sort(list(key) FILTER (method <> verb)), []) AS forbidden0
    FROM (SELECT query_id, query, split_part(query_id, '/', 1) AS summary, CASE split_part(query, ' ', 1) WHEN 'list' THEN 'GET' WHEN 'create' THEN 'POST' WHEN 'update' THEN 'PUT' ELSE 'DELETE' END AS verb FROM qs) JOIN ops USING (summary) GROUP BY ALL)),
records AS (
  SELECT section, id, query, CASE WHEN section LIKE '%negative' THEN [] ELSE expected0 END AS expected, CASE WHEN section LIKE '%negative' THEN expected0 ELSE forbidden0 END AS forbidden FROM er)"""
_USE = f"""
shown AS (
  SELECT query_id AS id, list(key ORDER BY rank) AS keys, CASE WHEN max(score) FILTER (rank = 1) >= 30 THEN max(key) FILTER (rank = 1) END AS recommended FROM ranked WHERE rank <= 3 GROUP BY 1),
usage AS (
  SELECT section, id, keys[1] AS top1, coalesce(list_contains(expected, keys[1]), false) AS top1_correct, list_has_any(expected, coalesce(keys, [])) AS top3, recommended, recommended IS NULL AS abstained,
         coalesce(list_contains(expected, recommended), false) AS rec_correct,
         coalesce(recommended IS NOT NULL AND NOT list_contains(expected, recommended) AND string_split(recommended, ':')[2] IN {WRITES}, false) AS wrong_write,
         coalesce(list_contains(forbidden, recommended), false) AS forbidden_recommended, length(id) >= 14 AS eligible
  FROM records LEFT JOIN shown USING (id))"""
_BASE = f"{B.RANKED}, {_REC}"
_VEC = """count(*) FILTER (t AND wrong_write) AS wv, count(*) FILTER (t AND forbidden_recommended) AS fr, count(*) FILTER (section IN ('seed', 'regression_positive') AND NOT eligible AND NOT abstained) AS ir,
  count(*) FILTER (section = 'seed' AND top3) AS sr3, count(*) FILTER (section = 'seed' AND NOT abstained) AS src, count(*) FILTER (section = 'seed' AND rec_correct) AS srk,
  count(*) FILTER (section = 'regression_positive' AND top3) AS rp3, count(*) FILTER (section = 'regression_positive' AND rec_correct) AS rpk, count(*) FILTER (section = 'regression_negative' AND abstained) AS nab,
  count(*) FILTER (section = 'seed') AS n_seed, count(*) FILTER (section = 'regression_positive') AS n_rp, count(*) FILTER (section = 'regression_negative') AS n_rn,
  count(*) FILTER (section = 'seed' AND eligible) AS n_seed_elig, count(*) FILTER (section = 'regression_positive' AND eligible) AS n_rp_elig"""
_T = "section IN ('seed', 'regression_positive', 'regression_negative') AS t"
_ACC = "wv = 0 AND fr = 0 AND ir = 0 AND 10 * sr3 >= 9 * n_seed AND 10 * src >= 9 * n_seed_elig AND 10 * srk >= 9 * src AND rp3 = n_rp AND rpk = n_rp_elig AND 8 * nab >= 7 * n_rn"
_POINTS = ", ".join(f"(SELECT unnest({vs})::DOUBLE AS {k})" for k, vs in AXES.items())
_GRID = f"""
pt AS (SELECT concat_ws('|', {', '.join(f'{k}::VARCHAR' for k in AXES)}) AS point_id, * FROM {_POINTS}),
cand AS (
  SELECT query_id, min(key) AS key, lexical, fits, unmatched, hint, res, first, covered, deprecated, tie FROM (
    SELECT query_id, key, lexical, list_contains(allowed, method) AS fits, len(list_filter(origins, lambda o: NOT {B._MET('o')})) AS unmatched, list_contains(hinted, source) AS hint,
           len(last) > 0 AND len(list_filter(last, lambda o: {B._MET('o')})) = len(last) AS res, method = allowed[1] AS first, len(list_filter(origins, lambda o: {B._MET('o')})) AS covered, deprecated,
           CASE WHEN method <> allowed[1] THEN 1 ELSE 0 END AS tie FROM lex JOIN of USING (key) JOIN qf USING (query_id)) GROUP BY ALL),
pts AS (
  SELECT point_id, query_id, key, CASE WHEN fits THEN 0 ELSE 1 END AS tier, tie, deprecated,
         greatest(lexical + (CASE WHEN fits THEN method_match_bonus ELSE -method_mismatch_penalty END - least(unmatched, path_unmatched_cap) * path_unmatched_penalty + CASE WHEN hint THEN product_hint_bonus ELSE 0 END
           + CASE WHEN res THEN resource_match_bonus ELSE 0 END + CASE WHEN first THEN method_order_bonus ELSE 0 END + covered * path_coverage_bonus), 0) * CASE WHEN deprecated THEN 0.7::DOUBLE ELSE 1 END AS final FROM cand, pt),
best AS (SELECT point_id, query_id, arg_min(key, (tier, -final, tie, deprecated, key)) AS key, arg_min(final, (tier, -final, tie, deprecated, key))::DOUBLE AS best_final FROM pts WHERE final > 0 GROUP BY ALL)"""
_SELF = """
qs AS (SELECT summary || '/' || method AS query_id, lower(method) || ' ' || lower(summary) AS query, min(key) AS expected FROM ops GROUP BY summary, method)"""
_NO_HINTS = B.SCORES.replace(B._HINTS, "[]::VARCHAR[]").replace("CASE WHEN list_contains(ws, 'list') THEN ['GET'] WHEN list_contains(ws, 'create') THEN ['POST'] WHEN list_contains(ws, 'update') THEN ['PUT', 'PATCH'] ELSE ['DELETE'] END", "[upper(split_part(query, ' ', 1))]").replace(f"(SELECT query_id, {B.Q.unigrams('query')} AS ws FROM qs)", f"(SELECT query_id, query, {B.Q.unigrams('query')} AS ws FROM qs)")
_FLAT = lambda s: s.replace("CASE WHEN list_contains(allowed, method) THEN 0 ELSE 1 END AS tier", "0 AS tier")
_TIED = lambda s: s.replace("CASE WHEN method <> allowed[1] THEN 1 ELSE 0 END AS tie", "0 AS tie")
_DAMPED = B.LEXICAL.replace("kind = 'base' OR terminal", "kind = 'base'").replace(" AND NOT terminal", "")
_TOP = lambda name, **parts: f"{name} AS ({B.RANKED_OF(B.OPS, _SELF, **parts)} SELECT query_id, expected, key FROM qs LEFT JOIN (SELECT query_id, key FROM ranked WHERE rank = 1) USING (query_id))"
_PLAIN = f"base AS (SELECT query_id, unnest({B.Q.token_set('query')}) AS token FROM qs), toks AS (SELECT *, 'base' AS kind FROM base)"

SQL = {
    "eval_invalid_records": f"""WITH {B.OPS}, {B.QS}, {_REC}
SELECT section, problem, count(*) AS n FROM (
  SELECT section, unnest(list_filter(['bad_id', CASE WHEN section LIKE '%negative' AND len(forbidden) = 0 THEN 'negative_shape' END, CASE WHEN section NOT LIKE '%negative' AND len(expected) = 0 THEN 'positive_shape' END], lambda x: x IS NOT NULL)) AS problem
  FROM records) GROUP BY ALL""",
    "eval_judge": f"""{_BASE}, j AS (
  SELECT section, coalesce(score >= 30, false) AS actionable, (len(expected) = 0 OR coalesce(list_contains(expected, key), false)) AND NOT coalesce(list_contains(forbidden, key), false) AS raw
  FROM records LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.query_id = id)
SELECT section, count(*) AS total, count(*) FILTER (CASE WHEN section = 'held_out' THEN raw AND actionable WHEN section LIKE '%negative' THEN raw OR NOT actionable ELSE raw END) AS passed,
       count(*) FILTER (raw) AS raw_passed, count(*) FILTER (actionable) AS actionable, count(*) FILTER (actionable AND raw) AS actionable_raw_passed, count(*) FILTER (NOT actionable) AS abstained FROM j GROUP BY section""",
    "eval_usage": f"{_BASE}, {_USE} SELECT * FROM usage",
    "eval_gate": f"""{_BASE}, {_USE}, u AS (SELECT *, section = 'held_out' AS h, section = 'negative' AS g FROM usage),
c AS (SELECT count(*) FILTER (h) AS held_out, count(*) FILTER (g) AS negative, count(*) FILTER (h AND eligible) AS held_out_eligible, count(*) FILTER (h AND top3) AS reach3, count(*) FILTER (h AND NOT abstained) AS recommended,
  count(*) FILTER (h AND rec_correct) AS correct, count(*) FILTER ((h OR g) AND wrong_write) AS wrong_writes, count(*) FILTER (g AND abstained) AS abstained, count(*) FILTER (h AND NOT eligible AND NOT abstained) AS ineligible_recommended,
  count(*) FILTER (h AND top1_correct) AS top1_correct FROM u),
m AS (SELECT *, 16 * reach3 >= 15 * held_out AS reach, 16 * recommended >= 14 * held_out_eligible AS coverage, recommended > 0 AND 10 * correct >= 9 * recommended AS precision, wrong_writes = 0 AS write_safety,
  8 * abstained >= 7 * negative AS abstention, ineligible_recommended = 0 AS eligibility FROM c)
SELECT *, reach AND coverage AND precision AND write_safety AND abstention AND eligibility AS pass FROM m""",
    "eval_training_vector": f"{_BASE}, {_USE}, v AS (SELECT {_VEC} FROM (SELECT *, {_T} FROM usage)) SELECT *, {_ACC} AS accepted FROM v",
    "eval_violations": f"""{_BASE}, {_USE} SELECT section, count(*) FILTER (wrong_write OR forbidden_recommended OR CASE WHEN section = 'regression_negative' THEN NOT abstained WHEN NOT eligible THEN NOT abstained OR NOT top3
  ELSE NOT top3 OR abstained OR NOT rec_correct END) AS violations FROM usage WHERE section IN ('seed', 'regression_positive', 'regression_negative') GROUP BY section""",
    "eval_grid_sweep": f"{_BASE}, {_GRID} SELECT * FROM best",
    "eval_select_point": f"""{_BASE}, {_GRID}, every AS (SELECT * FROM best JOIN records ON query_id = id),
fx AS (SELECT query_id, expected AS keys FROM every WHERE section = 'seed' AND point_id = '{BASE_POINT}' AND list_contains(expected, key)),
keep AS (SELECT point_id FROM every LEFT JOIN fx USING (query_id) GROUP BY 1 HAVING count(*) FILTER (list_contains(keys, key)) = (SELECT count(*) FROM fx)),
rows AS (
  SELECT point_id, section, list_contains(expected, key) AS top3, false AS abstained, list_contains(expected, key) AS rec_correct, NOT list_contains(expected, key) AND string_split(key, ':')[2] IN {WRITES} AS wrong_write,
         list_contains(forbidden, key) AS forbidden_recommended, true AS eligible FROM every JOIN keep USING (point_id)),
v AS (SELECT *, {_ACC} AS accepted FROM (SELECT point_id, {_VEC} FROM (SELECT *, {_T} FROM rows) GROUP BY point_id)),
o AS (SELECT *, {' + '.join(f"abs(list_position({AXES[k]}::DOUBLE[], {k}) - {AXES[k].index(BASELINE[k]) + 1})" for k in AXES)} AS dist FROM v JOIN pt USING (point_id))
SELECT point_id, wv, fr, sr3, accepted FROM o ORDER BY NOT accepted, CASE WHEN accepted THEN NULL ELSE (wv, fr, ir, -sr3, -srk, -src, -rp3, -rpk, -nab) END, path_coverage_bonus, method_order_bonus, dist, {' + '.join(k for k in AXES if k != 'path_unmatched_cap')}, {', '.join(AXES)} LIMIT 1""",
    "eval_ablation": f"""WITH {_TOP('off', lexical=_DAMPED, scores=_TIED(_FLAT(_NO_HINTS)))}, {_TOP('whole', scores=_NO_HINTS)}, {_TOP('flat', scores=_FLAT(_NO_HINTS))},
j AS (SELECT variant, coalesce(off.key = off.expected, false) AS was, coalesce(n.key = off.expected, false) AS now FROM off JOIN (SELECT 'all' AS variant, * FROM whole UNION ALL SELECT 'no_tier', * FROM flat) n USING (query_id)),
t AS (SELECT variant, count(*) FILTER (was) AS eligible, count(*) FILTER (was AND NOT now) AS losses, count(*) FILTER (NOT was AND now) AS gains FROM j GROUP BY 1)
SELECT *, 100 * losses <= eligible AND eligible > 0 AS ok FROM t""",
    "eval_ranking_differences": f"""WITH a AS ({B.RANKED} SELECT query_id, rank, key AS k1, score AS s1 FROM ranked WHERE rank <= 3), b AS ({B.RANKED_OF(B.OPS, expand=_PLAIN)} SELECT query_id, rank, key AS k2, score AS s2 FROM ranked WHERE rank <= 3)
SELECT query_id, min(rank) AS first_difference FROM a FULL JOIN b USING (query_id, rank) WHERE k1 IS DISTINCT FROM k2 OR s1 IS DISTINCT FROM s2 GROUP BY 1""",
}
