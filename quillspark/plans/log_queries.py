"""Log, audit and hygiene queries over ``events``, ``conversations``, ``benchmark`` and
``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import hygiene as H
from quillspark.operators import logs as L
from quillspark.plans import sqltext as Q
from quillspark.plans.search_queries import OPS, RANKING, operations, read
from quillspark.sources import tables as S
from quillspark.sources.stages import shared_folder


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are searches that show ten keys from k on; purchases are selections of key k."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase"))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("line_no"), "ts", F.when(F.col("event_type") == "view", "search").otherwise("selection").alias("kind"), F.col("user_id").cast("string").alias("session"),
        F.col("event_id").alias("call_seq"), F.when(F.col("event_type") == "purchase", k.cast("string")).alias("key"),
        F.when(F.col("event_type") == "view", F.transform(F.sequence(k, k + 9), lambda x: x.cast("string"))).alias("top"),
        F.when(F.col("event_type") == "view", k.cast("string")).alias("recommended"), (F.col("user_id") % 3).cast("string").alias("intelligence_fingerprint"),
    )


def attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.attribute(_log(spark, sf_dir)).drop("line_no")


def attribute_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In blocks of 256 lines and ranges of 8, so that most selections climb out of their block."""
    return L.attribute(_log(spark, sf_dir), 256, 8).drop("line_no")


def attribute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as JSON lines, which carry no numbers, and read again by their order."""
    log = _log(spark, sf_dir)
    lines = log.select("line_no", "kind", F.transform("top", lambda k: F.struct(k.alias("key"), F.lit(1.0).alias("score"))).alias("top"), F.col("recommended").alias("recommended_operation"), F.col("session").alias("server_session_id"), "call_seq", "key")
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    S.write_log(lines, path)
    return L.attribute(S.attribution_rows(S.read_log(spark, f"{path}/*"))).drop("line_no")


def qualifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.qualifying_verdict(_log(spark, sf_dir), "1", 100, 7)


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return L.agreement(L.attribute(log), log)


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(None).cast("string").alias("kind"), F.col("text").alias("query"), F.split("text", " ").alias("top"))
    return L.sanitize(c).select("conv_id", "turn", "kind", "query", F.array_join("top", "|").alias("top"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events: a first user turn sums up, an assistant's asks, later user turns of odd
    length approve, other roles' and every third turn call a tool."""
    c = read(spark, sf_dir, "conversations")
    n = F.length("text")
    kind = F.when(F.col("turn") == 0, "summary").when((F.col("role") == "assistant") & (n % 3 != 0), "confirm_request").when((F.col("role") == "user") & (n % 2 == 1), "user_reply").otherwise("tool_call")
    events = c.select(F.col("conv_id").alias("seq_id"), F.col("turn").alias("pos"), kind.alias("kind"), F.array(F.concat(F.lit("t"), (n % 3).cast("string"))).alias("targets"), F.when(n % 5 != 0, "approve").otherwise("reject").alias("reply"), (n % 2).cast("string").alias("content"))
    seqs = c.select(F.col("conv_id").alias("seq_id")).distinct().select("seq_id", F.when(F.col("seq_id") % 4 == 0, "reject").otherwise("approve").alias("decision"), F.array(F.lit("t0"), F.lit("t1")).alias("approved"), F.when(F.col("seq_id") % 2 == 0, "1").alias("approved_content"))
    return L.audit_confirmations(events, seqs).groupBy("seq_id", "problem").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.needles(read(spark, sf_dir, "benchmark").select(F.col("text").alias("query")))


def window_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.window_needles(read(spark, sf_dir, "benchmark"), 3, 7)


def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.scan(read(spark, sf_dir, "documents"), H.window_needles(read(spark, sf_dir, "benchmark"), quick=True))


def reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("query"), F.lit(True).alias("is_new"))
    return H.reuse(d)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each distinct part name: it expects its listed parts (of method GET)
    and forbids its deleted ones; short names are negatives, which expect nothing."""
    ops = operations(spark, sf_dir)
    keys = lambda m: F.array_sort(F.filter(F.collect_list(F.when(F.col("method") == m, F.col("key"))), lambda x: x.isNotNull()))
    per = ops.groupBy("summary").agg(keys("GET").alias("get"), keys("DELETE").alias("gone"))
    negative = F.length("summary") % 3 == 0
    return per.select(
        F.when(negative, "negative").otherwise("held_out").alias("section"), F.col("summary").alias("id"),
        F.concat_ws(" ", F.when(F.length("summary") % 2 == 0, "list").otherwise("fetch"), "summary", F.when(F.length("summary") % 5 == 0, "now and then é")).alias("query"),
        F.when(negative, F.array().cast("array<string>")).otherwise(F.col("get")).alias("expected"), F.concat(F.col("gone"), F.array(F.lit("brand0:GET:/none"))).alias("forbidden"),
    )


def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.check_records(_records(spark, sf_dir), operations(spark, sf_dir), RANKING).select("id", "rule").distinct()


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.rejections(H.check_records(_records(spark, sf_dir), operations(spark, sf_dir), RANKING))


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.distribution(_records(spark, sf_dir), ("ring", "bolt"))


def below_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distribution(spark, sf_dir)
    quotas = d.groupBy("section", "dimension").agg(F.ceil(F.avg("n")).alias("least")).join(d.select("section", "dimension", "value"), ["section", "dimension"])
    return H.below_quota(d, quotas)


QUERIES = {
    "log_attribution": attribute, "log_attribution_window": attribute_blocks, "log_attribution_lines": attribute_lines, "log_qualifying": qualifying, "log_agreement": agreement, "log_sanitize": sanitize,
    "log_confirmation_audit": audit, "hygiene_needles": needles, "hygiene_window_needles": window_needles, "hygiene_leak_scan": leak_scan, "hygiene_reuse": reuse,
    "hygiene_record_checks": record_checks, "hygiene_rejections": rejections, "hygiene_distribution": distribution, "hygiene_below_quota": below_quota,
}

# ---- SQL ------------------------------------------------------------------------------------

_LOG = """
log AS (
  SELECT event_id AS seq, user_id::VARCHAR AS session, ts, event_type, user_id % 3 AS fp, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events WHERE event_type IN ('view', 'purchase')),
att AS (
  SELECT session, p.seq AS selection_seq, p.k,
         (SELECT max(s.seq) FROM log s WHERE s.event_type = 'view' AND s.session = p.session AND s.seq < p.seq AND p.k BETWEEN s.k AND s.k + 9) AS search_seq
  FROM log p WHERE event_type = 'purchase'),
matched AS (
  SELECT a.session, a.selection_seq, a.search_seq, a.k::VARCHAR AS key, s.k = a.k AS recommended_matches FROM att a JOIN log s ON s.seq = a.search_seq)"""

_EVENTS = """
ev AS (
  SELECT conv_id AS seq_id, turn AS pos, 't' || (length(text) % 3) AS target, CASE WHEN length(text) % 5 <> 0 THEN 'approve' ELSE 'reject' END AS reply, (length(text) % 2)::VARCHAR AS content,
         CASE WHEN turn = 0 THEN 'summary' WHEN role = 'assistant' AND length(text) % 3 <> 0 THEN 'confirm_request' WHEN role = 'user' AND length(text) % 2 = 1 THEN 'user_reply' ELSE 'tool_call' END AS kind
  FROM conversations),
sq AS (SELECT DISTINCT conv_id AS seq_id, CASE WHEN conv_id % 4 = 0 THEN 'reject' ELSE 'approve' END AS decision, CASE WHEN conv_id % 2 = 0 THEN '1' END AS wanted FROM conversations),
s1 AS (SELECT seq_id, min(pos) AS p FROM ev WHERE kind = 'summary' GROUP BY 1),
s2 AS (SELECT e.seq_id, min(pos) AS p FROM ev e JOIN s1 USING (seq_id) WHERE kind = 'confirm_request' AND pos > p GROUP BY 1),
s3 AS (SELECT e.seq_id, min(pos) AS p FROM ev e JOIN s2 USING (seq_id) WHERE kind = 'user_reply' AND reply = 'approve' AND pos > p GROUP BY 1),
calls AS (SELECT e.*, decision, wanted, s3.p AS ok_from FROM ev e JOIN sq USING (seq_id) LEFT JOIN s3 USING (seq_id) WHERE kind = 'tool_call'),
cover AS (SELECT seq_id, list_sort(list(DISTINCT target)) AS c FROM calls GROUP BY 1),
problems AS (
  SELECT seq_id, pos, 'not_confirmed' AS problem FROM calls WHERE NOT coalesce(ok_from < pos, false) UNION ALL
  SELECT seq_id, pos, 'unapproved_target' FROM calls WHERE target NOT IN ('t0', 't1') UNION ALL
  SELECT seq_id, pos, 'duplicate_call' FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, target, content ORDER BY pos) AS n FROM calls) WHERE n > 1 UNION ALL
  SELECT seq_id, pos, 'content_mismatch' FROM calls WHERE wanted IS NOT NULL AND content <> wanted UNION ALL
  SELECT seq_id, NULL, 'call_after_refusal' FROM sq JOIN cover USING (seq_id) WHERE decision <> 'approve' UNION ALL
  SELECT seq_id, NULL, 'approved_but_no_call' FROM sq LEFT JOIN cover USING (seq_id) WHERE decision = 'approve' AND c IS NULL UNION ALL
  SELECT seq_id, NULL, 'target_set_mismatch' FROM sq JOIN cover USING (seq_id) WHERE decision = 'approve' AND c <> ['t0', 't1'])"""


def _windows(table: str, low: int, high: int, cols: str = "") -> str:
    return f"""SELECT DISTINCT {cols} n::INT AS n_words, sha256(array_to_string(w[i:i + n - 1], ' ')) AS sha256
  FROM (SELECT *, {Q.word_stream('text')} AS w FROM {table}), unnest(generate_series({low}, {high})) AS a(n), unnest(generate_series(1, greatest(len(w) - n + 1, 0))) AS b(i)"""


_SET = f"array_to_string(list_sort({Q.singulars(Q.unigrams('query'))}), ' ')"
_RECORDS = f"""
rec AS (
  SELECT *, {Q.unigrams('query')} AS ws FROM (
    SELECT summary AS id, CASE WHEN length(summary) % 3 = 0 THEN 'negative' ELSE 'held_out' END AS section,
           CASE WHEN length(summary) % 2 = 0 THEN 'list' ELSE 'fetch' END || ' ' || summary || CASE WHEN length(summary) % 5 = 0 THEN ' now and then é' ELSE '' END AS query,
           CASE WHEN length(summary) % 3 = 0 THEN [] ELSE coalesce(list_sort(list(key) FILTER (method = 'GET')), []) END AS expected,
           coalesce(list_sort(list(key) FILTER (method = 'DELETE')), []) || ['brand0:GET:/none'] AS forbidden FROM ops GROUP BY summary))"""
_CONTENT = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN {Q.words(T.STOPWORDS)})"
_PHRASE = lambda x: f"array_to_string(list_transform(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN {Q.words(T.STOPWORDS)}), lambda t: {Q.singular('t')}), ' ')"
_CHECKS = f"""
broken AS (
  SELECT id, 'words' AS rule FROM rec WHERE len(list_filter(string_split(query, ' '), lambda x: x <> '')) NOT BETWEEN 3 AND 7 UNION
  SELECT id, 'ascii' FROM rec WHERE NOT regexp_matches(query, '^[A-Za-z0-9 ''\\-]+$') UNION
  SELECT id, 'schema' FROM rec WHERE section = 'held_out' AND len(expected) = 0 UNION
  SELECT id, 'actionable' FROM rec WHERE section = 'held_out' AND (NOT list_contains(ws, 'list') OR len(expected) = 0) UNION
  SELECT id, 'catalog' FROM rec UNION
  SELECT r.id, 'operationId' FROM rec r JOIN (SELECT DISTINCT list_sort({Q.singulars(Q.unigrams('operation_id'))}) AS k FROM ops) o ON list_sort({Q.singulars('r.ws')}) = k UNION
  SELECT id, 'summary/tags' FROM (
    SELECT id, unnest(list_zip(c[:-2], c[2:])) AS b, s FROM (SELECT id, {_CONTENT('query')} AS c, {_CONTENT('id')} AS s FROM rec WHERE len(expected) > 0)) WHERE list_contains(list_zip(s[:-2], s[2:]), b) UNION
  SELECT r.id, 'negative-phrase' FROM rec r JOIN (
    SELECT DISTINCT unnest([{_PHRASE('summary')}, {_PHRASE('list_extract(' + Q.segments('path') + ', -1)')}]) AS p FROM ops) ON {_PHRASE('query')} = p WHERE section = 'negative')"""
_DIST = """
dist AS (
  SELECT section, dimension, value, count(*) AS n FROM (
    SELECT section, unnest(['source', 'method', 'product_named']) AS dimension, unnest([string_split(k, ':')[1], string_split(k, ':')[2], (list_has_any(ws, ['ring', 'bolt']))::VARCHAR]) AS value
    FROM (SELECT *, CASE WHEN section = 'negative' THEN forbidden[1] ELSE expected[1] END AS k FROM rec)) WHERE value IS NOT NULL GROUP BY ALL)"""

SQL = {
    "log_attribution": f"WITH {_LOG} SELECT * FROM matched",
    "log_attribution_window": f"WITH {_LOG} SELECT * FROM matched",
    "log_attribution_lines": f"WITH {_LOG} SELECT * FROM matched",
    "log_qualifying": f"""WITH {_LOG}, q AS (SELECT count(*) AS records, coalesce(floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT, 0) AS span_seconds FROM log WHERE event_type = 'view' AND fp = 1)
SELECT *, records >= 100 AND span_seconds >= 604800 AS sufficient FROM q""",
    "log_agreement": f"""WITH {_LOG} SELECT count(*) AS selections, count(*) FILTER (recommended_matches) AS agreeing,
CASE WHEN count(*) > 0 THEN (count(*) FILTER (recommended_matches))::DOUBLE / count(*) END AS agreement, 0::BIGINT AS write_recommendations FROM matched""",
    "log_sanitize": r"SELECT conv_id, turn, 'search' AS kind, left(regexp_replace(text, '[\x00-\x1f]', ' ', 'g'), 2048) AS query, array_to_string(string_split(text, ' ')[1:10], '|') AS top FROM conversations",
    "log_confirmation_audit": f"WITH {_EVENTS} SELECT seq_id, problem, count(*) AS n, min(pos) AS first_pos FROM problems GROUP BY ALL",
    "hygiene_needles": f"SELECT DISTINCT len(w)::INT AS n_words, sha256(array_to_string(w, ' ')) AS sha256 FROM (SELECT {Q.word_stream('text')} AS w FROM benchmark) WHERE len(w) > 0",
    "hygiene_window_needles": _windows("benchmark", 3, 7),
    "hygiene_leak_scan": f"WITH m AS ({_windows('benchmark', 3, 7)}), d AS ({_windows('documents', 3, 7, 'doc_id,')}) SELECT DISTINCT doc_id FROM d JOIN m USING (n_words, sha256)",
    "hygiene_reuse": f"""
WITH d AS (SELECT doc_id AS pos, doc_id::VARCHAR AS id, array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), ' ') AS t, {_SET.replace('query', 'text')} AS s FROM documents),
f AS (SELECT id, pos, first_value(pos) OVER (PARTITION BY t ORDER BY pos) AS pt, first_value(pos) OVER (PARTITION BY s ORDER BY pos) AS ps FROM d),
g AS (SELECT id, CASE WHEN pt < pos THEN pt END AS pt, CASE WHEN ps < pos THEN ps END AS ps FROM f)
SELECT id, CASE WHEN pt IS NOT NULL AND (ps IS NULL OR pt <= ps) THEN pt ELSE ps END::VARCHAR AS earlier_id, CASE WHEN pt IS NOT NULL AND (ps IS NULL OR pt <= ps) THEN 'string' ELSE 'set' END AS how
FROM g WHERE pt IS NOT NULL OR ps IS NOT NULL""",
    "hygiene_record_checks": f"WITH {OPS}, {_RECORDS}, {_CHECKS} SELECT id, rule FROM broken",
    "hygiene_rejections": f"WITH {OPS}, {_RECORDS}, {_CHECKS} SELECT id, arg_min(rule, list_position({list(H.RECORD_RULES)!r}, rule)) AS rule FROM broken GROUP BY id",
    "hygiene_distribution": f"WITH {OPS}, {_RECORDS}, {_DIST} SELECT * FROM dist",
    "hygiene_below_quota": f"""WITH {OPS}, {_RECORDS}, {_DIST}, q AS (SELECT section, dimension, ceil(avg(n))::BIGINT AS least FROM dist GROUP BY ALL)
SELECT section, dimension, value, n, least FROM dist JOIN q USING (section, dimension) WHERE n < least""",
}
