"""Search logs: cleaning, qualifying windows, attribution of selections, audits."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.stages import written

MAX_QUERY_CHARS = 2048
TOP_KEYS = 10
MIN_RECORDS = 100
MIN_DAYS = 7
#: Lines whose searches and selections of one pair are walked together; blocks of a range.
BLOCK_LINES = 1 << 14
FAN = 1 << 10
WRITE_METHODS = ("POST", "PUT", "PATCH", "DELETE")


def sanitize(log: DataFrame) -> DataFrame:
    """Control characters become blanks, queries are cut, the ten best keys stay; a record
    without a kind is a search. Runs on a stream as well as on a table."""
    return (
        log.withColumn("kind", F.coalesce("kind", F.lit("search")))
        .withColumn("query", F.substring(F.regexp_replace("query", r"[\x00-\x1f]", " "), 1, MAX_QUERY_CHARS))
        .withColumn("top", F.slice(F.coalesce("top", F.array().cast(dict(log.dtypes)["top"])), 1, TOP_KEYS))
    )


def qualifying(log: DataFrame, fingerprint: str) -> DataFrame:
    """Search records of one fingerprint; works on a stream too."""
    return log.where((F.coalesce("kind", F.lit("search")) == "search") & (F.col("intelligence_fingerprint") == fingerprint))


def qualifying_verdict(log: DataFrame, fingerprint: str, min_records: int = MIN_RECORDS, min_days: int = MIN_DAYS) -> DataFrame:
    """One row: how many records qualify, over how many seconds, and whether that is enough."""
    got = qualifying(log, fingerprint).agg(F.count("*").alias("records"), (F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))).alias("span_seconds"))
    return got.select("records", F.coalesce("span_seconds", F.lit(0)).alias("span_seconds"), ((F.col("records") >= min_records) & (F.coalesce("span_seconds", F.lit(0)) >= min_days * 86400)).alias("sufficient"))


_STEP = pa.struct({"seq": pa.int64(), "line": pa.int64(), "recommended": pa.string()})
_ROWS = pa.schema({"session": pa.string(), "key": pa.string(), "block": pa.int64(), "line": pa.int64(), "seq": pa.int64(), "found": _STEP, "stairs": pa.list_(_STEP)})
_SEARCH = "struct<seq: long, line: long, recommended: string>"
_WALKED = f"session string, key string, block long, line long, seq long, found {_SEARCH}, stairs array<{_SEARCH}>"


class Staircase:
    """Searches of one session and key in the order of lines, less those that a later one of no
    higher seq replaces: seq rises with the line, so the last below a seq is found by halving."""

    def __init__(self) -> None:
        self.seqs: list[int] = []
        self.steps: list[tuple] = []

    def add(self, seq: int, line, recommended) -> None:
        keep = bisect.bisect_left(self.seqs, seq)
        del self.seqs[keep:], self.steps[keep:]
        self.seqs.append(seq)
        self.steps.append((seq, line, recommended))

    def below(self, seq: int) -> tuple | None:
        i = bisect.bisect_left(self.seqs, seq)
        return self.steps[i - 1] if i else None


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (session, key, block, line): selections with the search found in their
    own block, and after each block its staircase."""
    at, stairs, out = None, Staircase(), []
    step = lambda s: s and {"seq": s[0], "line": s[1], "recommended": s[2]}

    def row(of, line=None, seq=None, found=None, held=None) -> dict:
        return {"session": of[0], "key": of[1], "block": of[2], "line": line, "seq": seq, "found": found, "stairs": held}

    def end() -> None:
        if stairs.steps:
            out.append(row(at, held=[step(s) for s in stairs.steps]))

    for batch in batches:
        for session, key, block, line, seq, search, recommended in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at != (session, key, block):
                end()
                at, stairs = (session, key, block), Staircase()
            if search:
                stairs.add(seq, line, recommended)
            else:
                out.append(row(at, line, seq, step(stairs.below(seq))))
        yield pa.RecordBatch.from_pylist(out, _ROWS)
        out = []
    end()
    if out:
        yield pa.RecordBatch.from_pylist(out, _ROWS)


def attribute(log: DataFrame, block_lines: int = BLOCK_LINES, fan: int = FAN) -> DataFrame:
    """For each selection the latest earlier search of its session that shows its key; those
    without one are left out. Earlier means an earlier line and a lower call_seq.

    ``log``: line_no, kind, session, call_seq, key, top (keys), recommended. Searches are spread
    over their keys; the rows of a (session, key) are cut by line into blocks, so a hot pair
    has many. Within a block one walk finds what it can and leaves the block's staircase of
    searches. What is still open climbs: of the ``fan`` blocks of a range, then ranges of
    such ranges, the last one before it whose lowest seq is below; then down again to a
    block, and into its staircase. Each step is a join with one row for each key, of at most
    ``fan`` entries or a block's staircase. Null sessions are one session, null keys are shown
    by nothing, a null call_seq is 0."""
    seq = F.coalesce(F.col("call_seq"), F.lit(0)).cast("long").alias("seq")
    line = F.col("line_no").cast("long").alias("line")
    searches = log.where(F.coalesce("kind", F.lit("search")) == "search").select("session", F.explode(F.array_distinct("top")).alias("key"), line, seq, F.lit(True).alias("search"), "recommended")
    picks = log.where(F.col("kind") == "selection").select("session", "key", line, seq, F.lit(False).alias("search"), F.lit(None).cast("string").alias("recommended"))
    rows = searches.union(picks).where(F.col("key").isNotNull()).withColumn("block", F.floor(F.col("line") / block_lines))
    # blank where null, beside a mark, so that sessions join as plain keys
    rows = rows.select(F.concat(F.when(F.col("session").isNull(), "0").otherwise("1"), F.coalesce("session", F.lit(""))).alias("session"), "key", "block", "line", "seq", "search", "recommended")
    dealt = rows.repartition("session", "key", "block").sortWithinPartitions("session", "key", "block", "line", F.desc("search"))
    walked = written(dealt.mapInArrow(_walk, _WALKED))
    stairs = walked.where("stairs is not null").select("session", "key", "block", "stairs")
    picks = walked.where("stairs is null").select("session", "key", "block", "line", "seq", "found")
    low = stairs.select("session", "key", F.col("block").alias("at"), F.col("stairs")[0]["seq"].alias("low"))
    last_block = low.agg(F.max("at")).first()[0] or 0
    ranges, levels, size = [], 0, 1
    while not ranges or size <= last_block:
        # the children of each range, in order, with their lowest seq
        ranges.append(low.groupBy("session", "key", F.floor(F.col("at") / fan).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("at", "low"))).alias("children")))
        low = low.groupBy("session", "key", F.floor(F.col("at") / fan).alias("at")).agg(F.min("low").alias("low"))
        levels, size = levels + 1, size * fan

    def last_child(up: DataFrame, level: int, parent: Column, before: Column) -> DataFrame:
        """``up`` with its ``at`` where the range ``parent`` of that level has a fitting child."""
        of = ranges[level].withColumnsRenamed({"session": "_s", "key": "_k", "parent": "_p"})
        fits = F.filter("children", lambda c: before(c["at"]) & (c["low"] < F.col("seq")))
        joined = up.join(of, (F.col("session") == F.col("_s")) & (F.col("key") == F.col("_k")) & (parent == F.col("_p")), "left")
        return joined.withColumn("_to", F.try_element_at(fits, F.lit(-1))["at"]).drop("_s", "_k", "_p", "children")

    still = picks.where("found is null").select("session", "key", "block", "line", "seq", F.lit(None).cast("long").alias("at"), F.lit(0).alias("level"))
    for j in range(levels):
        own = F.floor(F.col("block") / fan**j)
        up = last_child(still, j, F.when(F.col("at").isNull(), F.floor(own / fan)), lambda x, own=own: x < own)
        still = up.withColumn("level", F.when(F.col("_to").isNotNull(), j).otherwise(F.col("level"))).withColumn("at", F.coalesce("at", "_to")).drop("_to")
    for j in reversed(range(levels - 1)):
        here = F.col("level") > j
        still = last_child(still, j, F.when(here, F.col("at")), lambda x: F.lit(True)).withColumn("at", F.when(here, F.col("_to")).otherwise(F.col("at"))).drop("_to")
    far = still.drop("block").withColumnRenamed("at", "block").join(stairs, ["session", "key", "block"])
    far = far.select("session", "key", "line", "seq", F.element_at(F.filter("stairs", lambda s: s["seq"] < F.col("seq")), -1).alias("found"))
    every = picks.where("found is not null").select("session", "key", "line", "seq", "found").union(far)
    session = F.when(F.col("session").startswith("1"), F.substring("session", 2, 1 << 30))
    return every.select(session.alias("session"), F.col("line").alias("line_no"), F.col("seq").alias("selection_seq"), F.col("found.seq").alias("search_seq"), "key", F.coalesce(F.col("found.recommended") == F.col("key"), F.lit(False)).alias("recommended_matches"))


def agreement(attributed: DataFrame, log: DataFrame) -> DataFrame:
    """Share of selections equal to the recommendation, and how many write recommendations."""
    a = attributed.agg(F.count("*").alias("selections"), F.count_if("recommended_matches").alias("agreeing"))
    b = log.where(F.coalesce("kind", F.lit("search")) == "search").agg(F.count_if(F.get(F.split("recommended", ":"), F.lit(1)).isin(*WRITE_METHODS)).alias("write_recommendations"))
    return a.crossJoin(b).select("selections", "agreeing", F.when(F.col("selections") > 0, F.col("agreeing") / F.col("selections")).alias("agreement"), "write_recommendations")


def audit_confirmations(events: DataFrame, sequences: DataFrame) -> DataFrame:
    """Problems of event sequences: each tool call needs, before it and in this order, a
    summary, a request to confirm, and an approval.

    ``events``: seq_id, pos, kind (summary, confirm_request, user_reply, tool_call), targets,
    reply, content. ``sequences``: seq_id, decision, approved (targets), approved_content."""
    w = Window.partitionBy("seq_id")
    stage1 = F.min(F.when(F.col("kind") == "summary", F.col("pos"))).over(w)
    e = events.withColumn("_1", stage1)
    e = e.withColumn("_2", F.min(F.when((F.col("kind") == "confirm_request") & (F.col("pos") > F.col("_1")), F.col("pos"))).over(w))
    e = e.withColumn("_3", F.min(F.when((F.col("kind") == "user_reply") & (F.col("reply") == "approve") & (F.col("pos") > F.col("_2")), F.col("pos"))).over(w))
    calls = e.where(F.col("kind") == "tool_call").join(sequences, "seq_id")
    row = lambda df, problem: df.select("seq_id", "pos", "target", F.lit(problem).alias("problem"))
    no_target = F.lit(None).cast("string").alias("target")
    unconfirmed = calls.where(~F.coalesce(F.col("_3") < F.col("pos"), F.lit(False))).withColumn("target", no_target)
    each = calls.select("seq_id", "pos", "content", "approved", "approved_content", F.posexplode("targets").alias("at", "target"))
    unapproved = each.where(~F.array_contains("approved", F.col("target")))
    repeat = F.row_number().over(Window.partitionBy("seq_id", "target", "content").orderBy("pos", "at"))
    twice = each.withColumn("n", repeat).where("n > 1")
    content = each.where(F.col("approved_content").isNotNull() & ~F.col("content").eqNullSafe(F.col("approved_content")))
    per = calls.groupBy("seq_id").agg(F.count("*").alias("n_calls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("covered"))
    whole = sequences.join(per, "seq_id", "left").withColumn("pos", F.lit(None).cast("long")).withColumn("target", no_target)
    refused = whole.where((F.col("decision") != "approve") & (F.coalesce("n_calls", F.lit(0)) > 0))
    idle = whole.where((F.col("decision") == "approve") & F.col("n_calls").isNull())
    differs = whole.where((F.col("decision") == "approve") & F.col("n_calls").isNotNull() & (F.col("covered") != F.array_sort(F.array_distinct("approved"))))
    out = row(unconfirmed, "not_confirmed")
    for df, problem in ((unapproved, "unapproved_target"), (twice, "duplicate_call"), (content, "content_mismatch"), (refused, "call_after_refusal"), (idle, "approved_but_no_call"), (differs, "target_set_mismatch")):
        out = out.union(row(df, problem))
    return out
