"""The search log as a stream: cleaning keeps no state, attribution keeps each session's."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators import logs
from quillspark.sources.tables import LOG_ROWS, log_row

#: A session without a line for so long is taken as ended.
SESSION_IDLE_MS = 24 * 3600 * 1000


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON-lines files of a folder, cleaned as they come."""
    return logs.sanitize(spark.readStream.schema(LOG_ROWS).json(folder))


def write_qualifying(stream: DataFrame, fingerprint: str, out: str, checkpoint: str):
    """Starts a query that appends the qualifying searches to a Parquet folder."""
    return logs.qualifying(stream, fingerprint).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(out)


class _Attribute(StatefulProcessor):
    """Holds the staircase of each key that an open session was shown, one state entry a key:
    the seqs of its steps and whether each recommended that key."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stairs = handle.getMapState("stairs", "key string", "seqs array<bigint>, matches array<boolean>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows), ignore_index=True).sort_values(["file", "block", "at"], kind="stable")
        held: dict[str, tuple[list, list]] = {}

        def stairs(shown: str) -> tuple[list, list]:
            if shown not in held:
                got = self.stairs.getValue((shown,)) if self.stairs.containsKey((shown,)) else None
                held[shown] = (list(got[0]), list(got[1])) if got else ([], [])
            return held[shown]

        out, changed = [], set()
        for r in lines.itertuples(index=False):
            if r.is_search:
                for shown in json.loads(r.shown):
                    seqs, matches = stairs(shown)
                    keep = bisect.bisect_left(seqs, r.seq)
                    del seqs[keep:], matches[keep:]
                    seqs.append(int(r.seq))
                    matches.append(r.recommended == shown)
                    changed.add(shown)
            else:
                seqs, matches = stairs(r.key)
                i = bisect.bisect_left(seqs, r.seq)
                if i:
                    out.append((key[0], int(r.seq), seqs[i - 1], r.key, matches[i - 1]))
        for shown in changed:
            self.stairs.updateValue((shown,), held[shown])
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["session", "selection_seq", "search_seq", "key", "recommended_matches"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stairs.clear()
        yield pd.DataFrame([], columns=["session", "selection_seq", "search_seq", "key", "recommended_matches"])

    def close(self) -> None:
        pass


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their place in what their task reads, which is the order of each split."""
    n = 0
    for batch in batches:
        yield batch.append_column("at", pa.array(range(n, n + len(batch)), pa.int64()))
        n += len(batch)


def attribute_stream(spark: SparkSession, folder: str, idle_ms: int | None = SESSION_IDLE_MS) -> DataFrame:
    """Selections of new log files, each with the latest earlier search of its session that
    shows its key: what ``operators.logs.attribute`` gives for the whole log, as long as a
    session's files come in the order of their names and it is not idle past its time. With
    ``idle_ms`` None sessions never end; a query that stops when all is read needs that, as
    timers by the clock keep a query going.

    Lines that are no JSON objects are left out; null sessions are one session, given out as null."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.mapInArrow(_counted, "file string, block long, value string, at long").select("file", "block", "at", log_row(F.col("value")).alias("r"))
    rows = lines.where("r is not null").where(F.col("r.kind").isin("search", "selection") & ((F.col("r.kind") == "search") | F.col("r.key").isNotNull()))
    shown = F.filter(F.array_distinct(F.transform("r.top", lambda t: t["key"])), lambda k: k.isNotNull())
    rows = rows.select(
        F.coalesce(F.concat(F.lit("1"), "r.server_session_id"), F.lit("0")).alias("session"), "file", "block", "at", (F.col("r.kind") == "search").alias("is_search"),
        F.coalesce("r.call_seq", F.lit(0)).alias("seq"), "r.key", F.coalesce(F.to_json(shown), F.lit("[]")).alias("shown"), F.col("r.recommended_operation").alias("recommended"),
    )
    found = rows.groupBy("session").transformWithStateInPandas(_Attribute(idle_ms), "session string, selection_seq long, search_seq long, key string, recommended_matches boolean", "Append", "none" if idle_ms is None else "processingTime")
    return found.withColumn("session", F.when(F.col("session").startswith("1"), F.substring("session", 2, 1 << 30)))


def write_attributed(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False):
    """Starts a query that appends attributed selections to a Parquet folder, for good or
    until what is there now is read; the state store of the session must be RocksDB's."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(out)
