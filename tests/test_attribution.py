"""Attribution of selections under two orders, in blocks and on a stream, against plain loops."""

import json
import random
import time

import numpy as np
import pytest

from quillspark.operators import logs as L
from quillspark.sources import tables as T
from quillspark.streaming import logs as stream

LOG = "line_no long, kind string, session string, call_seq long, key string, top array<string>, recommended string"


def plain(rows):
    out = []
    for line, kind, session, seq, key, _, _ in rows:
        if kind != "selection" or key is None:
            continue
        for s in reversed([r for r in rows if r[0] < line]):
            if s[1] in ("search", None) and s[2] == session and (s[3] or 0) < (seq or 0) and key in (s[5] or []):
                out.append((session, line, seq or 0, s[3] or 0, key, s[6] == key))
                break
    return sorted(out, key=str)


def random_log(rng, n, rising=False):
    rows = []
    for i in range(1, n + 1):
        seq = i if rising else rng.choice([None, *range(1, n)])
        session = rng.choice(["s", "t", None, ""])
        if rng.random() < 0.5:
            top = rng.choice([None, [], rng.sample("abcd", 2), ["a", "a", None]])
            rows.append((i, rng.choice(["search", None]), session, seq, None, top, rng.choice(["a", "b", None])))
        else:
            rows.append((i, rng.choice(["selection"] * 8 + ["other"]), session, seq, rng.choice(["a", "b", "c", "z", None]), None, None))
    return rows


@pytest.mark.parametrize("block,fan,rising", [(1, 2, False), (8, 2, False), (5, 3, True), (1 << 14, 1 << 10, False)])
def test_equal_to_the_plain_search(spark, block, fan, rising):
    rows = random_log(random.Random(block + rising), 250, rising)
    got = L.attribute(spark.createDataFrame(rows, LOG).repartition(3), block, fan)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_a_hot_pair(spark):
    """One session and key with 100,000 lines, in seqs without order: equal to a search of all
    earlier lines; 25 blocks of it, so that no task walks more than 4096 lines."""
    rng = np.random.default_rng(5)
    n = 100_000
    seq, search = rng.permutation(n) + 1, rng.random(n) < 0.5
    seq[search] += n // 3  # many selections are below what came just before
    rows = [(i, "search" if s else "selection", "s", int(q), None if s else "k", ["k"] if s else None, "k" if i % 2 else "x") for i, (q, s) in enumerate(zip(seq, search, strict=True))]
    lines, seqs = np.flatnonzero(search), seq[search]
    want = {}
    for i in np.flatnonzero(~search):
        fits = np.flatnonzero(seqs[: np.searchsorted(lines, i)] < seq[i])
        if len(fits):
            want[int(i)] = int(seqs[fits[-1]])
    got = L.attribute(spark.createDataFrame(rows, LOG), 4096, 4)
    assert {r["line_no"]: r["search_seq"] for r in got.collect()} == want


def test_no_lines(spark):
    assert L.attribute(spark.createDataFrame([], LOG)).collect() == []


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    rows = random_log(random.Random(9), 300)

    def put(name, part):
        lines = []
        for _, kind, session, seq, key, top, rec in part:
            r = {"kind": kind, "server_session_id": session, "call_seq": seq, "key": key, "top": None if top is None else [{"key": k, "score": 1.0} for k in top], "recommended_operation": rec}
            lines.append(json.dumps({k: v for k, v in r.items() if v is not None}))
        (tmp_path / "in" / name).write_text("\n".join([*lines, "no json"]))

    def run():
        q = stream.write_attributed(stream.attribute_stream(spark, src, None), out, cp, available_now=True)
        assert q.awaitTermination(100)

    put("1.jsonl", rows[:90])
    put("2.jsonl", rows[90:150])
    run()
    put("3.jsonl", rows[150:])
    run()
    key = lambda r: (r["session"], r["selection_seq"], r["search_seq"], r["key"], r["recommended_matches"])
    batch = L.attribute(T.attribution_rows(T.read_log(spark, src)))
    got = sorted(map(key, spark.read.parquet(out).collect()), key=str)
    assert got == sorted(map(key, batch.collect()), key=str) and got
    assert got == sorted([(s, q, f, k, m) for s, _, q, f, k, m in plain(rows)], key=str)


def test_idle_sessions_end(spark, tmp_path):
    """A session is forgotten when its time is up, another before that is not."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    src.mkdir()
    search = json.dumps({"kind": "search", "server_session_id": "s", "call_seq": 1, "top": [{"key": "k", "score": 1}], "recommended_operation": "k"})
    pick = lambda seq: json.dumps({"kind": "selection", "server_session_id": "s", "call_seq": seq, "key": "k"})
    (src / "1.jsonl").write_text(f"{search}\n{pick(2)}")
    q = stream.write_attributed(stream.attribute_stream(spark, str(src), 1), str(tmp_path / "out"), str(tmp_path / "cp"))

    def wait(rows):
        end = time.time() + 60
        while sum(p.numInputRows for p in q.recentProgress) < rows or not q.recentProgress or q.recentProgress[-1].numInputRows:
            assert time.time() < end and q.isActive, q.exception()
            time.sleep(0.3)

    wait(2)
    (src / "2.jsonl").write_text(pick(3))
    wait(3)
    q.stop()
    assert [r["selection_seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
