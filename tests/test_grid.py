"""Grid sweep, lexicon caps, leak scan and reuse against plain versions."""

import random

from pyspark.sql import functions as F

from quillspark.operators import evaluation as E
from quillspark.operators import hygiene as H
from quillspark.operators import lexicon as X

CAND = "query_id int, key string, lexical double, intent int, unmatched int, hinted boolean, resource boolean, first boolean, covered int, deprecated boolean, tier int, tie int"


def candidates(rng, n):
    return [(rng.randrange(6), f"k{i:03}", float(rng.randrange(4)), rng.choice([-1, 0, 1]), rng.randrange(4), *(rng.random() < 0.5 for _ in range(3)), rng.randrange(3), rng.random() < 0.3, rng.randrange(2), rng.randrange(2)) for i in range(n)]


def test_sweep_matches_every_candidate_at_every_point(spark):
    rng = random.Random(2)
    rows = candidates(rng, 150)
    axes = {k: spark.createDataFrame([(v,) for v in vs], f"{k} double") for k, vs in {
        "method_match_bonus": [1.0, 2.0], "method_mismatch_penalty": [0.5], "path_unmatched_penalty": [0.5, 1.0], "path_unmatched_cap": [2.0, 3.0],
        "product_hint_bonus": [1.0], "resource_match_bonus": [2.0], "method_order_bonus": [0.0, 0.5], "path_coverage_bonus": [0.25],
    }.items()}
    points = E.grid_points(axes).withColumn("point_id", F.concat_ws("|", *axes))
    d = spark.createDataFrame(rows, CAND)
    assert E.collapse(d.union(d)).count() == len({(r[0], *r[2:]) for r in rows})
    got = {(r["point_id"], r["query_id"]): (r["key"], r["best_final"]) for r in E.sweep(d, points).collect()}
    want = {}
    for p in points.collect():
        for q, key, lex, intent, un, hint, res, first, cov, dep, tier, tie in rows:
            s = p["method_match_bonus"] if intent > 0 else -p["method_mismatch_penalty"] if intent < 0 else 0.0
            s += -min(un, p["path_unmatched_cap"]) * p["path_unmatched_penalty"] + hint * p["product_hint_bonus"] + res * p["resource_match_bonus"] + first * p["method_order_bonus"] + cov * p["path_coverage_bonus"]
            final = max(lex + s, 0.0) * (0.7 if dep else 1.0)
            if final > 0:
                at = p["point_id"], q
                want[at] = min(want.get(at, ((9,),)), ((tier, -final, tie, dep, key),))
    assert got == {at: (x[0][4], -x[0][1]) for at, x in want.items()}
    best = E.sweep(d, points)
    first = best.where("query_id = 0").select("key").first()[0]
    keep = {r[0] for r in E.passing_points(best, spark.createDataFrame([(0, [first])], "query_id int, keys array<string>")).collect()}
    assert keep == {p for (p, q), (k, _) in got.items() if q == 0 and k == first}
    assert E.passing_points(best, spark.createDataFrame([], "query_id int, keys array<string>")).count() == points.count()


def test_skyline_keeps_what_some_point_can_put_first(spark, monkeypatch):
    """Winners at random points, negative ones too, are the same without the vectors dropped; in
    small blocks and in one."""
    rng = random.Random(5)
    rows = candidates(rng, 400)
    d = E.collapse(spark.createDataFrame(rows, CAND))
    every = [r.asDict() for r in d.collect()]

    def first(rows, p):
        best = {}
        for r in rows:
            s = p["method_match_bonus"] if r["intent"] > 0 else -p["method_mismatch_penalty"] if r["intent"] < 0 else 0.0
            s += -min(r["unmatched"], p["path_unmatched_cap"]) * p["path_unmatched_penalty"] + r["hinted"] * p["product_hint_bonus"] + r["resource"] * p["resource_match_bonus"] + r["first"] * p["method_order_bonus"] + r["covered"] * p["path_coverage_bonus"]
            final = max(r["lexical"] + s, 0.0) * (0.7 if r["deprecated"] else 1.0)
            if final > 0:
                best[r["query_id"]] = min(best.get(r["query_id"], ((9,),)), ((r["tier"], -final, r["tie"], r["deprecated"], r["key"]),))
        return best

    for block, negative in ((256, ()), (7, ()), (256, ("path_unmatched_penalty", "product_hint_bonus"))):
        monkeypatch.setattr(E, "SKYLINE_BLOCK", block)
        kept = [r.asDict() for r in E.skyline(d, negative).collect()]
        assert len(kept) < len(every) * (0.9 if negative else 0.5)
        for _ in range(150):
            p = {k: rng.choice([0.0, 0.5, 1.0, 2.5]) * (rng.choice([1, -1]) if k in negative else 1) for k in E.CONSTANT_KEYS}
            assert first(kept, p) == first(every, p)


def test_caps_keep_the_first_keys(spark):
    rng = random.Random(3)
    rows = sorted({(rng.choice(["a", "b c", "d"]) + f" {rng.randrange(40)}" * (i % 2), ("t" + str(rng.randrange(3)),)) for i in range(120)} | {("x", ())})
    d = spark.createDataFrame([(k, list(t)) for k, t in rows], "key string, targets array<string>")
    got = {(r["key"], tuple(r["targets"])): r["kept"] for r in X.cap_per_concept(d, 4).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        peers = sorted(x for x, y in rows if y == t and (" " in x) == (" " in k))
        assert got[k, t] == (k in peers[:4])


def test_quick_hashes_change_no_leak(spark, monkeypatch):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    secret = [say(n) for n in (2, 3, 9)]
    docs = spark.createDataFrame([(i, say(20)) for i in range(60)] + [(100, f"{say(5)}, {secret[2].upper()}!"), (101, secret[1]), (102, secret[0]), (103, None), (104, "")], "doc_id int, text string")
    texts = spark.createDataFrame([(s,) for s in secret], "text string")
    plain = {r[0] for r in H.scan(docs, H.window_needles(texts)).collect()}
    assert {100, 101} <= plain and not plain & {102, 103, 104}
    for limit in (1 << 28, 1):
        monkeypatch.setattr(H, "MAX_BITS", limit)
        assert {r[0] for r in H.scan(docs, H.window_needles(texts, quick=True)).collect()} == plain
    assert {r[0] for r in H.scan(docs, H.window_needles(texts, quick=True), docs.where("doc_id = 100").select("doc_id")).collect()} == plain - {100}


def test_reuse_finds_the_first_earlier_record(spark):
    rows = [(0, "a", "List all boxes", False), (1, "b", "boxes list all", True), (2, "c", "list  ALL boxes", True), (3, "d", "other thing", True), (4, "e", "other thing", False), (5, "f", "", True), (6, "g", " ", True)]
    got = {r["id"]: (r["earlier_id"], r["how"]) for r in H.reuse(spark.createDataFrame(rows, "pos int, id string, query string, is_new boolean")).collect()}
    assert got == {"b": ("a", "set"), "c": ("a", "string"), "g": ("f", "string")}
