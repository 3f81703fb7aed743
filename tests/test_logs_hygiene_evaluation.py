import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation as E
from quillspark.operators import hygiene as H
from quillspark.operators import logs as L

LOG = "line_no long, kind string, session string, call_seq long, key string, top array<string>, recommended string"


def test_selection_goes_to_the_latest_search_that_shows_it(spark):
    log = spark.createDataFrame([(1, "search", "s", 1, None, ["A", "B"], "A"), (2, "search", "s", 2, None, ["C"], "C"), (3, "selection", "s", 3, "B", None, None), (4, "selection", "t", 4, "B", None, None), (5, "selection", "s", 5, "Z", None, None)], LOG)
    assert [(r["selection_seq"], r["search_seq"], r["recommended_matches"]) for r in L.attribute(log).collect()] == [(3, 1, False)]


def test_confirmation_audit(spark):
    events = spark.createDataFrame(
        [
            (1, 0, "summary", ["x"], None, None), (1, 1, "confirm_request", ["x"], None, None), (1, 2, "user_reply", [], "approve", None), (1, 3, "tool_call", ["x"], None, "c"),
            (2, 0, "confirm_request", [], None, None), (2, 1, "summary", [], None, None), (2, 2, "user_reply", [], "approve", None), (2, 3, "tool_call", ["x", "z"], None, "c"), (2, 4, "tool_call", ["x"], None, "c"),
        ],
        "seq_id int, pos long, kind string, targets array<string>, reply string, content string",
    )
    seqs = spark.createDataFrame([(1, "approve", ["x"], "c"), (2, "approve", ["x"], "d"), (3, "approve", ["x"], None), (4, "reject", ["x"], None)], "seq_id int, decision string, approved array<string>, approved_content string")
    got = sorted((r["seq_id"], r["problem"]) for r in L.audit_confirmations(events, seqs).collect())
    assert got == [(2, "content_mismatch")] * 3 + [(2, "duplicate_call")] + [(2, "not_confirmed")] * 2 + [(2, "target_set_mismatch"), (2, "unapproved_target"), (3, "approved_but_no_call")]


def test_sanitize_runs_on_a_stream(spark, tmp_path):
    from quillspark.sources import tables
    from quillspark.streaming import logs as stream

    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = spark.createDataFrame([(1, None, "a\tb", "fp"), (2, "search", "x" * 3000, "other"), (3, "selection", None, "fp")], "line_no long, kind string, query string, intelligence_fingerprint string")
    tables.write_log(rows, src)
    q = stream.write_qualifying(stream.read_stream(spark, f"{src}/*"), "fp", out, cp)
    q.processAllAvailable()
    q.stop()
    assert [(r["kind"], r["query"]) for r in spark.read.parquet(out).collect()] == [("search", "a b")]
    assert tables.read_log(spark, f"{src}/*").where("kind = 'search'").count() == 2


ROW = "section string, id string, top1_correct boolean, top3 boolean, abstained boolean, rec_correct boolean, wrong_write boolean, forbidden_recommended boolean, eligible boolean"


def gate(spark, reach=16, cov=16, correct=None, held=16, neg=8, abst=8, writes=0):
    correct = cov if correct is None else correct
    rows = [("held_out", f"h{i}", i < reach, i < reach, i >= cov, i < correct, i < writes, False, True) for i in range(held)] + [("negative", f"n{i}", False, False, i < abst, False, False, False, True) for i in range(neg)]
    return E.gate(spark.createDataFrame(rows, ROW)).first()


@pytest.mark.parametrize("kw,mark,want", [({"reach": 15}, "reach", True), ({"reach": 14}, "reach", False), ({"cov": 14}, "coverage", True), ({"cov": 13}, "coverage", False), ({"cov": 14, "correct": 13}, "precision", True), ({"cov": 14, "correct": 12}, "precision", False), ({"abst": 7}, "abstention", True), ({"abst": 6}, "abstention", False), ({"writes": 1}, "write_safety", False), ({"cov": 0}, "precision", False)])
def test_gate_boundaries(spark, kw, mark, want):
    assert gate(spark, **kw)[mark] is want


def test_point_selection_prefers_the_baseline(spark):
    axes, base = {"method_match_bonus": [1.0, 2.0, 3.0], "path_coverage_bonus": [0.0, 1.0]}, {"method_match_bonus": 2.0, "path_coverage_bonus": 0.0}
    good = dict(wv=0, fr=0, ir=0, sr3=10, src=10, srk=10, rp3=1, rpk=1, nab=8, n_seed=10, n_rp=1, n_rn=8, n_seed_elig=10, n_rp_elig=1)
    rows = [good | {"point_id": "a", "method_match_bonus": 1.0, "path_coverage_bonus": 0.0}, good | {"point_id": "b", "method_match_bonus": 2.0, "path_coverage_bonus": 0.0}, good | {"point_id": "c", "method_match_bonus": 2.0, "path_coverage_bonus": 1.0}, good | {"point_id": "d", "wv": 1, "method_match_bonus": 2.0, "path_coverage_bonus": 0.0}]
    assert E.select_point(spark.createDataFrame(rows), axes, base).first()["point_id"] == "b"
    worse = [r | {"wv": 2 if r["point_id"] == "c" else 3} for r in rows]
    assert E.select_point(spark.createDataFrame(worse), axes, base).first()["point_id"] == "c"


def test_leaks_are_found_and_allowed(spark):
    q = spark.createDataFrame([("Move an Issue now",)], "query string")
    docs = spark.createDataFrame([(1, "please move-an ISSUE, now!"), (2, "move an issue"), (3, "x move an issue now y")], "doc_id int, text string")
    allow = spark.createDataFrame([(3,)], "doc_id int")
    assert [r[0] for r in H.scan(docs, H.needles(q), allow).collect()] == [1]


def test_quick_scan_equals_the_plain_one(spark, monkeypatch):
    """Rolling hashes of all lengths and a Bloom filter, as full as can be too, against runs of
    words cut one by one; a word ends with its text; letters that lower-case to ASCII."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["ab", "c1", "d", "É", "e-f", "G", "\u212a"]) for _ in range(n))
    texts = [say(rng.randrange(0, 14)) for _ in range(300)] + ["ab", "", None, "ab " * 30_000]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    needles = spark.createDataFrame([(say(rng.randrange(0, 9)),) for _ in range(40)] + [("ab ab ab ab",), (None,)], "text string")
    stream = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    runs = lambda w: {tuple(w[i : i + n]) for n in range(3, 8) for i in range(len(w) - n + 1)}
    held = {r for (t,) in needles.collect() for r in runs(stream(t))}
    want = {f"d{i}" for i, t in enumerate(texts) if runs(stream(t)) & held}
    plain = {tuple(r) for r in H.window_needles(needles).collect()}
    quick = H.window_needles(needles, quick=True)
    assert {(r["n_words"], r["sha256"]) for r in quick.collect()} == plain and len(plain) == len(held)
    assert {r[0] for r in H.scan(docs, quick).collect()} == {r[0] for r in H.scan(docs, H.window_needles(needles)).collect()} == want
    monkeypatch.setattr(H, "MAX_BITS", 1)
    monkeypatch.setattr(H, "BITS_OF_NEEDLE", 1)
    assert {r[0] for r in H.scan(docs, quick).collect()} == want
    assert H.scan(docs, quick.where("false")).collect() == []


def test_reuse_prefers_the_same_string(spark):
    d = spark.createDataFrame([(1, "a", "List boxes", False), (2, "b", "box list", False), (3, "c", "Box  list", True), (4, "d", "other", True)], "pos int, id string, query string, is_new boolean")
    assert [tuple(r) for r in H.reuse(d).collect()] == [("c", "a", "set")]


def test_policy_diff_and_losses(spark):
    a = spark.createDataFrame([("x", ["p"]), ("y", ["q"]), ("z", ["r"])], "word string, targets array<string>")
    b = spark.createDataFrame([("x", ["p"]), ("y", ["q", "s"]), ("w", ["t"])], "word string, targets array<string>")
    assert sorted((r["word"], r["change"]) for r in E.policy_diff(a, b).collect()) == [("w", "added"), ("y", "changed"), ("z", "removed")]
    changed = spark.createDataFrame([("y", ["red", "box"])], "word string, tokens array<string>")
    ops = spark.createDataFrame([("k1", ["red", "box", "up"]), ("k2", ["red"])], "key string, tokens array<string>")
    run = lambda t: spark.createDataFrame([("k1", t)], "query_key string, top1 string")
    assert tuple(E.counterexample_losses(changed, ops, run("k1"), run("k2")).first()) == ("y", 1, 1, 1)


def test_record_shapes(spark):
    rows = [("negative", "n-001", "q", [], [], "seed-r1"), ("seed", "s-001", " ", ["k"], [], "seed-r1"), ("seed", "bad", "q", ["k"], [], "x"), ("seed", "s-002", "q", ["k"], [], "seed-r1"), ("seed", "s-002", "q", ["k"], [], "seed-r1")]
    d = spark.createDataFrame(rows, "section string, id string, query string, expected array<string>, forbidden array<string>, origin string")
    got = {(r["id"], r["problem"]) for r in E.invalid_records(d).collect()}
    assert got == {("n-001", "negative_shape"), ("s-001", "empty_query"), ("bad", "bad_id"), ("bad", "bad_origin"), ("s-002", "duplicate_id")}
    assert d.select(F.count("*")).first()[0] == 5
