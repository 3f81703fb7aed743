"""Readers, writers and policy files."""

import json

import pytest

from quillspark.operators import logs as L
from quillspark.sources import policies as P
from quillspark.sources import tables as T

RANKING = {
    "version": 1, "verb_methods": {"list": ["GET"], "make": ["POST", "PUT"]}, "path_noise": ["rest"], "product_hints": {"page": ["wiki"]},
    "tuning_grid": {"method_match_bonus": [1, 2], "path_unmatched_cap": [3, 2]}, "baseline": {"method_match_bonus": 1, "path_unmatched_cap": 3},
    "ordering_rules": dict.fromkeys(P.ORDERING_RULES, True), "constants": {"method_match_bonus": 2, "path_unmatched_cap": 3},
}


def put(path, name, value):
    (path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path / name)


def test_pages_and_bodies(spark, tmp_path):
    rows = [{"url": "https://h/a", "final_url": "https://h/b", "http_status": 200, "html_sha256": "ab"}, {"url": "https://h/c", "fail_reason": "timeout", "other": 1}]
    got = T.read_page_rows(spark, put(tmp_path, "pages.jsonl", "\n".join(map(json.dumps, rows)))).orderBy("url").collect()
    assert [(r["final_url"], r["http_status"], r["fail_reason"]) for r in got] == [("https://h/b", 200, None), (None, None, "timeout")]
    (tmp_path / "bodies").mkdir()
    put(tmp_path / "bodies", "ab.html", "<p>é")
    body = T.read_bodies(spark, str(tmp_path / "bodies")).first()
    assert body["name"] == "ab.html" and bytes(body["body"]).decode() == "<p>é"


def test_specifications_that_are_no_json_are_null(spark, tmp_path):
    put(tmp_path, "one.json", {"openapi": "3.0.1"})
    put(tmp_path, "two.json", "{nope")
    got = {r["source"]: r["spec_json"] for r in T.read_specs(spark, f"{tmp_path}/*.json").collect()}
    assert json.loads(got["one"]) == {"openapi": "3.0.1"} and got["two"] is None


def test_only_changed_specifications_are_written(spark, tmp_path):
    def write(changed, text):
        tracked = spark.createDataFrame([(s, s in changed, text) for s in ("a", "b")], "source string, changed boolean, sha256 string")
        specs = spark.createDataFrame([(s, text) for s in ("a", "b")], "source string, spec_json string")
        T.write_changed(tracked, specs, f"{tmp_path}/specs", f"{tmp_path}/meta")
        return {r["source"]: r["spec_json"] for r in spark.read.parquet(f"{tmp_path}/specs").collect()}, spark.read.parquet(f"{tmp_path}/meta").collect()

    assert write({"a", "b"}, "old")[0] == {"a": "old", "b": "old"}
    specs, meta = write({"b"}, "new")
    assert specs == {"a": "old", "b": "new"} and {(r["source"], r["sha256"]) for r in meta} == {("a", "new"), ("b", "new")} and "changed" not in meta[0]


LINES = [
    {"ts": "2026-10-11T00:00:00Z", "kind": "search", "query": "q", "server_session_id": "s", "call_seq": 1, "top": [{"key": "k", "score": 2.5}], "recommended_operation": "k"},
    {"kind": "selection", "tool": "get", "server_session_id": "s", "call_seq": 2, "key": "k"},
]


def test_log_lines_round_trip(spark, tmp_path):
    log = T.read_log(spark, put(tmp_path, "log.jsonl", "\n".join(map(json.dumps, LINES))))
    rows = {r["line_no"]: r for r in T.attribution_rows(log).collect()}
    assert rows[1]["kind"] == "search" and rows[1]["top"] == ["k"] and rows[1]["recommended"] == "k" and rows[2]["kind"] == "selection"
    assert [(r["selection_seq"], r["search_seq"], r["recommended_matches"]) for r in L.attribute(T.attribution_rows(log)).collect()] == [(2, 1, True)]
    T.write_log(log, f"{tmp_path}/out")
    T.write_log(log.where("line_no = 2"), f"{tmp_path}/out")
    again = T.read_log(spark, f"{tmp_path}/out/*").orderBy("line_no").collect()
    assert [(r["line_no"], r["kind"]) for r in again] == [(1, "search"), (2, "selection"), (3, "selection")]


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    """Small splits, so that a file is read by many tasks; a rotated file comes before its own."""
    old = [json.dumps({"query": f"old {i}", "call_seq": i}) for i in range(150)]
    new = [json.dumps({"query": f"new {i} " + "x" * (i % 90), "call_seq": i}) for i in range(700)]
    new[5], new[6], new[7] = "", "no json", "[1]"
    put(tmp_path, "a.jsonl", "\n".join(new) + "\n")
    put(tmp_path, "a.jsonl.prev", "\n".join(old))
    put(tmp_path, "b.jsonl", json.dumps({"query": "last"}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = T.numbered_lines(spark, str(tmp_path))
        got = lines.orderBy("line_no").collect()
        assert spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["line_no"], r["value"]) for r in got] == list(enumerate([*old, *new, json.dumps({"query": "last"})], 1))
    log = T.read_log(spark, str(tmp_path))
    assert log.count() == 848 and {r["line_no"] for r in log.where("query is null").collect()} == set()
    assert log.where("line_no = 851").first()["query"] == "last"


def test_ranking_files(spark, tmp_path):
    path = put(tmp_path, "ranking.json", RANKING)
    r = P.load_ranking(spark, path, ["wiki", "jobs-cloud"])
    assert r.verbs["make"] == ["POST", "PUT"] and r.product_names == ("cloud", "jobs", "wiki") and r.singular_collection_tiebreak
    assert P.grid_of(spark, path) == {"method_match_bonus": [1.0, 2.0], "path_unmatched_cap": [2.0, 3.0]}
    bad = RANKING | {"verb_methods": {"List": ["GET"], "none": [], "twice": ["GET", "GET"], "odd": ["LOOK"]}, "product_hints": {"page": ["gone"]}, "constants": {"method_match_bonus": 9}, "extra": 1, "ordering_rules": {}}
    del bad["baseline"]
    path = put(tmp_path, "bad.json", bad)
    got = {tuple(x) for x in P.ranking_problems(spark, path, ["wiki"]).collect()}
    want = {("List", "bad_verb"), ("none", "no_methods"), ("twice", "repeated_method"), ("odd", "unknown_method"), ("page", "unknown_source"), ("method_match_bonus", "not_in_grid"), ("extra", "unknown"), ("baseline", "missing")}
    assert got == want | {(k, "not_boolean") for k in P.ORDERING_RULES}
    with pytest.raises(ValueError, match="bad_verb"):
        P.load_ranking(spark, path, ["wiki"])


def test_alias_files(spark, tmp_path):
    path = put(tmp_path, "aliases.json", {"alias_damping": 0.5, "rule_damping": 1.5, "aliases": {"ticket": ["issue"], "two words": ["x1"]}, "rules": [{"when_all": ["open", "bug"], "add": ["issue"]}, {"when_all": ["lone"], "add": []}]})
    a, w, t = P.alias_tables(spark, path)
    assert {tuple(r) for r in a.collect()} == {("ticket", "issue"), ("two words", "x1")} and w.count() == 3 and t.count() == 1
    got = {tuple(r) for r in P.alias_problems(a, w, t, P.damping_table(spark, path)).collect()}
    assert got == {("two words", "not_a_token"), ("1", "rule_adds_nothing"), ("rule_damping", "damping_out_of_range")}


def test_override_files(spark, tmp_path):
    ops = {
        "s:GET:/a": {"headers": [{"name": "X-A", "value": "v", "enforcement": "required", "value_policy": "literal"}, {"name": "x-a", "action": "suppress", "value": "v"}]},
        "s:get:/a": {"headers": [{"name": "X-B", "value": "v", "enforcement": "required", "value_policy": "literal"}]},
        "s:PUT:/a": {"headers": [{"name": "Cookie", "value": "v", "enforcement": "maybe", "value_policy": "literal"}], "request_hints": {"multipart_fields": [{"name": "file", "required": True}]}},
    }
    heads, hints = P.override_tables(spark, put(tmp_path, "overrides.json", {"operations": ops}))
    gone = heads.where("action = 'suppress'").first()
    assert (gone["enforcement"], gone["value_policy"], gone["value"]) == ("advisory", "observed", None)
    assert [tuple(r) for r in hints.collect()] == [("s:PUT:/a", "file", True)]
    got = {tuple(r) for r in P.override_problems(heads).collect()}
    assert got == {("s:get:/a", "X-B", "bad_key"), ("s:PUT:/a", "Cookie", "credential_header"), ("s:GET:/a", "x-a", "duplicate_header")}
