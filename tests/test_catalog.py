import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalog as C
from quillspark.operators import corpus as D
from quillspark.operators import harvest as V
from quillspark.operators import jsonwalk, quirks, refs, requests

SPEC = {
    "openapi": "3.1.0", "info": {"title": "t"}, "security": [{"oauth": ["read"]}], "tags": [{"name": "Declared"}],
    "components": {
        "parameters": {"page": {"name": "page", "in": "query", "schema": {"type": "integer", "example": 3}}},
        "schemas": {
            "Node": {"type": "object", "properties": {"next": {"$ref": "#/components/schemas/Node"}, "leaf": {"$ref": "#/components/schemas/Leaf"}, "example": {"type": "string", "example": "x"}}},
            "Leaf": {"type": "object", "properties": {"gone": {"$ref": "#/components/schemas/Gone"}, "out": {"$ref": "other.json#/X"}}},
            "Base": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "size": {"type": "integer"}}},
        },
        "securitySchemes": {"k": {"type": "apiKey", "in": "header", "name": "X-Secret"}},
    },
    "paths": {
        "/thing/{id}": {
            "parameters": [{"name": "id", "in": "path"}, {"name": "q", "in": "query", "description": "old"}],
            "get": {"operationId": "getThing", "summary": 5, "deprecated": "true", "parameters": [{"$ref": "#/components/parameters/page"}, {"name": "q", "in": "query", "required": True, "description": "new"}], "security": [{}, {"k": []}], "x-experimental": "maybe", "responses": {"404": {"description": "no"}, "200": {"description": "ok", "content": {"text/z": {"schema": {"$ref": "#/components/schemas/Node"}}, "application/a": {}}}}},
            "post": {"operationId": "getThing", "deprecated": True, "tags": ["Used"], "x-oauth2-scopes": ["a", {"scopes": ["b", "a"]}], "description": "Send `X-Check: no` and X-Other.", "requestBody": {"required": True, "content": {"application/json": {"schema": {"allOf": [{"$ref": "#/components/schemas/Base"}, {"type": "object", "required": ["kind"], "properties": {"kind": {"enum": ["a", "b"]}, "made": {"type": "string", "readOnly": True}, "size": {"type": "string"}}, "additionalProperties": False}]}}}}},
            "put": {"parameters": {}}, "delete": {"parameters": [{"name": "x", "in": "nowhere"}]},
        },
        "/ref": {"$ref": "x"}, "/bad": 7,
    },
}


@pytest.fixture(scope="module")
def cat(spark):
    d = spark.createDataFrame([("s", json.dumps(SPEC))], "source string, spec_json string")
    return {k: v.cache() for k, v in C.normalize(d).items()} | {"specs": d}


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_operations(cat):
    got = {r["key"]: r for r in cat["operations"].collect()}
    assert set(got) == {"s:GET:/thing/{id}", "s:POST:/thing/{id}"}
    g, p = got["s:GET:/thing/{id}"], got["s:POST:/thing/{id}"]
    assert (g["summary"], g["deprecated"], g["experimental"], g["operation_id"]) == (None, False, False, "getThing")
    assert p["deprecated"] and p["tags"] == ["Used"] and p["oauth2_scopes"] == ["a", "b"]


def test_parameters_keep_place_and_take_the_operations_value(cat):
    got = rows(cat["parameters"].where("key like '%GET%'").orderBy("pos"), "name", "location", "required", "description")
    assert got == [("id", "path", True, None), ("q", "query", True, "new"), ("page", "query", False, None)]
    assert json.loads(cat["parameters"].where("name = 'page'").first()["schema_json"]) == {"type": "integer"}


def test_security_media_tags_warnings(cat):
    assert sorted(rows(cat["security"], "key", "alternative", "scheme", "scopes"), key=str) == sorted([("s:GET:/thing/{id}", 0, None, None), ("s:GET:/thing/{id}", 1, "k", []), ("s:POST:/thing/{id}", 0, "oauth", ["read"])], key=str)
    assert rows(cat["responses"].orderBy("pos"), "status", "description") == [("404", "no"), ("200", "ok")]
    assert rows(cat["response_media"].orderBy("pos"), "content_type") == [("text/z",), ("application/a",)]
    assert {r[0] for r in rows(cat["tags"], "tag")} == {"Declared", "Used"}
    assert sorted(rows(cat["warnings"], "kind", "path")) == sorted([("experimental_value_ignored", "/thing/{id}"), ("operation_skipped", "/thing/{id}"), ("operation_skipped", "/thing/{id}"), ("path_item_invalid", "/bad"), ("path_item_ref_unsupported", "/ref")])
    assert C.is_partial(cat["warnings"]).first()["partial"]


def test_examples_go_but_names_stay(cat):
    node = json.loads(cat["components"].where("name = 'Node'").first()["node"])
    assert node["properties"]["example"] == {"type": "string"}


def test_references(spark, cat):
    e = refs.edges(cat["components"])
    assert {(r["name"], r["ref"].split("/")[-1], r["state"]) for r in e.collect()} == {("Node", "Node", "ok"), ("Node", "Leaf", "ok"), ("Leaf", "Gone", "missing"), ("Leaf", "X", "external")}
    root = spark.createDataFrame([("s", "Node"), ("s", "Nope")], "source string, name string")
    got = {r["name"]: r for r in refs.expand(root, cat["components"], 2, 200).collect()}
    assert got["Node"]["cycles"] == ["#/components/schemas/Node"] and got["Node"]["node_count"] == 2
    assert got["Node"]["unresolved"] == ["#/components/schemas/Gone", "other.json#/X"] and not got["Node"]["truncated"]
    assert not got["Nope"]["found"]
    assert refs.expand(root, cat["components"], 2, 1).where("name = 'Node'").first()["truncated"]
    need = C.trim(cat["specs"], spark.createDataFrame([("s", "/thing/{id}")], "source string, path string"))
    assert {(r["section"], r["name"]) for r in need.collect()} == {("parameters", "page"), ("schemas", "Node"), ("schemas", "Leaf"), ("schemas", "Base")}


def test_resolve(spark, cat):
    r = spark.createDataFrame([(1, "s:GET:/thing/{id}", None, None), (2, None, "getThing", None), (3, None, "nope", "s"), (4, None, None, None)], "request_id int, key string, operation_id string, source string")
    got = {x["request_id"]: (x["key"], x["error"]) for x in C.resolve(r, cat["operations"]).collect()}
    assert got == {1: ("s:GET:/thing/{id}", None), 2: (None, "ambiguous"), 3: (None, "operation_not_found"), 4: (None, "invalid_argument")}


def test_profile_and_compact(spark, cat):
    p = C.profile(cat["specs"]).first()
    assert (p["operations"], p["duplicate_ids"], p["paths_with_parameters"], p["schemas"], p["deprecated"]) == (4, 1, 1, 3, 1)
    c = C.compact(cat["operations"], cat["response_media"], 5).where("method = 'POST'").first()
    assert c["truncated"] and c["description"] == "Send "


REQ = "request_id int, key string, path_params map<string,string>, query map<string,string>, headers map<string,string>, content_type string, body_present boolean, body_json string"


def test_requests(spark, cat):
    get, post = "s:GET:/thing/{id}", "s:POST:/thing/{id}"
    good = '{"name":"n","kind":"a"}'
    r = spark.createDataFrame(
        [
            (1, get, {"id": '"a b/c"'}, {"q": '"1"', "page": '"7"'}, {}, None, False, None),
            (2, get, {}, {"page": '"x"', "zz": "1"}, {"X-Secret": '"s"', "Accept": '"a"', "Odd": '"o"'}, None, True, "{}"),
            (3, post, {"id": "1"}, {}, {"x-check": '"no"'}, None, True, good),
            (4, post, {"id": "1"}, {}, {"X-Check": '"yes"'}, "application/json; charset=x", True, '{"name":3,"kind":"z","other":1,"made":"m"}'),
            (5, post, {"id": "1"}, {}, {}, "text/plain", False, None),
            (6, post, {"id": "1"}, {}, {"x-check": '"no"'}, None, True, "[]"),
        ],
        REQ,
    )
    ops = cat["operations"]
    creds = quirks.credential_headers(cat["specs"].select("source"), cat["components"])
    mined = quirks.mine(ops, ["X-Check"])
    over = spark.createDataFrame([(post, "x-check", "set", "no", "required", "literal", None), ("s:GET:/gone", "A", "set", None, "required", "literal", None)], "key string, name string, action string, value string, enforcement string, value_policy string, note string")
    merged = quirks.merge(mined, over)
    assert rows(mined, "name", "value") == [("X-Check", "no")] and rows(quirks.orphans(over, ops), "key") == [("s:GET:/gone",)]
    assert rows(quirks.mentions(ops, ["X-Check"]), "header") == [("X-Other",)]
    got = {x["request_id"]: x for x in requests.check(r, cat, merged, creds).collect()}
    rules = lambda i, side="errors": sorted((x["location"], x["rule"]) for x in got[i][side])
    assert got[1]["compatible"] and rules(1) == []
    assert rules(2) == [("path.id", "required"), ("query.page", "type"), ("query.q", "required")]
    assert ("query.zz", "unknown_parameter") in rules(2, "warnings") and ("header.Odd", "unknown_parameter") in rules(2, "warnings") and ("body", "body_not_declared") in rules(2, "warnings")
    assert rules(3) == [("query.q", "required")] or rules(3) == []
    assert {("body.kind", "body_property_enum"), ("body.name", "body_property_type"), ("body.other", "body_unknown_property"), ("header.x-check", "quirk_value_mismatch")} <= set(rules(4))
    assert ("body.size", "conflicting_allof_property") in rules(4, "warnings") and ("body.made", "readonly_property_present") in rules(4, "warnings")
    assert {("body", "body_required"), ("content_type", "content_type"), ("header.x-check", "required")} <= set(rules(5))
    assert ("body", "body_root_type") in rules(6)
    paths = {x["request_id"]: x["path"] for x in requests.render_paths(r, ops, cat["parameters"]).collect()}
    assert paths[1] == "/thing/a%20b%2Fc" and paths[2] is None
    lost = {(x["request_id"], x["name"]) for x in requests.missing_required(r, cat["parameters"], merged, cat["body_media"], ops, creds).collect()}
    assert (2, "id") in lost and (5, "body") in lost and (5, "x-check") in lost and (1, "id") not in lost
    heads = requests.header_table(r, cat["parameters"], merged, ops, creds).where("request_id = 5").first()
    assert heads["effective_required"] and heads["value"] == "no" and not heads["declared_required"]


PAGES = [
    ("top", "window.__DATA__ = " + json.dumps(SPEC) + "; more", "ok"), ("nested", "x window.__DATA__={\"a\":[{\"b\":" + json.dumps(SPEC) + "}]};", "ok"), ("blank", "window.__DATA__   =   {};", "no_candidate"),
    ("none", "<html>", "error_marker_count"), ("two", "window.__DATA__ = {}; window.__DATA__ = {};", "error_marker_count"), ("bad", "window.__DATA__ = {a: 1};", "error_bad_json"), ("both", "window.__DATA__ = " + json.dumps([SPEC, SPEC]) + ";", "ambiguous"),
]


def test_harvest(spark):
    d = spark.createDataFrame([(n, f"https://h/rest/v3/{n}?a=/rest/v9/", h) for n, h, _ in PAGES], "source string, url string, html string").withColumn("final_url", F.lit(None).cast("string"))
    got = {r["source"]: r for r in V.extract_specs(d).collect()}
    assert {n: got[n]["status"] for n, _, _ in PAGES} == {n: s for n, _, s in PAGES}
    assert got["top"]["sha256"] == got["nested"]["sha256"] and got["top"]["api_version"] == "v3"
    assert got["none"]["spec_json"] is None


def test_canonical_hash_ignores_order(spark):
    d = spark.createDataFrame([('{"b": 1, "a": "é"}',), ('{"a":"é","b":1}',), ("nope",)], "t string")
    a, b, c = [r[0] for r in d.select(jsonwalk.canonical_sha256(F.col("t"))).collect()]
    assert a == b and c is None


@pytest.mark.parametrize("spec,gate", [(SPEC, None), ({"openapi": 3, "info": {}, "paths": {}}, "invalid_structure"), (SPEC | {"openapi": "4.0.0"}, "incompatible_dialect"), (SPEC | {"paths": {"/a": {"parameters": []}}}, "no_operations"), (SPEC | {"components": []}, "invalid_components")])
def test_compatibility_gate(spark, spec, gate):
    d = spark.createDataFrame([("s", json.dumps(spec))], "source string, spec_json string")
    assert V.compatibility(d).first()["gate"] == gate


def test_titles_and_sitemaps(spark):
    html = [("a", "<h1>A &amp; <b>B</b></h1><title>x</title>"), ("b", "<title>T | Site</title><h1> </h1>"), ("c", "<title>\n Only  title </title>"), ("d", "<p>")]
    got = {r[0]: r[1] for r in spark.createDataFrame(html, "u string, html string").select("u", jsonwalk.page_title(F.col("html"))).collect()}
    assert got == {"a": "A & B", "b": "T", "c": "Only title", "d": ""}
    loc = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    maps = spark.createDataFrame([("ok", loc("https://h/x/1", "https://h/x/2", "https://h/y")), ("far", loc("https://z/x/1")), ("odd", "<html/>")], "source string, xml string")
    rules = spark.createDataFrame([(s, "h", "https://h/x/") for s in ("ok", "far", "odd")], "source string, host string, prefix string")
    out = {r["source"]: (r["kept"], r["discarded"], r["problem"]) for r in D.preflight(maps, rules).collect()}
    assert out == {"ok": (2, 1, None), "far": (0, 0, "foreign_host"), "odd": (0, 0, "invalid_root")}
