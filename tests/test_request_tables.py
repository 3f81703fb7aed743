import json

from quillspark.operators import catalog as C
from quillspark.operators import requests as N

BODY = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}}}


def specs(spark, copies):
    item = {"post": {"operationId": "x", "requestBody": {"content": {"application/json": {"schema": BODY}, "text/a": {"schema": {"type": "string"}}}}}}
    return spark.createDataFrame([(s, json.dumps({"paths": {f"/p{i}": item for i in range(copies)}})) for s in "ab"], "source string, spec_json string")


def test_body_rules_are_made_once_for_a_text(spark):
    """Operations with one schema share its rules; each request still meets them."""
    few, many = (C.normalize(specs(spark, n)) for n in (1, 7))
    rules = [N.body_rules(c["body_media"], c["components"]) for c in (few, many)]
    assert rules[0].count() == rules[1].count() == 6
    asked = spark.createDataFrame([(f"{s}{i}", f"{s}:POST:/p{i}", {}, "application/json", True, '{"name":1}') for s in "ab" for i in range(7)], "request_id string, key string, headers map<string,string>, content_type string, body_present boolean, body_json string")
    got = sorted((r["request_id"], r["rule"], r["location"]) for r in N.check_body(asked, many["body_media"], rules[1]).collect())
    assert got == [(f"{s}{i}", "body_property_type", "body.name") for s in "ab" for i in range(7)]


def test_documents_are_taken_apart_once(spark):
    """No table of the catalog reads the specifications' paths again."""
    cat = C.normalize(specs(spark, 2))
    for name in ("operations", "parameters", "body_media", "components"):
        assert "spec_json" not in cat[name]._jdf.queryExecution().optimizedPlan().toString()
    assert cat["operations"].count() == 4
