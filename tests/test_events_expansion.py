"""Specifications found by events, and bounded expansion, each against a plain walk."""

import json
import random
import tracemalloc

import pytest

from quillspark.operators import jsonevents, refs


def plain_candidates(text):
    seen = []

    def note(pairs):
        node = dict(pairs)
        if isinstance(node.get("openapi"), str) and isinstance(node.get("info"), dict) and isinstance(node.get("paths"), dict):
            seen.append(node)
        return node

    try:
        json.JSONDecoder(object_pairs_hook=note).raw_decode(text)
    except ValueError:
        return None
    return len(seen), seen[0] if seen else None


def some_json(rng, depth):
    """Text of a random value: keys and kinds often those of a specification, members repeated."""
    blank = lambda: rng.choice(["", "", " ", "\n\t "])
    kind = rng.choice("oooaas") if depth else "s"
    if kind == "s":
        return rng.choice(['"3.0"', '"a\\"b\\\\"', '"\\u00e9\\ud83d\\ude00"', "1", "-0.5e+3", "0", "true", "null", "NaN", "-Infinity", '""', "{}", "[]", "[ ]", '"x,}]"'])
    inside = [some_json(rng, depth - 1) for _ in range(rng.randrange(5))]
    if kind == "a":
        return "[" + blank() + f"{blank()},{blank()}".join(inside) + blank() + "]"
    keys = ["openapi", "info", "paths", "open\\u0061pi", "a", "", "infos", "\\n"]
    spec = ['"openapi":"3.1"', '"info":{}', '"paths":{ }'] if rng.random() < 0.4 else []
    members = [f'"{rng.choice(keys)}"{blank()}:{blank()}{v}' for v in inside] + spec
    rng.shuffle(members)
    return "{" + blank() + f"{blank()},{blank()}".join(members) + blank() + "}"


def test_candidates_equal_those_of_a_full_decode():
    rng, counts = random.Random(5), {}
    for i in range(6000):
        text = some_json(rng, rng.randrange(5)) + rng.choice(["", ";", " tail {", "}"])
        if i % 3 == 0 and text:  # broken somewhere, or still sound
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", ",", "}", "]", '"', "\\", "0", "\x01", ":"]) + text[at + 1 :]
        want, got = plain_candidates(text), jsonevents.candidates(text)
        if want is None:
            assert got is None, text
        else:
            assert got is not None and got[0] == want[0], text
            if want[0]:
                assert repr(json.loads(text[slice(*got[1])])) == repr(want[1]), text
        counts[want and min(want[0], 2)] = counts.get(want and min(want[0], 2), 0) + 1
    assert all(counts[k] > 100 for k in (None, 0, 1, 2)), counts


@pytest.mark.parametrize("text", ["", " {}", "{", "[1,]", '{"a":1,}', '{"a" 1}', "[1 2]", "tru", '{"a":}', "{,}", '"\t"', '{1:2}', "]", "-"])
def test_what_no_json_value_begins(text):
    assert plain_candidates(text) is None and jsonevents.candidates(text) is None


def test_memory_of_the_scan_does_not_grow_with_the_page():
    peaks = []
    for times in (2_000, 40_000):
        text = '{"s":{"openapi":"3","info":{},"paths":{}},"list":[' + ",".join(['{"a":"b","n":[1,2,{"k":null}]},"x",7'] * times) + "]}"
        tracemalloc.start()
        assert jsonevents.candidates(text)[0] == 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] and peaks[1] < 100_000, peaks


def test_very_deep_texts_are_read():
    assert jsonevents.candidates("[" * 50_000 + "]" * 50_000) == (0, None)


def plain_expand(name, comps, depth, budget):
    """Depth first by recursion: (schema, truncated, unresolved, cycles, count)."""
    state = {"n": 0, "truncated": False, "unresolved": [], "cycles": []}

    def schema(node, trail):
        if not isinstance(node, dict):
            return node
        if isinstance(ref := node.get("$ref"), str):
            if ref in trail:
                state["cycles"].append(ref)
                return {"$ref": ref, "_cycle": True}
            if len(trail) >= depth or state["n"] >= budget:
                state["truncated"] = True
                return {"$ref": ref, "_truncated": "depth" if len(trail) >= depth else "nodes"}
            held = comps.get(ref.removeprefix("#/components/schemas/"))
            if not isinstance(held, dict) or not ref.startswith("#/components/schemas/"):
                state["unresolved"].append(ref)
                return {"$ref": ref, "_unresolved": "missing" if ref.startswith("#/components/") else "external"}
            state["n"] += 1
            return schema(held, (*trail, ref))
        out = {}
        for k, v in node.items():
            if k == "properties" and isinstance(v, dict):
                out[k] = {p: schema(x, trail) for p, x in v.items()}
            elif k in ("allOf", "anyOf") and isinstance(v, list):
                out[k] = [schema(x, trail) for x in v]
            else:
                out[k] = schema(v, trail) if k == "items" else v
        return out

    made = schema({"$ref": f"#/components/schemas/{name}"}, ())
    return made, state["truncated"], state["unresolved"], state["cycles"], state["n"]


def some_components(rng, n):
    def ref():
        to = rng.choice([f"#/components/schemas/S{rng.randrange(n)}"] * 6 + ["#/components/schemas/Gone", "#/components/schemas/Odd", "other.json#/X"])
        return {"$ref": to, "description": "dropped"} if rng.random() < 0.2 else {"$ref": to}

    def node(depth):
        if depth == 0 or rng.random() < 0.4:
            return ref()
        out = {"type": "object", "properties": {rng.choice(["a", "b/c", "d#0", "~", "$ref"]) + str(i) * (i > 0): node(depth - 1) for i in range(rng.randrange(4))}}
        if rng.random() < 0.4:
            out["allOf"] = [node(depth - 1), {"type": "string", "enum": ["x", None, 1.5]}]
        if rng.random() < 0.3:
            out["items"] = node(depth - 1)
        return out

    return {f"S{i}": node(2) for i in range(n)} | {"Odd": ["no object"]}


@pytest.mark.parametrize("depth,budget", [(0, 200), (2, 7), (6, 15)])
def test_expansion_equals_a_depth_first_walk(spark, depth, budget):
    rng = random.Random(depth)
    made = {f"spec{s}": some_components(rng, 6) for s in range(8)}
    held = [(s, "schemas", n, json.dumps(v)) for s, comps in made.items() for n, v in comps.items()] + [("spec0", "responses", "S1", "{}"), ("spec0", "schemas", "Null", None)]
    roots = [(s, n) for s, comps in made.items() for n in [*comps, "Nope"]] + [("spec0", "S0"), ("spec0", "Null"), ("none", "S0")]
    got = refs.expand(spark.createDataFrame(roots, "source string, name string"), spark.createDataFrame(held, "source string, section string, name string, node string"), depth, budget).collect()
    assert len(got) == len(set(roots))
    cut = 0
    for r in got:
        comps = made.get(r["source"], {})
        want = plain_expand(r["name"], comps, min(depth + 1, 8), budget)
        assert (json.loads(r["schema_json"]), r["truncated"], r["unresolved"], r["cycles"], r["node_count"]) == want, r
        assert list(json.loads(r["schema_json"])) == list(want[0]) and r["found"] == (r["name"] in comps)
        cut += "nodes" in str(want[0])
    assert cut > 3 or budget > 100


def test_nothing_to_expand(spark):
    none = spark.createDataFrame([], "source string, section string, name string, node string")
    assert refs.expand(spark.createDataFrame([], "source string, name string"), none).collect() == []
    got = refs.expand(spark.createDataFrame([("s", "A")], "source string, name string"), none).first()
    assert (got["found"], got["unresolved"], got["node_count"]) == (False, ["#/components/schemas/A"], 0)
