"""Trials as deltas against searches made anew with the trial's aliases and rules."""

import random

import pytest

from quillspark.operators import counterfactual as C
from quillspark.operators import search as S

RANKING = S.Ranking(verbs={"list": ["GET"], "make": ["POST", "PUT"]}, noise=("rest",), hints={"wiki": ["b"]}, singular_collection_tiebreak=False)
ALIASES, WORDS, ADDS = [("ticket", "issue"), ("box", "crate")], [(0, "issue"), (0, "open")], [(0, "crate")]
ALIAS, WORD, ADD = "trial_id string, word string, target string", "trial_id string, rule_id string, word string", "trial_id string, rule_id string, target string"


def catalog(spark):
    rng = random.Random(7)
    nouns = ["issue", "issues", "crate", "box", "page", "wiki", "user", "open", "label"]
    rows = []
    for i in range(60):
        a, b = rng.choice(nouns), rng.choice(nouns)
        path = f"/rest/{a}/{{id}}/{b}" if i % 3 else f"/rest/{a}/{b}s"
        method = rng.choice(["GET", "POST", "PUT"])
        rows.append((f"{'ab'[i % 2]}:{method}:{path}{i}", "ab"[i % 2], method, path + str(i), f"{method.lower()}{a.title()}{i}", f"{rng.choice(nouns)} {b}", None, [a], i % 9 == 0, []))
    ops = spark.createDataFrame(rows, "key string, source string, method string, path string, operation_id string, summary string, description string, tags array<string>, deprecated boolean, schema_names array<string>")
    words = [*nouns, "ticket", "list", "make", "thing", "gadget"]
    qs = [(f"q{i}", " ".join(rng.sample(words, rng.randrange(1, 5)))) for i in range(40)] + [("pin", rows[3][4]), ("key", rows[5][0]), ("none", "zzz")]
    return spark.createDataFrame(qs, "query_id string, query string"), ops


@pytest.fixture(scope="module")
def base(spark):
    q, ops = catalog(spark)
    tables = spark.createDataFrame(ALIASES, "word string, target string"), spark.createDataFrame(WORDS, "rule_id int, word string"), spark.createDataFrame(ADDS, "rule_id int, target string")
    return q, ops, tables, C.store(q, ops, RANKING, *tables)


TRIALS = {
    "becomes direct": ([("open", "crate")], [], []),  # what the rule added is now an alias's
    "fires a rule": ([("thing", "open"), ("gadget", "ticket")], [], []),
    "rule by alias": ([], [["issue", "thing"]], ["user"]),
    "both": ([("page", "wiki")], [["wiki", "box"], ["crate"]], ["label"]),
    "nothing": ([("unused", "page")], [], []),
}


def test_tops_equal_searches_made_anew(spark, base):
    q, ops, tables, stored = base
    aliases = [(t, w, x) for t, (a, _, _) in TRIALS.items() for w, x in a]
    words = [(t, f"r{i}", w) for t, (_, r, _) in TRIALS.items() for i, ws in enumerate(r) for w in ws]
    adds = [(t, f"r{i}", x) for t, (_, r, xs) in TRIALS.items() for i in range(len(r)) for x in xs]
    got = {}
    for r in C.tops(stored, spark.createDataFrame(aliases, ALIAS), spark.createDataFrame(words, WORD), spark.createDataFrame(adds, ADD), 3).collect():
        got.setdefault((r["trial_id"], r["query_id"]), []).append((r["rank"], r["key"], round(r["score"], 9)))

    def ranked(a, w, x):
        rows = {}
        for r in S.search(q, ops, RANKING, 3, a, w, x).collect():
            rows.setdefault(r["query_id"], []).append((r["rank"], r["key"], round(r["score"], 9)))
        return {k: sorted(v) for k, v in rows.items()}

    before = ranked(*tables)
    changed = 0
    for t, (a, r, xs) in TRIALS.items():
        if t == "nothing":
            continue
        rules = [(100 + i, w) for i, ws in enumerate(r) for w in ws]
        more = [(100 + i, x) for i in range(len(r)) for x in xs]
        after = ranked(spark.createDataFrame(ALIASES + a, "word string, target string"), spark.createDataFrame(WORDS + rules, "rule_id int, word string"), spark.createDataFrame(ADDS + more, "rule_id int, target string"))
        for query in [r["query_id"] for r in q.collect()]:
            want = after.get(query, [])
            assert sorted(got.get((t, query), before.get(query, []))) == want, (t, query)
            changed += want != before.get(query, [])
    assert changed > 10 and not any(t == "nothing" for t, _ in got)


def test_flipped_records(spark, base):
    q, ops, tables, stored = base
    lexicon = spark.createDataFrame([("thing", ["page"]), ("wiki page", ["label"]), ("box", ["issue"])], "key string, targets array<string>")
    first = {r["query_id"]: r["key"] for r in S.search(q, ops, RANKING, 1, *tables).collect()}
    records = spark.createDataFrame([(k, [v], []) for k, v in first.items() if k != "q3"] + [("q3", [], [])], "id string, expected array<string>, forbidden array<string>")
    want = set()
    for key, targets in [(r["key"], r["targets"]) for r in lexicon.collect()]:
        a, w, x = tables
        if " " in key:
            w = w.union(spark.createDataFrame([(9, t) for t in key.split()], "rule_id int, word string"))
            x = x.union(spark.createDataFrame([(9, t) for t in targets], "rule_id int, target string"))
        else:
            a = a.union(spark.createDataFrame([(key, t) for t in targets], "word string, target string"))
        now = {r["query_id"]: r["key"] for r in S.search(q, ops, RANKING, 1, a, w, x).collect()}
        want |= {(key, k) for k, v in first.items() if k != "q3" and now.get(k) != v}
    assert {tuple(r) for r in C.flipped(stored, lexicon, records).collect()} == want and want


def test_items_beside_collections_are_refused(spark, base):
    with pytest.raises(ValueError, match="collection"):
        C.store(base[0], base[1], S.Ranking(verbs={}), *base[2])
