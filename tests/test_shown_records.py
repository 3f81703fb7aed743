from pyspark.sql import functions as F

from quillspark.operators import counterfactual as C
from quillspark.plans import eval_queries as U


def test_lists_hold_what_a_judgement_of_shown_keys_looks_at(spark, tmp_path):
    """Lists don't grow with copies of a part; whether a list has any key, and a shown one, stays."""
    rows = [(i, n, "Brand#1", "SMALL", s, 1.0) for i, (n, s) in enumerate([("red ring", s) for s in range(1, 41)] + [("blue bolt", 4)])]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    whole = {r["id"]: r for r in U.records(spark, str(tmp_path)).collect()}
    keys = sorted(k for r in whole.values() for c in ("expected", "forbidden") for k in r[c])[::9]
    few = {r["id"]: r for r in U.records(spark, str(tmp_path), spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert set(few) == set(whole) == {"red ring/SMALL", "blue bolt/SMALL"}
    for i, r in few.items():
        for c in ("expected", "forbidden"):
            all_, some = whole[i][c], r[c]
            assert some == sorted(set(some)) and set(some) <= set(all_) and set(some) & set(keys) == set(all_) & set(keys)
            assert some[:1] == all_[:1] and len(some) <= len(set(all_) & set(keys)) + 3


def test_a_base_holds_groups(spark):
    """Copies that neither queries nor trials tell apart have one row for a query in the base."""
    ops = [(f"a:GET:/x/p{i}", "a", "GET", f"/x/p{i}", f"getLamp{i}", "lamp", None, ["lamp"], False, []) for i in range(30)]
    ops = spark.createDataFrame(ops, "key string, source string, method string, path string, operation_id string, summary string, description string, tags array<string>, deprecated boolean, schema_names array<string>")
    q = spark.createDataFrame([("q", "list lamp")], "query_id string, query string")
    no = spark.createDataFrame([], "word string, target string"), spark.createDataFrame([], "rule_id int, word string"), spark.createDataFrame([], "rule_id int, target string")
    base = C.store(q, ops, U.B.RANKING, *no, spark.createDataFrame([("p7",)], "target string"), 3)
    assert base.places.count() == 2  # what a trial may add, p7, and the others
    first = [r["key"] for r in C.first_places(base, 3).orderBy("place").collect()]
    assert first == sorted(f"a:GET:/x/p{i}" for i in range(30))[:3]
    trial = spark.createDataFrame([("t", "lamp", "p7")], "trial_id string, word string, target string")
    none = spark.createDataFrame([], "trial_id string, rule_id string, word string"), spark.createDataFrame([], "trial_id string, rule_id string, target string")
    got = [r["key"] for r in C.tops(base, trial, *none, 3).where(F.col("query_id") == "q").orderBy("rank").collect()]
    assert got == ["a:GET:/x/p7", *first[:2]]
