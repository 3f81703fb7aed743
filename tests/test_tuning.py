from pyspark.sql import functions as F
from test_counterfactual import ADDS, ALIASES, RANKING, WORDS, catalog

from quillspark.operators import counterfactual as C
from quillspark.operators import evaluation as E
from quillspark.operators import search as S
from quillspark.operators import tuning as N

ROW = "trial_id int, section string, id string, top3 boolean, abstained boolean, rec_correct boolean, wrong_write boolean, forbidden_recommended boolean, eligible boolean"


def test_trials_are_singles_then_pairs_of_different_words():
    assert N.trial_order([("b", "y"), ("a", "x"), ("a", "z")]) == [(("a", "x"),), (("a", "z"),), (("b", "y"),), (("a", "x"), ("b", "y")), (("a", "z"), ("b", "y"))]


def test_first_trial_that_mends_and_harms_nothing_is_taken(spark):
    def usage_of(trials):
        rows = []
        for i, t in trials:
            mended = ("a", "good") in t
            harm = ("a", "bad") in t
            rows.append((i, "seed", "s-001", mended or harm, False, mended or harm, False, False, True))
            rows.append((i, "seed", "s-002", True, False, True, harm, False, True))
        return spark.createDataFrame(rows, ROW)

    got = N.propose_aliases([("s-001", "seed")], {"s-001": [("a", "bad"), ("a", "good"), ("b", "x")]}, usage_of)
    assert got == [("a", "good")]
    assert N.propose_aliases([("s-001", "seed")], {}, usage_of) == []


def test_proposals_over_a_table_equal_the_plain_loop(spark):
    """All trials at once on stored scores, against one search for each list of trials."""
    q, ops = catalog(spark)
    tables = spark.createDataFrame(ALIASES, "word string, target string"), spark.createDataFrame(WORDS, "rule_id int, word string"), spark.createDataFrame(ADDS, "rule_id int, target string")
    base = C.store(q, ops, RANKING, *tables)
    queries = {r["query_id"]: r["query"].split() for r in q.collect()}
    tops = lambda a: {r["query_id"]: r["key"] for r in S.search(q, ops, RANKING, 1, spark.createDataFrame(ALIASES + a, "word string, target string"), *tables[1:]).collect()}
    first, wished = tops([]), tops([("thing", "page"), ("gadget", "label")])
    moved = sorted(k for k in first if wished[k] != first[k])
    assert len(moved) > 3
    # the moved ones want what aliases would show first; one of them is harmed by the first trial
    recs = [("seed" if i % 2 else "regression_positive", k, [wished[k]], [first[k]]) for i, k in enumerate(moved)]
    recs += [("regression_negative", k, [], [first[k]]) for k in sorted(set(first) - set(moved))[:5]] + [("held_out", k, [first[k]], []) for k in sorted(set(first) - set(moved))[5:9]]
    records = spark.createDataFrame(recs, "section string, id string, expected array<string>, forbidden array<string>")
    shown = lambda t: t.groupBy("trial_id", F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("keys"), F.max("score").alias("s")).select("trial_id", "id", "keys", F.when(F.col("s") > 14, F.get("keys", F.lit(0))).alias("recommended"), (F.length("id") > 2).alias("eligible"))
    training = records.where("section <> 'held_out'")

    def usage_of(trials):
        rows = None
        for i, acts in trials:
            a = spark.createDataFrame(ALIASES + list(acts), "word string, target string")
            top = S.search(q, ops, RANKING, 3, a, *tables[1:]).select(F.lit(str(i)).alias("trial_id"), "query_id", "rank", "key", "score")
            one = E.usage(training, shown(top).drop("trial_id")).select(F.lit(i).alias("trial_id"), "*")
            rows = one if rows is None else rows.union(one)
        return rows

    before = usage_of([(0, ())])
    open_ = [(r["id"], r["section"]) for r in before.where(E.violation()).collect() if r["id"] in moved][:1]
    acts = {i: [(w, t) for w in queries[i] if w in ("thing", "gadget") for t in ("crate", "page")] for i, _ in open_}
    want = N.propose_aliases(open_, acts, usage_of, budget=3, per_record=1)
    actions = spark.createDataFrame([(i, w, t) for i, a in acts.items() for w, t in a], "id string, word string, target string")
    got = N.propose_over(base, records, actions, shown, budget=3, per_record=1).orderBy("place").collect()
    assert [(r["word"], r["target"]) for r in got] == want and want


def test_trials_of_a_table_are_in_the_same_order(spark):
    acts = [("b", "y"), ("a", "x"), ("a", "z"), ("a", "x")]
    rows = N.trials_of(spark.createDataFrame([("r", *a) for a in acts], "id string, word string, target string")).orderBy("place").collect()
    assert [tuple(tuple(x) for x in r["acts"]) for r in rows] == N.trial_order(acts)
