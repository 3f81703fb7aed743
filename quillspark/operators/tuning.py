"""Proposal of aliases: a greedy search whose trials of one record are scored together."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import counterfactual as C
from quillspark.operators import evaluation as E
from quillspark.sources.stages import written

BUDGET = 15
PER_RECORD = 2


def trial_order(actions: list[tuple[str, str]]) -> list[tuple[tuple[str, str], ...]]:
    """Single (word, target) actions in order, then pairs of different words."""
    acts = sorted(set(actions))
    return [(a,) for a in acts] + [p for p in combinations(acts, 2) if p[0][0] != p[1][0]]


def improved(section: Column) -> Column:
    """Whether a row of flags mends the same flags before it, named with ``b_``."""
    harm = lambda p: F.col(f"{p}wrong_write") | F.col(f"{p}forbidden_recommended")
    gone = harm("b_") & ~harm("")
    quiet = ~F.col("b_abstained") & F.col("abstained")
    better = (~F.col("b_top3") & F.col("top3")) | (~F.col("b_rec_correct") & F.col("rec_correct"))
    return gone | F.when(section == "regression_negative", quiet).otherwise(better | (~F.col("b_eligible") & quiet))


def improvements(before: DataFrame, after: DataFrame, section: str) -> DataFrame:
    """(trial_id) of the trials that mend the record: harm gone, or a rightly abstained,
    reached or recommended result that wasn't there before. Both hold one record's usage row."""
    b = before.select(*[F.col(c).alias(f"b_{c}") for c in ("wrong_write", "forbidden_recommended", "abstained", "top3", "rec_correct", "eligible")])
    return after.crossJoin(F.broadcast(b)).where(improved(F.lit(section))).select("trial_id")


def no_worse(base: DataFrame, vectors: DataFrame) -> DataFrame:
    """(trial_id) of the metric vectors that are at least as good as ``base`` in every part."""
    parts = ("wv", "fr", "ir", "sr3", "src", "srk", "rp3", "rpk", "nab")
    b = base.select(*[F.col(p).alias(f"b_{p}") for p in parts])
    j = vectors.crossJoin(F.broadcast(b))
    ok = F.lit(True)
    for p in parts:
        ok = ok & (F.col(p) <= F.col(f"b_{p}") if p in ("wv", "fr", "ir") else F.col(p) >= F.col(f"b_{p}"))
    return j.where(ok).select("trial_id")


def propose_aliases(violating: list[tuple[str, str]], actions: dict[str, list[tuple[str, str]]], usage_of: Callable[[list[tuple[int, tuple]]], DataFrame], budget: int = BUDGET, per_record: int = PER_RECORD) -> list[tuple[str, str]]:
    """Accepted (word, target) aliases, record by record in the order of ids.

    ``violating``: (id, section) of records that call for a change; ``actions``: their
    candidate aliases; ``usage_of`` maps trials (trial_id, aliases on top of none) to usage
    rows of all records with a trial_id column, in one Spark job. The first trial by order
    that improves its record and worsens nothing is accepted; later records see it."""
    taken: list[tuple[str, str]] = []
    for rid, section in sorted(violating):
        room = min(per_record, budget - len(taken))
        trials = [t for t in trial_order(actions.get(rid, [])) if len(t) <= room and not {w for w, _ in t} & {w for w, _ in taken}]
        if not trials:
            continue
        rows = usage_of([(0, tuple(taken)), *((i, (*taken, *t)) for i, t in enumerate(trials, 1))]).persist()
        vectors = E.training_vector(rows, ["trial_id"])
        own = rows.where(F.col("id") == rid)
        better = improvements(own.where("trial_id = 0"), own.where("trial_id > 0"), section)
        first = better.join(no_worse(vectors.where("trial_id = 0"), vectors.where("trial_id > 0")), "trial_id").agg(F.min("trial_id")).first()[0]
        rows.unpersist()
        if first is not None:
            taken += trials[first - 1]
    return taken


def trials_of(actions: DataFrame, per_record: int = PER_RECORD) -> DataFrame:
    """(id, place, acts) from (id, word, target): each record's single actions in order, then its
    pairs of actions on different words, numbered as ``trial_order`` does."""
    acts = actions.distinct().groupBy("id").agg(F.array_sort(F.collect_list(F.struct("word", "target"))).alias("all"))
    singles = F.transform("all", lambda a: F.array(a))
    pairs = F.flatten(F.transform("all", lambda a, i: F.transform(F.filter(F.slice("all", i + 2, F.size("all")), lambda b: b["word"] != a["word"]), lambda b: F.array(a, b))))
    every = F.concat(singles, pairs) if per_record > 1 else singles
    return acts.select("id", F.posexplode(every).alias("place", "acts"))


METRICS = ("wv", "fr", "ir", "sr3", "src", "srk", "rp3", "rpk", "nab")


def propose_over(base: C.Base, records: DataFrame, actions: DataFrame, shown: Callable[[DataFrame], DataFrame], budget: int = BUDGET, per_record: int = PER_RECORD) -> DataFrame:
    """(place, id, word, target) of the accepted aliases; ``propose_aliases`` over a whole table of
    records, with what they are shown made from deltas to a stored ranking.

    ``records``: section, id (of its query), expected, forbidden. ``actions``: id, word, target, the
    candidates of a record. ``shown`` maps (trial_id, query_id, rank, key, score) to (trial_id, id,
    keys, recommended, eligible).

    All trials of all records are scored in one job on top of what is accepted so far; the first
    record by id with a trial that mends it and worsens nothing takes its first such trial.
    Records before it stay as they are, those behind it are tried again on top of that. So there
    is a job for each accept and one more, ``budget`` + 1 at most, whatever the records."""
    spark = records.sparkSession
    none = lambda ddl: spark.createDataFrame([], ddl)
    rules = none("trial_id string, rule_id string, word string"), none("trial_id string, rule_id string, target string")
    training = records.where(F.col("section").isin("seed", "regression_positive", "regression_negative"))

    def rows_of(tops: DataFrame) -> DataFrame:
        return E.usage(training, shown(tops), ("trial_id",))

    places = C.first_places(base, 3).select(F.lit("").alias("trial_id"), "query_id", F.col("place").alias("rank"), "key", F.col("final").alias("score"))
    start = written(rows_of(places.join(base.pins.select("query_id"), "query_id", "left_anti").union(C.pinned_tops(base))))
    missing = training.join(start.select("id"), "id", "left_anti")
    start = written(start.union(E.usage(missing, shown(none("trial_id string, query_id string, rank int, key string, score double")).drop("trial_id")).select(F.lit("").alias("trial_id"), "*")))
    trials = written(trials_of(actions.join(training.select("id"), "id", "left_semi"), per_record))
    taken: list[tuple[str, str, str]] = []
    behind = None
    now = start
    while len(taken) < budget:
        open_ = now.where(E.violation()).select("id", "section")
        open_ = open_ if behind is None else open_.where(F.col("id") > behind)
        words = [w for _, w, _ in taken]
        fits = trials.where(F.size("acts") <= min(per_record, budget - len(taken)))
        fits = fits.where(~F.exists("acts", lambda a: a["word"].isin(words))) if words else fits
        name = F.concat_ws("\x01", "id", F.col("place").cast("string"))
        asked = written(fits.join(open_, "id").select(name.alias("trial_id"), "id", "section", "place", "acts"))
        own = asked.select("trial_id", F.explode("acts").alias("a")).select("trial_id", "a.word", "a.target")
        so_far = spark.createDataFrame([(w, t) for _, w, t in taken], "word string, target string")
        every = own.union(asked.select("trial_id").crossJoin(F.broadcast(so_far))) if taken else own
        changed = written(rows_of(C.tops(base, every, *rules, limit=3).select("trial_id", "query_id", "rank", "key", "score")))
        # a trial's metrics are those before, less the records it shows anew as they were, plus as they are
        old = changed.select("trial_id", "id").join(start.drop("trial_id"), "id")
        sums = lambda rows, sign: E.training_vector(rows, ["trial_id"]).select("trial_id", *[(sign * F.col(m)).alias(m) for m in METRICS])
        delta = sums(changed, 1).union(sums(old.select(*changed.columns), -1)).groupBy("trial_id").agg(*[F.sum(m).alias(m) for m in METRICS])
        at_start, at_now = (E.training_vector(x).first() for x in (start, now))
        for m in METRICS:
            delta = delta.withColumn(m, F.col(m) + at_start[m])
        good = F.lit(True)
        for m in METRICS:
            good = good & (F.col(m) <= at_now[m] if m in ("wv", "fr", "ir") else F.col(m) >= at_now[m])
        flags = ("wrong_write", "forbidden_recommended", "abstained", "top3", "rec_correct", "eligible")
        mine = asked.join(changed.drop("section"), ["trial_id", "id"]).join(now.select("id", *[F.col(c).alias(f"b_{c}") for c in flags]), "id")
        better = mine.where(improved(F.col("section")))
        best = better.join(delta.where(good).select("trial_id"), "trial_id").orderBy("id", "place").select("id", "trial_id", "acts").limit(1).collect()
        if not best:
            break
        behind, trial = best[0]["id"], best[0]["trial_id"]
        taken += [(behind, a["word"], a["target"]) for a in best[0]["acts"]]
        shown_now = changed.where(F.col("trial_id") == trial)
        now = written(start.join(shown_now.select("id"), "id", "left_anti").select(*changed.columns).union(shown_now))
    return spark.createDataFrame([(i, *t) for i, t in enumerate(taken)], "place int, id string, word string, target string")
