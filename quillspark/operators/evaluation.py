"""Evaluation of rankings on labelled queries, and the choice of ranking constants."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They must equal the evaluation's definition for equal results.
WRITE_METHODS = ("POST", "PUT", "PATCH", "DELETE")
ID_PATTERN = r"^(s|rn|h|n)-[0-9]{3}$"
ORIGIN_PATTERN = r"^(seed|held_out|negative|promoted)-r[0-9]+$"
NEGATIVE_SECTIONS = ("negative", "regression_negative")
ACCEPT_COMPONENTS = ("wv", "fr", "ir", "sr3", "src", "srk", "rp3", "rpk", "nab")
BONUS_KEYS = ("path_coverage_bonus", "method_order_bonus")
CONSTANT_KEYS = ("method_match_bonus", "method_mismatch_penalty", "path_unmatched_penalty", "path_unmatched_cap", "product_hint_bonus", "resource_match_bonus", "method_order_bonus", "path_coverage_bonus")


def _all(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def invalid_records(records: DataFrame) -> DataFrame:
    """(section, id, problem) of malformed records: section, id, query, expected, forbidden, origin."""
    negative = F.col("section").isin(*NEGATIVE_SECTIONS)
    n_exp, n_forb = F.size(F.coalesce("expected", F.array().cast("array<string>"))), F.size(F.coalesce("forbidden", F.array().cast("array<string>")))
    checks = {
        "bad_id": ~F.coalesce(F.col("id").rlike(ID_PATTERN), F.lit(False)),
        "empty_query": F.trim(F.coalesce("query", F.lit(""))) == "",
        "missing_lists": F.col("expected").isNull() | F.col("forbidden").isNull(),
        "negative_shape": negative & ((n_exp > 0) | (n_forb == 0)),
        "positive_shape": ~negative & (n_exp == 0),
        "bad_origin": ~F.coalesce(F.col("origin").rlike(ORIGIN_PATTERN), F.lit(False)),
        "expected_is_forbidden": (F.col("section") == "regression_positive") & F.coalesce(F.arrays_overlap("expected", "forbidden"), F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    own = records.select("section", "id", F.explode(found).alias("problem"))
    twice = records.groupBy("section", "id").count().where("count > 1").select("section", "id", F.lit("duplicate_id").alias("problem"))
    return own.union(twice)


def judge(records: DataFrame, top1: DataFrame) -> DataFrame:
    """Each record judged by the first result of its query.

    ``records``: section, id, expected, forbidden; ``top1``: id, key, actionable."""
    j = records.join(top1, "id", "left").withColumn("actionable", F.coalesce("actionable", F.lit(False)))
    no = F.lit(False)
    raw = ((F.size("expected") == 0) | F.coalesce(F.array_contains("expected", F.col("key")), no)) & ~F.coalesce(F.array_contains("forbidden", F.col("key")), no)
    ok = F.when(F.col("section") == "held_out", raw & F.col("actionable")).when(F.col("section").isin(*NEGATIVE_SECTIONS), raw | ~F.col("actionable")).otherwise(raw)
    return j.select("section", "id", "key", "actionable", raw.alias("raw_ok"), ok.alias("ok"))


def judge_totals(judged: DataFrame) -> DataFrame:
    return judged.groupBy("section").agg(
        F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if("raw_ok").alias("raw_passed"), F.count_if("actionable").alias("actionable"),
        F.count_if(F.col("actionable") & F.col("raw_ok")).alias("actionable_raw_passed"), F.count_if(~F.col("actionable")).alias("abstained"),
    )


def usage(records: DataFrame, ranked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What a user sees of each record. ``ranked``: id, keys (best first), recommended, eligible;
    with columns ``by`` a record has a row for each of its rows there, and none without one."""
    r = records.join(ranked, "id", "inner" if by else "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>"))).withColumn("eligible", F.coalesce("eligible", F.lit(True)))
    rec, no = F.col("recommended"), F.lit(False)
    right = F.coalesce(F.array_contains("expected", rec), no)
    return r.select(
        *by, "section", "id", F.get("keys", F.lit(0)).alias("top1"),
        F.coalesce(F.array_contains("expected", F.get("keys", F.lit(0))), no).alias("top1_correct"),
        F.arrays_overlap("expected", F.slice("keys", 1, 3)).alias("top3"),
        "recommended", rec.isNull().alias("abstained"), right.alias("rec_correct"),
        F.coalesce(rec.isNotNull() & ~right & F.get(F.split(rec, ":"), F.lit(1)).isin(*WRITE_METHODS), no).alias("wrong_write"),
        F.coalesce(F.array_contains("forbidden", rec), no).alias("forbidden_recommended"), "eligible",
    )


def gate(rows: DataFrame) -> DataFrame:
    """Counts and pass marks over held_out and negative usage rows, in whole-number fractions."""
    held, neg = F.col("section") == "held_out", F.col("section") == "negative"
    c = rows.agg(
        F.count_if(held).alias("held_out"), F.count_if(neg).alias("negative"), F.count_if(held & F.col("eligible")).alias("held_out_eligible"),
        F.count_if(held & F.col("top3")).alias("reach3"), F.count_if(held & ~F.col("abstained")).alias("recommended"),
        F.count_if(held & F.col("rec_correct")).alias("correct"), F.count_if((held | neg) & F.col("wrong_write")).alias("wrong_writes"),
        F.count_if(neg & F.col("abstained")).alias("abstained"), F.count_if(held & ~F.col("eligible") & ~F.col("abstained")).alias("ineligible_recommended"),
        F.count_if(held & F.col("top1_correct")).alias("top1_correct"),
    )
    marks = {
        "reach": 16 * F.col("reach3") >= 15 * F.col("held_out"),
        "coverage": 16 * F.col("recommended") >= 14 * F.col("held_out_eligible"),
        "precision": (F.col("recommended") > 0) & (10 * F.col("correct") >= 9 * F.col("recommended")),
        "write_safety": F.col("wrong_writes") == 0,
        "abstention": 8 * F.col("abstained") >= 7 * F.col("negative"),
        "eligibility": F.col("ineligible_recommended") == 0,
    }
    return c.select("*", *[m.alias(k) for k, m in marks.items()], _all(*marks.values()).alias("pass"))


def training_vector(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The metric vector of seed, regression_positive and regression_negative usage rows."""
    seed, rp, rn = (F.col("section") == s for s in ("seed", "regression_positive", "regression_negative"))
    n = lambda c: F.count_if(c)
    return rows.groupBy(*(by or [])).agg(
        n((seed | rp | rn) & F.col("wrong_write")).alias("wv"), n((seed | rp | rn) & F.col("forbidden_recommended")).alias("fr"),
        n((seed | rp) & ~F.col("eligible") & ~F.col("abstained")).alias("ir"), n(seed & F.col("top3")).alias("sr3"), n(seed & ~F.col("abstained")).alias("src"),
        n(seed & F.col("rec_correct")).alias("srk"), n(rp & F.col("top3")).alias("rp3"), n(rp & F.col("rec_correct")).alias("rpk"), n(rn & F.col("abstained")).alias("nab"),
        n(seed).alias("n_seed"), n(rp).alias("n_rp"), n(rn).alias("n_rn"), n(seed & F.col("eligible")).alias("n_seed_elig"), n(rp & F.col("eligible")).alias("n_rp_elig"),
    )


def accepted() -> Column:
    """Whether a metric vector is good enough, in whole-number fractions."""
    c = F.col
    return _all(c("wv") == 0, c("fr") == 0, c("ir") == 0, 10 * c("sr3") >= 9 * c("n_seed"), 10 * c("src") >= 9 * c("n_seed_elig"), 10 * c("srk") >= 9 * c("src"), c("rp3") == c("n_rp"), c("rpk") == c("n_rp_elig"), 8 * c("nab") >= 7 * c("n_rn"))


def fallback_key() -> Column:
    """Smaller is better where no vector is accepted."""
    return F.struct("wv", "fr", "ir", *[(-F.col(k)).alias(f"minus_{k}") for k in ("sr3", "srk", "src", "rp3", "rpk", "nab")])


def violation() -> Column:
    """Whether a usage row of the training sections calls for a change."""
    positive = F.when(~F.col("eligible"), ~F.col("abstained") | ~F.col("top3")).otherwise(~F.col("top3") | F.col("abstained") | ~F.col("rec_correct"))
    return F.col("wrong_write") | F.col("forbidden_recommended") | F.when(F.col("section") == "regression_negative", ~F.col("abstained")).otherwise(positive)


# ---- the grid of constants --------------------------------------------------------------------


def grid_points(axes: dict[str, DataFrame]) -> DataFrame:
    """The product of one-column axes (name, DataFrame of values): a few values each."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes.values())


#: What a point needs of a candidate besides its query and key.
FEATURES = ("lexical", "intent", "unmatched", "hinted", "resource", "first", "covered", "deprecated", "tier", "tie")


def collapse(candidates: DataFrame) -> DataFrame:
    """One candidate for each query and vector of FEATURES: the smallest key. The others come
    after it at every point, as an order by equal values ends in the key."""
    return candidates.groupBy("query_id", *FEATURES).agg(F.min("key").alias("key"))


#: The features by which a candidate's score rises, and those by which it falls, where the
#: constants they go with aren't negative.
RISING = {"lexical": (), "intent": ("method_match_bonus", "method_mismatch_penalty"), "hinted": ("product_hint_bonus",), "resource": ("resource_match_bonus",), "first": ("method_order_bonus",), "covered": ("path_coverage_bonus",)}
FALLING = {"unmatched": ("path_unmatched_penalty", "path_unmatched_cap"), "deprecated": ()}
#: Vectors of one query that are compared at a time with those kept so far.
SKYLINE_BLOCK = 256


def skyline(vectors: DataFrame, negative: tuple[str, ...] = ()) -> DataFrame:
    """Of each query's vectors (from ``collapse``) those that can be first at some point.

    One goes if another comes before it at every point: in tier no later, in every feature no
    worse (for constants in ``negative``, which may be below 0: equal), and in what decides equal
    scores no later. Sums and products keep their order when rounded, so that holds to the
    last bit. A query's vectors are few, whatever its operations; they are sorted so that
    what can drop a vector comes before it, and compared in blocks with those kept so far."""
    order = sorted(RISING), sorted(FALLING)
    fixed = [f for f, axes in (RISING | FALLING).items() if set(axes) & set(negative)]

    def keep(table: pa.Table) -> pa.Table:
        col = lambda c: table[c].to_numpy(zero_copy_only=False)
        f = np.stack([col(c).astype(float) for c in order[0]] + [-col(c).astype(float) for c in order[1]], axis=1)
        same = [list(order[0] + order[1]).index(c) for c in fixed]
        tier, tie, dep = (col(c).astype(np.int64) for c in ("tier", "tie", "deprecated"))
        place = np.empty(len(f), np.int64)
        place[np.lexsort([col("key").astype(str), dep, tie])] = np.arange(len(f))
        seq = np.lexsort([place, -f.sum(axis=1), tier])
        kept = np.zeros(0, np.int64)
        for i in range(0, len(seq), SKYLINE_BLOCK):
            block = seq[i : i + SKYLINE_BLOCK]
            over = np.concatenate([kept, block])
            no_worse = (f[over][:, None] >= f[block][None]).all(axis=2) & (f[over][:, None, same] == f[block][None, :, same]).all(axis=2)
            before = (tier[over][:, None] < tier[block][None]) | (tier[over][:, None] == tier[block][None]) & (place[over][:, None] < place[block][None])
            kept = np.concatenate([kept, block[~(no_worse & before).any(axis=0)]])
        return table.take(pa.array(np.sort(kept)))

    cols = vectors.select("query_id", *FEATURES, "key")
    return cols.groupBy("query_id").applyInArrow(keep, cols.schema)


def final_score() -> Column:
    """The score of a candidate's features at a point (a column for each constant)."""
    c = F.col
    intent = F.when(c("intent") > 0, c("method_match_bonus")).when(c("intent") < 0, -c("method_mismatch_penalty")).otherwise(0.0)
    flag = lambda name, value: F.when(c(name), c(value)).otherwise(0.0)
    structural = intent - F.least(c("unmatched").cast("double"), c("path_unmatched_cap")) * c("path_unmatched_penalty") + flag("hinted", "product_hint_bonus") + flag("resource", "resource_match_bonus") + flag("first", "method_order_bonus") + c("covered") * c("path_coverage_bonus")
    return F.greatest(c("lexical") + structural, F.lit(0.0)) * F.when(c("deprecated"), 0.7).otherwise(1.0)


def sweep(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """The best key of each query at each point, in the order of the search.

    ``candidates`` (query_id, key, FEATURES) are collapsed first, and of each query only those
    stay that some point can put first, so that what meets the points is a few vectors for each
    query; points are the broadcast side (their number is the grid's), and the best row of
    each (point, query) is kept while rows are made."""
    low = points.agg(*[F.min(k).alias(k) for k in CONSTANT_KEYS]).first()
    negative = tuple(k for k in CONSTANT_KEYS if low[k] is not None and low[k] < 0)
    scored = skyline(collapse(candidates), negative).crossJoin(F.broadcast(points)).withColumn("final", final_score()).where("final > 0")
    best = F.struct("tier", (-F.col("final")).alias("f"), "tie", "deprecated", "key")
    out = scored.groupBy("point_id", "query_id").agg(F.min(best).alias("b"))
    return out.select("point_id", "query_id", "b.key", (-F.col("b.f")).alias("best_final"))


def passing_points(best: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(point_id) of points at which every fixture (query_id, keys) has one of its keys first."""
    n = fixtures.agg(F.count("*").alias("n"))
    right = best.join(fixtures, "query_id").where(F.array_contains("keys", F.col("key"))).groupBy("point_id").agg(F.count("*").alias("right"))
    return best.select("point_id").distinct().join(right, "point_id", "left").crossJoin(F.broadcast(n)).where(F.coalesce("right", F.lit(0)) == F.col("n")).select("point_id")


def select_point(vectors: DataFrame, axes: dict[str, list[float]], baseline: dict[str, float]) -> DataFrame:
    """The chosen point: accepted ones (else the best by fallback), then smaller bonuses,
    fewer grid steps from the baseline, a smaller sum of magnitudes, and the smaller tuple."""
    step = lambda k: F.array_position(F.array(*[F.lit(float(v)) for v in axes[k]]), F.col(k).cast("double"))
    distance = sum((F.abs(step(k) - (axes[k].index(baseline[k]) + 1)) for k in axes), F.lit(0))
    magnitude = sum((F.col(k).cast("double") for k in axes if k != "path_unmatched_cap"), F.lit(0.0))
    bonuses = [F.col(k).cast("double") for k in BONUS_KEYS if k in axes]
    pool = F.when(accepted(), 0).otherwise(1)
    fallback = F.when(accepted(), F.lit(None)).otherwise(fallback_key())
    return vectors.withColumn("accepted", accepted()).orderBy(pool, fallback.asc_nulls_first(), *bonuses, distance, magnitude, *[F.col(k) for k in axes]).limit(1)


def compare_runs(off: DataFrame, on: DataFrame) -> DataFrame:
    """Ablation: off and on hold (variant, query_id, key, expected). Of queries right in the
    off run, how many are lost; how many are gained; ok if 100 * losses <= eligible > 0."""
    a = off.select("query_id", "expected", F.col("key").alias("off_key"))
    b = on.select("query_id", "variant", F.col("key").alias("on_key"))
    no = F.lit(False)
    j = a.join(b, "query_id").withColumn("was", F.coalesce(F.col("off_key") == F.col("expected"), no)).withColumn("now", F.coalesce(F.col("on_key") == F.col("expected"), no))
    t = j.groupBy("variant").agg(F.count_if("was").alias("eligible"), F.count_if(F.col("was") & ~F.col("now")).alias("losses"), F.count_if(~F.col("was") & F.col("now")).alias("gains"))
    return t.withColumn("ok", (100 * F.col("losses") <= F.col("eligible")) & (F.col("eligible") > 0))


def ranking_differences(want: DataFrame, got: DataFrame) -> DataFrame:
    """(query_id, first_difference): the first rank where keys or scores of two runs differ."""
    w = want.select("query_id", "rank", F.col("key").alias("k1"), F.col("score").alias("s1"))
    g = got.select("query_id", "rank", F.col("key").alias("k2"), F.col("score").alias("s2"))
    j = w.join(g, ["query_id", "rank"], "full")
    return j.where(~(F.col("k1").eqNullSafe(F.col("k2")) & F.col("s1").eqNullSafe(F.col("s2")))).groupBy("query_id").agg(F.min("rank").alias("first_difference"))


def policy_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(word, change) between two alias maps (word, targets): added, removed or changed."""
    x, y = a.select("word", F.array_sort("targets").alias("t1")), b.select("word", F.array_sort("targets").alias("t2"))
    j = x.join(y, "word", "full")
    change = F.when(F.col("t1").isNull(), "added").when(F.col("t2").isNull(), "removed").when(F.col("t1") != F.col("t2"), "changed")
    return j.withColumn("change", change).where("change is not null").select("word", "change", F.col("t1").alias("before"), F.col("t2").alias("after"))


def counterexample_losses(changed: DataFrame, summaries: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """For each changed key the operations whose summary holds all its tokens, and how many
    were found first by their own summary before the change but not after it.

    ``changed``: word, tokens; ``summaries``: key, tokens; ``before``, ``after``: query_key, top1."""
    words = changed.select("word", F.size(F.array_distinct("tokens")).alias("n"), F.explode(F.array_distinct("tokens")).alias("token"))
    ops = summaries.select("key", F.explode(F.array_distinct("tokens")).alias("token"))
    held = words.join(ops, "token").groupBy("word", "n", "key").agg(F.count("*").alias("got")).where("got = n").select("word", "key")
    no = F.lit(False)
    j = held.join(before.select(F.col("query_key").alias("key"), F.col("top1").alias("b")), "key", "left").join(after.select(F.col("query_key").alias("key"), F.col("top1").alias("a")), "key", "left")
    was, now = F.coalesce(F.col("b") == F.col("key"), no), F.coalesce(F.col("a") == F.col("key"), no)
    return j.groupBy("word").agg(F.count("*").alias("operations"), F.count_if(was).alias("eligible"), F.count_if(was & ~now).alias("losses"))
