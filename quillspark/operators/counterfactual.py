"""Rankings as they would be with more aliases or rules, as deltas to stored scores.

A base ranking is made once: each query's tokens, the summed weights of each (query, operation)
and each operation's place. A trial adds aliases and rules. Only queries that hold a trial's
words are touched, and of their operations only those that hold a token which the trial adds to
the query (or takes from it, where a rule's token becomes an alias's). Their stored sums are
corrected and they are scored anew; the other operations keep their order, so the best of them
are those at the first places that no touched operation stood at, which follow from the
touched places alone. All trials of all queries are one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import search as S
from quillspark.sources.stages import written


@dataclass
class Base:
    """A stored ranking: tables of ``store``, and the ranking's rules."""

    ranking: S.Ranking
    queries: DataFrame
    tokens: DataFrame
    parts: DataFrame
    places: DataFrame
    pins: DataFrame
    op_rows: DataFrame
    index: DataFrame
    groups: S.Alike
    limit: int
    rule_words: DataFrame
    rule_adds: DataFrame



def store(queries: DataFrame, operations: DataFrame, ranking: S.Ranking, aliases: DataFrame, rule_words: DataFrame, rule_adds: DataFrame, targets: DataFrame | None = None, limit: int = 3) -> Base:
    """Everything of the base ranking that trials are measured against, over groups of operations
    that neither a query nor a trial tells apart (``search.alike``).

    ``targets`` (target): all that trials will add; without them every token tells operations
    apart. ``limit``: the rows that ``tops`` may be asked for."""
    if ranking.singular_collection_tiebreak:
        raise ValueError("an item's place beside its collection depends on its whole run of ties: rank such trials with search.search")
    queries = written(queries)
    tokens = written(S.expand(queries, aliases, rule_words, rule_adds))
    pins = written(S.exact_pins(queries, S.features(operations, ranking.noise)))
    asked = None
    if targets is not None:
        every_add = targets.select("target").union(rule_adds.select("target")).union(aliases.select("target"))
        asked = written(tokens.select("token").union(every_add.select(F.explode(T.forms(F.array("target"))))).distinct())
    groups = S.alike(operations, asked, ranking, limit, pins)
    op_rows, index = written(groups.heads), written(groups.index)
    parts = written(S.lexical_parts(queries, tokens, index, ranking))
    scored = S.score(S.combined(parts, ranking), S.query_features(queries, tokens, ranking), op_rows, ranking)
    others = scored.join(pins.select("query_id", "key"), ["query_id", "key"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*S._order()))
    places = written(others.select("query_id", "key", "source", "method", "final", "tier", "tie", "deprecated", place.alias("place")))
    # operations are also found by the path tokens that signals look at, with no weight
    both = F.array_distinct(F.flatten(F.transform(F.concat("origins", "last"), lambda o: F.array(o, T.singular(o)))))
    paths = op_rows.select(F.explode(both).alias("token"), "key", F.lit(0).cast("long").alias("weight"), F.lit(False).alias("terminal"))
    every = written(index.select("token", "key", F.col("weight").cast("long").alias("weight"), "terminal").union(paths))
    rules = rule_words.select(F.col("rule_id").cast("string").alias("rule_id"), "word").distinct(), rule_adds.select(F.col("rule_id").cast("string").alias("rule_id"), "target")
    return Base(ranking, queries, tokens, parts, places, pins, op_rows, every, groups, limit, *rules)


def first_places(base: Base, limit: int = 3) -> DataFrame:
    """The rows of ``base.places`` at the first places as operations: members, not heads."""
    return S.spread(base.places.where(F.col("place") <= limit), base.groups, limit, ["query_id"])


def _forms(rows: DataFrame, *by: str) -> DataFrame:
    return rows.select(*by, F.explode(T.forms(F.array("target"))).alias("token")).distinct()


def trial_pairs(base: Base, aliases: DataFrame, rule_words: DataFrame) -> DataFrame:
    """(trial_id, query_id) that may differ from the base: the query holds a word of the trial,
    for rules also by an alias of the base."""
    own = base.tokens.where("kind = 'base'").select("query_id", "token").distinct()
    held = base.tokens.where("kind in ('base', 'direct')").select("query_id", "token").distinct()
    by_word = lambda words, tokens: words.select("trial_id", "word").distinct().join(tokens, F.col("word") == F.col("token")).select("trial_id", "query_id")
    return by_word(aliases, own).union(by_word(rule_words, held)).distinct()


def trial_tokens(base: Base, aliases: DataFrame, rule_words: DataFrame, rule_adds: DataFrame) -> DataFrame:
    """(trial_id, query_id, token, kind) of every query that a trial's alias or rule fires in:
    all its tokens with the trial. ``rule_words``, ``rule_adds``: as in ``search.expand``, with trial_id."""
    kind = lambda k: base.tokens.where(F.col("kind") == k).select("query_id", "token")
    pair = ["trial_id", "query_id"]
    own = kind("base")
    added = _forms(aliases.join(own, F.col("word") == F.col("token")).select("trial_id", "query_id", "target"), *pair)
    reached = trial_pairs(base, aliases, rule_words)
    mine = reached.join(own, "query_id")
    direct = reached.join(kind("direct"), "query_id").select(*pair, "token").union(added).distinct().join(mine.select(*pair, "token"), [*pair, "token"], "left_anti")
    trigger = mine.select(*pair, "token").union(direct).distinct()
    every_rule = base.rule_words.select(F.lit(None).cast("string").alias("rule_trial"), F.concat(F.lit("b"), "rule_id").alias("rule_id"), "word").union(rule_words.select("trial_id", F.concat(F.lit("t"), F.col("rule_id").cast("string")), "word").distinct())
    sizes = every_rule.groupBy("rule_trial", "rule_id").agg(F.count("*").alias("size"))
    met = trigger.join(every_rule, (F.col("token") == F.col("word")) & (F.col("rule_trial").isNull() | (F.col("rule_trial") == F.col("trial_id"))))
    fired = met.groupBy(*pair, "rule_trial", "rule_id").agg(F.count("*").alias("got"))
    fired = fired.join(sizes.withColumnsRenamed({"rule_trial": "_t", "rule_id": "_r"}), F.col("rule_trial").eqNullSafe(F.col("_t")) & (F.col("rule_id") == F.col("_r")) & (F.col("got") == F.col("size"))).select(*pair, "rule_trial", "rule_id")
    adds = base.rule_adds.select(F.lit(None).cast("string").alias("_t"), F.concat(F.lit("b"), "rule_id").alias("_r"), "target").union(rule_adds.select("trial_id", F.concat(F.lit("t"), F.col("rule_id").cast("string")), "target"))
    cond = _forms(fired.join(adds, F.col("rule_trial").eqNullSafe(F.col("_t")) & (F.col("rule_id") == F.col("_r"))).select(*pair, "target"), *pair).join(trigger, [*pair, "token"], "left_anti")
    joined = reached.join(kind("joined"), "query_id")
    rows = [(mine, "base"), (joined, "joined"), (direct, "direct"), (cond, "cond")]
    out = [df.select(*pair, "token", F.lit(k).alias("kind")).distinct() for df, k in rows]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def tops(base: Base, aliases: DataFrame, rule_words: DataFrame, rule_adds: DataFrame, limit: int = 3) -> DataFrame:
    """(trial_id, query_id, rank, key, source, method, score): the first rows of every query that
    a trial fires in. Queries without a row here rank as in the base, or have no hit at all."""
    if limit > base.limit:
        raise ValueError(f"the base was stored for {base.limit} rows")
    pair, r = ["trial_id", "query_id"], base.ranking
    tokens = written(trial_tokens(base, aliases, rule_words, rule_adds))
    pairs = tokens.select(*pair).distinct()
    before = pairs.join(base.tokens.where("kind in ('direct', 'cond')"), "query_id").select(*pair, "token", "kind")
    after = tokens.where("kind in ('direct', 'cond')")
    delta = after.join(before, [*pair, "token", "kind"], "left_anti").withColumn("sign", F.lit(1)).union(before.join(after, [*pair, "token", "kind"], "left_anti").withColumn("sign", F.lit(-1)))
    at_last = F.col("terminal") if r.terminal_alias_full_weight else F.lit(False)
    part = lambda cond: F.sum(F.when(cond, F.col("sign") * F.col("weight")).otherwise(0))
    touched = delta.join(base.index, "token").groupBy(*pair, "key").agg(part(at_last).alias("d_whole"), part((F.col("kind") == "direct") & ~at_last).alias("d_direct"), part((F.col("kind") == "cond") & ~at_last).alias("d_cond"))
    touched = written(touched.join(base.pins.select("query_id", "key"), ["query_id", "key"], "left_anti"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = touched.join(base.parts, ["query_id", "key"], "left").select(
        F.struct(*pair).alias("query_id"), "key", (zero("whole") + F.col("d_whole")).alias("whole"), (zero("direct") + F.col("d_direct")).alias("direct"),
        (zero("cond") + F.col("d_cond")).alias("cond"), F.coalesce("every", F.lit(False)).alias("every"),
    )
    asked = pairs.join(base.queries, "query_id").select(F.struct(*pair).alias("query_id"), "query")
    rows = S.query_features(asked, tokens.select(F.struct(*pair).alias("query_id"), "token", "kind"), r)
    scored = S.score(S.combined(parts, r), rows, base.op_rows, r).select("query_id.*", "key", "source", "method", "final", "tier", "tie", "deprecated")
    # the k-th place without a touched operation: k and as many touched ones as stand before it
    stood = touched.join(base.places.select("query_id", "key", "place"), ["query_id", "key"]).select(*pair, "place")
    stood = stood.withColumn("free_before", F.col("place") - F.row_number().over(Window.partitionBy(*pair).orderBy("place")))
    gone = stood.groupBy(*pair).agg(*[F.count_if(F.col("free_before") < k).alias(f"n{k}") for k in range(1, limit + 1)])
    free = pairs.join(gone, pair, "left").select(*pair, F.explode(F.array(*[F.coalesce(f"n{k}", F.lit(0)) + k for k in range(1, limit + 1)])).alias("place"))
    kept = free.join(base.places, ["query_id", "place"]).select(*pair, "key", "source", "method", "final", "tier", "tie", "deprecated")
    best = Window.partitionBy(*pair).orderBy(*S._order())
    others = scored.union(kept).withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    others = S.spread(others, base.groups, limit, pair)
    # pins come first, by key, with one more than the best other score
    first = others.where("place = 1").select(*pair, F.col("final").alias("top"))
    pins = pairs.join(base.pins, "query_id").join(base.op_rows.select("key", "source", "method"), "key").join(first, pair, "left")
    pins = pins.select(*pair, F.lit(0).alias("after"), F.col("key").alias("by"), F.lit(0).alias("place"), "key", "source", "method", (F.coalesce("top", F.lit(0.0)) + 1.0).alias("score"))
    every = pins.union(others.select(*pair, F.lit(1).alias("after"), F.lit("").alias("by"), "place", "key", "source", "method", F.col("final").alias("score")))
    rank = F.row_number().over(Window.partitionBy(*pair).orderBy("after", "by", "place"))
    return every.withColumn("rank", rank).where(F.col("rank") <= limit).select(*pair, "rank", "key", "source", "method", "score")


def pinned_tops(base: Base, limit: int = 3) -> DataFrame:
    """(trial_id '', query_id, rank, key, score) of the base's queries with pins."""
    own = base.pins.select("query_id").distinct().join(first_places(base, limit), "query_id").select("query_id", F.lit(1).alias("after"), F.lit("").alias("by"), "place", "key", F.col("final").alias("score"))
    top = own.where("place = 1").select("query_id", "score")
    pins = base.pins.join(top, "query_id", "left").select("query_id", F.lit(0).alias("after"), F.col("key").alias("by"), F.lit(0).alias("place"), "key", (F.coalesce("score", F.lit(0.0)) + 1.0).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("after", "by", "place"))
    return pins.union(own).withColumn("rank", rank).where(F.col("rank") <= limit).select(F.lit("").alias("trial_id"), "query_id", "rank", "key", "score")


def lexicon_trials(lexicon: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each entry (key, targets) as a trial of its own: a word as an alias, a phrase as a rule."""
    phrase = F.col("key").contains(" ")
    aliases = lexicon.where(~phrase).select(F.col("key").alias("trial_id"), F.col("key").alias("word"), F.explode("targets").alias("target"))
    rules = lexicon.where(phrase)
    words = rules.select(F.col("key").alias("trial_id"), F.col("key").alias("rule_id"), F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    return aliases, words, rules.select(F.col("key").alias("trial_id"), F.col("key").alias("rule_id"), F.explode("targets").alias("target"))


def flipped(base: Base, lexicon: DataFrame, records: DataFrame) -> DataFrame:
    """(key, id): entries that, merged alone, turn a record's first result from right to wrong.

    Right is: expected, where the record expects any, and not forbidden. ``records``: id (of its
    query), expected, forbidden."""

    def right(key):
        no = F.lit(False)
        return ((F.size("expected") == 0) | F.coalesce(F.array_contains("expected", key), no)) & ~F.coalesce(F.array_contains("forbidden", key), no)

    trials = lexicon_trials(lexicon)
    after = tops(base, *trials, limit=1)
    of = records.select(F.col("id").alias("query_id"), "expected", "forbidden")
    pinned = base.pins.groupBy("query_id").agg(F.min("key").alias("pin"))
    before = of.join(base.places.where("place = 1").select("query_id", F.col("key").alias("was")), "query_id", "left").join(pinned, "query_id", "left")
    passing = before.where(right(F.coalesce("pin", "was"))).drop("was", "pin")
    reached = trial_pairs(base, *trials[:2]).join(passing, "query_id").join(after.select("trial_id", "query_id", F.col("key").alias("now")), ["trial_id", "query_id"], "left")
    return reached.where(~right(F.col("now"))).select(F.col("trial_id").alias("key"), F.col("query_id").alias("id"))
