"""Hand-kept policy files: ranking, aliases, header overrides. Reading checks them, and the
checks give rows, so that a whole file's faults are seen at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.quirks import CREDENTIAL_HEADERS
from quillspark.operators.search import Ranking

# Fixed values.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")
RANKING_KEYS = ("version", "verb_methods", "path_noise", "product_hints", "tuning_grid", "baseline", "ordering_rules", "constants")
ORDERING_RULES = ("intent_tier", "preferred_method_tiebreak", "singular_collection_tiebreak", "terminal_alias_full_weight")
ENFORCEMENTS, VALUE_POLICIES, ACTIONS = ("required", "advisory"), ("literal", "observed"), ("set", "suppress")


def _json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def ranking_problems(spark: SparkSession, path: str, sources: list[str]) -> DataFrame:
    """(item, problem) of a ranking file."""
    raw = _json(spark, path)
    out = [(k, "missing") for k in RANKING_KEYS if k not in raw] + [(k, "unknown") for k in raw if k not in RANKING_KEYS]
    verbs = spark.createDataFrame([(k, v) for k, v in raw.get("verb_methods", {}).items()], "item string, methods array<string>")
    bad = F.when(~F.col("item").rlike("^[a-z]+$"), "bad_verb").when(F.size("methods") < 1, "no_methods").when(F.size(F.array_distinct("methods")) < F.size("methods"), "repeated_method").when(F.size(F.array_except("methods", F.array(*map(F.lit, METHODS)))) > 0, "unknown_method")
    hints = spark.createDataFrame([(k, v) for k, v in raw.get("product_hints", {}).items()], "item string, sources array<string>")
    wrong = F.when(F.size(F.array_except("sources", F.array(*map(F.lit, sources)))) > 0, "unknown_source")
    out += [(k, "not_boolean") for k in ORDERING_RULES if not isinstance(raw.get("ordering_rules", {}).get(k), bool)]
    out += [(k, "not_in_grid") for k, v in raw.get("constants", {}).items() if v not in raw.get("tuning_grid", {}).get(k, [])]
    rows = verbs.select("item", bad.alias("problem")).union(hints.select("item", wrong.alias("problem"))).where("problem is not null")
    return rows.union(spark.createDataFrame(out, "item string, problem string"))


def load_ranking(spark: SparkSession, path: str, sources: list[str], **dampings) -> Ranking:
    faults = ranking_problems(spark, path, sources).collect()  # one row for each fault of a hand-kept file
    if faults:
        raise ValueError(f"{path}: " + "; ".join(f"{f['item']}: {f['problem']}" for f in faults))
    raw = _json(spark, path)
    names = tuple(sorted({t for s in sources for t in s.lower().split("-")}))
    return Ranking(verbs=raw["verb_methods"], noise=tuple(raw["path_noise"]), hints=raw["product_hints"], product_names=names, constants=raw["constants"], **raw["ordering_rules"], **dampings)


def grid_of(spark: SparkSession, path: str) -> dict[str, list[float]]:
    return {k: sorted(map(float, v)) for k, v in _json(spark, path)["tuning_grid"].items()}


def alias_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """aliases (word, target), rule words (rule_id, word), rule additions (rule_id, target)."""
    raw = _json(spark, path)
    rules = list(enumerate(raw.get("rules", [])))
    return (
        spark.createDataFrame([(w, t) for w, ts in raw.get("aliases", {}).items() for t in ts], "word string, target string"),
        spark.createDataFrame([(i, w) for i, r in rules for w in r["when_all"]], "rule_id int, word string"),
        spark.createDataFrame([(i, t) for i, r in rules for t in r["add"]], "rule_id int, target string"),
    )


def damping_table(spark: SparkSession, path: str) -> DataFrame:
    """(item, value) of an alias file's dampings; an absent one isn't there."""
    raw = _json(spark, path)
    return spark.createDataFrame([(k, float(raw[k])) for k in ("alias_damping", "rule_damping") if k in raw], "item string, value double")


def alias_problems(aliases: DataFrame, rule_words: DataFrame, rule_adds: DataFrame, dampings: DataFrame | None = None) -> DataFrame:
    """(item, problem): words that aren't a token of their own, rules without words or
    additions, dampings that aren't in 0..1. A token is normal if tokenizing gives just it, or
    it and its singular."""
    normal = lambda c: (F.size(T.unigrams(c)) == 1) & (F.get(T.unigrams(c), F.lit(0)) == F.col(c))
    words = aliases.select(F.col("word").alias("item")).union(aliases.select("target")).union(rule_words.select("word")).union(rule_adds.select("target")).distinct()
    bad = words.where(~normal("item")).select("item", F.lit("not_a_token").alias("problem"))
    lone = rule_words.select("rule_id").distinct().join(rule_adds, "rule_id", "left_anti").select(F.col("rule_id").cast("string").alias("item"), F.lit("rule_adds_nothing").alias("problem"))
    empty = rule_adds.select("rule_id").distinct().join(rule_words, "rule_id", "left_anti").select(F.col("rule_id").cast("string").alias("item"), F.lit("rule_without_words").alias("problem"))
    out = bad.union(lone).union(empty)
    if dampings is None:
        return out
    return out.union(dampings.where("value is null or value < 0 or value > 1").select("item", F.lit("damping_out_of_range").alias("problem")))


def override_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header overrides, and form-field hints. ``suppress`` forces advisory, observed and no
    value."""
    ops = _json(spark, path).get("operations", {})
    heads = [(k, h.get("name"), h.get("action", "set"), h.get("value"), h.get("enforcement"), h.get("value_policy"), h.get("note")) for k, o in ops.items() for h in o.get("headers", [])]
    hints = [(k, f.get("name"), bool(f.get("required"))) for k, o in ops.items() for f in o.get("request_hints", {}).get("multipart_fields", [])]
    h = spark.createDataFrame(heads, "key string, name string, action string, value string, enforcement string, value_policy string, note string")
    gone = F.col("action") == "suppress"
    h = h.withColumn("value", F.when(~gone, F.col("value"))).withColumn("enforcement", F.when(gone, "advisory").otherwise(F.col("enforcement"))).withColumn("value_policy", F.when(gone, "observed").otherwise(F.col("value_policy")))
    return h, spark.createDataFrame(hints, "key string, name string, required boolean")


def override_problems(overrides: DataFrame) -> DataFrame:
    """(key, name, problem) of header overrides."""
    low = F.lower("name")
    no = F.lit(False)
    bad = (
        F.when(~F.col("key").rlike(r"^[^:]+:[A-Z]+:/"), "bad_key").when(low.isin(*CREDENTIAL_HEADERS), "credential_header").when(~F.coalesce(F.col("action").isin(*ACTIONS), no), "bad_action")
        .when(~F.coalesce(F.col("enforcement").isin(*ENFORCEMENTS), no), "bad_enforcement").when(~F.coalesce(F.col("value_policy").isin(*VALUE_POLICIES), no), "bad_value_policy")
    )
    own = overrides.select("key", "name", bad.alias("problem")).where("problem is not null")
    twice = overrides.groupBy("key", low.alias("name")).count().where("count > 1").select("key", "name", F.lit("duplicate_header").alias("problem"))
    return own.union(twice)
