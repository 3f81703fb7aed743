"""URL filters by association rules mined with FP-growth.

Given rules (a host with its subdomains and a path prefix, the longest fitting one wins)
judge the urls they fit, and so label them. Each labelled url is a basket of tokens: the
labels of its host, its path's segments with digits folded, its file ending, the names in
its query. Tokens that occur in the same labelled urls are one item (all parts of a template
stand together, and would make a combination of each subset of them); each of them stands for
the item in a rule, with the same support and confidence, so a url holds an item if it holds
any of its tokens. FP-growth mines combinations of items of any length that occur with a
label. Kept are rules of enough support and confidence, less those with a shorter rule inside
them that is no less sure of the same verdict; such parts are found by an inverted index over
their rarest item. They judge the urls that no given rule fits: rules are indexed by their
rarest item, so a url only meets rules that share it, and the others' items are then checked
for containment. The surest rule decides (then the better supported, then the shorter, then
the first by the tokens that meet it); a url that no mined rule matches is allowed.

Urls of equal tokens are judged once. Defined results: a null url, and one without
``://``, has empty host and path, matches no given rule and holds no tokens, so it is
allowed; repeated rows are judged alike; an empty table gives no rows; where no url is
labelled nothing is mined. Very long urls are taken whole; other columns aren't read,
whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, table

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
#: Copies of a basket that one row stands for at most while they are dealt out.
COPIES = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if null or without."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of its name and verdict; null if none."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url, sorted: h: host label, p: path segment, e: ending, q: query name."""
    host, path = url_host(url), url_path(url)
    query = F.regexp_extract(_rest(url), r"\A[^?#]*\?([^#]*)", 1)
    fold = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")
    filled = lambda a: F.filter(a, lambda x: x != "")
    name = lambda prefix, a: F.transform(a, lambda x: F.concat(F.lit(prefix), fold(x)))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)
    return F.array_sort(
        F.array_distinct(
            F.concat(
                name("h:", filled(F.split(host, r"\."))),
                name("p:", filled(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]+\z", ""), "/"))),
                name("e:", filled(F.array(ending))),
                name("q:", filled(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)))),
            )
        )
    )


def token_groups(labelled: DataFrame) -> DataFrame:
    """(token, item): tokens in the same labelled baskets are one item, named by the first of them."""
    h = lambda seed: F.sum(F.xxhash64("tokens", F.lit(seed)).cast("decimal(38,0)"))  # noqa: E731  of repeated baskets too
    each = labelled.select("tokens", F.explode("tokens").alias("token"))
    marks = each.groupBy("token").agg(F.count("*").alias("n"), h(1).alias("x"), h(2).alias("y"))
    names = marks.groupBy("n", "x", "y").agg(F.min("token").alias("item"))
    return marks.join(names, ["n", "x", "y"]).select("token", "item")


def held_items(token_sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(tokens, items, least) of the distinct ``token_sets`` with a labelled token: the items
    they hold a token of, and a map to the least such token."""
    each = token_sets.select("tokens", F.explode("tokens").alias("token")).join(groups, "token")
    one = each.groupBy("tokens", "item").agg(F.min("token").alias("token"))
    held = one.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("item", "token"))).alias("held"))
    return held.select("tokens", F.transform("held", lambda x: x["item"]).alias("items"), F.map_from_entries("held").alias("least"))


def parts(rules: DataFrame, of: DataFrame) -> DataFrame:
    """Rows of ``of`` (items and more) with each rule (need, key) that they hold whole.

    A rule is looked up by its item that is rarest among ``of``."""
    each = of.withColumn("item", F.explode("items"))
    count = each.groupBy("item").agg(F.count("*").alias("n"))
    # cut, so that the join on a hot item is one that can be split at run time
    rarest = cut(
        rules.select("need", "key", F.explode("need").alias("item"))
        .join(count, "item")
        .groupBy("need", "key")
        .agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    )
    return each.join(rarest, "item").where(F.size(F.array_except("need", "items")) == 0)


def _repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Rows as often as ``copies`` says, in steps, so that no row holds a list of all of them."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = rows.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPIES)))).repartition(tasks)
    return steps.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col(copies) - F.col("_step") * COPIES)))).drop("_step", "_copy", copies)


def mine(labelled: DataFrame, groups: DataFrame | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, verdict, confidence, support) of the kept rules, from (tokens, verdict).

    A rule names items; any token of each stands for it, with the same support and confidence.
    An item that occurs with one verdict only is a rule that nothing can better, so no kept
    rule has another item beside it: such items don't go to the miner, which then never meets
    the combinations of a block list's tokens that stand together nearly always."""
    labelled = labelled.where(F.size("tokens") > 0)
    groups = token_groups(labelled) if groups is None else groups
    n = labelled.count()
    if not n:
        return labelled.select("tokens", "verdict", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"))
    # baskets of equal tokens and verdict are few among urls; each goes to the miner as often as it occurs
    alike = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("copies"))
    each = cut(alike.withColumn("token", F.explode("tokens")).join(groups.where("token = item"), "token").select("tokens", "verdict", "copies", "item"))
    counted = each.groupBy("item").agg(F.min("verdict").alias("verdict"), (F.min("verdict") == F.max("verdict")).alias("pure"), F.sum("copies").alias("freq"))
    sure = counted.where("pure").select(F.array("item").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), (F.col("freq") / F.lit(n)).alias("support"))
    mixed = each.join(counted.where("not pure").select("item"), "item", "left_semi").groupBy("tokens", "verdict", "copies").agg(F.collect_list("item").alias("items"))
    # baskets without a mixed item count among all of which the least support is a share
    every_basket = alike.join(mixed, ["tokens", "verdict", "copies"], "left").select("copies", F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit("v:"), "verdict"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(_repeated(every_basket, "copies")).freqItemsets
    is_verdict = lambda x: x.startswith("v:")
    every = cut(sets.select(F.array_sort(F.filter("items", lambda x: ~is_verdict(x))).alias("tokens"), F.get(F.filter("items", is_verdict), F.lit(0)).alias("v"), "freq"))
    with_verdict = every.where(F.col("v").isNotNull() & (F.size("tokens") > 0))
    alone = every.where(F.col("v").isNull()).select("tokens", F.col("freq").alias("n_tokens"))
    rules = cut(
        with_verdict.join(alone, "tokens")
        .select("tokens", F.substring("v", 3, 100).alias("verdict"), (F.col("freq") / F.col("n_tokens")).alias("confidence"), (F.col("freq") / F.lit(n)).alias("support"))
        .where(F.col("confidence") >= min_confidence)
    )
    # a rule goes if a part of it is as sure of the same verdict
    short = rules.select(F.col("tokens").alias("need"), F.struct("verdict", "confidence").alias("key"))
    inside = parts(short, rules.withColumn("items", F.col("tokens"))).where((F.size("need") < F.size("tokens")) & (F.col("key.verdict") == F.col("verdict")) & (F.col("key.confidence") >= F.col("confidence")))
    kept = rules.join(inside.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")
    return kept.select("tokens", "verdict", "confidence", "support").union(sure.where(F.col("support") >= min_support))


def match(token_sets: DataFrame, rules: DataFrame, groups: DataFrame) -> DataFrame:
    """(tokens, verdict) of the distinct ``token_sets`` that some mined rule matches."""
    known = rules.select(F.col("tokens").alias("need"), F.struct("verdict", "confidence", "support").alias("key"))
    # the tokens by which a set meets the rule: the least of each item
    own = F.array_sort(F.transform("need", lambda x: F.element_at("least", x)))
    best = F.struct((-F.col("key.confidence")).alias("c"), (-F.col("key.support")).alias("s"), F.size("need").alias("n"), own.alias("own"), F.col("key.verdict").alias("v"))
    found = parts(known, cut(held_items(token_sets, groups))).select("tokens", "key", best.alias("best"))
    return found.groupBy("tokens").agg(F.min_by("key.verdict", "best").alias("mined"))


def judge_urls(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), given_rule(host, path, rules).alias("given"), url_tokens(F.col("url")).alias("tokens"))
    labelled = urls.where(F.col("given").isNotNull()).select("tokens", F.col("given.verdict").alias("verdict"))
    is_open = F.col("given").isNull() & (F.size("tokens") > 0)
    open_sets = urls.where(is_open).select("tokens").distinct()
    groups = cut(token_groups(labelled))
    # cut, so that a hot set of tokens can be split in the join
    mined = cut(match(open_sets, mine(labelled, groups, min_support, min_confidence), groups))
    out = lambda rows, verdict: rows.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"))
    # pages with a given rule, and those without tokens, need no look-up
    return out(urls.where(is_open).join(mined, "tokens", "left"), F.coalesce("mined", F.lit("allow"))).union(out(urls.where(~is_open), F.coalesce("given.verdict", F.lit("allow"))))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
