"""Vocabulary of a catalog, candidate synonyms, their screening and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.search import Ranking, method_intent

# They must equal the screening's definition for equal results.
FUNCTION_WORDS = (
    "my", "me", "this", "that", "these", "those", "another", "every", "which", "what", "who", "now", "today", "please", "into", "onto", "brand", "own",
    "current", "some", "any", "all", "one", "two", "few", "several", "inside", "up",
)
ID_LIKE = ("id", "ids", "key", "keys")
MAX_PER_CONCEPT = 5
#: Targets whose sets are bits of one number.
MAX_BITS = 63

_STRINGS = "array<string>"


def _tags(each) -> Column:
    return F.flatten(F.transform(F.coalesce("tags", F.array().cast(_STRINGS)), each))


def _one(a: Column) -> Column:
    return F.array_distinct(F.transform(a, T.singular))


def resource_tokens(noise=()) -> Column:
    """Singular tokens of literal path segments, numbers dropped, and of tags."""
    path = _one(T.literal_path_tokens("path"))
    if noise:
        path = F.filter(path, lambda t: ~t.isin(*noise))
    return F.array_distinct(F.concat(path, _tags(T.singular_tokens)))


def vocabulary() -> Column:
    """Singular tokens of an operation's id, summary, path and tags."""
    return F.array_distinct(F.concat(T.singular_tokens("operation_id"), T.singular_tokens("summary"), resource_tokens()))


def concepts(operations: DataFrame, noise=()) -> DataFrame:
    """(token, count, sources): each concept token, counted once for each operation."""
    each = operations.select("source", F.explode(resource_tokens(noise)).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("source")).alias("sources"))


def document_frequency(operations: DataFrame) -> DataFrame:
    """(token, df): in how many operations each vocabulary token occurs."""
    return operations.select(F.explode(vocabulary()).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def verb_report(operations: DataFrame, ranking: Ranking) -> DataFrame:
    """Per verb the methods of operations that mention it, and those it doesn't allow."""
    verbs = operations.sparkSession.createDataFrame([(v, m) for v, m in sorted(ranking.verbs.items())], "verb string, allowed array<string>")
    said = F.array_distinct(F.concat(T.singular_tokens("operation_id"), T.singular_tokens("summary")))
    n = operations.select("method", F.explode(said).alias("verb")).groupBy("verb", "method").count()
    per = n.groupBy("verb").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "count")))).alias("methods"))
    j = verbs.join(per, "verb", "left")
    outside = F.array_sort(F.array_except(F.coalesce(F.map_keys("methods"), F.array().cast(_STRINGS)), F.col("allowed")))
    return j.select("verb", "methods", outside.alias("outside"), (F.size(outside) > 0).alias("review"))


def _expected_methods() -> Column:
    return F.array_distinct(F.transform("expected", lambda k: F.get(F.split(k, ":"), F.lit(1))))


def method_safety(records: DataFrame, ranking: Ranking) -> DataFrame:
    """(id, allowed, expected_methods, ok): ok without a verb, with contradicting verbs, or
    where an expected operation's method is allowed. ``records``: id, query, expected."""
    r = records.withColumn("allowed", method_intent(T.unigrams("query"), ranking)).withColumn("expected_methods", F.array_sort(_expected_methods()))
    ok = F.col("allowed").isNull() | (F.size("allowed") == 0) | F.arrays_overlap("allowed", "expected_methods")
    return r.select("id", F.array_sort("allowed").alias("allowed"), "expected_methods", ok.alias("ok"))


def expected_vocabulary(records: DataFrame, operations: DataFrame, noise=()) -> DataFrame:
    """(id, token): resource tokens of a record's expected operations that may be targets."""
    drop = {*FUNCTION_WORDS, *ID_LIKE, *T.STOPWORDS, *noise}
    keys = records.select("id", F.explode("expected").alias("key"))
    tokens = operations.select("key", F.explode(resource_tokens()).alias("token")).where(~F.col("token").isin(*drop) & ~F.col("token").rlike("^[0-9]+$"))
    return keys.join(tokens, "key").select("id", "token").distinct()


def _token_reasons(records: DataFrame, operations: DataFrame, ranking: Ranking, alias_words: DataFrame) -> DataFrame:
    """(id, token, reason) of every query token; a null reason makes it a candidate."""
    tokens = records.select("id", F.posexplode(T.singular_tokens("query")).alias("pos", "token"))
    expected = expected_vocabulary(records, operations, ranking.noise).withColumn("_e", F.lit(True))
    ids = operations.select(F.lower("operation_id").alias("token")).where("token is not null").distinct().withColumn("_i", F.lit(True))
    words = alias_words.select(F.col("word").alias("token")).distinct().withColumn("_a", F.lit(True))
    j = tokens.join(expected, ["id", "token"], "left").join(ids, "token", "left").join(words, "token", "left")
    t = F.col("token")
    isin = lambda values: t.isin(*values) if values else F.lit(False)
    reason = (
        F.when(isin(list(ranking.verbs)), "verb").when(isin([*FUNCTION_WORDS, *T.STOPWORDS]), "function_word").when(isin(list(ranking.hints)), "product_hint")
        .when(F.col("_a"), "existing_alias").when(F.col("_e"), "expected_vocab").when(F.col("_i"), "identifier").when(isin(ID_LIKE), "id_like")
        .when(isin(ranking.noise), "path_noise").when(t.rlike("^[0-9]+$"), "digit")
    )
    return j.select("id", "pos", "token", reason.alias("reason"))


def candidates(records: DataFrame, operations: DataFrame, ranking: Ranking, alias_words: DataFrame) -> DataFrame:
    """(token, seed_ids, allowed_targets, df): query tokens that may become aliases. A token
    excluded in one record can be a candidate from another."""
    rows = _token_reasons(records, operations, ranking, alias_words).where("reason is null")
    targets = expected_vocabulary(records, operations, ranking.noise).select("id", F.col("token").alias("target"))
    per = rows.join(targets, "id", "left").groupBy("token").agg(F.array_sort(F.collect_set("id")).alias("seed_ids"), F.array_sort(F.collect_set("target")).alias("allowed_targets"))
    return per.join(document_frequency(operations), "token", "left").select("token", "seed_ids", "allowed_targets", F.coalesce("df", F.lit(0)).alias("df"))


def excluded(records: DataFrame, operations: DataFrame, ranking: Ranking, alias_words: DataFrame) -> DataFrame:
    """(token, reason) of tokens that no record makes a candidate: the reason of the first."""
    rows = _token_reasons(records, operations, ranking, alias_words)
    first = rows.groupBy("token").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.struct("id", "pos"))).alias("reason"), F.bool_or(F.col("reason").isNull()).alias("open"))
    return first.where("not open").select("token", "reason")


def failure_classes(records: DataFrame, operations: DataFrame, ranking: Ranking, alias_words: DataFrame) -> DataFrame:
    """(id, classes): R5 where no verb allows an expected method, R6 where a token is unknown."""
    safe = method_safety(records, ranking)
    no = F.lit(False)
    r5 = safe.select("id", (~F.coalesce(F.arrays_overlap("allowed", "expected_methods"), no)).alias("r5"))
    r6 = _token_reasons(records, operations, ranking, alias_words).groupBy("id").agg(F.bool_or(F.col("reason").isNull()).alias("r6"))
    j = records.select("id").join(r5, "id").join(r6, "id", "left")
    return j.select("id", F.filter(F.array(F.when(F.col("r5"), "R5"), F.when(F.coalesce("r6", no), "R6")), lambda x: x.isNotNull()).alias("classes"))


def normalize_synonyms(raw: DataFrame) -> DataFrame:
    """(key, targets): singular tokens; two-word phrases of the same words become the one that
    came first. ``raw``: pos, synonym, target."""
    toks = T.singular_tokens("synonym")
    r = raw.withColumn("_t", toks).withColumn("_k", F.when(F.size("_t") > 0, F.array_join("_t", " ")).otherwise(F.lower("synonym")))
    r = r.withColumn("_set", F.when(F.size("_t") == 2, F.array_join(F.array_sort("_t"), " ")).otherwise(F.concat(F.lit("="), "_k")))
    first = F.min_by("_k", "pos").alias("key")
    return r.withColumn("t", F.explode_outer(T.singular_tokens("target"))).groupBy("_set").agg(first, F.array_sort(F.collect_set("t")).alias("targets")).select("key", "targets")


class Targets:
    """Collects what the targets of a group's rows stand for, as a sorted array.

    Few are bits of a number, which a hash table updates in place; sets of strings, which are
    collected where there are more, sort the rows instead. ``targets``: target, with repeats;
    of them MAX_BITS + 1 come to the driver at most."""

    def __init__(self, targets: DataFrame, tokens=F.array):
        self._tokens = tokens
        rows = targets.select("target").where("target is not null").distinct().limit(MAX_BITS + 1).select("target", tokens("target").alias("t")).collect()
        self.names = sorted({t for r in rows for t in r["t"]})
        self.few = len(rows) <= MAX_BITS and len(self.names) <= MAX_BITS
        self._bits = {r["target"]: sum(1 << self.names.index(t) for t in set(r["t"])) for r in rows} if self.few else {}

    def value(self, target: str) -> Column:
        """Of one row, to be collected."""
        if not self.few:
            return self._tokens(target)
        return F.coalesce(*[F.when(F.col(target) == n, F.lit(b).cast("long")) for n, b in self._bits.items()], F.lit(0).cast("long"))

    def collected(self, value: str) -> Column:
        """Of a group's rows, an aggregate."""
        return F.bit_or(value) if self.few else F.collect_set(value)

    def array(self, collected: str) -> Column:
        if not self.few:
            return F.sort_array(F.array_distinct(F.flatten(collected)))
        none = F.array().cast(_STRINGS)
        return F.concat(none, *[F.when(F.getbit(collected, F.lit(i)) == 1, F.array(F.lit(n))).otherwise(none) for i, n in enumerate(self.names)])


def normalize_neighbours(texts: DataFrame, targets: Targets) -> DataFrame:
    """(key, targets): as ``normalize_synonyms``, of all neighbouring words as synonyms. Each
    word's singular is taken once, and pairs of the same words meet in one shuffle.

    ``texts``: doc_id (long), words (raw tokens), target."""
    # a stopword is marked, as it counts only beside another
    one = F.transform("words", lambda t: F.when(t.isin(*T.STOPWORDS), F.concat(F.lit("="), t)).otherwise(T.singular(t)))
    # places of all texts as one number, so that their minimum is updated in place
    d = texts.select((F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)")).alias("_doc"), targets.value("target").alias("_v"), one.alias("_one"))
    n = F.greatest(F.size("_one") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_one", F.lit(1), n), F.slice("_one", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    r = d.select("_doc", "_v", F.posexplode(pairs).alias("_at", "_p")).select("_v", (F.col("_doc") + F.col("_at").cast("decimal(10,0)")).alias("_pos"), F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))
    a, b, space, mark = F.col("a"), F.col("b"), F.lit(" "), F.lit("=")
    no_a, no_b = a.startswith("="), b.startswith("=")
    two = ~no_a & ~no_b & (a != b)
    # two words in the order of their names, all else as it is behind the mark
    words = F.when(two, F.concat(F.least(a, b), space, F.greatest(a, b))).when(no_a & no_b, F.concat(a, space, F.ltrim(b, mark))).when(no_a, F.concat(mark, b)).otherwise(F.concat(mark, a))
    r = r.select(words.alias("_set"), "_v", F.when(two & (a > b), F.col("_pos")).alias("_turned"), F.when(~two | (a < b), F.col("_pos")).alias("_straight"))
    g = r.groupBy("_set").agg(F.min("_straight").alias("_straight"), F.min("_turned").alias("_turned"), targets.collected("_v").alias("_v"))
    turned = F.concat(F.substring_index("_set", " ", -1), space, F.substring_index("_set", " ", 1))
    key = F.when(F.col("_set").startswith("="), F.ltrim("_set", mark)).when(F.col("_straight").isNull() | (F.col("_turned") < F.col("_straight")), turned).otherwise(F.col("_set"))
    return g.select(key.alias("key"), targets.array("_v").alias("targets"))


def screen(lexicon: DataFrame, operations: DataFrame, ranking: Ranking, alias_words: DataFrame, rule_sets: DataFrame) -> DataFrame:
    """Adds ``reason``: why a word or two-word phrase can't be a synonym, null if it can.

    ``lexicon``: key, targets; ``alias_words``: word; ``rule_sets``: words (sorted array)."""
    concept = concepts(operations, ranking.noise).select(F.col("token"), F.col("sources"))
    known = document_frequency(operations).select(F.col("token").alias("key")).withColumn("_in", F.lit(True))
    toks = F.split("key", " ")
    first = F.get("targets", F.lit(0))
    j = (
        lexicon.withColumn("_first", first).withColumn("_words", F.array_join(F.array_sort(toks), " "))
        .join(concept.select(F.col("token").alias("_first"), F.col("sources").alias("_ts")), "_first", "left")
        .join(concept.select(F.col("token").alias("key"), F.col("sources").alias("_ks")), "key", "left")
        .join(known, "key", "left")
        .join(alias_words.select(F.col("word").alias("key")).distinct().withColumn("_alias", F.lit(True)), "key", "left")
        .join(rule_sets.select(F.array_join("words", " ").alias("_words")).distinct().withColumn("_rule", F.lit(True)), "_words", "left")
    )
    any_in = lambda values: F.exists(toks, lambda t: t.isin(*values)) if values else F.lit(False)
    phrase, no = F.size(toks) == 2, F.lit(False)
    shape = (F.size(toks) > 2) | F.exists(toks, lambda t: ~t.rlike("^[a-z0-9]+$") | (F.length(t) < 2) | t.isin(*T.STOPWORDS))
    single = F.size("targets") == 1
    # a word of one product may stand for another's resource
    other_product = single & F.col("_ks").isNotNull() & ~F.coalesce(F.arrays_overlap("_ks", "_ts"), no)
    reason = (
        F.when(shape, "shape").when(F.exists(toks, lambda t: ~t.rlike("[a-z]") | t.isin(*ID_LIKE)), "id_like").when(any_in(FUNCTION_WORDS), "function_word")
        .when(any_in(list(ranking.verbs)), "verb").when(any_in(list(ranking.hints)), "product_hint").when(phrase & F.coalesce("_rule", no), "rule_conflict")
        .when(~phrase & F.coalesce("_in", no) & ~F.coalesce(other_product, no), "in_catalog").when(~phrase & F.coalesce("_alias", no), "alias_conflict")
        .when(~single, "multi_target").when(F.col("_ts").isNull(), "target_not_concept")
    )
    return j.select("key", "targets", reason.alias("reason"))


def merge_verdicts(historical: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """(key, targets, verdict, conflict): agreeing past verdicts hold; fresh ones count only
    where none agreed. Both: key, targets, verdict."""
    h = historical.groupBy("key", "targets").agg(F.collect_set("verdict").alias("v"))
    agreed = h.select("key", "targets", F.when(F.size("v") == 1, F.get("v", F.lit(0))).alias("verdict"))
    if fresh is None:
        return agreed.select("key", "targets", "verdict", F.col("verdict").isNull().alias("conflict"))
    f = fresh.groupBy("key", "targets").agg(F.max("verdict").alias("new"), (F.count_distinct("verdict") > 1).alias("split"))
    j = agreed.join(f, ["key", "targets"], "full")
    verdict = F.coalesce("verdict", F.when(~F.coalesce("split", F.lit(False)), F.col("new")))
    return j.select("key", "targets", verdict.alias("verdict"), verdict.isNull().alias("conflict"))


def resolve(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(key, state, targets, rank): of a key's candidates that are sound and approved the one
    of the highest source rank; else pending if one is unreviewed, else rejected.

    ``entries``: canonical, key, targets, rank, reason; ``verdicts``: key (canonical), targets, verdict."""
    v = verdicts.select(F.col("key").alias("canonical"), "targets", "verdict")
    j = entries.join(v, ["canonical", "targets"], "left")
    good = F.col("reason").isNull() & F.coalesce("verdict", F.lit(False))
    open_ = F.col("reason").isNull() & F.col("verdict").isNull()
    per = j.groupBy("canonical").agg(F.max_by(F.struct("key", "targets", "rank"), F.when(good, F.col("rank"))).alias("best"), F.bool_or(open_).alias("open"), F.max_by(F.struct("key", "targets", "rank"), "rank").alias("last"), F.bool_or(good).alias("found"))
    pick = F.when(F.col("found"), F.col("best")).otherwise(F.col("last"))
    return per.select(pick["key"].alias("key"), F.when(F.col("found"), "selected").when(F.col("open"), "pending").otherwise("rejected").alias("state"), pick["targets"].alias("targets"), pick["rank"].alias("rank"))


def cap_per_concept(lexicon: DataFrame, limit: int = MAX_PER_CONCEPT) -> DataFrame:
    """Adds ``kept``: the first keys by name of each first target, words and phrases apart.
    Keys of a target are distinct.

    Each task keeps its own first keys, so a target with many isn't sorted as a whole."""
    rows = lexicon.withColumn("_t", F.get("targets", F.lit(0))).withColumn("_p", F.col("key").contains(" "))
    w = Window.partitionBy("_t", "_p").orderBy("key")
    last = rows.select("_t", "_p", "key").withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).groupBy("_t", "_p").agg(F.max("key").alias("_last"))
    return rows.alias("r").join(last.alias("l"), F.col("r._t").eqNullSafe(F.col("l._t")) & (F.col("r._p") == F.col("l._p"))).select(*[F.col(f"r.`{c}`") for c in lexicon.columns], (F.col("key") <= F.col("_last")).alias("kept"))


def merge_aliases(lexicon: DataFrame, alias_words: DataFrame, rule_sets: DataFrame) -> DataFrame:
    """(key, kind, targets, skipped): words become aliases unless there is one, phrases become
    rules unless one has the same words.

    Both are looked up by sorted words, a word being its own, so the lexicon is dealt once."""
    words = lambda w: F.array_join(F.sort_array(w), " ")
    have = alias_words.select(F.col("word").alias("_w"), F.lit(False).alias("_p")).union(rule_sets.select(words("words"), F.lit(True))).distinct().withColumn("_have", F.lit(True))
    phrase = F.col("key").contains(" ")
    j = lexicon.withColumn("_p", phrase).withColumn("_w", F.when(phrase, words(F.split("key", " "))).otherwise(F.col("key"))).join(have, ["_w", "_p"], "left")
    return j.select("key", F.when(F.col("_p"), "rule").otherwise("alias").alias("kind"), "targets", F.coalesce("_have", F.lit(False)).alias("skipped"))


def benchmark_gate(lexicon: DataFrame, records: DataFrame, operations: DataFrame, noise=(), flipped: DataFrame | None = None) -> DataFrame:
    """(key, reason): seed-incompatible where a record holds all the key's tokens but no such
    record's expected vocabulary holds a target; seed-regression where ``flipped`` (key) says
    that merging it alone turns a passing record into a failing one."""
    k = lexicon.select("key", F.size(F.split("key", " ")).alias("n"), F.explode(F.split("key", " ")).alias("token"))
    q = records.select("id", F.explode(T.singular_tokens("query")).alias("token"))
    held = k.join(q, "token").groupBy("key", "n", "id").count().where("count = n").select("key", "id")
    targets = lexicon.select("key", F.explode("targets").alias("token"))
    fits = held.join(expected_vocabulary(records, operations, noise), "id").join(targets, ["key", "token"]).select("key").distinct()
    wrong = held.select("key").distinct().join(fits, "key", "left_anti").withColumn("reason", F.lit("seed-incompatible"))
    if flipped is None:
        return wrong
    return wrong.union(held.select("key").distinct().join(fits, "key").join(flipped, "key", "left_semi").withColumn("reason", F.lit("seed-regression")))


def grounding(operations: DataFrame, noise=()) -> DataFrame:
    """(token, count, sources, excerpt): the first sentence of the smallest-key operation whose
    last path token is the concept; ``-`` without one."""
    path = F.filter(_one(T.literal_path_tokens("path")), lambda t: F.lit(True))
    last = F.try_element_at(path, F.lit(-1))
    ends = operations.select("key", "description", last.alias("token")).where("token is not null")
    if noise:
        ends = ends.where(~F.col("token").isin(*noise))
    first = ends.groupBy("token").agg(F.min_by(F.coalesce("description", F.lit("")), "key").alias("d"))
    return concepts(operations, noise).join(first, "token", "left").select("token", "count", "sources", T.excerpt("d").alias("excerpt"))


def adjudicate(a: DataFrame, b: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """(id, answerable, keys, disputed): equal labels hold; a third review decides the others.

    Each: id, answerable, keys."""
    x = a.select("id", F.struct("answerable", F.array_sort(F.array_distinct("keys")).alias("keys")).alias("x"))
    y = b.select("id", F.struct("answerable", F.array_sort(F.array_distinct("keys")).alias("keys")).alias("y"))
    j = x.join(y, "id")
    disputed = F.col("x") != F.col("y")
    if c is not None:
        j = j.join(c.select("id", F.struct("answerable", F.array_sort(F.array_distinct("keys")).alias("keys")).alias("z")), "id", "left")
        final = F.when(disputed, F.col("z")).otherwise(F.col("x"))
    else:
        final = F.when(~disputed, F.col("x"))
    return j.select("id", final["answerable"].alias("answerable"), final["keys"].alias("keys"), disputed.alias("disputed"))


def apply_labels(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Splits records by label: answerable ones expect the acceptable keys, which leave the
    forbidden ones; the others expect nothing. ``records``: id, forbidden; from ``adjudicate``."""
    j = records.join(labels, "id")
    yes = F.col("answerable")
    return j.select(
        "id", F.when(yes, "regression_positive").otherwise("regression_negative").alias("section"),
        F.when(yes, F.col("keys")).otherwise(F.array().cast(_STRINGS)).alias("expected"),
        F.array_sort(F.when(yes, F.array_except("forbidden", "keys")).otherwise(F.array_distinct("forbidden"))).alias("forbidden"),
        F.array_sort(F.when(yes, F.array_intersect("forbidden", "keys")).otherwise(F.array().cast(_STRINGS))).alias("legacy_forbidden"),
    )


def catalog_closure(records: DataFrame, operations: DataFrame) -> DataFrame:
    """(id, expected, missing, stop): expected keys that the catalog has, those it lacks, and
    whether none is left. ``records``: id, expected."""
    each = records.select("id", F.posexplode_outer("expected").alias("pos", "key"))
    j = each.join(operations.select("key").distinct().withColumn("_has", F.lit(True)), "key", "left")
    has = F.coalesce("_has", F.lit(False))
    keys = lambda cond: F.transform(F.array_sort(F.filter(F.collect_list(F.when(cond & F.col("key").isNotNull(), F.struct("pos", "key"))), lambda x: x.isNotNull())), lambda x: x["key"])
    out = j.groupBy("id").agg(keys(has).alias("expected"), keys(~has).alias("missing"))
    return out.withColumn("stop", (F.size("expected") == 0) & (F.size("missing") > 0))
