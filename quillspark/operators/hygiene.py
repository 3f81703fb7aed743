"""Hygiene of evaluation records: form, reuse, copied phrases, quotas, leaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import wordruns
from quillspark.operators.search import Ranking, method_intent
from quillspark.sources.stages import written

# Rules in order of priority.
RECORD_RULES = ("schema", "catalog", "words", "ascii", "actionable", "negative-method", "operationId", "summary/tags", "negative-phrase", "reuse", "no-answer")
MIN_QUERY_WORDS, MAX_QUERY_WORDS = 3, 7
#: Bits of the Bloom filter for each needle (2 runs in 10,000 pass by chance), and its bound: 32 MB.
BITS_OF_NEEDLE = 32
MAX_BITS = 1 << 28
ASCII_QUERY = r"^[A-Za-z0-9 '\-]+$"


def _bigrams(tokens: Column) -> Column:
    firsts = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.transform(firsts, lambda t, i: F.concat_ws(" ", t, F.get(tokens, i + 1)))


def _content(text) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*T.STOPWORDS))


def _set_key(text) -> Column:
    return F.array_join(F.array_sort(T.singular_tokens(text)), " ")


def _phrase(text) -> Column:
    return F.array_join(F.transform(T.phrase_tokens(text), T.singular), " ")


def _methods(keys: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(keys, lambda k: F.size(F.split(k, ":")) >= 3), lambda k: F.split(k, ":")[1]))


def check_records(records: DataFrame, operations: DataFrame, ranking: Ranking) -> DataFrame:
    """(id, rule, detail) for every rule a record breaks by itself or against the catalog.

    ``records``: section (held_out or negative), id, query, expected, forbidden; written once, as
    each rule reads them. Keys of a record are told apart in its row, and a bigram is looked up in
    the operation's row, so no task groups keys or bigrams of the catalog."""
    q, exp, forb = F.col("query"), F.col("expected"), F.col("forbidden")
    rec = records.withColumn("words", F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))).withColumn("allowed", method_intent(T.unigrams("query"), ranking))
    rec = written(rec)
    bad = lambda df, rule, detail: df.select("id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    out = bad(rec.where(~F.col("words").between(MIN_QUERY_WORDS, MAX_QUERY_WORDS)), "words", F.col("words"))
    out = out.union(bad(rec.where(~q.rlike(ASCII_QUERY)), "ascii", q))
    negative = F.col("section") == "negative"
    out = out.union(bad(rec.where(F.when(negative, (F.size(exp) > 0) | (F.size(forb) == 0)).otherwise(F.size(exp) == 0)), "schema", F.lit(None)))
    allowed = F.coalesce(F.size("allowed"), F.lit(-1))
    reason = F.when(F.col("allowed").isNull(), "no verb").when(allowed == 0, "no common method").when(~F.arrays_overlap(_methods(exp), F.col("allowed")), "expected methods outside intent")
    out = out.union(bad(rec.where(~negative).withColumn("r", reason).where("r is not null"), "actionable", F.col("r")))
    out = out.union(bad(rec.where(negative & (allowed > 0) & ~F.arrays_overlap(_methods(forb), F.col("allowed"))), "negative-method", F.lit(None)))
    # a catalog in few small files looks small enough to be broadcast, but isn't
    keys = rec.select("id", F.explode(F.array_distinct(F.concat(exp, forb))).alias("key"))
    out = out.union(bad(keys.join(operations.select("key").hint("merge"), "key", "left_anti").distinct(), "catalog", F.col("key")))
    ids = operations.where(F.col("operation_id").isNotNull()).select(_set_key("operation_id").alias("k"), "operation_id")
    same = rec.select("id", _set_key("query").alias("k")).join(ids, "k").groupBy("id").agg(F.min("operation_id").alias("o"))
    out = out.union(bad(same, "operationId", F.col("o")))
    # bigrams of an expected operation's summary or tags
    texts = operations.select("key", F.concat(F.array(F.coalesce("summary", F.lit(""))), F.coalesce("tags", F.array().cast("array<string>"))).alias("t"))
    ours = rec.select("id", F.explode(F.array_distinct(exp)).alias("key"), _bigrams(_content(q)).alias("b"))
    theirs = F.flatten(F.transform("t", lambda t: _bigrams(_content(t))))
    copied = ours.join(texts.hint("merge"), "key").select("id", F.array_min(F.array_intersect("b", theirs)).alias("b")).where("b is not null").distinct()
    out = out.union(bad(copied.groupBy("id").agg(F.min("b").alias("b")), "summary/tags", F.col("b")))
    # a negative that is just an operation's summary or last path segment
    last = F.coalesce(F.try_element_at(T.literal_segments(F.regexp_replace("key", "^[^:]*:[^:]*:", "")), F.lit(-1)), F.lit(""))
    phrases = operations.select("key", F.explode(F.array_distinct(F.array(_phrase(F.col("summary")), _phrase(last)))).alias("phrase"))
    equal = rec.where(negative).select("id", _phrase(q).alias("phrase")).join(phrases, "phrase").groupBy("id").agg(F.min("key").alias("k"))
    return out.union(bad(equal, "negative-phrase", F.col("k")))


def reuse(records: DataFrame) -> DataFrame:
    """(id, earlier_id, how): the first earlier record with the same query, or else the same
    set of tokens. ``records``: pos (prior sets first, all different), id, query, is_new.

    Texts and sets are told apart by 128-bit hashes, made once; the first of each hash comes
    from one aggregate over both kinds, and only hashes that occur again are joined back."""
    text = F.array_join(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != ""), " ")
    key = lambda kind, x: F.struct(F.lit(kind).alias("kind"), F.unhex(F.md5(x.cast("binary"))).alias("h"))
    keys = written(records.select("pos", "id", "is_new", F.explode(F.array(key("string", text), key("set", _set_key("query")))).alias("k")).select("pos", "id", "is_new", "k.kind", "k.h"))
    first = keys.groupBy("kind", "h").agg(F.min(F.struct("pos", "id")).alias("f"), F.count("*").alias("n")).where("n > 1").select("kind", "h", "f")
    later = keys.where("is_new").join(first, ["kind", "h"]).where(F.col("f.pos") < F.col("pos"))
    # the earlier of the two; at one earlier record the text is compared first
    best = F.struct(F.col("f.pos"), F.when(F.col("kind") == "string", 0).otherwise(1).alias("second"))
    return later.groupBy("pos", "id").agg(F.min_by(F.struct("f.id", "kind"), best).alias("b")).select("id", F.col("b.id").alias("earlier_id"), F.col("b.kind").alias("how"))


def distribution(records: DataFrame, product_words) -> DataFrame:
    """(dimension, value, n): records by source and method of their first key (forbidden for
    negatives), and by whether one of the product words is in the query, in one grouping-sets aggregate."""
    first = F.get(F.when(F.col("section") == "negative", F.col("forbidden")).otherwise(F.col("expected")), F.lit(0))
    parts = F.when(F.size(F.split(first, ":")) >= 3, F.split(first, ":"))
    named = F.arrays_overlap(T.unigrams("query"), F.array(*map(F.lit, product_words)))
    r = records.select("section", F.get(parts, F.lit(0)).alias("source"), F.get(parts, F.lit(1)).alias("method"), named.cast("string").alias("named"))
    sets = r.groupingSets([("section", "source"), ("section", "method"), ("section", "named")], "section", "source", "method", "named").agg(F.count("*").alias("n"), F.grouping("source").alias("gs"), F.grouping("method").alias("gm"))
    dim = F.when(F.col("gs") == 0, "source").when(F.col("gm") == 0, "method").otherwise("product_named")
    return sets.select("section", dim.alias("dimension"), F.coalesce("source", "method", "named").alias("value"), "n").where("value is not null")


def below_quota(dist: DataFrame, quotas: DataFrame) -> DataFrame:
    """Quotas (section, dimension, value, least) that aren't met."""
    return quotas.join(dist, ["section", "dimension", "value"], "left").where(F.coalesce("n", F.lit(0)) < F.col("least")).select("section", "dimension", "value", F.coalesce("n", F.lit(0)).alias("n"), "least")


def rejections(violations: DataFrame) -> DataFrame:
    """(id, rule): of the rules a record breaks the first by priority."""
    order = F.array_position(F.array(*map(F.lit, RECORD_RULES)), F.col("rule"))
    return violations.where(order > 0).groupBy("id").agg(F.min_by("rule", order).alias("rule"))


def needles(queries: DataFrame) -> DataFrame:
    """(n_words, sha256) of whole normalised queries; the texts themselves aren't kept."""
    words = T.word_stream("query")
    return queries.select(F.size(words).alias("n_words"), F.sha2(F.array_join(words, " "), 256).alias("sha256")).where("n_words > 0").distinct()


def windows(words: Column, n: Column | int) -> Column:
    """sha256 of every run of ``n`` words."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(words, i, n), " "), 256))


def window_needles(texts: DataFrame, least: int = MIN_QUERY_WORDS, most: int = MAX_QUERY_WORDS, quick: bool = False) -> DataFrame:
    """(n_words, sha256) of all runs of ``least`` to ``most`` words of free texts; ``quick`` adds
    the rolling hash by which a scan sorts out nearly all runs of its documents."""
    if not quick:
        words = texts.select(T.word_stream("text").alias("words"), F.explode(F.array(*[F.lit(n) for n in range(least, most + 1)])).alias("n_words"))
        return words.select("n_words", F.explode(windows(F.col("words"), F.col("n_words"))).alias("sha256")).distinct()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in wordruns.words_of(batch.column(0)):
                for n, first, h in w.runs(list(range(least, most + 1))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), n, np.int32)), pa.array([w.sha256(i, n) for i in first.tolist()], pa.string()), pa.array(h.view(np.int64))], ["n_words", "sha256", "quick"])

    return texts.select(F.lower("text")).mapInArrow(runs, "n_words int, sha256 string, quick long").distinct()


def bit_table(quick: DataFrame, count: int) -> wordruns.BitTable:
    """The Bloom filter of a column ``quick`` of ``count`` hashes, made in the tasks: what comes
    to the driver is one number for each 64 of its bits that hold any, ``MAX_BITS`` at most."""
    bits = 1 << 12
    while bits < MAX_BITS and bits < count * BITS_OF_NEEDLE:
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            place = np.unique(np.concatenate([wordruns.BitTable.place(h, k, bits) for k in range(wordruns.BitTable.PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["slot", "bit"])

    got = quick.mapInArrow(places, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    return wordruns.BitTable(bits, got["slot"].to_numpy(), got["bits"].to_numpy().view(np.uint64))


def scan(documents: DataFrame, manifest: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Documents (doc_id, text) that hold an n-gram of the manifest, less the allowed ones.

    Only lengths that the manifest has are cut. With a ``quick`` hash in the manifest one pass
    over the documents rolls the hashes of all lengths, looks them up in a Bloom filter of
    bounded size, and gives out sha256 only of runs that may be held; these are compared in a
    semi-join. Past the filter's size more runs are given out, and the result is the same."""
    docs = documents.select("doc_id", "text").where("doc_id is not null")
    docs = docs if allow is None else docs.join(allow, "doc_id", "left_anti")
    if "quick" in manifest.columns:
        manifest = written(manifest)
        sizes = [r[0] for r in manifest.groupBy("n_words").agg(F.count("*").alias("n")).collect()]  # a few lengths
        held = bit_table(manifest.select("quick"), manifest.count())
        spark_type = documents.schema["doc_id"].dataType.simpleString()

        def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first_doc, w in wordruns.words_of(batch.column(1)):
                    for n, first, h in w.runs(sizes):
                        at = first[held.may_hold(h)]
                        if len(at):
                            ids = batch.column(0).take(pa.array(first_doc + w.text[at]))
                            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(at), n, np.int32)), pa.array([w.sha256(i, n) for i in at.tolist()])], ["doc_id", "n_words", "sha256"])

        grams = docs.select("doc_id", F.lower("text")).mapInArrow(survivors, f"doc_id {spark_type}, n_words int, sha256 string")
    else:
        lengths = manifest.agg(F.collect_set("n_words").alias("lengths"))
        cut = docs.select("doc_id", T.word_stream("text").alias("words")).crossJoin(lengths).select("doc_id", "words", F.explode("lengths").alias("n_words"))
        grams = cut.select("doc_id", "n_words", F.explode(F.array_distinct(windows(F.col("words"), F.col("n_words")))).alias("sha256"))
    return grams.join(manifest.select("n_words", "sha256"), ["n_words", "sha256"], "left_semi").select("doc_id").distinct()
