"""Mixing sources to target weights by weighted fair queueing, with built-in functions only.

Every source offers its documents in shuffled order (by a hash of doc_id), and after the
last again from the first, twice over at most. A document's virtual start and finish are
the words its source has offered before and after it, divided by the source's target. All
documents are served in the order of virtual finish (a global range sort), until the
total budget is spent. By virtual time v each source has been served v times its target, so
all together v times the budget, which therefore ends about virtual time 1.

``truncated`` is that stream cut at the total budget: the copies of all documents, range-sorted
by finish, with running sums over ranges and within them; of the copy at the budget's end a
part is taken. At virtual time 1 all have served their targets but for the copies in service,
so every source's words come within two documents of its target. ``mix`` gives out whole
documents instead: of each source those that begin before virtual time 1, range-sorted.

Targets: the budget is shared by weight; a target stops at twice its source's size and
the excess is shared anew, until none is above. Sorted by size/weight, capped sources
come first, so the level is found with running sums over sources.

Prefix sums within a source are made over buckets of the hash: sums of buckets first, then
within each. So a source with a third of all rows spreads over all tasks.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; an empty table gives no rows; sources without words have target 0; repeated rows
are served one after the other; equal hashes are ordered by id, then by size; very long
texts are counted whole; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, table

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MAX_REPEATS = 2
#: Hex digits of the hash that name a bucket: 16 to that power buckets for each source.
BUCKET_DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT) -> DataFrame:
    """(source, source_size, target) from (source, size): one row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    w = per.select("source", "source_size", weight.cast("long").alias("weight"), (MAX_REPEATS * F.col("source_size")).alias("most"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * (budget_percent / 100.0) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    w = w.withColumn("level", left / share).withColumn("capped", F.col("level") * F.col("weight") >= F.col("most"))
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return w.withColumn("level", level).select("source", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def served(sized: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT) -> DataFrame:
    """``sized`` (doc_id, source, size and more) with source_size, target, and ``offered``:
    the words its source has offered when the document first ends."""
    rows = sized.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    # at most 16 ** BUCKET_DIGITS rows for each source; written so that texts are read only once more
    sums = cut(rows.groupBy("source", "_b").agg(F.sum("size").alias("_sum")))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    share = targets(sums.select("source", F.col("_sum").alias("size")), weights, budget_percent)
    # what each bucket starts from, and its source's target: one row for each source and bucket
    start = before.alias("a").join(share.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source"))).select(F.col("a.source").alias("_s"), F.col("a._b").alias("_k"), "_before", "source_size", "target")
    own = F.sum("size").over(Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_own", own)
        .join(start, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_k")))
        .withColumn("offered", F.col("_before") + F.col("_own"))
        .drop("_h", "_b", "_own", "_s", "_k", "_before")
    )


def words_taken(copy: int) -> Column:
    """Words of the document's copy number ``copy`` that are served by virtual time 1."""
    begins = F.col("offered") - F.col("size") + copy * F.col("source_size")
    return F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.floor(F.col("target") - begins + 0.5).cast("long")))


def finish(copy: int) -> Column:
    return F.try_divide(F.col("offered") + copy * F.col("source_size"), F.col("target"))  # null where nothing is served


def copies() -> Column:
    """The copies of a row of ``served`` in the truncated stream: finish and words of each."""
    each = F.array(*[F.struct(finish(c).alias("finish"), words_taken(c).alias("words")) for c in range(MAX_REPEATS)])
    return F.filter(each, lambda x: x["words"] > 0)


def stream(rows: DataFrame) -> DataFrame:
    """``rows`` (from ``served``) once for each copy that is served until the budget ends, with
    its virtual ``_finish`` and the ``_words`` of it that are taken."""
    return rows.select("*", F.explode(copies()).alias("_c")).select(*rows.columns, F.col("_c.finish").alias("_finish"), F.col("_c.words").alias("_words"))


def truncated(rows: DataFrame, budget_percent: int = BUDGET_PERCENT, partitions: int | None = None) -> DataFrame:
    """Words taken of each row of ``served`` with words (source, offered, taken): its copies in
    the order of virtual finish over all sources, truncated where the total budget is spent.

    The copies are range-sorted; each range's words are summed, running sums over the ranges
    (as many rows as partitions) say where each begins, and within a range a running sum says
    what is served before a copy. What the last one exceeds the budget by isn't taken."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    offers = F.explode(F.array(*[finish(c) for c in range(MAX_REPEATS)])).alias("finish")
    queue = rows.where((F.col("size") > 0) & (F.col("target") > 0)).select("source", "offered", "size", offers)
    order = ["finish", "source", "offered"]
    dealt = cut(queue.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("range").agg(F.sum("size").alias("words"))
    before = sums.select("range", F.coalesce(F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    budget = total * min(budget_percent, 100 * MAX_REPEATS) // 100
    left = F.lit(budget) - (F.col("before") + F.col("own") - F.col("size"))
    taken = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), left))
    served_words = dealt.withColumn("own", own).join(before, "range").select("source", "offered", taken.alias("taken"))
    return served_words.groupBy("source", "offered").agg(F.sum("taken").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # narrow rows, written so that texts are counted once
    rows = cut(served(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))))
    taken = truncated(rows).select(F.col("source").alias("_s"), F.col("offered").alias("_o"), "taken")
    out = rows.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("offered") == F.col("_o")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mix(docs: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, partitions: int | None = None) -> DataFrame:
    """The mixed stream: documents in the order they're served, columns as they come.

    Documents are whole here: of each source the one in service at the end is the last.
    A document is repeated where its source's target is above its size."""
    names = docs.columns
    packed = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    served_rows = stream(served(packed, weights, budget_percent)).select("_row", "doc_id", "_finish")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return served_rows.repartitionByRange(n, "_finish", "doc_id").sortWithinPartitions("_finish", "doc_id").select("_row.*")
