"""Minimax contiguous partition of documents into shards, with built-in functions only.

Documents of equal text are one atomic group. Groups are ordered by a 64-bit hash of the
text, so an ordered prefix of groups is a range of that hash, and a partition into
contiguous shards is a few cut points. The smallest feasible shard capacity is found by
binary search with a greedy check (fill a shard as far as the capacity allows, then start
the next). The check only needs prefix sums near the cuts. So the sums of cells (ranges of
the hash) are collected, ``CELLS`` at a time; cells no cut can fall into are left alone and
the others are divided, until those hold one group each. What the driver sees is a fixed
number of sums at each step, whatever the number of documents.

Slots number a shard's rows without a gap: rows are dealt over ``buckets`` by a hash of
doc_id, numbered within their bucket, and moved up by the sizes of the buckets before.

Defined results: a null text has size 1 and forms a group with other null texts; repeated
rows belong to one group and get different slots; an empty table gives no rows; with
fewer groups than shards some shards are empty; a group larger than a fair share fills a
shard of its own, as groups are never divided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, table

SHARDS = 8
CELLS = 4096
BUCKETS = 512

_LOW, _HIGH = -(2**63), 2**63  # the hash's range


def group_key(text: Column) -> Column:
    return F.xxhash64(text)


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


class _Cells:
    """Consecutive ranges of the hash with the sum of sizes in each; ``whole`` ones hold at
    most one group."""

    def __init__(self, cells: list[tuple[int, int, int, bool]]):
        self.cells = cells  # (low, high, sum, whole)

    def greedy(self, capacity: int, shards: int, split: bool) -> list[int] | None:
        """Index of the cell that each shard ends before, or None if they don't suffice.

        ``split`` treats a divisible cell as if it could be cut anywhere."""
        ends, used = [], 0
        for i, (_, _, size, whole) in enumerate(self.cells):
            if used + size <= capacity:
                used += size
                continue
            if split and not whole:
                rest = used + size
                while rest > capacity:
                    ends.append(i)
                    rest -= capacity
                used = rest
            else:
                ends.append(i)
                used = size
                if size > capacity:
                    return None
            if len(ends) >= shards:
                return None
        return ends

    def smallest(self, shards: int, split: bool) -> int:
        total = sum(c[2] for c in self.cells)
        low = max([-(-total // shards), *(c[2] for c in self.cells if c[3] or not split)], default=0)
        high = max(total, low)
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, split) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def undecided(self, shards: int) -> set[int]:
        """Divisible cells that a cut may fall into, for any capacity still possible.

        A shard's furthest end grows with the capacity. So every cut lies between where
        it falls if cells are atomic and the capacity is the least, and where it falls if
        they can be cut anywhere and the capacity is the most."""
        least, most = self.smallest(shards, True), self.smallest(shards, False)
        prefix = [0]
        for c in self.cells:
            prefix.append(prefix[-1] + c[2])
        out: set[int] = set()
        lo = hi = 0
        for _ in range(shards - 1):
            # atomic cells at the least capacity: the furthest boundary not beyond lo + least
            lo = max((p for p in prefix if p <= lo + least), default=0) if lo < prefix[-1] else prefix[-1]
            hi = min(hi + most, prefix[-1])
            out |= {i for i, c in enumerate(self.cells) if not c[3] and prefix[i + 1] > lo and prefix[i] < hi}
        return out


def cut_points(sizes: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> list[int]:
    """Hash values at which the shards after the first begin, in order.

    ``sizes``: (k, size). Fewer than ``shards - 1`` where some shards stay empty."""
    space = _Cells([(_LOW, _HIGH, 0, False)])
    first, todo = True, {0}
    while todo:
        parts = max(2, cells // len(todo))
        bounds, wide = [], {}
        for i in sorted(todo):
            low, high = space.cells[i][:2]
            wide[i] = max(1, -(-(high - low) // parts))
            bounds.append((low, high, wide[i]))
        # the cell's number, from the hash alone; exact in decimals, as low may be -2^63
        k = F.col("k").cast("decimal(20,0)")
        low_of, wide_of = F.lit(None).cast("decimal(20,0)"), F.lit(None).cast("decimal(20,0)")
        if first:
            low_of, wide_of = F.lit(str(_LOW)).cast("decimal(20,0)"), F.lit(str(bounds[0][2])).cast("decimal(20,0)")
            part = sizes
        else:
            lows = F.array(*[F.lit(b[0]) for b in bounds])
            at = F.size(F.filter(lows, lambda x: x <= F.col("k")))
            part = sizes.withColumn("at", at).where(F.col("at") > 0).withColumn("high", F.element_at(F.array(*[F.lit(b[1] - 1) for b in bounds]), F.col("at"))).where(F.col("k") <= F.col("high"))
            low_of = F.element_at(lows, F.col("at")).cast("decimal(20,0)")
            wide_of = F.element_at(F.array(*[F.lit(str(b[2])).cast("decimal(20,0)") for b in bounds]), F.col("at"))
        cell = F.floor((k - low_of) / wide_of).cast("long")
        got = (
            part.groupBy(low_of.cast("string").alias("low"), cell.alias("cell"))
            .agg(F.sum("size").alias("size"), F.min("k").alias("first"), F.max("k").alias("last"))
            .collect()
        )
        new: dict[int, dict[int, tuple]] = {}
        for r in got:
            new.setdefault(int(r["low"]), {})[r["cell"]] = (r["size"], r["first"], r["last"])
        out = []
        for i, c in enumerate(space.cells):
            if i not in todo:
                out.append(c)
                continue
            at, own = c[0], new.get(c[0], {})
            for j in sorted(own):
                size, a, b = own[j]
                low, high = c[0] + j * wide[i], min(c[1], c[0] + (j + 1) * wide[i])
                if low > at:
                    out.append((at, low, 0, True))
                out.append((low, high, size, a == b))
                at = high
            if at < c[1]:
                out.append((at, c[1], 0, True))
        space, first = _Cells(out), False
        todo = space.undecided(shards)
    ends = space.greedy(space.smallest(shards, False), shards, False) or []
    return [space.cells[i][0] for i in ends]


def shard_of(k: Column, cuts: list[int]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= k)) if cuts else F.lit(0)


def assign_shards(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    narrow = cut(
        docs.select(
            "doc_id",
            group_key(F.col("text")).alias("k"),
            text_size(F.col("text")).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        )
    )
    cuts = cut_points(narrow.select("k", "size"), shards)
    dealt = narrow.withColumn("shard", shard_of(F.col("k"), cuts).cast("int")).withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(buckets)).cast("int"))
    before = (
        dealt.groupBy("shard", "bucket")
        .count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "k"))
    return dealt.withColumn("own", own).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_corpus(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The pipeline's last stage: where every document goes."""
    return assign_shards(docs, shards)
