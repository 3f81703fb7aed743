"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item's windows are its runs of 13 words (the whole item where it has fewer).
Each window is a set of 5-word shingles (fewer where the window is shorter). All shingles
of the benchmark are counted over all documents and ordered by rarity; as a window must
be contained whole, its required prefix is its one rarest shingle. A document's shingle
that equals such a prefix gives a candidate at a fixed offset; the positional and length
bounds drop it where the window would reach over the document's ends; the rest is
verified word by word.

The benchmark is the stated query set. It is read in blocks of at most ``BLOCK_WORDS``
words, so what one pass ships to the tasks has a fixed size however large it grows.

Defined results: a null or empty text has no words and is clean; an item without words
has no windows; items with a null id or equal text each count by themselves (a null id
is left out of the list of ids); ids may be of any type; repeated
documents are judged alike, each by itself; an empty table gives no rows; very long texts
are scanned whole; other columns stay, whatever their names. Words are compared by 64-bit
hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quillspark.llm.common import table
from quillspark.llm.textkit import ALNUM, chunks, lists, structs, windows, words

WINDOW = 13
SHINGLE = 5
BLOCK_WORDS = 200_000
MIN_SHARE = 20  # contaminated where MIN_SHARE * n_hit >= n_words

def _spans(item: DataType) -> str:
    return f"struct<n_words long, starts array<long>, ends array<long>, items array<{item.simpleString()}>>"


@dataclass
class Block:
    """Windows of some items. ``shingles[m]``: sorted distinct m-word shingle hashes."""

    lengths: np.ndarray
    words: list[np.ndarray]
    items: list[list]
    shingles: dict[int, np.ndarray]


def _block(rows: list[tuple[object, str | None]]) -> Block:
    windows_of: dict[bytes, tuple[np.ndarray, set]] = {}
    col = pa.array([t for _, t in rows], pa.string())
    for chunk in chunks(col):
        w = words(chunk, ALNUM, lower=True)
        h = w.hashes()
        for d, (a, b) in enumerate(zip(w.wo[:-1], w.wo[1:], strict=True)):
            n = min(WINDOW, b - a)
            for i in range(a, b - n + 1) if n else ():
                windows_of.setdefault(h[i : i + n].tobytes(), (h[i : i + n], set()))[1].add(rows[chunk.first + d][0])
    ws = [w for w, _ in windows_of.values()]
    lengths = np.array([len(w) for w in ws], np.int64)
    per: dict[int, list] = {}
    for w in ws:
        m = min(SHINGLE, len(w))
        per.setdefault(m, []).append(windows(w, np.zeros(len(w), np.int8), m)[0])
    return Block(lengths, ws, [sorted(x for x in i if x is not None) for _, i in windows_of.values()], {m: np.unique(np.concatenate(v)) for m, v in per.items()})


def _blocks(benchmark: DataFrame, limit: int):
    """Items in order of id, in blocks of at most ``limit`` bytes/8 words or one item."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"] or "") // 6 + 1
        if rows and size + n > limit:
            yield _block(rows)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += n
    if rows:
        yield _block(rows)


class _Lookup:
    """Positions in an array of hashes that are in a small sorted set; a bit table first."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, np.zeros(1 << 20, bool)
        self.bits[(keys >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == h[at]
        return at[hit], k[hit]


def shingle_counts(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""
    finds = {m: _Lookup(k) for m, k in block.shingles.items()}

    def count(batches):
        totals = {m: np.zeros(len(k), np.int64) for m, k in block.shingles.items()}
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                w = words(chunk, ALNUM, lower=True)
                h = w.hashes()
                for m, find in finds.items():
                    g, ok = windows(h, w.doc, m)
                    at, k = find(g)
                    totals[m] += np.bincount(k[ok[at]], minlength=len(totals[m]))
        for m, n in totals.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), m), pa.int32()), pa.array(k, pa.int64()), pa.array(n[k])], ["m", "k", "n"])

    out = {m: np.zeros(len(k), np.int64) for m, k in block.shingles.items()}
    # at most as many rows as the block has shingles
    for r in docs.select("text").mapInArrow(count, "m int, k long, n long").groupBy("m", "k").agg(F.sum("n").alias("n")).collect():
        out[r["m"]][r["k"]] = r["n"]
    return out


def _scan(block: Block, counts: dict[int, np.ndarray], item: DataType):
    """The join of one block as an expression of the text column, of type ``_spans(item)``."""
    kind = pa.list_(to_arrow_type(item))
    prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for i, w in enumerate(block.words):
        m = min(SHINGLE, len(w))
        g = windows(w, np.zeros(len(w), np.int8), m)[0]
        df = counts[m][np.searchsorted(block.shingles[m], g)]
        j = int(np.lexsort((g, df))[0])
        if df[j]:  # a window whose rarest shingle occurs nowhere needs no look-up
            prefix.setdefault(m, {}).setdefault(int(g[j]), []).append((i, j))
    keys = {m: np.array(sorted(p), np.uint64) for m, p in prefix.items()}
    held = {m: [prefix[m][int(k)] for k in ks] for m, ks in keys.items()}

    @F.arrow_udf(_spans(item))
    def scan(text: pa.Array) -> pa.Array:
        finds = {m: _Lookup(k) for m, k in keys.items()}
        parts = []
        for chunk in chunks(text):
            w = words(chunk, ALNUM, lower=True)
            h = w.hashes()
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set] = {}
            for m, find in finds.items():
                g, ok = windows(h, w.doc, m)
                at, k = find(g)
                for p, q in zip(at[ok[at]].tolist(), k[ok[at]].tolist(), strict=True):
                    d = int(w.doc[p])
                    for win, j in held[m][q]:
                        a, n = p - j, len(block.words[win])
                        if a >= w.wo[d] and a + n <= w.wo[d + 1] and np.array_equal(h[a : a + n], block.words[win]):
                            spans.setdefault(d, []).append((a - int(w.wo[d]), a - int(w.wo[d]) + n))
                            items.setdefault(d, set()).update(block.items[win])
            starts, ends, names = [], [], []
            for d in range(len(chunk)):
                merged: list[list[int]] = []
                for a, b in sorted(set(spans.get(d, ()))):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                starts.append(np.array([a for a, _ in merged], np.int64))
                ends.append(np.array([b for _, b in merged], np.int64))
                names.append(sorted(items.get(d, ())))
            parts.append(structs(n_words=np.diff(w.wo).astype(np.int64), starts=lists(starts, pa.int64()), ends=lists(ends, pa.int64()), items=pa.array(names, kind)))
        return pa.concat_arrays(parts)

    return scan.asNondeterministic()


def _count_words(item: DataType):
    """What ``_scan`` gives where there is nothing to find."""

    kind = pa.list_(to_arrow_type(item))

    @F.arrow_udf(_spans(item))
    def count(text: pa.Array) -> pa.Array:
        parts = []
        for chunk in chunks(text):
            none = lists([np.zeros(0, np.int64)] * len(chunk), pa.int64())
            parts.append(structs(n_words=np.diff(words(chunk, ALNUM, lower=True).wo).astype(np.int64), starts=none, ends=none, items=pa.array([[]] * len(chunk), kind)))
        return pa.concat_arrays(parts)

    return count


def _add(a, b):
    return F.struct(
        F.coalesce(a["n_words"], b["n_words"]).alias("n_words"),
        F.concat(a["starts"], b["starts"]).alias("starts"),
        F.concat(a["ends"], b["ends"]).alias("ends"),
        F.array_distinct(F.concat(a["items"], b["items"])).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, name: str = "hits", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` and a struct column ``name``: n_words, n_hit, items, contaminated."""
    tmp = "_" * (1 + max(map(len, docs.columns), default=0))
    item = benchmark.schema["item_id"].dataType
    out, first = docs, True
    for block in _blocks(benchmark, block_words):
        if not len(block.lengths):
            continue
        hit = _scan(block, shingle_counts(docs, block), item)(F.col("text"))
        out = out.withColumn(tmp, hit if first else F.struct(F.col(tmp).alias("a"), hit.alias("b")))
        if not first:
            out = out.withColumn(tmp, _add(F.col(tmp)["a"], F.col(tmp)["b"]))
        first = False
    if first:
        out = out.withColumn(tmp, _count_words(item)(F.col("text")))
    s = F.col(tmp)
    # union of the blocks' spans: sorted by start, each adds what lies beyond the furthest end so far
    n_hit = F.aggregate(
        F.array_sort(F.arrays_zip(s["starts"].alias("s"), s["ends"].alias("e"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")),
        lambda acc: acc["n"],
    )
    out = out.withColumn(tmp, F.struct(s["n_words"].alias("n_words"), n_hit.alias("n_hit"), s["items"].alias("items")))
    bad = (s["n_hit"] > 0) & (MIN_SHARE * s["n_hit"] >= s["n_words"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(s["n_words"].alias("n_words"), s["n_hit"].alias("n_hit"), s["items"].alias("items"), bad.alias("contaminated")).alias(name))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that aren't contaminated; columns as they come."""
    tmp = "_" * (3 + max(map(len, docs.columns), default=0))
    return contamination(docs, benchmark, tmp).where(~F.col(tmp)["contaminated"]).drop(tmp)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.col("hits")
    ids = F.array_sort(F.transform(h["items"], lambda x: x.cast("string")))
    return contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        h["contaminated"].alias("contaminated"),
    )
