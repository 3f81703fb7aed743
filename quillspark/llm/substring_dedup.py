"""Substring dedup: passages that repeat across documents.

A document is cut into paragraphs in two ways. Its lines are natural paragraphs; lines of
under ``MIN_WORDS`` words are joined with those next to them, up to a blank line. Paragraphs
of ``MIN_WORDS`` words or more are banded by MinHash over 5-word shingles, colliding ones are
joined and verified by exact Jaccard similarity, and classes are connected components.
``tune`` picks rows and bands for a recall of ``RECALL`` at the similarity asked for, at the
least cost. As a repeated passage may also stand in the middle of different lines, every
document is cut again into overlapping paragraphs of ``SPAN`` words that begin at winnowed
positions (the smallest hash in each ``WINNOW`` positions), so that an equal passage of
``SPAN + WINNOW - 1`` words (``MIN_WORDS``) or more yields equal paragraphs wherever it stands,
and all of it but ``WINNOW - 1`` words at an end at most. Those need no bands: their class is
the 64-bit hash of their words, which aren't compared further (among 10 ** 10 different
paragraphs some three pairs have one hash by chance). A document of fewer words is a
paragraph as a whole, which repeats in exact copies of it.

In each class the paragraph that comes first (by doc_id, then position) stays; the others'
words are removed. Overlapping removals of a document are united.

``MIN_WORDS`` is what counts as a passage here, whatever the size of the data: a shorter
paragraph that isn't a whole document is none. Equal passages of that length are found always,
similar natural paragraphs with a recall of ``RECALL``.

Defined results: null and empty texts, and those without a passage, aren't in the result;
rows with a null id are left out; repeated rows (equal id) are one document to the classes,
and a passage that repeats within one document only isn't shared; very long texts are cut
whole; other columns aren't read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.candidates import shared
from quillspark.llm.common import cut, table
from quillspark.llm.linking import candidates, link
from quillspark.llm.textkit import NOT_SPACE, chunks, mix64, windows, words

SHINGLE = 5
NUM, DEN = 80, 100
MIN_WORDS = 24
SPAN = 20
WINNOW = 5
RECALL = 0.99
ROWS = 2
#: What unlike paragraphs have in common, and the cost of bringing two of them together,
#: counted in minima.
UNLIKE, COLLISION = 0.5, 100


def tune_bands(similarity: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` minima each that reach the recall at the similarity."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def tune(similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """Rows and bands of least cost among those that reach the recall: more rows make more
    minima, and fewer collisions of unlike paragraphs."""

    def cost(rows: int) -> float:
        bands = tune_bands(similarity, recall, rows)
        return rows * bands + COLLISION * (1 - (1 - UNLIKE**rows) ** bands)

    rows = min(range(1, 9), key=cost)
    return rows, tune_bands(similarity, recall, rows)


class _Lines:
    """The natural paragraphs of a chunk: words, their hashes, and each one's first and end word."""

    def __init__(self, chunk):
        self.w = w = words(chunk, NOT_SPACE, lower=True)
        self.h = w.hashes()
        mark = np.cumsum(chunk.buf == 0x0A)[w.start] if len(w.start) else np.zeros(0, np.int64)
        new = np.ones(len(w.start), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (w.doc[1:] != w.doc[:-1])
        first = np.flatnonzero(new)
        short = np.diff(np.append(first, len(w.start))) < MIN_WORDS
        joined = np.zeros(len(first), bool)
        joined[1:] = short[1:] & short[:-1] & (w.doc[first[1:]] == w.doc[first[:-1]]) & (mark[first[1:]] - mark[first[:-1]] == 1)
        self.first = first[~joined]
        self.end = np.append(self.first[1:], len(w.start)).astype(np.int64)[: len(self.first)]
        self.long = self.end - self.first >= MIN_WORDS
        self.g, _ = windows(self.h, w.doc, SHINGLE)

    def ids(self) -> np.ndarray:
        """A hash of each line's words in order."""
        return self._ids(self.first, self.end)

    def _ids(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words of each run; runs follow each other and cover all words."""
        if not len(first):
            return np.zeros(0, np.int64)
        size = end - first
        powers = np.multiply.accumulate(np.full(int(size.max()), np.uint64(0x9FB21C651E98DF25)))
        at = np.arange(len(self.h)) - np.repeat(first, size)
        return mix64(np.add.reduceat(self.h * powers[at], first) + size.astype(np.uint64)).view(np.int64)

    def short_documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with words, but fewer than a passage has: their places, sizes and hashes."""
        size = np.diff(self.w.wo)
        doc = np.flatnonzero(size)
        few = size[doc] < MIN_WORDS
        return doc[few], size[doc][few], self._ids(self.w.wo[:-1][doc], self.w.wo[1:][doc])[few]

    def minima(self, seeds: np.ndarray) -> np.ndarray:
        """For each seed the least hash of each line's shingles."""
        ok = np.arange(len(self.h)) + SHINGLE <= np.repeat(self.end, self.end - self.first)
        out = np.empty((len(seeds), len(self.first)), np.uint64)
        v = np.full(len(self.h), np.iinfo(np.uint64).max)
        at = np.flatnonzero(ok)
        for i, seed in enumerate(seeds):
            v[at] = mix64(self.g[at] ^ seed)
            out[i] = np.minimum.reduceat(v, self.first)
        return out

    def sizes(self) -> np.ndarray:
        """How many distinct shingles each line has."""
        line = np.repeat(np.arange(len(self.first)), self.end - self.first)[: len(self.g)]
        ok = np.arange(len(self.g)) + SHINGLE <= self.end[line]
        line, g = line[ok], self.g[ok]
        order = np.lexsort((g, line))
        line, g = line[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (line[1:] != line[:-1])
        return np.bincount(line[new], minlength=len(self.first))

    def shingles(self, i: int) -> np.ndarray:
        return np.unique(self.g[self.first[i] : self.end[i] - SHINGLE + 1])


def _spans(w, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the winnowed paragraphs of SPAN words, and their hashes."""
    g2, _ = windows(h, w.doc, 2)
    if len(g2) < WINNOW:
        view = np.arange(len(g2))
    else:
        at = np.lib.stride_tricks.sliding_window_view(g2, WINNOW).argmin(axis=1) + np.arange(len(g2) - WINNOW + 1)
        view = np.unique(at)
    hs, ok = windows(h, w.doc, SPAN)
    view = view[view < len(hs)]
    view = view[ok[view]]
    return view, hs[view]


def paragraphs(docs: DataFrame) -> DataFrame:
    """sid, doc_id, first and end word, and number of shingles of every natural paragraph (a
    document's words are counted from 0), and of short documents as a whole. Paragraphs of
    equal words have the same sid."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                x = _Lines(chunk)
                first, end = x.first[x.long], x.end[x.long]
                doc = x.w.doc[first]
                at = x.w.wo[:-1][doc]
                few, size, own = x.short_documents()
                both = lambda a, b: pa.array(np.concatenate([a, b]))
                ids = batch.column(0).slice(chunk.first, len(chunk)).take(both(doc, few))
                none = np.zeros(len(few), np.int64)
                yield pa.RecordBatch.from_arrays([both(x.ids()[x.long], own), ids, both(first - at, none), both(end - at, size), both(x.sizes()[x.long], none).cast(pa.int32())], ["sid", "doc_id", "a", "b", "n"])

    return docs.mapInArrow(run, "sid long, doc_id long, a long, b long, n int")


def repeated_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """class, doc_id, a, b of natural paragraphs that have a similar or equal one."""
    rows, bands = tune(num / den)
    seeds = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def entries(batch):
        for chunk in chunks(batch.column(1)):
            x = _Lines(chunk)
            if x.long.any():
                m, sid = x.minima(seeds)[:, x.long], x.ids()[x.long]
                t = [mix64(np.bitwise_xor.reduce(mix64(m[b * rows : (b + 1) * rows] + np.arange(rows, dtype=np.uint64)[:, None]), axis=0) + np.uint64(b)) for b in range(bands)]
                yield np.concatenate(t), np.tile(sid, bands), None

    lines = cut(paragraphs(docs))
    distinct = cut(lines.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n")))
    group = shared(docs, entries, lines.count() * bands)
    stay = candidates(group.join(distinct.select("sid", "n"), "sid"), num, den, np.ones_like)
    # the sets of the ids that may have a link, from one document of each
    wanted = stay.select("sid").distinct().join(distinct, "sid").groupBy("doc_id").agg(F.collect_set("sid").alias("want"))

    def hashed(batches):
        for batch in batches:
            sids, toks = [], []
            for chunk in chunks(batch.column(1)):
                x = _Lines(chunk)
                ids = x.ids()
                want = [set(v.as_py()) for v in batch.column(2).slice(chunk.first, len(chunk))]
                for i in np.flatnonzero(x.long).tolist():
                    if int(ids[i]) in want[x.w.doc[x.first[i]]]:
                        sids.append(int(ids[i]))
                        toks.append(x.shingles(i).astype(">u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(toks, pa.binary())], ["sid", "toks"])

    sets = docs.join(wanted, "doc_id").select("doc_id", "text", "want").mapInArrow(hashed, "sid long, toks binary").dropDuplicates(["sid"])
    _, linked = link(stay, sets, num, den)
    again = cut(distinct.join(linked, "sid", "left").where(F.col("root").isNotNull() | (F.col("copies") > 1)).select("sid", F.coalesce("root", "sid").alias("class")))
    return lines.join(again, "sid").select("class", "doc_id", "a", "b")


def repeated_spans(docs: DataFrame, words_total: int) -> DataFrame:
    """class, doc_id, a, b of the winnowed paragraphs that occur in two documents or more."""

    def entries(batch):
        for chunk in chunks(batch.column(1)):
            w = words(chunk, NOT_SPACE, lower=True)
            at, hs = _spans(w, w.hashes())
            ids = batch.column(0).slice(chunk.first, len(chunk)).to_numpy()
            doc = w.doc[at]
            # (token, document); the position goes along as the size
            yield hs, ids[doc], (at - w.wo[:-1][doc]).astype(np.int32)

    got = shared(docs, entries, words_total * 2 // (WINNOW + 1), carry=True)
    return got.select(F.col("key").alias("class"), F.col("sid").alias("doc_id"), F.col("n").cast("long").alias("a"), (F.col("n") + SPAN).cast("long").alias("b"))


def repeats(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """class, doc_id, a, b, first_doc, first_a of every repeated paragraph; the row with
    doc_id = first_doc and a = first_a is the one that stays."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_words = docs.select((F.length("text") / 4).alias("n")).agg(F.sum("n")).first()[0] or 0
    both = cut(repeated_lines(docs, num, den).union(repeated_spans(docs, int(n_words))))
    # cut, so that the join on a hot class is one that can be split at run time
    first = cut(both.groupBy("class").agg(F.min(F.struct("doc_id", "a")).alias("f"), F.max("doc_id").alias("last")).where("last > f.doc_id").select("class", "f"))
    return both.join(first, "class").select("class", "doc_id", "a", "b", F.col("f.doc_id").alias("first_doc"), F.col("f.a").alias("first_a"))


def _gone() -> Column:
    return (F.col("doc_id") != F.col("first_doc")) | (F.col("a") != F.col("first_a"))


def _united(ranges: Column) -> Column:
    """Word ranges, united and in order."""
    return F.aggregate(
        F.array_sort(ranges),
        F.array().cast("array<struct<a: long, b: long>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))),
    )


def removals(found: DataFrame) -> DataFrame:
    """doc_id and its removed word ranges, united and in order; from ``repeats``."""
    return found.where(_gone()).groupBy("doc_id").agg(_united(F.collect_set(F.struct("a", "b"))).alias("ranges"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that shares a passage with another: class_id (the smallest
    document that a passage of it was first in), how many of its paragraphs repeat, how many
    of its words lie in them, how many are removed as repeats of an earlier copy, and which.
    Documents that share nothing aren't listed."""
    found = repeats(table(spark, sf_dir, "documents"))
    here = F.struct("a", "b")
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    per = found.groupBy("doc_id").agg(F.min("first_doc").alias("class_id"), F.count("*").alias("n_paragraphs"), _united(F.collect_set(here)).alias("shared"), _united(F.collect_set(F.when(_gone(), here))).alias("removed"))
    return per.select("doc_id", "class_id", "n_paragraphs", words(F.col("shared")).alias("n_words"), words(F.col("removed")).alias("n_removed"), "removed")
