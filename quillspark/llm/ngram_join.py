"""N-gram Jaccard join: documents whose sets of word n-grams are similar, as components.

Documents of equal sets are one id. Each set's n-grams are put into one global order: by
hash, but those that are far more frequent than others last (counted over all documents in
a table of ``2 ** SKETCH_BITS`` counters). Similar sets share n-grams within their prefixes
of that order. Of n n-grams the prefix has ``n - ceil(t * n) + 1 + e`` with e a twentieth
of n, so that a similar pair shares more than e' of them, e' being the smaller set's e; a
set with fewer n-grams in its prefix that any other prefix has is left out. N-grams in
prefixes of several ids give the candidate groups, whose sets are joined in prefix trees
(see ``linking``).

Defined results: a document without words or with a null text has an empty set and is
linked with nothing; fewer words than n make one n-gram of the whole sequence; a null id
has a null component and links nothing; repeated rows get the same component; an empty
table gives no rows. Very long texts are taken whole; other columns aren't read, whatever
their names. n_links is the number of different sets that are similar to a row's
own, exact copies counting as one. Ids of sets are 64-bit fingerprints: among a thousand million
different sets two are expected to agree with a chance of 3 %.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.candidates import shared
from quillspark.llm.common import cut, table
from quillspark.llm.linking import candidates, link
from quillspark.llm.textkit import chunks, mix64, shingle_sets, windows, words

N = 4
NUM, DEN = 85, 100
SKETCH_BITS = 18
EXTRA = 20


def fingerprint(s: np.ndarray) -> int:
    """Of a set of hashes; the empty set has 0."""
    if not len(s):
        return 0
    x = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))), np.uint64(len(s))])
    return int(mix64(mix64(mix64(x[:1]) ^ x[1:2]) ^ x[2:])[0].astype(np.int64))


def _sets(batch: pa.RecordBatch, n: int):
    """(row, set) of every document in a batch of (doc_id, text, ...)."""
    for chunk in chunks(batch.column(1)):
        for i, s in enumerate(shingle_sets(chunk, n)):
            yield chunk.first + i, s


def membership(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, sid (the set's fingerprint) and n_shingles of every row."""

    def run(batches):
        for batch in batches:
            got = [(fingerprint(s), len(s)) for _, s in _sets(batch, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["doc_id", "sid", "n_shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sid long, n_shingles long")


def frequency(docs: DataFrame, n: int = N) -> np.ndarray:
    """Occurrences of n-grams in all documents, in a table of counters by hash."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                w = words(chunk, lower=True)
                g, ok = windows(w.hashes(), w.doc, n)
                total += np.bincount((g[ok] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["slot", "n"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    got = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[got["slot"].to_numpy()] = got["n"].to_numpy()  # as many rows as counters at most
    return out


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 + n // EXTRA


def order_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each counter: 0, or its count where that stands out."""
    mean = counts.mean()
    return np.where(counts > mean + 8 * np.sqrt(mean) + 8, counts, 0)


def similar(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    member = cut(membership(docs, n))
    known = member.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # a set counts once, by its smallest document
    sets_of = cut(known.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))
    size = sets_of.agg(F.sum("n")).first()[0] or 0
    late = order_of(frequency(docs, n))

    def prefixes(batch):
        t, s = [], []
        for i, x in _sets(batch, n):
            if len(x) and batch.column(0)[i].is_valid:
                p = prefix_length(len(x), num, den)
                order = np.argsort(late[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:p]
                t.append(mix64(x[order]))
                s.append(np.full(p, fingerprint(x), np.int64))
        if t:
            yield np.concatenate(t), np.concatenate(s), None

    group = shared(docs, prefixes, size * (den - num) // den + size // EXTRA)
    # the smallest similar set has ceil(t * n) n-grams, and shares one more than its extra
    least = 1 + F.floor(F.ceil(F.col("n") * num / den) / EXTRA)
    active = group.groupBy("sid").count().join(sets_of, "sid").where(F.col("count") >= least).select("sid", "n")
    stay = candidates(group.join(active, "sid"), num, den, lambda size: 1 + size // EXTRA)
    wanted = stay.select("sid").distinct().join(sets_of, "sid").select(F.col("rep").alias("doc_id"), F.col("sid").alias("want"))

    def hashed(batches):
        for batch in batches:
            want, rows = batch.column(2).to_numpy(), []
            for i, x in _sets(batch, n):
                if fingerprint(x) == want[i]:
                    rows.append((int(want[i]), x.astype(">u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["sid", "toks"])

    # rows of one id may repeat, so a set may come several times
    sets = docs.join(wanted, "doc_id").select("doc_id", "text", "want").mapInArrow(hashed, "sid long, toks binary").dropDuplicates(["sid"])
    links, linked = link(stay, sets, num, den)
    classes = sets_of.join(linked, "sid").select("sid", "rep", "root")
    # cut, so that joins on a hot class or a hot set are such that can be split at run time
    least = cut(classes.groupBy("root").agg(F.min("rep").alias("least")))
    found = sets_of.join(classes.join(least, "root").select("sid", "least"), "sid", "left").join(links, "sid", "left")
    final = cut(found.select("sid", F.coalesce("least", "rep").alias("component_id"), "n_links"))
    empty = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    return member.join(final, "sid", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), None).when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """One document of each component, the one with the smallest id; columns as they come.

    Rows are told apart by doc_id, so rows that repeat the smallest id all stay; documents
    without words, or with a null id, stay as they are."""
    found = similar(docs, n, num, den)
    losers = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(losers, "doc_id", "left_anti")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")
