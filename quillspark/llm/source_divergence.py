"""How far the sources of a language differ in their words.

Equal texts are collapsed: of each distinct text of a language only its hash and, per source,
its multiplicity are kept beside one copy of the text, which is tokenized once. A task adds up
what its texts give: for each term and source the occurrences and the documents, both times
the multiplicity. Terms in at least ``MIN_DOCS`` documents of their language stay.

A group's share of a term is smoothed and scaled to whole numbers (``shares``), and two
shares p and q give ``(p - q)^2 / (p + q)``, rounded down. Pairs of sources are compared
sparsely: a term that neither source has gives one constant, a term that one of them has
depends on its count alone (so terms of equal count are summed once), and only terms that both
have are met one by one, where they are counted by the two counts. All in whole numbers.

A term's row holds a count for each source that has it, so it grows with the sources, as does
the result, which has a row for each pair of them; it doesn't grow with the documents.

Defined results: null text, lang and source are ''; repeated rows count as often as they
occur, whatever their ids; an empty table gives no rows; a group without kept terms has count
0 of each; in a language without kept terms all pairs have value 0, ordered by name; very long
texts are tokenized whole; ties are ordered by item; other columns aren't read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, drop_cut, table
from quillspark.llm.textkit import Words, chunks, words

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Rows of (lang, term, source) that a task holds at most before it passes its sums on.
HELD_ROWS = 1_000_000

_BY = pa.list_(pa.struct({"source": pa.string(), "n": pa.int64(), "docs": pa.int64()}))
_b = np.arange(256)
#: [^\x00-\x40\x5B-\x60\x7B-\x7F], after lower-casing
TERM = ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)


def collapse(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, h, sources: each with its multiplicity) and (lang, h, text) of the distinct texts.

    Multiplicities are summed from narrow rows; of a text's copies each task passes on one."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*blank).withColumn("h", F.unhex(F.md5(F.col("text").cast("binary"))))
    each = rows.groupBy("lang", "h", "source").agg(F.count("*").alias("n"))
    times = each.groupBy("lang", "h").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    return times, rows.groupBy("lang", "h").agg(F.first("text").alias("text"))


def _tokens(w: Words) -> pa.Array:
    """The words of a chunk as strings, cut out of its bytes."""
    size = w.end - w.start
    inside = np.zeros(len(w.buf) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    data = w.buf[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    off = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes()))


def _chunk_counts(w: Words, langs: list, sources: list) -> pa.Table:
    """(lang, source, term, n, docs) of some documents, each with its lang and its sources."""
    coded = pc.dictionary_encode(_tokens(w))
    terms, n_terms = coded.dictionary, len(coded.dictionary)
    doc_term, n = np.unique(w.doc * n_terms + coded.indices.to_numpy(), return_counts=True)
    doc, term = np.divmod(doc_term, max(n_terms, 1))
    # a document without words still names its groups: a null term, with no occurrences
    n_docs = len(langs)
    doc, term, n = np.concatenate([doc, np.arange(n_docs)]), np.concatenate([term, np.full(n_docs, -1)]), np.concatenate([n, np.zeros(n_docs, np.int64)])
    groups: dict[tuple, int] = {}
    of = [[(groups.setdefault((lang, s["source"]), len(groups)), s["n"]) for s in some] for lang, some in zip(langs, sources, strict=True)]
    many = np.array([len(x) for x in of])
    first = np.concatenate([[0], np.cumsum(many)[:-1]])
    flat = np.array([x for y in of for x in y], np.int64).reshape(-1, 2)
    # each (document, term) once for each of the document's sources
    each = np.repeat(np.arange(len(doc)), many[doc])
    at = np.arange(len(each)) - np.repeat(np.cumsum(many[doc]) - many[doc], many[doc]) + first[doc[each]]
    group, times = flat[at, 0], flat[at, 1]
    term, n = term[each], n[each] * times
    lang, source = (pa.array(x, pa.large_string()) for x in zip(*groups, strict=True))
    cols = [lang.take(pa.array(group)), source.take(pa.array(group)), terms.take(pa.array(term, mask=term < 0)), pa.array(n), pa.array(times)]
    return _summed(pa.table(cols, ["lang", "source", "term", "n", "docs"]))


def _summed(t: pa.Table) -> pa.Table:
    out = t.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _nested(t: pa.Table) -> pa.RecordBatch:
    """One row for each (lang, term), with its sources: what a task passes on."""
    t = t.sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks()
    lang, term = (pc.fill_null(pc.dictionary_encode(t[c], null_encoding="encode").combine_chunks().indices, -1).to_numpy(zero_copy_only=False) for c in ("lang", "term"))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(lang) != 0) | (np.diff(term) != 0)]))
    one = lambda c: c.combine_chunks().chunk(0) if isinstance(c.combine_chunks(), pa.ChunkedArray) else c.combine_chunks()
    rows = pa.StructArray.from_arrays([one(t[c]) for c in ("source", "n", "docs")], ["source", "n", "docs"])
    by = pa.ListArray.from_arrays(pa.array(np.append(first, len(t)).astype(np.int32)), rows)
    return pa.RecordBatch.from_arrays([one(t["lang"]).take(pa.array(first)).cast(pa.string()), one(t["term"]).take(pa.array(first)).cast(pa.string()), by.cast(_BY)], ["lang", "term", "by"])


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for chunk in chunks(batch.column(1)):
            span = slice(chunk.first, chunk.first + len(chunk))
            held.append(_chunk_counts(words(chunk, TERM, lower=True), langs[span], sources[span]))
            if sum(map(len, held)) > HELD_ROWS:
                held = [_summed(pa.concat_tables(held))]
                if len(held[0]) > HELD_ROWS // 2:
                    yield _nested(held.pop())
    if held:
        yield _nested(_summed(pa.concat_tables(held)))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a null term counts documents alone.

    Tasks pass on one row for each term with its sources, dealt by (lang, term): one shuffle,
    after which both the sums by source and those by term are made in place."""
    times, texts = collapse(docs)
    both = texts.join(times, ["lang", "h"]).select("lang", "text", "sources")
    parts = both.mapInArrow(_tokenize, "lang string, term string, by array<struct<source: string, n: long, docs: long>>").repartition("lang", "term")
    return parts.select("lang", "term", F.explode("by").alias("x")).groupBy("lang", "term", "x.source").agg(F.sum("x.n").alias("n"), F.sum("x.docs").alias("docs"))


def shares(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total), total being N + 2 * V."""
    big = lambda x: x.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", big(F.lit(SCALE)) * big(count + 2), big(total))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, by): each kept term with its occurrences in all and by source, ordered."""
    some = F.when(F.col("n") > 0, F.struct("source", "n"))
    per = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(some)).alias("by"))
    return per.where(F.col("docs") >= min_docs).select("lang", "term", "n", "by")


def groups_of(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, m, lang_m, v): what shares of a group and of its language are divided by,
    and the number of kept terms."""
    lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    own = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("own_n"))
    every = counts.where("term is null").select("lang", "source")
    v = F.coalesce("v", F.lit(0))
    total = lambda n: F.coalesce(n, F.lit(0)) + 2 * v
    return every.join(own, ["lang", "source"], "left").join(lang, "lang", "left").select("lang", "source", total("own_n").alias("m"), total("lang_n").alias("lang_m"), v.alias("v"))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources."""
    zero = F.lit(0).cast("long")
    a, b = groups.select("lang", "source", F.col("m").alias("ma"), "v"), groups.select("lang", F.col("source").alias("item"), F.col("m").alias("mb"))
    pairs = a.join(b, "lang").where(F.col("source") != F.col("item"))
    no_terms = F.col("v") == 0
    p0, q0 = shares(zero, F.col("ma")), shares(zero, F.col("mb"))
    none = distance(p0, q0)
    # neither has the term, were it so of all kept terms
    flat = pairs.select("lang", "source", "item", F.when(no_terms, zero).otherwise(F.col("v") * none).alias("value"))
    # what the terms of one source change, by their counts; the other's are the same with the pair turned round
    by_count = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", "x.source", "x.n").agg(F.count("*").alias("terms"))
    own = by_count.join(pairs, ["lang", "source"]).select("lang", "source", "item", (F.col("terms") * (distance(shares(F.col("n"), F.col("ma")), q0) - none)).alias("value"))
    own = own.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one = own.union(own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # terms of both, by their counts: each source is met with those behind it in the row
    first = kept.select("lang", "by", F.posexplode("by").alias("i", "x")).where(F.col("i") + 1 < F.size("by"))
    met = first.select("lang", F.col("x.source").alias("source"), F.col("x.n").alias("n"), F.explode(F.slice("by", F.col("i") + 2, F.size("by"))).alias("y"))
    same = met.groupBy("lang", "source", F.col("y.source").alias("item"), "n", F.col("y.n").alias("k")).agg(F.count("*").alias("terms"))
    p, q = shares(F.col("n"), F.col("ma")), shares(F.col("k"), F.col("mb"))
    both = same.join(pairs, ["lang", "source", "item"]).select("lang", "source", "item", (F.col("terms") * (distance(p, q) - distance(p, q0) - distance(p0, q) + none)).alias("value"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = both.union(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return flat.union(one).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source uses more than its language."""
    each = kept.select("lang", F.col("term").alias("item"), F.col("n").alias("all_n"), F.explode("by").alias("x")).select("lang", "x.source", "item", "all_n", "x.n")
    p, q = shares(F.col("n"), F.col("m")), shares(F.col("all_n"), F.col("lang_m"))
    both = each.join(groups, ["lang", "source"]).select("lang", "source", "item", p.alias("p"), q.alias("q"))
    return both.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    counts = cut(term_counts(docs))
    kept = cut(kept_terms(counts, min_docs))
    groups = cut(groups_of(counts, kept))
    drop_cut(counts)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return out(pair_values(kept, groups), "pair").union(out(term_values(kept, groups), "term").where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
