"""Quality rules as a short-circuit cascade.

``measure`` gives the base counts of every whole text. ``plan_cascade`` times each rule on
a bounded sample of documents and notes which share it rejects; rules then run in
falling order of rejection per cost, each only on documents that all earlier rules kept.
The order changes the cost and the reported rule, never whether a document is kept.

Defined results: a null or empty text has no words, so all counts are 0, the word-count
base rule fails and it is not kept. Repeated rows are judged alike, each by itself. Rows
with a null id are kept as rows. An empty table gives no rows. Very long texts are counted
whole, one at a time. Extra columns are untouched, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table
from quillspark.llm.textkit import NOT_SPACE, Chunk, Words, chunks, structs, windows, words

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SAMPLE_DOCS = 2000

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LETTER = np.arange(256) >= 0x80
_LETTER |= np.isin(np.arange(256) | 0x20, np.arange(0x61, 0x7B))


class Facts:
    """Counts of one chunk's documents, each made when first asked for."""

    def __init__(self, chunk: Chunk | None, memo: dict | None = None):
        self._memo = dict(memo or {})
        if chunk is not None:
            self._memo["chunk"] = chunk

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in _FACTS:
            raise AttributeError(name)
        if name not in self._memo:
            self._memo[name] = _FACTS[name](self)
        return self._memo[name]

    def only(self, keep: np.ndarray) -> Facts:
        """Of some of the documents: counts already made are kept, others are made for them
        alone, and their bytes are only copied once such a count is asked for."""
        out = Facts(None, {k: v[keep] for k, v in self._memo.items() if k in COUNTS})
        out._memo["whole"], out._memo["keep"] = self, keep
        return out


def _per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _lines(f: Facts) -> Words:
    not_break = np.arange(256) != 0x0A
    return words(f.chunk, not_break)


def _dup_lines(f: Facts) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    lines = f.lines
    has_word = np.searchsorted(f.words.start, lines.end) > np.searchsorted(f.words.start, lines.start)
    h = lines.hashes()
    out = np.zeros(len(f.chunk), np.int64)
    for i, (a, b) in enumerate(zip(lines.wo[:-1].tolist(), lines.wo[1:].tolist(), strict=True)):
        if b - a > 1:
            own = h[a:b][has_word[a:b]]
            out[i] = len(own) - len(np.unique(own))
    return out


def _repeat_words(f: Facts) -> np.ndarray:
    """Words inside 8-word windows that occur twice or more in the text."""
    w = f.words
    g, _ = windows(f.hash, w.doc, WINDOW)
    out = np.zeros(len(f.chunk), np.int64)
    for i, (a, b) in enumerate(zip(w.wo[:-1].tolist(), w.wo[1:].tolist(), strict=True)):
        n = b - a - WINDOW + 1
        if n > 1:
            own = g[a : a + n]
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            if same.any():
                again = np.zeros(n, bool)
                again[order[1:][same]] = again[order[:-1][same]] = True
                edge = np.zeros(b - a + 1, np.int64)
                np.add.at(edge, np.flatnonzero(again), 1)
                np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
                out[i] = np.count_nonzero(np.cumsum(edge))
    return out


def _word_chars(f: Facts) -> np.ndarray:
    buf = f.chunk.buf
    return _per_doc(NOT_SPACE[buf] & ((buf & 0xC0) != 0x80), f.chunk.off)


def _letter_words(f: Facts) -> np.ndarray:
    """Words that hold a letter (any byte above ASCII counts as one)."""
    w = f.words
    total = np.concatenate([[0], np.cumsum(_LETTER[f.chunk.buf], dtype=np.int64)])
    held = total[w.end] > total[w.start]
    return _per_doc(held, w.wo)


#: Facts with one number for each document.
COUNTS = ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letter_words")
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_FACTS: dict[str, Callable[[Facts], np.ndarray]] = {
    "chunk": lambda f: _subset(f._memo["whole"].chunk, f._memo["keep"]),
    "words": lambda f: words(f.chunk),
    "hash": lambda f: f.words.hashes(),
    "lines": _lines,
    "n_words": lambda f: np.diff(f.words.wo).astype(np.int64),
    "n_lines": lambda f: np.diff(f.lines.wo).astype(np.int64),
    "word_chars": _word_chars,
    "n_symbols": lambda f: _per_doc(_SYMBOL[f.chunk.buf], f.chunk.off),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_letter_words": _letter_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the facts of some documents to a mask of those to reject."""

    name: str
    rejects: Callable[[Facts], np.ndarray]


RULES = (
    Rule("few_words", lambda f: f.n_words < MIN_WORDS),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > MAX_REPEAT_PERCENT * f.n_words),
    Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 14 * f.n_words)),
    Rule("symbols", lambda f: 100 * f.n_symbols > 10 * f.n_words),
    Rule("duplicate_lines", lambda f: 100 * f.n_dup_lines > 30 * f.n_lines),
    Rule("few_letters", lambda f: 100 * f.n_letter_words < 70 * f.n_words),
)
BASE = ("few_words", "repeated_words")


def _subset(chunk: Chunk, keep: np.ndarray) -> Chunk:
    size = np.diff(chunk.off)
    return Chunk(chunk.first, chunk.buf[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]))


def plan_cascade(docs: DataFrame, rules=RULES, sample_docs: int = SAMPLE_DOCS, counts: bool = False) -> list[str]:
    """Rule names in falling order of rejected documents per second.

    The sample has the ``sample_docs`` smallest hashes of doc_id, so that it is drawn from
    all documents; only ids are sorted and broadcast, and no text is moved. Each rule is
    timed on it in the tasks as it will run: with the base counts made where ``counts`` says
    that the cascade makes them first, or else from scratch. Without ids the rules keep their
    given order."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # rows that repeat an id count once
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    names = [r.name for r in rules]

    def timed(batches):
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                cost, gone = [], []
                for r in rules:
                    facts = Facts(chunk)
                    for name in BASE_COUNTS if counts else ():
                        getattr(facts, name)
                    t = time.perf_counter()
                    gone.append(int(r.rejects(facts).sum()))
                    cost.append(time.perf_counter() - t)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(cost), pa.array(gone)], ["rule", "cost", "gone"])

    got = sample.select("text").mapInArrow(timed, "rule string, cost double, gone long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("gone").alias("gone")).collect()
    rate = {r["rule"]: r["gone"] / max(r["cost"], 1e-9) for r in got}
    return sorted(names, key=lambda n: (-rate.get(n, 0.0), names.index(n)))


def judge(order: list[str], rules=RULES, counts: bool = True):
    """The cascade as an expression of the text column.

    Gives kept and the name of the rule that rejected the text (which depends on timings,
    so no result may hold it). Each rule sees only the texts that all earlier rules kept.
    With ``counts`` the base counts are made first, for all texts, and given out too; rules
    then find those counts made, and what else they need is counted for survivors only."""
    by_name = {r.name: r for r in rules}
    chain = [by_name[n] for n in order]
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " if counts else ""

    @F.arrow_udf(f"struct<{fields}kept boolean, rejected_by string>")
    def run(text: pa.Array) -> pa.Array:
        parts = []
        for chunk in chunks(text):
            n = len(chunk)
            alive, by, facts = np.arange(n), np.full(n, None, object), Facts(chunk)
            cols = {k: getattr(facts, k) for k in BASE_COUNTS} if counts else {}
            for rule in chain:
                if not len(alive):
                    break
                gone = rule.rejects(facts)
                by[alive[gone]] = rule.name
                alive = alive[~gone]
                if gone.any() and len(alive):
                    facts = facts.only(~gone)
            kept = np.zeros(n, bool)
            kept[alive] = True
            parts.append(structs(**cols, kept=kept, rejected_by=pa.array(by, pa.string())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([]))

    return run.asNondeterministic()


def filter_quality(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Keeps the documents that pass every rule; columns as they come."""
    verdict = judge(plan_cascade(docs, sample_docs=sample_docs), counts=False)
    names = docs.columns
    tmp = "_" * (1 + max(map(len, names), default=0))
    return docs.withColumn(tmp, verdict(F.col("text"))).where(F.col(f"{tmp}.kept")).select(*[F.col(f"`{n}`") for n in names])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = docs.select("doc_id", judge(plan_cascade(docs, counts=True))("text").alias("q"))
    failed: Column = (F.col("q.n_words") < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q.n_words"))
    return q.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", failed.alias("base_failed"), (F.col("q.kept") & ~failed).alias("kept"))
