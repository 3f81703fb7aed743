"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is described by the features of ``FEATURES``. A feature is cut into bins at
quantiles; its shape is a lookup table over bins. Boosting goes round the features in
turn: a shallow tree over one feature's bins (at most ``LEAVES`` leaves) is fitted to the
current gradient and added, damped, to that feature's table. Then the pairs of features
whose joint table would gain most are boosted the same way, with trees that cut both
features. A document's score is the logistic of a sum of table entries: vectorised
additions over its bins.

The fit takes at most ``SAMPLE_DOCS`` labelled documents (a documented bound, drawn by a
hash of doc_id), of which only the features leave the tasks. Scoring covers all texts.

Defined results: null and empty texts have all features 0 and get a score like others;
null labels teach nothing; without labels of both kinds every score is the clipped share
of label 1 (0.5 without any); repeated rows score alike; extra columns are untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import labelled_sample, remainder, table
from quillspark.llm.quality_rules import Facts
from quillspark.llm.textkit import Chunk, chunks

SAMPLE_DOCS = 20000
BINS = 32
LEAVES = 4
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.1
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "symbols", "pipes", "dup_lines", "repeat_words", "letter_words", "capitals",
    "stops", "commas", "digits", "line_words", "non_ascii", "distinct_words", "spaces", "short_words",
)

_any = np.arange(256)


def _is(chars: bytes) -> np.ndarray:
    return np.isin(_any, np.frombuffer(chars, np.uint8))


_PIPE, _UPPER, _STOP, _COMMA, _DIGIT, _HIGH, _SPACE = _is(b"|"), (_any >= 0x41) & (_any <= 0x5A), _is(b".!?"), _is(b",;:"), _is(b"0123456789"), _any >= 0x80, _is(b" ")


def features(chunk: Chunk) -> np.ndarray:
    """One row of FEATURES for each document of the chunk."""
    f = Facts(chunk)
    size, n, buf = np.diff(chunk.off), f.n_words, chunk.buf

    def count(mask):
        total = np.concatenate([[0], np.cumsum(mask[buf], dtype=np.int64)])
        return total[chunk.off[1:]] - total[chunk.off[:-1]]

    by_word, by_byte, by_line = np.maximum(n, 1), np.maximum(size, 1), np.maximum(f.n_lines, 1)
    w = f.words
    length = w.end - w.start
    short = np.concatenate([[0], np.cumsum(length <= 3)])
    short = short[w.wo[1:]] - short[w.wo[:-1]]
    distinct = np.array([len(np.unique(f.hash[a:b])) for a, b in zip(w.wo[:-1].tolist(), w.wo[1:].tolist(), strict=True)], np.int64)
    cols = [
        np.log1p(n), f.word_chars / by_word, f.n_symbols / by_word, count(_PIPE) / by_word, f.n_dup_lines / by_line, f.n_repeat_words / by_word,
        f.n_letter_words / by_word, count(_UPPER) / by_word, count(_STOP) / by_word, count(_COMMA) / by_word, count(_DIGIT) / by_byte,
        n / by_line, count(_HIGH) / by_byte, distinct / by_word, count(_SPACE) / by_byte, short / by_word,
    ]
    return np.stack(cols, axis=1)


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _gain(g, h):
    return g**2 / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The cut of a run of bins that gains most, and its gain."""
    gs, hs = np.cumsum(g), np.cumsum(h)
    gain = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - _gain(gs[-1], hs[-1])
    if not len(gain):
        return 0.0, 0
    i = int(np.argmax(gain))
    return float(gain[i]), i + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf value of each bin, for the tree grown by the best cut so far."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(parts)]
        gain, at, k = max(found, key=lambda x: x[0])
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts the first feature once and each side by the second; its gain."""
    best, value = 0.0, np.zeros(g.shape)
    gs, hs = np.cumsum(g, 0), np.cumsum(h, 0)
    for i in range(g.shape[0] - 1):
        total, sides = 0.0, []
        for gg, hh in ((gs[i], hs[i]), (gs[-1] - gs[i], hs[-1] - hs[i])):
            gain, at = _best_cut(gg, hh)
            total += gain + _gain(gg.sum(), hh.sum())
            sides.append((gg, hh, at))
        if total > best:
            best, value = total, np.zeros(g.shape)
            for (gg, hh, at), rows in zip(sides, (slice(0, i + 1), slice(i + 1, None)), strict=True):
                value[rows, :at] = gg[:at].sum() / (hh[:at].sum() + 1.0)
                value[rows, at:] = gg[at:].sum() / (hh[at:].sum() + 1.0)
    return best - _gain(g.sum(), h.sum()), value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Model:
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = Model(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    b = model.bins(x)
    size = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in size]
    z = np.full(len(y), model.base)

    def slope():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, s in enumerate(size):
            g, h = slope()
            leaf = RATE * _shallow_tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s), LEAVES)
            model.tables[j] += leaf
            z += leaf[b[:, j]]
    g, h = slope()

    def joint(i, j, v):
        return np.bincount(b[:, i] * size[j] + b[:, j], v, size[i] * size[j]).reshape(size[i], size[j])

    gains = sorted(((_pair_tree(joint(i, j, g), joint(i, j, h))[0], i, j) for i in range(len(size)) for j in range(i + 1, len(size))), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:pairs] if gain > 3.0]
    model.pair_tables = [np.zeros((size[i], size[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slope()
            leaf = RATE * _pair_tree(joint(i, j, g), joint(i, j, h))[1]
            t += leaf
            z += leaf[b[:, i], b[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, keep, sample_docs: int = SAMPLE_DOCS, label: str = "quality") -> Model:
    names = [f"x{i}" for i in range(len(FEATURES))]

    def described(batches):
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                x = features(chunk)
                yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column(1).slice(chunk.first, len(chunk))], [*names, "y"])

    got = labelled_sample(docs, labels, label, keep, sample_docs).mapInArrow(described, ", ".join(f"{n} double" for n in names) + ", y int").toArrow()
    m = np.stack([got[n].to_numpy() for n in [*names, "y"]], axis=1) if len(got) else np.zeros((0, len(names) + 1))
    m = m[np.lexsort(m.T)]  # sums don't depend on the order of rows
    return fit(m[:, :-1], m[:, -1])


def scorer(model: Model):
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = [pa.array(model.score(features(chunk))) for chunk in chunks(text)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())

    return score.asNondeterministic()


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    out = docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
