"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's probability is a logistic function of its words' weights. A document is
toxic unless every sentence is clean and no unseen cause acts (a leaky noisy-or):
``P = 1 - (1 - leak) * prod(1 - p_sentence)``. The leak takes up labels that no sentence
explains. A sentence's probability is what its words add to log odds of ``BIAS``: one without
weighted words has 0, so length alone doesn't make a clean document toxic. Weights and leak
are fitted to document labels alone, by AdaGrad with an L1 penalty. The fitted sentence
model then names the offending sentences.

The fit takes at most ``SAMPLE_DOCS`` labelled documents (a documented bound, drawn by a
hash of doc_id); tasks hash and count their words and pass on those with evidence, so the
driver holds numbers of learned words and no text. Scoring covers every whole text.

Defined results: null, empty and word-less texts score the leak; null labels teach
nothing; without labels of both kinds all weights are 0 and the leak is the share of label
1 (0.05 without any); repeated rows score alike and teach once for each id (the least text);
very long texts are scored whole, one at a time; an empty table gives no rows. Extra columns
are untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import labelled_sample, remainder, table
from quillspark.llm.textkit import ALNUM, Chunk, Words, chunks, mix64, structs, words

SAMPLE_DOCS = 8000
BITS = 18
MIN_DOCS = 5
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: Log odds from which a sentence's words count.
BIAS = -11.0
#: Pseudo-counts and standard deviations of a word's evidence at the start.
PRIOR, SIGMAS = 3, 5
STEPS = 100

_END = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


def _sentences(chunk: Chunk) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, each word's features, and the index of each sentence's first word.

    Sentences end at . ! ? and line breaks, and with their document. A word's features are
    itself and its first 4, 5 and 6 bytes, so that inflected forms share weight; where the
    word is no longer than that it is itself again, so every word has as many features."""
    w = words(chunk, ALNUM, lower=True)
    feature = np.zeros((len(w.start), 1 + len(STEMS)), np.int64)
    feature[:, 0] = 1 + (w.hashes() >> np.uint64(64 - BITS)).astype(np.int64) % ((1 << BITS) - 1)
    size, h, j = w.end - w.start, np.zeros(len(w.start), np.uint64), 0
    for i, k in enumerate(STEMS, 1):
        for j in range(j, k):
            h = h * np.uint64(0x100000001B3) + w.buf[np.minimum(w.start + j, len(w.buf) - 1)]
        j = k
        feature[:, i] = np.where(size > k, 1 + (mix64(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64) % ((1 << BITS) - 1), feature[:, 0])
    mark = np.cumsum(_END[chunk.buf], dtype=np.int64)[w.start] if len(w.start) else np.zeros(0, np.int64)
    new = np.ones(len(w.start), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (w.doc[1:] != w.doc[:-1])
    return w, feature, np.flatnonzero(new)


@dataclass
class Model:
    weight: np.ndarray  # of each hashed word, 2**BITS of them
    bias: float
    leak: float


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _clean(z: np.ndarray) -> np.ndarray:
    """Log of a sentence's probability to be clean, by the sum of its words' weights; 0 where
    that isn't above 0."""
    p = _sigmoid(BIAS + np.maximum(z, 0))
    return np.log1p(-np.minimum(p, 1 - 1e-12)) - np.log1p(-_sigmoid(BIAS))


def evidence(docs_with: np.ndarray, toxic: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Features that get weights, and the weights they start from.

    Noise in a rare word's labels looks like evidence, and where a sentence's odds have a
    floor, evidence for clean is of no use: other words get no weight."""
    spread = np.sqrt(docs_with * base * (1 - base))
    used = np.flatnonzero((docs_with >= MIN_DOCS) & (toxic - base * docs_with >= spread))
    toxic, seen, spread = toxic[used], docs_with[used], spread[used]
    # Start from the log odds of words whose documents' labels differ from the others' beyond
    # chance: with all weights 0 no sentence of a toxic document would stand out.
    odds = np.log((toxic + PRIOR) / (seen - toxic + PRIOR)) - np.log(base / (1 - base))
    odds[toxic - base * seen < SIGMAS * spread] = 0
    return used, -BIAS * np.minimum(odds / 4, 1) / (1 + len(STEMS))


#: A feature of a sentence: its number, the sentence's in the document, and how often it occurs.
HELD = np.dtype([("f", "<i4"), ("s", "<i4"), ("c", "<u2")])


def fit(held: np.ndarray, size: np.ndarray, y: np.ndarray, w: np.ndarray, l1: float = 0.1, rate: float = 0.2, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and leak, from weights ``w``. ``held``: the features of all documents in turn,
    in the order of sentences, which are numbered without a gap; ``size``: how many each has."""
    n, base = len(y), float(np.clip(y.mean(), 1e-3, 0.999))
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    new = np.ones(len(held), bool)
    new[1:] = (held["s"][1:] != held["s"][:-1]) | (doc[1:] != doc[:-1])
    starts, sent = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - np.int32(1)
    sent_doc = doc[starts]
    flat, times = held["f"].astype(np.intp), held["c"].astype(np.float32)
    del doc, new, held
    lk = np.log(base / (1 - base)) - 0.5
    # A document's part in a gradient is up to 1 / n. Sums that start far below make steps
    # without bound, and the L1 step then clears weights that already separate the labels.
    gw, gl = np.full(len(w), 1.0 / n**2), 1e-12
    for _ in range(steps):
        z = np.add.reduceat(w[flat] * times, starts)
        leak = _sigmoid(lk)
        log_q = np.bincount(sent_doc, _clean(z), n) + np.log1p(-leak)
        q = np.exp(log_q)
        # d loss / d z of a sentence: p for a clean document, -p q / (1 - q) for a toxic one,
        # p being the logistic function of its odds; none where z is under 0
        factor = np.where(y > 0, -q / np.maximum(1 - q, 1e-9), 1.0) / n
        dz = factor[sent_doc] * np.where(z < 0, 0, _sigmoid(BIAS + z))
        dw = np.bincount(flat, dz[sent] * times, len(w))
        gw += dw**2
        step = rate / np.sqrt(gw)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1 / n, 0)
        dl = (factor * leak).sum()
        gl += dl**2
        lk -= 0.1 * dl / np.sqrt(gl)
    return w, float(_sigmoid(lk))


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents and toxic documents with each feature, counted in tasks; in the last place
    those of the whole sample."""

    def run(batches):
        n = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(0)):
                w, feature, _ = _sentences(chunk)
                for i, (a, b) in enumerate(zip(w.wo[:-1], w.wo[1:], strict=True)):
                    held = np.append(np.unique(feature[a:b]), 1 << BITS)
                    n[0, held] += 1
                    n[1, held] += y[chunk.first + i] > 0
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[0, at]), pa.array(n[1, at])], ["slot", "n", "toxic"])

    got = sample.mapInArrow(run, "slot int, n long, toxic long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    out = np.zeros((2, (1 << BITS) + 1))
    out[:, got["slot"].to_numpy()] = got["n"].to_numpy(), got["toxic"].to_numpy()  # as many rows as features at most
    return out[0], out[1]


def train(docs: DataFrame, labels: DataFrame, keep, sample_docs: int = SAMPLE_DOCS, label: str = "toxic") -> Model:
    """Fits to at most ``sample_docs`` documents for which ``keep`` holds on ``labels``.

    Features are chosen by counts made in tasks; of the documents only those features reach
    the driver, so its memory doesn't depend on the lengths of other words' runs."""
    sample = labelled_sample(docs, labels, label, keep, sample_docs)
    docs_with, toxic = _counts(sample)
    n, n_toxic = docs_with[-1], toxic[-1]
    base = float(np.clip(n_toxic / n, 1e-3, 0.999)) if n else 0.05
    model = Model(np.zeros(1 << BITS, np.float32), BIAS, base)
    used, start = evidence(docs_with[:-1], toxic[:-1], base)
    if not n or n_toxic in (0, n) or not len(used):
        return model
    number = np.full(1 << BITS, -1, np.int32)
    number[used] = np.arange(len(used))

    def numbered(batches):
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                w, feature, first = _sentences(chunk)
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w.start))))
                rows = []
                for a, b in zip(w.wo[:-1], w.wo[1:], strict=True):
                    at = number[feature[a:b]]
                    both, count = np.unique(np.broadcast_to(of[a:b, None], at.shape)[at >= 0] * len(used) + at[at >= 0], return_counts=True)
                    row = np.empty(len(both), HELD)
                    row["f"], row["c"] = both % len(used), np.minimum(count, 65535)
                    row["s"] = np.unique(both // len(used), return_inverse=True)[1]
                    rows.append(row.tobytes())
                y = batch.column(1).slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([pa.array([crc32(r) for r in rows], pa.int64()), y, pa.array(rows, pa.binary())], ["h", "y", "held"])

    # sums don't depend on the order in which rows come
    got = sample.mapInArrow(numbered, "h long, y int, held binary").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    y = (got["y"].to_numpy() > 0).astype(np.float64)
    rows = [np.frombuffer(x.as_buffer(), HELD) for x in got["held"]]
    size, held = np.array([len(r) for r in rows]), np.concatenate(rows)
    del rows, got
    weight, model.leak = fit(held, size, y, start)
    model.weight[used] = weight
    return model


def scorer(model: Model, threshold: float = THRESHOLD):
    """score; explained, the part of it that the sentences account for (without the leak); and
    the sentences at or above ``threshold`` with their byte spans and scores."""

    @F.arrow_udf("struct<score double, explained double, sentences array<struct<start: long, end: long, score: double, text: string>>>")
    def score(text: pa.Array) -> pa.Array:
        parts = []
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))
        for chunk in chunks(text):
            w, feature, first = _sentences(chunk)
            n = len(chunk)
            all_clean, bad = np.zeros(n), [[] for _ in range(n)]  # log of the probability
            if len(first):
                clean = _clean(np.add.reduceat(model.weight[feature].sum(axis=1, dtype=np.float64), first))
                p, doc = -np.expm1(clean), w.doc[first]
                all_clean = np.bincount(doc, clean, n)
                last = np.append(first[1:], len(w.start)) - 1
                for i in np.flatnonzero(p >= threshold).tolist():
                    d, a, b = int(doc[i]), int(w.start[first[i]]), int(w.end[last[i]])
                    bad[d].append({"start": a - int(chunk.off[d]), "end": b - int(chunk.off[d]), "score": float(p[i]), "text": chunk.buf[a:b].tobytes().decode(errors="replace")})
            score = 1 - (1 - model.leak) * np.exp(all_clean)
            parts.append(structs(score=np.clip(score, 0, 1), explained=np.clip(-np.expm1(all_clean), 0, 1), sentences=pa.array(bad, kind)))
        return pa.concat_arrays(parts)

    return score.asNondeterministic()


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Documents of which sentences account for less than ``threshold``; columns as they come.

    The leak tells how many labels no sentence explains, nothing of the document at hand. So it
    drops none, and where no word was learned all documents stay."""
    tmp = "_" * (1 + max(map(len, docs.columns), default=0))
    return docs.withColumn(tmp, scorer(model)(F.col("text"))).where(F.col(tmp)["explained"] < threshold).drop(tmp)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    out = docs.select("doc_id", scorer(model)(F.col("text")).alias("t"))
    return out.select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("t.score").alias("score"),
        (F.col("t.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.transform("t.sentences", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"))).alias("offending"),
    )
