"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1-, 2- and 3-grams (ASCII lower-cased) are hashed to ``2 ** BITS`` features; a
text's value for one is its share of the text's n-grams times its inverse document
frequency. Document frequencies are counted over all documents open to training. Weights
are trained with follow-the-regularised-leader (per-coordinate rates, elastic-net
penalty, so most weights are exactly 0), and the logits are divided by a temperature
fitted on documents kept from training.

The fit takes at most ``SAMPLE_DOCS`` labelled documents (a documented bound, drawn by a
hash of doc_id); counting and prediction cover every whole text.

Defined results: ``und`` with score 0 for a null text, one without a letter, or if no
language was learned; a null language teaches nothing; with one learned language that one
is predicted with score 1; repeated rows are predicted alike and teach once for each id
(the least text); very long texts are taken whole; an empty table teaches nothing and gives
no rows; extra columns are untouched, whatever their names.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import remainder, table
from quillspark.llm.textkit import LOWER, Chunk, chunks, structs

SAMPLE_DOCS = 4000
BITS = 15
ORDERS = (1, 2, 3)
SCALE = 20.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
EPOCHS = 2

UNKNOWN = "und"


def _grams(chunk: Chunk) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature of each n-gram by order, code-point offsets of documents, and code points.

    An n-gram that reaches over the end of its document gets the feature 2**BITS."""
    buf = LOWER[chunk.buf]
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)])
    off = heads[chunk.off]
    out = []
    for n in ORDERS:
        h = cp * np.uint32(0x9E3779B1)
        for j in range(1, n):
            h = h[:-1] * np.uint32(0x85EBCA6B) + cp[j:] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D) + np.uint32(2 * n)
        g = np.full(len(cp), 1 << BITS, np.int32)
        g[: len(h)] = h >> np.uint32(32 - BITS)
        for back in range(1, n):
            ends = off[1:] - back
            g[ends[(ends >= 0) & (ends < len(g))]] = 1 << BITS
        out.append(g)
    return out, off, cp


def _per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[off[1:]] - total[off[:-1]]


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and how many documents there are."""

    def count(batches):
        df, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                grams, off, _ = _grams(chunk)
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    seen = np.zeros(len(df), bool)
                    for g in grams:
                        seen[g[a:b]] = True
                    df += seen
                n += len(chunk)
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["feature", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]  # 2**BITS + 1 rows at most
    return out[:-1], int(out[-1])


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # one row for each language, idf included; the last column is 0
    bias: np.ndarray
    temperature: float


def _softmax(z):
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], idf: np.ndarray, epochs: int = EPOCHS) -> Model:
    """``docs``: features and their shares of each document; ``y``: index into ``langs``."""
    k, d = len(langs), 1 << BITS
    z, n = np.zeros((k, d + 1)), np.zeros((k, d + 1))  # the last column is the bias

    def weights(at):
        zz, nn = z[:, at], n[:, at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    kept = np.arange(len(docs)) % 5 == 4 if len(docs) >= 10 else np.zeros(len(docs), bool)  # for the temperature
    for _ in range(epochs):
        for i in np.flatnonzero(~kept).tolist():
            at, share = docs[i]
            at, x = np.append(at, d), np.append(share * idf[at] * SCALE, 1.0)
            w = weights(at)
            err = _softmax(w @ x)
            err[y[i]] -= 1
            g = np.outer(err, x)
            sigma = (np.sqrt(n[:, at] + g**2) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n[:, at] += g**2
    w = weights(np.arange(d + 1))
    held = [(np.append(s * idf[a] * SCALE, 1.0) @ w[:, np.append(a, d)].T, y[i]) for i, (a, s) in enumerate(docs) if kept[i]]
    temperature = 1.0
    if held:
        logits, truth = np.stack([h[0] for h in held]), np.array([h[1] for h in held])
        grid = np.geomspace(0.05, 5, 60)
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    table_ = np.zeros((k, d + 1), np.float32)
    table_[:, :d] = w[:, :d] * idf * SCALE
    return Model(langs, table_, w[:, d], temperature)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """``docs``: (doc_id, text, lang), all of them open to training."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # rows that repeat an id count once, so the bound holds for rows too
    ids = known.select("doc_id").distinct().select("doc_id", F.xxhash64("doc_id", F.lit(11)).alias("h")).orderBy("h", "doc_id").limit(sample_docs)

    def described(batches):
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                grams, off, _ = _grams(chunk)
                at, share = [], []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    f, c = np.unique(np.concatenate([g[a:b] for g in grams]), return_counts=True)
                    f, c = f[f < 1 << BITS], c[f < 1 << BITS]
                    at.append(f.astype(np.int32).tobytes())
                    share.append((c / max(c.sum(), 1)).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(share, pa.binary()), batch.column(1).slice(chunk.first, len(chunk)), batch.column(2).slice(chunk.first, len(chunk))], ["at", "share", "lang", "h"])

    rows = known.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "h").agg(F.min(F.struct("text", "lang")).alias("r"))
    sample = rows.select("r.text", "r.lang", "h")
    got = sample.mapInArrow(described, "at binary, share binary, lang string, h long").toArrow().to_pylist()
    got.sort(key=lambda r: (r["h"], r["at"], r["lang"]))  # the order of training is fixed
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return Model([], np.zeros((0, (1 << BITS) + 1), np.float32), np.zeros(0), 1.0)
    df, n = document_frequency(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    pairs = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["share"], np.float32).astype(np.float64)) for r in got]
    return fit(pairs, np.array([langs.index(r["lang"]) for r in got]), langs, idf)


def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)], bool)


def predictor(model: Model):
    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        letter = getattr(sys, "_quillspark_letters", None)
        if letter is None:
            letter = sys._quillspark_letters = _letters()
        parts = []
        for chunk in chunks(text):
            grams, off, cp = _grams(chunk)
            has_letter = _per_doc(letter[cp], off) > 0
            if not model.langs:
                parts.append(structs(lang=pa.array([UNKNOWN] * len(chunk)), score=np.zeros(len(chunk))))
                continue
            many = np.maximum(sum(np.maximum(np.diff(off) - n + 1, 0) for n in ORDERS), 1)
            z = np.stack([_per_doc(sum(w[g] for g in grams), off) / many + b for w, b in zip(model.weight, model.bias, strict=True)], axis=1)
            p = _softmax(z / model.temperature)
            best = p.argmax(axis=1)
            lang = np.where(has_letter, np.array(model.langs, object)[best], UNKNOWN)
            parts.append(structs(lang=pa.array(lang, pa.string()), score=np.where(has_letter, p[np.arange(len(p)), best], 0.0)))
        return pa.concat_arrays(parts)

    return predict.asNondeterministic()


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(remainder(F.col("doc_id"), 3) != 1))
    out = docs.select("doc_id", predictor(model)(F.col("text")).alias("p"))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
