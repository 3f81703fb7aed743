"""Fill-in-the-middle training texts by displacement scatter, and their exact restoration.

A text is cut into units (a run of ASCII letters, or one other code point); two cuts, drawn
by a hash of the document's id, make a prefix, a middle and a suffix. ``psm`` puts the parts
out as prefix, suffix, middle, ``spm`` as suffix, prefix, middle, each behind its mark; the
rest, and texts that are empty or hold a mark, stay plain.

All texts of a batch are rearranged together. One scan finds the units and so the bytes at
the cuts. The shift of each part (where it stands in the output, less where it stood) is
noted in a difference array at the part's first byte, less the shift before it; the running
sum is every byte's displacement, and one scatter writes the batch's output. Restoring finds
the marks of an output, makes the same kind of difference array over it, and gathers.

Defined results: a null text is the empty text, which stays plain with no units; a null id
counts as the empty text behind ``1:``; repeated rows are cut alike; an empty table gives no
rows; very long texts are cut whole; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table
from quillspark.llm.textkit import Chunk, chunks, structs

#: Fixed by the format of the output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FIM_PERCENT = 90
SPM_PERCENT = 20
SEED = 1

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = len(PREFIX)


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers below 2 ** 32 from a hash of the id."""
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(hex_, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _marks(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks begin in ``buf``, and their middle letters; a mark never overlaps another."""
    at = np.flatnonzero(buf[:-2] == 0x3C) if len(buf) > 2 else np.zeros(0, np.int64)
    at = at[(buf[at + 2] == 0x3E) & np.isin(buf[at + 1], [PREFIX[1], SUFFIX[1], MIDDLE[1]])]
    return at, buf[at + 1]


def _units(chunk: Chunk) -> np.ndarray:
    """The byte at which each unit of the chunk begins."""
    buf, off = chunk.buf, chunk.off
    letter = _LETTER[buf]
    first = (buf & 0xC0) != 0x80
    first[1:] &= ~(letter[1:] & letter[:-1])
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] = True
    return np.flatnonzero(first)


def _shifts(size: int, at: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Every byte's displacement: parts that begin at ``at`` (ordered, each with bytes) move by ``shift``."""
    steps = np.zeros(size, np.int64)
    steps[at] = np.diff(shift, prepend=0)
    return np.cumsum(steps)


def _parts(begin: np.ndarray, end: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts in the order of their first bytes, without empty ones, and their shifts."""
    begin, end, to = begin.ravel(), end.ravel(), to.ravel()
    held = begin < end
    order = np.argsort(begin[held], kind="stable")
    return begin[held][order], (to - begin)[held][order]


def scatter(chunk: Chunk, h: np.ndarray, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT):
    """Units, form, byte cuts and the outputs (bytes and offsets) of a chunk's texts."""
    buf, off = chunk.buf, chunk.off
    first = _units(chunk)
    base = np.searchsorted(first, off)
    n = np.diff(base)
    cut = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # the byte at which a unit begins; beyond the last unit, the text's end
    place = np.append(first, len(buf))[np.minimum(base[:-1, None] + cut, len(first))]
    place = np.where(cut == n[:, None], off[1:, None], place)
    marks, _ = _marks(buf)
    whole = np.searchsorted(off, marks, side="right") - 1
    inside = marks + _MARK <= off[whole + 1]  # a mark over the end of a text is none
    marked = np.bincount(whole[inside], minlength=len(n)) > 0
    plain = (n == 0) | marked | (h[:, 2] % 100 >= fim_percent)
    spm = ~plain & (h[:, 3] % 100 < spm_percent)
    size = np.diff(off)
    out_off = np.concatenate([[0], np.cumsum(size + 3 * _MARK * ~plain)])
    a, b, e = off[:-1], place, off[1:]
    pre, mid, suf = b[:, 0] - a, b[:, 1] - b[:, 0], e - b[:, 1]
    o = out_off[:-1]
    to_pre = np.where(plain, o, np.where(spm, o + 2 * _MARK + suf, o + _MARK))
    to_suf = np.where(plain, o + pre + mid, np.where(spm, o + _MARK, o + 2 * _MARK + pre))
    to_mid = np.where(plain, o + pre, o + 3 * _MARK + pre + suf)
    at, shift = _parts(np.stack([a, b[:, 0], b[:, 1]], 1), np.stack([b[:, 0], b[:, 1], e], 1), np.stack([to_pre, to_mid, to_suf], 1))
    out = np.empty(int(out_off[-1]), np.uint8)
    out[np.arange(len(buf)) + _shifts(len(buf), at, shift)] = buf
    for mark, to in ((PREFIX, to_pre), (SUFFIX, to_suf), (MIDDLE, to_mid)):
        for i, byte in enumerate(mark):
            out[to[~plain] - _MARK + i] = byte
    return n, np.where(plain, 0, np.where(spm, 2, 1)), place, out, out_off


def gather(chunk: Chunk, fim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts (bytes and offsets) of outputs, of which ``fim`` tells those that aren't plain."""
    buf, off = chunk.buf, chunk.off
    at, letter = _marks(buf)
    doc = np.searchsorted(off, at, side="right") - 1
    held = fim[doc] & (at + _MARK <= off[doc + 1])
    at, letter, doc = at[held], letter[held], doc[held]
    if not np.array_equal(np.bincount(doc, minlength=len(fim)), 3 * fim):
        raise ValueError("an output that isn't plain has three marks")
    begin = at + _MARK
    end = np.where(np.diff(doc, append=-1) == 0, np.append(at[1:], 0), off[doc + 1])
    size = np.diff(off) - 3 * _MARK * fim
    text_off = np.concatenate([[0], np.cumsum(size)])
    # parts by document, in the order of the text
    order = np.lexsort([np.select([letter == PREFIX[1], letter == MIDDLE[1]], [0, 1], 2), doc])
    begin, end = begin[order], end[order]
    plain = np.flatnonzero(~fim)
    begin, end = np.concatenate([begin, off[plain]]), np.concatenate([end, off[plain + 1]])
    order = np.argsort(np.concatenate([doc, plain]), kind="stable")
    begin, end = begin[order], end[order]
    length = end - begin
    to = np.cumsum(length) - length
    held = length > 0
    source = np.arange(int(text_off[-1])) + _shifts(int(text_off[-1]), to[held], (begin - to)[held])
    return buf[source], text_off


def _strings(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    data = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint8)
    off, base = [np.zeros(1, np.int64)], 0
    for _, o in parts:
        off.append(o[1:] + base)
        base += int(o[-1])
    off = np.concatenate(off)
    if base < 1 << 31:
        return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes()))


FORMS = ("plain", "psm", "spm")


def transform(fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT):
    """An expression of (text, draws): n, form, prefix_chars, middle_chars, output."""

    @F.arrow_udf("struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>")
    def run(text: pa.Array, drawn: pa.Array) -> pa.Array:
        h = drawn.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        cols, outs = [], []
        for chunk in chunks(text):
            n, form, place, out, off = scatter(chunk, h[chunk.first : chunk.first + len(chunk)], fim_percent, spm_percent)
            point = np.concatenate([[0], np.cumsum((chunk.buf & 0xC0) != 0x80, dtype=np.int64)])
            cols.append((n, form, point[place[:, 0]] - point[chunk.off[:-1]], point[place[:, 1]] - point[place[:, 0]]))
            outs.append((out, off))
        n, form, pre, mid = [np.concatenate(c) for c in zip(*cols, strict=True)] if cols else [np.zeros(0, np.int64)] * 4
        return structs(
            n=pa.array(n, pa.int64()),
            form=pa.DictionaryArray.from_arrays(pa.array(form, pa.int8()), pa.array(FORMS)).cast(pa.string()),
            prefix_chars=pa.array(pre, pa.int64(), mask=form == 0),
            middle_chars=pa.array(mid, pa.int64(), mask=form == 0),
            output=_strings(outs),
        )

    return run


def restore():
    """An expression of (output, form): the text, rebuilt."""

    @F.arrow_udf("string")
    def run(output: pa.Array, form: pa.Array) -> pa.Array:
        fim = form.to_numpy(zero_copy_only=False) != "plain"
        return _strings([gather(chunk, fim[chunk.first : chunk.first + len(chunk)]) for chunk in chunks(output)])

    return run


def fill_in_middle(docs: DataFrame, name: str = "fim", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """``docs`` and a struct column ``name``: n, form, prefix_chars, middle_chars, output."""
    return docs.withColumn(name, transform(fim_percent, spm_percent)(F.col("text"), draws(F.col("doc_id"), seed)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(restore()(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )
