"""Secrets in texts: key patterns, and high entropy in sliding windows of candidate strings.

Base spans come from three patterns (an assignment to a name like ``password``, an access
key id, a long run of hex digits). The method adds spans: for each character class, runs of
its characters are candidate strings; a window slides over each, its Shannon entropy known
from the counts of its characters, of which one leaves and one enters at each step. All
candidates of a batch move in step, long ones in pieces of ``PIECE`` windows. Windows at or
above the class's threshold that hold the kinds of characters it asks for are joined to
spans. An allow-list then suppresses those that stand in known harmless strings (ids in the
form of a UUID, links, digests named as such, embedded images, alphabets, placeholders), and
a span inside another adds nothing. Base spans are never suppressed.

Entropy is compared in whole numbers (``c * log2(c)`` in units of 2 ** -20), so the same
windows pass on every machine.

Defined results: a null or empty text has no spans; repeated rows are judged alike, each by
itself; rows with a null id are kept; an empty table gives no rows; very long texts are
scanned whole, in bounded memory beside the text; equal starts are ordered by kind, as
listed; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table
from quillspark.llm.textkit import LOWER, NOT_SPACE, Chunk, chunks, words

MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Windows of one candidate that are walked one after the other.
PIECE = 128
UNIT = 1 << 20

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ASSIGN_STARTS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")


def _bytes(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8))


_DIGITS, _LOWERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPERS = _LOWERS.upper()
_HEX = _bytes("0123456789abcdef")
_KINDS = {"digit": _bytes(_DIGITS), "lower": _bytes(_LOWERS), "upper": _bytes(_UPPERS), "letter": _bytes(_LOWERS + _UPPERS)}


@dataclass(frozen=True)
class CharClass:
    """Runs of ``chars`` are candidates; a window of ``window`` of them counts from
    ``bits`` of entropy a character, if it holds each of the kinds in ``needs``, as often."""

    name: str
    chars: str
    window: int
    bits: float
    needs: tuple[tuple[str, int], ...]

    @property
    def most(self) -> int:
        """The largest sum of c * log2(c), in units, of a window that counts."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * UNIT)


CLASSES = (
    CharClass("hex_entropy", _DIGITS + "abcdefABCDEF", 20, 3.0, (("digit", 3), ("letter", 3))),
    CharClass("lower_entropy", _DIGITS + _LOWERS, 24, 3.7, (("digit", 4), ("lower", 4))),
    CharClass("upper_entropy", _DIGITS + _UPPERS, 24, 3.7, (("digit", 4), ("upper", 4))),
    CharClass("base64_entropy", _DIGITS + _LOWERS + _UPPERS + "+/_-", 20, 3.6, (("digit", 1), ("lower", 2), ("upper", 2))),
)
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, *(c.name for c in CLASSES))

#: Harmless strings, met in the run of non-space characters around a span.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"[A-Za-z][A-Za-z0-9+.-]*://",
    r"(?i:\bdata:[a-z]+/[a-z0-9.+-]+;base64,)",
    r"(?i:\b(?:sha(?:1|224|256|384|512)|md5|integrity|checksum|digest|etag)[-:=])",
    r"(?i:abcdefghijklmnop|0123456789abcdef|example|placeholder|changeme|xxxxxx)",
    r"[\w.+-]+@[\w-]+\.[\w.]+",
)
#: Bytes on both sides of a span in which an allowed string counts.
NEAR = 64
SPANS = "array<struct<kind: string, start: long, end: long>>"


def entropy_windows(buf: np.ndarray, start: np.ndarray, end: np.ndarray, kind: CharClass) -> np.ndarray:
    """Starts of the windows inside the runs [start, end) whose entropy reaches the class's."""
    w = kind.window
    long = end - start >= w
    start, n = start[long], (end - start - w + 1)[long]
    if not len(start):
        return start
    each = -(-n // PIECE)
    piece = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    at = np.repeat(start, each) + piece * PIECE
    size = np.minimum(np.repeat(n, each) - piece * PIECE, PIECE)
    order = np.argsort(-size, kind="stable")  # those still walked at any step come first
    at, size = at[order], size[order]
    code = np.zeros(256, np.int64)
    code[np.frombuffer(kind.chars.encode(), np.uint8)] = np.arange(len(kind.chars))
    c = np.arange(w + 1)
    value = np.rint(c * np.log2(np.maximum(c, 1)) * UNIT).astype(np.int64)
    gain = np.diff(value, append=value[-1])
    counts, total, row = np.zeros((len(at), len(kind.chars)), np.int16), np.zeros(len(at), np.int64), np.arange(len(at))

    def enter(rows, pos):
        k = code[buf[pos]]
        total[rows] += gain[counts[rows, k]]
        counts[rows, k] += 1

    def leave(rows, pos):
        k = code[buf[pos]]
        counts[rows, k] -= 1
        total[rows] -= gain[counts[rows, k]]

    for j in range(w):
        enter(row, at + j)
    found = [at[total <= kind.most]]
    for t in range(1, int(size[0])):
        rows = row[: np.searchsorted(-size, -t)]
        leave(rows, at[rows] + t - 1)
        enter(rows, at[rows] + t + w - 1)
        found.append(at[rows][total[rows] <= kind.most] + t)
    return np.sort(np.concatenate(found))


def _entropy_spans(chunk: Chunk, kind: CharClass) -> list[tuple[int, int]]:
    runs = words(chunk, _bytes(kind.chars))
    at = entropy_windows(chunk.buf, runs.start, runs.end, kind)
    for name, least in kind.needs:
        before = np.concatenate([[0], np.cumsum(_KINDS[name][chunk.buf], dtype=np.int64)])
        at = at[before[at + kind.window] - before[at] >= least]
    if not len(at):
        return []
    # windows that overlap within a run are one span
    run = np.searchsorted(runs.start, at, side="right")
    new = np.flatnonzero(np.concatenate([[True], (np.diff(run) > 0) | (np.diff(at) > kind.window)]))
    return list(zip(at[new].tolist(), (np.append(at[new[1:] - 1], at[-1]) + kind.window).tolist(), strict=True))


def _starts(text: bytes, keys: tuple[bytes, ...]) -> list[int]:
    out = []
    for key in keys:
        i = text.find(key)
        while i >= 0:
            out.append(i)
            i = text.find(key, i + 1)
    return sorted(out)


def _matches(pattern: re.Pattern, text: bytes, at: list[int], ends: np.ndarray):
    """Leftmost matches, none over another, of a pattern that begins at one of ``at``."""
    free = 0
    for i in at:
        if i >= free and (m := pattern.match(text, i, int(ends[np.searchsorted(ends, i, side="right")]))):
            free = m.end()
            yield m


def _base_spans(chunk: Chunk) -> list[tuple[int, int, int]]:
    text, ends = chunk.buf.tobytes(), chunk.off[1:]
    out = [(m.start(), 0, m.end()) for m in _matches(_ASSIGN, text, _starts(LOWER[chunk.buf].tobytes(), _ASSIGN_STARTS), ends) if len(m[2]) >= MIN_ASSIGNED]
    out += [(m.start(), 1, m.end()) for m in _matches(_ACCESS, text, _starts(text, (b"AKIA",)), ends) if len(m[0]) >= MIN_ACCESS]
    runs = words(chunk, _HEX)
    long = runs.end - runs.start >= MIN_HEX
    out += [(a, 2, b) for a, b in zip(runs.start[long].tolist(), runs.end[long].tolist(), strict=True)]
    return sorted(out)


def _chunk_spans(chunk: Chunk, classes, allowed: re.Pattern | None) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of a chunk's spans, in bytes, ordered."""
    base = _base_spans(chunk)
    added = [(a, len(BASE_KINDS) + k, b) for k, kind in enumerate(classes) for a, b in _entropy_spans(chunk, kind)]
    if not added:
        return base
    around = words(chunk, NOT_SPACE)
    held, reach = [], -1
    # a span inside another starts no earlier and ends no later; of equal ones the first kind stays
    for a, k, b in sorted([*base, *added], key=lambda x: (x[0], -x[2], x[1])):
        inside, reach = b <= reach, max(reach, b)
        if k >= len(BASE_KINDS) and not inside:
            i = np.searchsorted(around.start, a, side="right") - 1
            if not (allowed and _is_allowed(chunk.buf[around.start[i] : around.end[i]].tobytes(), a - int(around.start[i]), b - int(around.start[i]), allowed)):
                held.append((a, k, b))
    return sorted([*base, *held])


def _is_allowed(run: bytes, a: int, b: int, allowed: re.Pattern) -> bool:
    """Whether the run of non-space bytes holds an allowed string within ``NEAR`` bytes of its span [a, b)."""
    return allowed.search(run, max(0, a - NEAR), min(len(run), b + NEAR)) is not None


def secret_spans(classes=CLASSES, allowed=ALLOWED):
    """An expression of a text column: its spans (kind, start, end) by start, then kind, in
    code points, ends exclusive."""
    names = np.array([*BASE_KINDS, *(c.name for c in classes)], object)
    harmless = re.compile("|".join(allowed).encode()) if allowed else None

    @F.arrow_udf(SPANS)
    def scan(text: pa.Array) -> pa.Array:
        off, kinds, starts, ends = [np.zeros(1, np.int64)], [], [], []
        for chunk in chunks(text):
            got = np.array(_chunk_spans(chunk, classes, harmless), np.int64).reshape(-1, 3)
            doc = np.searchsorted(chunk.off, got[:, 0], side="right") - 1
            off.append(off[-1][-1] + np.searchsorted(doc, np.arange(1, len(chunk) + 1)))
            point = np.concatenate([[0], np.cumsum((chunk.buf & 0xC0) != 0x80, dtype=np.int64)]) if len(got) else np.zeros(1, np.int64)
            first = point[chunk.off[doc]]
            kinds.append(names[got[:, 1]])
            starts.append(point[got[:, 0]] - first)
            ends.append(point[got[:, 2]] - first)
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        rows = pa.StructArray.from_arrays([flat(kinds, pa.string()), flat(starts, pa.int64()), flat(ends, pa.int64())], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(off).astype(np.int32)), rows)

    return scan


def find_secrets(docs: DataFrame, name: str = "secrets", classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """``docs`` and an array column ``name`` of the spans of each text."""
    return docs.withColumn(name, secret_spans(classes, allowed)(F.col("text")))


def redact(docs: DataFrame, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """``docs`` with each secret replaced by its kind in brackets; overlapping ones by the first's."""
    tmp = "_" * (1 + max(map(len, docs.columns), default=0))
    spans, text = F.col(tmp), F.col("text")
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["to"], F.concat(acc["out"], text.substr((acc["to"] + 1).cast("int"), (s["start"] - acc["to"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["to"], s["end"]).alias("to"),
    )
    clean = F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], text.substr((acc["to"] + 1).cast("int"), F.length(text))))
    out = find_secrets(docs, tmp, classes, allowed).withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return docs.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )
