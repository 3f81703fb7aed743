"""Which hashes are shared by several ids, found with one exchange of packed blocks.

Tasks emit (token, id) entries, with a place where places count, as packed arrays dealt over
buckets by token. What a task itself sees in several ids goes out for the first of them, and
the entries of the others go straight to the result by way of a bucket of their own. So a
token held by a third of all ids reaches its bucket only once from each block of about
``FLUSH`` entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import cut

FLUSH = 400_000
BUCKET_BYTES = 8 << 20
#: Groups that entries known to be shared are dealt to in a bucket: they needn't meet.
SALTS = 4096

#: A token's upper 40 bits (its bucket comes from the lower ones), whether its task met it
#: in several ids, and the id. With places: the whole token, and the place.
ENTRY = [("t", "<u4"), ("u", "u1"), ("f", "u1"), ("s", "<i8")]
PLACED = [("t", "<u8"), ("f", "u1"), ("s", "<i8"), ("n", "<i4")]


def _blocks(t: np.ndarray, s: np.ndarray, n: np.ndarray | None, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, bucket, packed entries): kind 1 is to be matched, kind 0 known to be shared."""
    at = np.zeros(len(t), np.int32) if n is None else n
    order = np.lexsort((at, s, t))
    t, s, at = t[order], s[order], at[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (at[1:] != at[:-1])
    t, s, at = t[new], s[new], at[new]
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    size = np.diff(np.append(starts, len(t)))
    first = s == np.repeat(s[starts], size)
    several = np.repeat(~np.logical_and.reduceat(first, starts), size)
    home = (t & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
    e = np.zeros(len(t), ENTRY if n is None else PLACED)
    e["f"], e["s"] = several, s
    if n is None:
        e["t"], e["u"] = t >> np.uint64(32), (t >> np.uint64(24)) & np.uint64(0xFF)
    else:
        e["t"], e["n"] = t, at
    for kind, part, bucket in ((1, e[first], home[first]), (0, e[~first], home[~first])):
        if not len(part):
            continue
        order = np.argsort(bucket, kind="stable")
        ids, at = np.unique(bucket[order], return_index=True)
        for b, rows in zip(ids.tolist(), np.split(order, at[1:]), strict=True):
            yield kind, b, part[rows].tobytes()


def shared(docs: DataFrame, entries: Callable, total: int, carry: bool = False) -> DataFrame:
    """Distinct (key, sid) of all tokens held by two ids or more; with ``carry`` every place n
    that an id has one of them at.

    ``entries`` maps a record batch of ``docs`` to arrays (token, sid, n), n None without
    ``carry``; ``total`` is about how many entries there will be, and sets the number of
    buckets. Two tokens rarely count as one, as 40 bits and the bucket tell them apart; with
    ``carry`` all 64 bits do, and are the key."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind_ = np.dtype(PLACED if carry else ENTRY)
    buckets = min(max(least * 2, -(-total * kind_.itemsize // BUCKET_BYTES)), 1 << 23)

    def emit(batches):
        held, size = [], 0

        def flush():
            kinds, ids, blobs, salts = [], [], [], []
            t, s, n = zip(*held, strict=True)
            for kind, b, blob in _blocks(np.concatenate(t), np.concatenate(s), np.concatenate(n) if carry else None, buckets):
                kinds.append(kind)
                ids.append(b)
                blobs.append(blob)
                # what is known to be shared needn't meet others of its token
                salts.append(0 if kind else 1 + crc32(blob) % SALTS)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(salts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "salt", "kind", "blob"])

        for batch in batches:
            for t, s, n in entries(batch):
                held.append((t, s, n))
                size += len(t)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def match(group: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(x.as_py() for x in group["blob"]), kind_)
        key = e["t"].astype(np.int64) if carry else (e["t"].astype(np.int64) << 8) | e["u"] | (np.int64(group["bucket"][0].as_py()) << 40)
        if group["kind"][0].as_py():
            order = np.lexsort((e["s"], key))
            e, key = e[order], key[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(e)))
            many = (e["s"][starts] != e["s"][starts + size - 1]) | (np.maximum.reduceat(e["f"], starts) > 0)
            e, key = e[np.repeat(many, size)], key[np.repeat(many, size)]
        return pa.table({"key": key, "sid": e["s"].astype(np.int64)} | ({"n": e["n"].astype(np.int32)} if carry else {}))

    packed = docs.mapInArrow(emit, "bucket int, salt int, kind int, blob binary")
    found = packed.groupBy("bucket", "salt").applyInArrow(match, "key long, sid long" + ", n int" * carry)
    return cut(found.distinct())  # an id may come from several blocks
