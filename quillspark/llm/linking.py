"""Exact similarity links and classes from candidate groups, compared in prefix trees.

Input are groups of ids that may be similar (``members``: key, sid, n; n is the size of the
id's set) and the ids' sets of hashes (``sets``: sid, toks). Wanted are, for all pairs that share enough keys and whose
Jaccard similarity is high enough, the number of links of each id and the connected
components.

Groups of copies share many keys, so comparing key by key would move and compare them again
for each. Groups of equal members are one group that weighs as many keys. Every group is
named by its member of least hash, and groups of one name are one family: groups with nearly
the same members nearly always get the same name. A pair that meets in several families
counts in the first of them only. Families of any size are treated in the same way: they are
dealt into blocks of about ``BLOCK_IDS`` ids or ``BLOCK_HASHES`` hashes, and a task has two
blocks. So no task holds more than two blocks of a family, and no pair is written anywhere.

First only the groups' names are moved: a member stays in its family if it shares enough keys
with another one of a size that fits. Then the sets of those that stay are moved, and the two
blocks are compared by a prefix tree: the sets of one, ordered by how common their hashes are
in the blocks (the commonest first, so that similar sets share long paths), form a tree whose
edges hold runs of hashes. All sets of the other block walk it together, level by level: the
overlap along a shared path is counted once for all sets below it, and a subtree is left as
soon as its sizes don't fit, or what remains on either side can't reach the overlap that its
smallest set needs. What a task gives out is one row for each linked id: how many links it
has there, and the smallest id it is tied to there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, drop_cut

BLOCK_IDS, BLOCK_HASHES = 256, 1 << 20
#: Cells of the table (probes x hashes) that the tree's walkers are looked up in, and hashes
#: that a step of the walk looks up at once.
TABLE, STEP = 1 << 23, 1 << 21
#: A family's rows are dealt over so many keys where its number of blocks is looked up.
SALTS = 32


class Trie:
    """A prefix tree of sequences of numbers, each sorted; edges hold runs of numbers."""

    def __init__(self, seqs: list[np.ndarray]):
        order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
        parent, begin, end, rep = [-1], [0], [0], [0]
        self.items: list[list[int]] = [[]]
        stack, before = [0], np.zeros(0, np.int64)
        for i in order:
            x = seqs[i]
            m = min(len(x), len(before))
            differs = np.flatnonzero(x[:m] != before[:m])
            shared = int(differs[0]) if len(differs) else m
            last = -1
            while end[stack[-1]] > shared:
                last = stack.pop()
            if end[stack[-1]] < shared:  # the edge is divided where the sequences part
                parent.append(stack[-1]), begin.append(end[stack[-1]]), end.append(shared), rep.append(rep[last]), self.items.append([])
                stack.append(len(parent) - 1)
                parent[last], begin[last] = stack[-1], shared
            if len(x) > shared:
                parent.append(stack[-1]), begin.append(shared), end.append(len(x)), rep.append(i), self.items.append([])
                stack.append(len(parent) - 1)
            self.items[stack[-1]].append(i)
            before = x
        n = len(parent)
        least, most = [1 << 60] * n, [0] * n
        for v in sorted(range(n), key=begin.__getitem__, reverse=True):  # children before parents
            if self.items[v]:
                least[v], most[v] = min(least[v], end[v]), max(most[v], end[v])
            if v:
                p = parent[v]
                least[p], most[p] = min(least[p], least[v]), max(most[p], most[v])
        self.end, self.least, self.most = np.array(end), np.array(least), np.array(most)
        self.held = np.array([len(x) for x in self.items])
        by_parent = np.argsort(np.array(parent), kind="stable")[1:]
        self.children, self.n_children = by_parent, np.bincount(np.array(parent)[by_parent], minlength=n)
        self.first = np.cumsum(self.n_children) - self.n_children
        runs = [seqs[rep[v]][begin[v] : end[v]] for v in range(n)]
        self.size = np.array([len(r) for r in runs])
        self.at = np.cumsum(self.size) - self.size
        self.run = np.concatenate(runs) if n > 1 else np.zeros(0, np.int64)
        self.last = np.array([r[-1] if len(r) else -1 for r in runs])

    def below(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each child of each of the nodes: the place of its parent in ``node``, and itself."""
        return _ranges(self.first[node], self.n_children[node], self.children)


def _ranges(first: np.ndarray, size: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of = np.repeat(np.arange(len(size)), size)
    return of, values[np.arange(len(of)) + np.repeat(first - (np.cumsum(size) - size), size)]


def _walk(tree: Trie, probes: list[np.ndarray], width: int, num: int, den: int, out: np.ndarray) -> None:
    """Marks in ``out`` (probes x sets of the tree) the pairs that are similar enough."""
    n = np.array([len(x) for x in probes])
    held = np.zeros((len(probes), width + 1), np.int32)
    held[np.repeat(np.arange(len(probes)), n), np.concatenate(probes) + 1] = 1
    rank = np.cumsum(held, axis=1, dtype=np.int32).ravel()  # how many of a probe's numbers are below each
    held = held.ravel()
    work = [(np.arange(len(probes)), np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64))]
    while work:
        p, node, hits = work.pop()
        of, child = tree.below(node)
        p, hits = p[of], hits[of]
        fits = (tree.most[child] * den >= n[p] * num) & (n[p] * den >= tree.least[child] * num)
        p, hits, child = p[fits], hits[fits], child[fits]
        while len(p):
            at = max(1, int(np.searchsorted(np.cumsum(tree.size[child]), STEP, "right")))
            q, v, h = p[:at], child[:at], hits[:at]
            p, child, hits = p[at:], child[at:], hits[at:]
            of, run = _ranges(tree.at[v], tree.size[v], tree.run)
            h = h + np.add.reduceat(held[q[of] * (width + 1) + run + 1], np.cumsum(tree.size[v]) - tree.size[v])
            rest = np.minimum(n[q] - rank[q * (width + 1) + tree.last[v] + 1], tree.most[v] - tree.end[v])
            # den * o >= num * (x + y - o) is the overlap needed of the smallest set below
            ok = (h + rest) * (num + den) >= num * (n[q] + tree.least[v])
            q, v, h = q[ok], v[ok], h[ok]
            for i in np.flatnonzero((tree.held[v] > 0) & (h * (num + den) >= num * (n[q] + tree.end[v]))).tolist():
                out[q[i], tree.items[v[i]]] = True
            down = tree.n_children[v] > 0
            if down.any():
                work.append((q[down], v[down], h[down]))


def trie_join(probes: list[np.ndarray], items: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which pairs have den * intersection >= num * union: a mask of probes x items.

    All are non-empty arrays of distinct hashes. The tree is made of ``items``."""
    out = np.zeros((len(probes), len(items)), bool)
    if not len(probes) or not len(items):
        return out
    _, number, count = np.unique(np.concatenate([*probes, *items]), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")  # equally common ones by hash
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    number = place[number]
    cuts = np.cumsum([len(x) for x in (*probes, *items)])[:-1]
    seqs = [np.sort(x) for x in np.split(number, cuts)]
    tree, width = Trie(seqs[len(probes) :]), len(order)
    step = max(1, TABLE // (width + 1))
    for a in range(0, len(probes), step):
        _walk(tree, seqs[a : min(a + step, len(probes))], width, num, den, out[a : a + step])
    return out


def _overlaps(row: np.ndarray, name: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weights of the names that each two of n rows both hold, a few thousand names at a time."""
    _, col, count = np.unique(name, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    held = count[col] > 1
    row, col, weight = row[held], number[col[held]], weight[held]
    order = np.argsort(col, kind="stable")
    row, col, weight = row[order], col[order], weight[order]
    out, width = np.zeros((n, n), np.float32), 4096
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [first, first + width])
        m = np.zeros((n, min(width, int(col[-1]) + 1 - first)), np.float32)
        m[row[a:b], col[a:b] - first] = np.sqrt(weight[a:b])
        out += m @ m.T
    return out


def _list(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column."""
    size = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(size)]), col.flatten()


def by_blocks(rows: DataFrame, start: Callable, schema: str) -> DataFrame:
    """Applies a function to the rows of each (family, lo, hi), which come together in one task.

    ``start`` takes a table of whole groups and gives a function of (first, end) row numbers,
    whose results are record batches; so most families, which are small, cost no batch of
    their own."""

    def results(table: pa.Table, cuts: list[int]):
        one = start(table.combine_chunks())
        out = [r for a, b in zip(cuts[:-1], cuts[1:], strict=True) if (r := one(a, b)) is not None]
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            new = np.zeros(table.num_rows, bool)
            for k in ("family", "lo", "hi"):
                x = table[k].to_numpy()
                new[1:] |= x[1:] != x[:-1]
            cuts = [0, *np.flatnonzero(new).tolist()]
            if len(cuts) > 1:
                yield from results(table.slice(0, cuts[-1]), cuts)
            held = table.slice(cuts[-1])  # more of the last group may come
        if held is not None:
            yield from results(held, [0, held.num_rows])

    # a number, as what counts is the work of comparing, not the bytes that small tasks would be joined by
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "family", "lo", "hi").sortWithinPartitions("family", "lo", "hi").mapInArrow(run, schema)


def _seen_before(row: np.ndarray, families: np.ndarray, family: int, n: int) -> np.ndarray:
    """Pairs of ids that share a family before ``family``: there they are counted."""
    pairs = np.unique(np.stack([row, families], axis=1)[families < family], axis=0)
    return _overlaps(pairs[:, 0], pairs[:, 1], np.ones(len(pairs)), n) > 0.5


def _tied(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number tied to each of 0..n-1 by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def staying(rows: DataFrame, num: int, den: int, need: Callable) -> DataFrame:
    """(family, sid, n) of the ids that share at least ``need`` (of the smaller size) keys with
    another. ``rows``: family, lo, hi, block, sid, n, held."""

    def start(table: pa.Table) -> Callable:
        out = table.select(["family", "sid", "n"])
        family, lo, hi, block, size = (table[k].to_numpy() for k in ("family", "lo", "hi", "block", "n"))
        off, held = _list(table["held"].chunk(0))
        names, keys, weights = (held.field(k).to_numpy() for k in ("family", "g", "w"))

        def one(a: int, b: int) -> pa.RecordBatch | None:
            left, right = np.flatnonzero(block[a:b] == lo[a]), np.flatnonzero(block[a:b] == hi[a])
            n = size[a:b].astype(np.int64)
            less, more = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
            ok = (left[:, None] != right[None, :]) & (less * den >= more * num)
            if not ok.any():
                return None
            row, at = np.repeat(np.arange(b - a), np.diff(off[a : b + 1])), slice(off[a], off[b])
            ok &= _overlaps(row, keys[at], weights[at], b - a)[np.ix_(left, right)] + 0.5 >= need(less)
            if ok.any():
                ok &= ~_seen_before(row, names[at], family[a], b - a)[np.ix_(left, right)]
            has = np.union1d(left[ok.any(axis=1)], right[ok.any(axis=0)])
            return out.take(a + has).combine_chunks().to_batches()[0] if len(has) else None

        return one

    return by_blocks(rows, start, "family long, sid long, n int")


def compared(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(sid, other, n): links of each id in the tasks it meets others in, and the smallest
    id it is tied to there. ``rows``: family, lo, hi, block, sid, families, toks."""

    def start(table: pa.Table) -> Callable:
        family, lo, hi, block, sids = (table[k].to_numpy() for k in ("family", "lo", "hi", "block", "sid"))
        off, names = _list(table["families"].chunk(0))
        names, toks = names.to_numpy(), table["toks"].chunk(0)

        def one(a: int, b: int) -> pa.RecordBatch | None:
            order = a + np.argsort(sids[a:b], kind="stable")
            sid, of = sids[order], block[order]
            left, right = np.flatnonzero(of == lo[a]), np.flatnonzero(of == hi[a])
            sets = [np.frombuffer(toks[int(i)].as_buffer(), ">u8").astype(np.uint64) for i in order]
            ok = trie_join([sets[i] for i in left], [sets[i] for i in right], num, den) & (left[:, None] != right[None, :])
            if not ok.any():
                return None
            rank = np.empty(b - a, np.int64)
            rank[order - a] = np.arange(b - a)
            ok &= ~_seen_before(np.repeat(rank, np.diff(off[a : b + 1])), names[off[a] : off[b]], family[a], b - a)[np.ix_(left, right)]
            x, y = np.nonzero(ok)
            n = np.bincount(left[x], minlength=b - a)
            if lo[a] != hi[a]:
                n = n + np.bincount(right[y], minlength=b - a)
            root, has = _tied(left[x], right[y], b - a), n > 0
            return pa.RecordBatch.from_arrays([pa.array(sid[has]), pa.array(sid[root[has]]), pa.array(n[has], pa.int64())], ["sid", "other", "n"])

        return one

    return by_blocks(rows, start, "sid long, other long, n long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable.

    Large-star and small-star steps in turn: every node's neighbours are tied to the
    smallest of them, until all edges are stars. Each step is cut by a checkpoint, and the
    one before is deleted."""

    def step(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        tied = both.join(least, "u")
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if larger else tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        before, e = e, cut(step(step(e, True), False))
        drop_cut(before)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now


def grouped(members: DataFrame) -> DataFrame:
    """(family, g, w, sid, n): members of groups of two or more; g stands for the w groups that
    have the same members. ``members``: distinct (key, sid, n), n the size of the set."""
    h = lambda seed: F.bit_xor(F.xxhash64(F.col("sid"), F.lit(seed)))
    least = F.min(F.struct(F.xxhash64("sid").alias("h"), "sid"))["sid"]
    keys = members.groupBy("key").agg(F.count("*").alias("ids"), h(1).alias("x"), h(2).alias("y"), least.alias("family")).where("ids > 1")
    # cut, so that the join on a hot key is one that can be split at run time
    name = cut(keys.groupBy("ids", "x", "y").agg(F.min("key").alias("key"), F.count("*").cast("int").alias("w"), F.first("family").alias("family")).select("key", "w", "family"))
    out = cut(members.join(name, "key").select("family", F.col("key").alias("g"), "w", "sid", F.col("n").cast("int").alias("n")))
    drop_cut(name)
    return out


def with_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (family, sid, n and more) and the number of blocks of their family."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_IDS), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int")
    # one row in BLOCK_IDS at most, each for SALTS keys
    large = rows.select("family", "sid", "n").distinct().groupBy("family").agg(blocks.alias("blocks")).where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int")).join(large, ["family", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("salt")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (family, blocks, sid and more) once for each pair of blocks (lo, hi) of theirs."""
    each = rows.withColumn("block", F.pmod(F.xxhash64("sid", F.lit(5)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")


def candidates(members: DataFrame, num: int, den: int, need: Callable) -> DataFrame:
    """(family, sid, n) of all that may have a link; ``link`` needs the sets of these sids only.

    ``members``: distinct (key, sid, n); ``need``: how many keys similar sets share at least,
    by the size of the smaller one."""
    rows = grouped(members)
    held = with_blocks(rows).groupBy("sid", "n").agg(F.collect_list(F.struct("family", "g", "w")).alias("held"), F.collect_set(F.struct("family", "blocks")).alias("f"))
    first = dealt(held.select("sid", "n", "held", F.explode("f").alias("f")).select("sid", "n", "held", "f.*"))
    stay = cut(staying(first, num, den, need).distinct())
    drop_cut(rows)
    return stay


def link(stay: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """((sid, n_links), (sid, root)) of every id with a link; root is the smallest id of its
    class. ``stay``: as ``candidates`` gives it; ``sets``: sid and toks, one row for each sid."""
    own = with_blocks(stay).groupBy("sid").agg(F.collect_list(F.struct("family", "blocks")).alias("f")).join(sets.select("sid", "toks"), "sid")
    rows = dealt(own.select("sid", "toks", F.col("f.family").alias("families"), F.explode("f").alias("x")).select("sid", "toks", "families", "x.*"))
    found = cut(compared(rows, num, den))
    root = components(found.select(F.col("sid").alias("a"), F.col("other").alias("b")))
    return found.groupBy("sid").agg(F.sum("n").alias("n_links")), root.select(F.col("node").alias("sid"), "root")
