"""Sharding, mixing and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def smallest_capacity(sizes, shards):
    def fits(c):
        n, used = 1, 0
        for x in sizes:
            if x > c:
                return False
            if used + x > c:
                n, used = n + 1, 0
            used += x
        return n <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def table(spark, n, seed, hot=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = None if i == 0 else "" if i in (1, 2) else "hot text" * 40 if hot and i % 3 == 0 else "é" * rng.randrange(1, 300)
        rows.append((i, text, "en", rng.choice(["a", "b", "c", None, "big", "big", "big"]), 0))
    return spark.createDataFrame(rows, DOCS)


def test_shards_are_minimax_over_groups(spark):
    for n, seed, hot in ((300, 1, False), (300, 2, True), (5, 3, False)):
        d = table(spark, n, seed, hot)
        got = sharding.assign_shards(d).collect()
        assert len(got) == n
        groups = d.groupBy(sharding.group_key(F.col("text")).alias("k")).agg(F.sum(sharding.text_size(F.col("text"))).alias("s")).orderBy("k").collect()
        per = {}
        for r in got:
            per.setdefault(r["shard"], []).append(r)
        assert max(sum(r["size"] for r in rs) for rs in per.values()) == smallest_capacity([g["s"] for g in groups], 8)
        assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in per.values())
        text = {r["doc_id"]: r["text"] for r in d.collect()}
        home = {}
        for r in got:
            assert home.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
            assert r["size"] == len((text[r["doc_id"]] or "").encode()) + 1


def test_cells_are_divided_until_cuts_are_exact(spark):
    d = table(spark, 400, 4).select(sharding.group_key(F.col("text")).alias("k"), sharding.text_size(F.col("text")).alias("size"))
    few, many = (sharding.shard_of(F.col("k"), sharding.cut_points(d, 8, n)) for n in (4, 4096))
    assert d.where(few != many).count() == 0


def test_sharding_edges(spark):
    d = table(spark, 3, 5)
    assert sharding.assign_shards(d.where("false")).count() == 0
    twice = sharding.assign_shards(d.union(d)).collect()
    assert len(twice) == 6 and len({(r["shard"], r["slot"]) for r in twice}) == 6


def plain_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] >= 2 * sizes[s]]
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))) if i else None, "en", rng.choice(["a", "b", None, "c", "c", "c", "c"]), 0) for i in range(400)]
    d = spark.createDataFrame(rows, DOCS)
    sized = d.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    got = mixing.served(sized).withColumn("taken", mixing.words_taken(0) + mixing.words_taken(1)).collect()
    assert len(got) == 400
    sizes = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = plain_targets(sizes)
    for s in sizes:
        of = [r for r in got if r["source"] == s]
        assert abs(of[0]["target"] - want[s]) < 1e-6 and of[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in of) - want[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.served(sized.repartition(7)).withColumn("taken", mixing.words_taken(0) + mixing.words_taken(1)).collect()))
    stream = mixing.mix(d)
    assert stream.columns == d.columns
    total = stream.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert abs(total - sum(want.values())) <= 60 * len(want)
    assert mixing.mix(d.where("false")).count() == 0


def test_mixing_is_the_stream_truncated_at_the_budget(spark):
    """Against a plain fair queue: words served one time step after the other, until the budget
    is spent; the copies that are served are those of the sorted stream, in its order."""
    rng = random.Random(16)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 30))), "en", rng.choice(["a", "b", None, "c", "c"]), 0) for i in range(120)]
    rows += [rows[3]] * 3 + [(500, "long " * 900, "en", "c", 0)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.served(d.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    plain = got.collect()
    budget = 1.5 * sum(r["size"] for r in plain)
    copies = sorted(((r["offered"] + c * r["source_size"]) / r["target"], str(r["source"]), r["doc_id"], r["size"], r["target"]) for r in plain for c in (0, 1))
    left, taken, last = budget, [], {}
    for fin, source, doc, size, target in copies:  # whole copies, in the order of finish
        if fin <= 1 + 1e-12:
            left -= size
            taken.append((doc, size))
        elif source not in last:
            last[source] = (doc, target - (fin * target - size))
    assert left == pytest.approx(sum(x for _, x in last.values()))  # what is left is what those in service have had
    taken += [(doc, round(x)) for doc, x in last.values() if round(x) > 0]
    stream = mixing.stream(got)
    assert sorted(taken) == sorted((r["doc_id"], r["_words"]) for r in stream.collect())
    assert abs(sum(x for _, x in taken) - budget) <= len(last)
    mixed = mixing.mix(d, partitions=1)
    order = [r["doc_id"] for r in mixed.collect()]
    assert order == [r["doc_id"] for r in stream.orderBy("_finish", "doc_id").collect()]


@pytest.mark.parametrize("partitions", [1, 7])
def test_words_taken_are_those_of_the_queue_up_to_the_budget(spark, partitions):
    """Against a plain queue in the order of finish; repeated ids, empty texts, null sources, a
    hot id, and a range for each partition."""
    rng = random.Random(26)
    rows = [(i % 90, " ".join("w" for _ in range(rng.randrange(0, 30))), "en", rng.choice(["a", "b", None, "c", "c"]), 0) for i in range(160)]
    rows += [(7, "same words here", "en", "c", 0)] * 900 + [(None, None, "en", "a", 0), (500, "long " * 700, "en", "c", 0), (501, "", "en", "none", 0)]
    d = spark.createDataFrame(rows, DOCS)
    held = mixing.served(d.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))).collect()
    plain = [r for r in held if r["size"]]
    left, want = sum(r["size"] for r in plain) * 150 // 100, {}
    nulls_first = lambda s: (s is not None, s or "")
    for _, s, at, size in sorted(((r["offered"] + c * r["source_size"]) / r["target"], nulls_first(r["source"]), r["offered"], r["size"]) for r in plain for c in (0, 1)):
        want[s, at] = want.get((s, at), 0) + min(size, max(0, left))
        left -= size
    got = mixing.truncated(spark.createDataFrame(held, mixing.served(d.select("doc_id", "source", F.lit(1).cast("long").alias("size"))).schema), partitions=partitions)
    assert {(nulls_first(r["source"]), r["offered"]): r["taken"] for r in got.collect()} == want
    per = {}
    for r in plain:
        x = per.setdefault(nulls_first(r["source"]), [0, r["target"], 0])
        x[0] += want[nulls_first(r["source"]), r["offered"]]
        x[2] = max(x[2], r["size"])
    assert all(abs(taken - target) <= 2 * most for taken, target, most in per.values())
    assert sum(x[0] for x in per.values()) == sum(r["size"] for r in plain) * 150 // 100


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = say(40)
    rows, labels = [], []
    for i in range(200):
        toxic = i % 5 == 0
        text = f"{say(30)}. you vile {say(2)}. {say(5)}" if toxic else say(50)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    copy = rows[1][1]
    rows += [(900, copy, "en", "s0", 0), (901, f"{say(20)} {item} {say(20)}", "en", "s1", 0)]
    for name, data, schema in (("documents", rows, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    before_mixing = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, before_mixing, str(tmp_path))
        assert out.columns == before_mixing.columns
        before_mixing = out
    kept = {r["doc_id"] for r in before_mixing.collect()}
    assert kept == {i for i in range(200) if i % 5}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} <= kept and len({(r["shard"], r["slot"]) for r in final}) == len(final)
