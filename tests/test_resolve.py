from pyspark.sql import functions as F

from quillspark.operators import catalog as C


def test_lists_of_candidates_are_made_once_for_an_id(spark):
    """Requests meet one list for each id, not each operation of it."""
    ops = spark.createDataFrame([(f"{s}:{i}", f"o{i % 2}", s) for s in "ab" for i in range(4)], "key string, operation_id string, source string")
    asked = [("r1", "a:1", None, None), ("r2", "x", None, None), ("r3", None, "o1", None), ("r4", None, "o1", "a"), ("r5", None, "zz", None), ("r6", None, None, None), ("r7", None, "o1", "c")]
    got = {r["request_id"]: (r["key"], r["error"], r["candidates"]) for r in C.resolve(spark.createDataFrame(asked, "request_id string, key string, operation_id string, source string"), ops).collect()}
    assert got == {
        "r1": ("a:1", None, None), "r2": (None, "operation_not_found", None), "r3": (None, "ambiguous", ["a:1", "a:3", "b:1", "b:3"]), "r4": (None, "ambiguous", ["a:1", "a:3"]),
        "r5": (None, "operation_not_found", None), "r6": (None, "invalid_argument", None), "r7": (None, "operation_not_found", None),
    }


def test_no_task_meets_a_longer_list_after_shorter_rows(spark, monkeypatch):
    """A writer that judges coming rows by those before never holds more than it reckons with."""
    ops = spark.createDataFrame([(f"a:{i}:{j}", f"o{i}", "ab"[j % 2]) for i in range(12) for j in range(3 * i + 1)], "key string, operation_id string, source string")
    every = ops.select(F.col("key").alias("request_id"), F.when(F.col("key").endswith("0"), F.col("key")).alias("key"), "operation_id", F.when(F.col("key").endswith("1"), F.col("source")).alias("source"))
    asked = every.withColumn("operation_id", F.when(F.col("key").isNull(), F.col("operation_id"))).union(spark.createDataFrame([("n", None, None, None), ("z", None, "zz", None)], every.schema))
    told = lambda df: df.withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).orderBy("place").collect()

    def in_order(rows, size):
        tasks = {}
        for r in rows:
            tasks.setdefault(r["task"], []).append(size(r["candidates"]) if r["candidates"] else 0)
        assert all(x == sorted(x, reverse=True) and (min(x) > 1 or max(x) == 0) for x in tasks.values()), tasks

    plain = told(C.resolve(asked, ops))
    in_order(plain, len)
    want = {r["request_id"]: (r["key"], r["error"], r["candidates"] and ",".join(r["candidates"])) for r in plain}
    assert len(want) == len(plain) == asked.count() and want["z"] == (None, "operation_not_found", None) and want["n"] == (None, "invalid_argument", None)
    for part_keys in (40, 10_000):
        monkeypatch.setattr(C, "PART_KEYS", part_keys)
        got = told(C.resolve(asked, ops, lambda c: F.array_join(c, ",")))
        in_order(got, lambda c: c.count(",") + 1)
        assert len(got) == len(want) and {r["request_id"]: (r["key"], r["error"], r["candidates"]) for r in got} == want
