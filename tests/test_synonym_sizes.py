"""Synonyms and aliases of whole texts: each pair is dealt once, for few targets and many."""

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import lexicon as X
from quillspark.plans import catalog_queries as B
from quillspark.plans import detail_queries as D

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["page box", "Boxes pages of the of the issues", "issues box boxes", "of page to page the", "word", "", None, "news series statuses status", "boxPage JQLQuery x1 1x", "of the pages of, pages", "zebra apple", "apple zebras"]


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def _dealt(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def _texts(spark, n, big=0):
    rows = [(big + i * 7 % len(TEXTS), TEXTS[i % len(TEXTS)], f"src {i % n}s" if i % n else None) for i in range(len(TEXTS))]
    rows += [(big - 1 - i, "filler words", f"of t{i}x names") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, target string").withColumn("words", T.raw_tokens("text"))


def test_neighbours_are_normalized_as_synonyms(spark):
    """Also for more targets than a number has bits, and for doc_ids near a long's end."""
    for n, big in ((3, 0), (70, 0), (3, 2**63 - 20), (3, -(2**63) + 100)):
        d = _texts(spark, n, big)
        at = F.posexplode(F.expr("transform(filter(sequence(1, greatest(size(words), 1)), i -> i < size(words)), i -> concat(words[i - 1], ' ', words[i]))")).alias("at", "synonym")
        raw = d.select("doc_id", "target", at).select(F.struct("doc_id", "at").alias("pos"), "synonym", "target")
        targets = X.Targets(d, T.singular_tokens)
        assert targets.few == (n == 3)
        got = sorted(map(tuple, X.normalize_neighbours(d, targets).collect()))
        assert got == sorted(map(tuple, X.normalize_synonyms(raw).collect())) and ("=" not in "".join(k for k, _ in got))
        assert {"of the", "page"} <= {k for k, _ in got}


def test_no_targets(spark):
    d = _texts(spark, 3).withColumn("target", F.lit(None).cast("string"))
    assert {tuple(r["targets"]) for r in X.normalize_neighbours(d, X.Targets(d)).collect()} == {()}


def test_synonyms_are_dealt_once(spark, tmp_path):
    """Before, pairs were sorted by synonym and target, dealt by both, and then by their words."""
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(TEXTS)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = D.normalize_synonyms(spark, str(tmp_path))
    assert "SortAggregate" not in _plan(got) and "ObjectHashAggregate" not in _plan(got) and len(_dealt(got)) == 1
    assert dict(map(tuple, got.collect()))["zebra apple"] == "s1,s2"


def test_aliases_and_rules_are_looked_up_at_once(spark):
    """Words among alias words, phrases among rules of the same words in any order; the lexicon
    is met by one table, before by two."""
    lexicon = spark.createDataFrame([("box", ["a"]), ("page box", ["b", "c"]), ("box page", []), ("page", ["d"]), ("red page", ["e"]), ("issue", None)], "key string, targets array<string>")
    words = spark.createDataFrame([("box",), ("box",), ("red page",)], "word string")
    rules = spark.createDataFrame([(["page", "box"],), (["box", "page"],), (["page"],)], "words array<string>")
    got = X.merge_aliases(lexicon, words, rules)
    assert {r["key"]: (r["kind"], r["targets"], r["skipped"]) for r in got.collect()} == {
        "box": ("alias", ["a"], True), "page box": ("rule", ["b", "c"], True), "box page": ("rule", [], True),
        "page": ("alias", ["d"], False), "red page": ("rule", ["e"], False), "issue": ("alias", None, False),
    }
    assert got.count() == 6 and _plan(got).count("Join") == 1


def test_aliases_read_texts_once(spark, tmp_path):
    """Before, the tokens of all texts were taken for the lexicon, its words and its phrases."""
    for n in (3, 70):
        path = f"{tmp_path}/{n}"
        rows = [(i, TEXTS[i % len(TEXTS)], "en", f"s{i % n}" if i % n else None, 1) for i in range(140)]
        spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
        out = B.merge_aliases(spark, path)
        assert "Generate" not in _plan(out)
        want = {}
        for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source", T.unigrams("text").alias("w")).collect():
            for key in r["w"] if r["doc_id"] % 2 == 0 else [f"{a} {b}" for a, b in zip(r["w"], r["w"][1:])]:
                want.setdefault(key, set()).update([r["source"]] if r["source"] else [])
        got = sorted(map(tuple, out.collect()))
        assert got == sorted((k, "rule" if " " in k else "alias", ",".join(sorted(v)), len(k) % 3 == 0) for k, v in want.items())
