from pyspark.sql import functions as F

from quillspark.functions import text as T

CASES = {
    "getIssueTypes": (["get", "issue", "types"], ["getissuetypes"]),
    "JQLQuery parser": (["jql", "query", "parser"], ["jqlquery"]),
    "The statuses of an issue": (["statuses", "issue"], []),
    "a b cd cd": (["cd"], []),
    None: ([], []),
    "é naïve": (["na", "ve"], []),
}


def test_unigrams_and_joined_forms(spark):
    d = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", T.unigrams("t").alias("u"), T.joined_forms("t").alias("j"))
    for r in d.collect():
        assert (r["u"], [x for x in r["j"] if x != "nave"]) == CASES[r["t"]], r


def test_singular(spark):
    pairs = {"statuses": "status", "series": "series", "news": "news", "bus": "bus", "policies": "policy", "classes": "class", "wishes": "wish", "boxes": "box", "class": "class", "status": "status", "analysis": "analysis", "issues": "issue", "issue": "issue"}
    got = spark.createDataFrame([(k,) for k in pairs], "t string").select("t", T.singular(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in got.collect()} == pairs


def test_paths(spark):
    d = spark.createDataFrame([("/rest/api/3/issue/{id}/issueLinks",), ("/a/{x}",), ("/{x}",), (None,), ("/v2/12",)], "p string")
    got = d.select(T.path_tokens("p", ("rest", "api")).alias("a"), T.terminal_tokens("p").alias("b"), T.literal_path_tokens("p").alias("c")).collect()
    assert [tuple(r) for r in got] == [(["issue", "links"], ["issue", "links"], ["rest", "api", "issue", "issue", "links"]), ([], [], []), ([], [], []), ([], [], []), (["v2", "12"], [], ["v2"])]


def test_excerpt(spark):
    d = spark.createDataFrame([("One  sentence. Two.",), ("No stop",), ("Ends.",), ("  ",), (None,), ("x" * 300,)], "t string")
    assert [r[0] for r in d.select(T.excerpt("t")).collect()] == ["One sentence.", "No stop", "Ends.", "-", "-", "x" * 160]
