"""Nulls, empty and very long texts, repeated rows, ties, empty tables, names that clash."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, decontamination, language_id, mixing, ngram_join, quality_gam, quality_rules, sharding, substring_dedup, toxicity

CLASH = ("size", "score", "sid", "toks", "n", "_finish", "_row", "_c", "_words", "hits", "shard", "slot", "target", "words", "text_crc32", "component_id", "class")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    long = " ".join(f"u{i}" for i in range(60_000))
    rows = [(None, say(30), "en", "a"), (None, None, None, None), (1, None, "en", "a"), (2, "", None, None), (3, "word", "de", "b"), (4, long, "en", "a"), (4, long, "en", "a"), (5, say(40), "fr", "b"), (6, "\n\t \u0085", "en", None)]
    rows += [rows[7]] * 3 + [(7, say(25) + ".\n" + say(25), "en", "a")] + [(100 + i, say(30), rng.choice(["en", "de"]), rng.choice(["a", "b"])) for i in range(30)]
    d = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        d = d.withColumn(c, F.lit("x"))
    return d


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, i % 2, int(i % 3 == 0)) for i in range(30)] + [(4, 1, 1), (5, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_stages_keep_rows_and_columns(spark, odd, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "never seen words stand here"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for d in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = common.cut(stage(spark, d, str(tmp_path)))
            assert name == "sharding" or out.columns == odd.columns
            assert out.count() > 0 or d.isEmpty()
            d = out
    assert d.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_scores_of_odd_rows(spark, odd, labels):
    for train, score in ((toxicity, lambda m: toxicity.scorer(m)("text")["score"]), (quality_gam, lambda m: quality_gam.scorer(m)("text"))):
        model = train.train(odd, labels, F.lit(True))
        got = odd.select("doc_id", score(model).alias("s")).collect()
        assert len(got) == odd.count() and all(0 <= r["s"] <= 1 for r in got)
        same = {r["s"] for r in got if r["doc_id"] == 5}
        assert len(same) == 1
        none = train.train(odd.where("false"), labels, F.lit(True))
        assert odd.where("false").select(score(none).alias("s")).count() == 0
    model = toxicity.train(odd, labels, F.lit(True))
    score = {r["doc_id"]: r["s"] for r in odd.select("doc_id", toxicity.scorer(model)("text")["score"].alias("s")).collect()}
    assert score[1] == score[2] == score[6] == pytest.approx(model.leak)


def test_samples_are_bounded_in_rows(spark, odd, labels, monkeypatch):
    many = odd.union(odd).union(odd)
    assert common.labelled_sample(many, labels, "toxic", F.lit(True), 5).count() <= 5
    assert quality_rules.plan_cascade(many, sample_docs=4) and quality_rules.plan_cascade(odd.where("false"))
    taken = []
    monkeypatch.setattr(language_id, "fit", lambda docs, y, langs, idf: taken.append((len(docs), langs)))
    for x in (odd, many):
        language_id.train(x, 20)
    assert taken == [(20, taken[0][1])] * 2


def test_languages_of_odd_rows(spark, odd):
    d = odd.union(odd.limit(1).withColumn("doc_id", F.lit(900).cast("long")).withColumn("text", F.lit("\U00030000\U00030001 123")))
    got = {r["doc_id"]: r["p"] for r in d.select("doc_id", language_id.predictor(language_id.train(odd))("text").alias("p")).collect()}
    assert got[1]["lang"] == got[2]["lang"] == got[6]["lang"] == "und" and got[1]["score"] == 0
    assert got[900]["lang"] != "und"  # letters beyond the third plane are letters
    none = language_id.train(odd.where("false"))
    assert {r["p"]["lang"] for r in odd.select(language_id.predictor(none)("text").alias("p")).collect()} == {"und"}


def test_logits_match_plain_sums(spark, odd):
    """The prediction against a plain sum of weights over the n-grams of a text."""
    model = language_id.train(odd)
    texts = [r["text"] for r in odd.where("length(text) between 20 and 400").select("text").collect()]
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(language_id.predictor(model)("text").alias("p")).collect()]
    for t, p in zip(texts, got, strict=True):
        chunk = next(language_id.chunks(language_id.pa.array([t])))
        grams = [int(g) for one in language_id._grams(chunk)[0] for g in one if g < 1 << language_id.BITS]
        z = np.array([sum(float(w[g]) for g in grams) / len(grams) for w in model.weight]) + model.bias
        e = np.exp((z - z.max()) / model.temperature)
        assert p["score"] == pytest.approx((e / e.sum()).max(), rel=1e-4) and p["lang"] == model.langs[int(z.argmax())]


def test_table_sums_match_plain_lookups():
    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    model = quality_gam.fit(x, ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float))
    for row, s in zip(x[:50], model.score(x[:50]), strict=True):
        b = [int((e <= v).sum()) for e, v in zip(model.edges, row, strict=True)]
        z = model.base + sum(t[k] for t, k in zip(model.tables, b, strict=True)) + sum(t[b[i], b[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert s == pytest.approx(1 / (1 + np.exp(-z)))


def test_noisy_or_matches_plain_product(spark):
    """A document's score from its sentences' words, one by one."""
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), toxicity.BIAS, 0.05)
    slot = lambda word: toxicity._sentences(next(toxicity.chunks(toxicity.pa.array([word]))))[1][0]
    for word, w in (("vile", 2.0), ("nasty", 1.5), ("kind", -1.0)):
        model.weight[slot(word)] = w
    texts = ["you vile one. fine day. nasty nasty kind", "all fine. really", "vile\nvile! vile?", "kind words."]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(toxicity.scorer(model)("text")["score"].alias("s")).collect()]
    logistic = lambda z: 1 / (1 + np.exp(-z))
    for t, s in zip(texts, got, strict=True):
        clean = 1 - model.leak
        for sentence in t.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
            z = sum(float(model.weight[f]) for w in sentence.split() for f in slot(w))
            clean *= (1 - logistic(toxicity.BIAS + max(z, 0))) / (1 - logistic(toxicity.BIAS))
        assert s == pytest.approx(1 - clean, abs=1e-6)


def test_later_rules_see_survivors_only(spark, odd):
    def strict(facts):
        assert len(facts.n_letter_words) == len(facts.n_words) and (facts.n_words >= quality_rules.MIN_WORDS).all(), "a rejected text was looked at again"
        return facts.n_words > 10_000

    rules = (quality_rules.RULES[0], quality_rules.Rule("strict", strict))
    for counts in (True, False):
        got = odd.select("doc_id", quality_rules.judge(["few_words", "strict"], rules, counts)("text").alias("q")).collect()
        kept = {r["doc_id"] for r in got if r["q"]["kept"]}
        assert 7 in kept and not kept & {1, 2, 3, 4, 6} and len(got) == odd.count()
    assert quality_rules.filter_quality(odd).columns == odd.columns


def test_items_of_any_type_in_long_texts(spark, odd):
    item = " ".join(f"u{i}" for i in range(50_000, 50_030))
    for ids, kind in (([7, None], "long"), (["b-7", None], "string")):
        bench = spark.createDataFrame(list(zip(ids, (item, "not there at all"), strict=True)), f"item_id {kind}, text string")
        got = {r["doc_id"]: r["found"] for r in decontamination.contamination(odd, bench, "found").select("doc_id", "found").collect()}
        assert got[4]["items"] == ids[:1] and got[4]["n_hit"] == 30 and not got[4]["contaminated"] and got[5]["items"] == []


def test_joins_of_odd_rows(spark, odd):
    got = ngram_join.similar(odd).collect()
    assert len(got) == odd.count() and {r["n_links"] for r in got} == {0}
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, i) for (i,) in odd.where("doc_id is not null").select("doc_id").distinct().collect()}
    assert ngram_join.keep_one(odd).count() == odd.count()
    assert substring_dedup.repeats(odd).count() == 0


def test_shards_and_mixes_of_odd_rows(spark, odd):
    got = sharding.assign_shards(odd).collect()
    assert len(got) == odd.count() and len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert max(r["size"] for r in got) > 300_000
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd.where("false")).count() == 0
    assert mixing.mix(odd).where("doc_id in (1, 2)").count() == 0
