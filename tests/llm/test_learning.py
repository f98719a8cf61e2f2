"""What the classifiers learn from, and the toxicity network against plain versions."""

import math
import zlib

import numpy as np
import pytest

from tidelog.llm import language, learning, quality, toxicity

SCHEMA = "doc_id long, text string"


def test_an_id_stored_many_times_teaches_once(spark):
    df = spark.range(10_000).selectExpr("7L AS doc_id", "'the same text' AS text").unionAll(spark.createDataFrame([(8, "other"), (7, None), (9, None)], SCHEMA))
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (9, 0), (None, 1), (8, None)], "doc_id long, label int")
    found = sorted((r.label, r.text or "") for r in learning.training_rows(df, labels, 5).collect())
    assert found == [(0, ""), (0, "other"), (1, ""), (1, "the same text")]


def test_an_id_with_many_texts_stays_below_the_bound(spark):
    df = spark.range(3_000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, label int")
    assert learning.training_rows(df, labels, 5).count() == 5


def test_texts_are_whole_and_their_bytes_are_bounded(spark):
    df = spark.range(100).selectExpr("id AS doc_id", "repeat('é', 500) AS text").unionAll(spark.createDataFrame([(100, "x" * 20_000)], SCHEMA))
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS label")
    found = learning.training_rows(df, labels, 1_000, most=10_000).collect()
    assert {r.text for r in found} == {"é" * 500}
    assert sum(r.label == 0 for r in found) == sum(r.label == 1 for r in found) == 11


def test_a_rare_language_is_drawn_beside_a_frequent_one(spark):
    df = spark.range(20_020).selectExpr("id AS doc_id", "if(id % 1001 = 0, 'ein seltenes Wort', concat('plain words ', id)) AS text", "if(id % 1001 = 0, 'de', 'en') AS label")
    found = learning.training_rows(df.select("doc_id", "text"), df.select("doc_id", "label"), 100).collect()
    assert sum(r.label == "en" for r in found) == 100
    assert sum(r.label == "de" for r in found) == 20
    model, names = language.fit(df.select("doc_id", "text"), df.select("doc_id", "label"))
    assert names == ["de", "en"]
    assert language.Scorer(model, names).texts(["ein seltenes Wort", "plain words 5"])[0] == ["de", "en"]


def test_no_text_or_label_is_no_sample(spark):
    df, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, label int")
    assert learning.training_rows(df, labels, 5).collect() == []
    assert toxicity.Scorer(toxicity.fit(df, labels)).score("text") == 0.5
    assert quality.score_texts(quality.fit(df, labels), ["text", None]).tolist() == [0.5, 0.5]


def plain_values(model, text):
    odds = []
    for w in (text or "").lower().split():
        bare = "<" + "".join(c for c in w if c.isalnum() or c == "_") + ">"
        grams = [bare[i : i + n] for n in (4, 5, 6) for i in range(len(bare)) if i + n <= len(bare)] + [bare]
        odds.append(np.mean([model["bucket"][zlib.crc32(g.encode()) % len(model["bucket"])] for g in grams]))
    worst = sorted(odds, reverse=True)[:3] or [0.0]
    return model["bias"] + worst[0], model["bias"] + np.mean(worst), math.log(1 + len(odds))


def test_toxicity_values_are_those_of_a_plain_version():
    random = np.random.default_rng(3)
    model = {"bucket": random.normal(size=toxicity.BUCKETS).astype(np.float32), "bias": 0.25, "slopes": [0.5, -0.25, 0.1], "offset": -0.3}
    scorer = toxicity.Scorer(model)
    for text in [None, "", " \n", "one", "Two words!", "a b c d e f g", "ça va? ça va?", "long " * 500 + "x" * 300]:
        want = plain_values(model, text)
        assert scorer.values(text) == pytest.approx(want, abs=1e-5)
        assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(0.3 - 0.5 * want[0] + 0.25 * want[1] - 0.1 * want[2])), abs=1e-5)


def test_forward_pass_is_the_mean_of_means():
    random = np.random.default_rng(4)
    sample = toxicity.Sample(["alpha beta alpha", "", "gamma"], np.array([1, 0, 0]))
    model = {"table": random.normal(size=(toxicity.BUCKETS, 8)), "weights": random.normal(size=(8, 2)), "bias": random.normal(size=2)}
    chosen = np.arange(len(sample.of))
    means, logits, _ = toxicity.forward(model, sample, chosen)
    want = np.array([model["table"][toxicity.grams(w)].mean(axis=0) for w in ("alpha", "beta", "alpha", "gamma")])
    assert sample.of.tolist() == [0, 0, 0, 2]
    np.testing.assert_allclose(means, want)
    np.testing.assert_allclose(logits, want @ model["weights"] + model["bias"])


def test_calibration_finds_the_slopes():
    random = np.random.default_rng(5)
    x = random.normal(size=(20_000, 2))
    y = (random.random(20_000) < learning.sigmoid(x @ [1.5, -0.5] + 0.3)).astype(np.int64)
    slopes, offset = learning.calibrate(x, y)
    assert slopes == pytest.approx([1.5, -0.5], abs=0.1)
    assert offset == pytest.approx(0.3, abs=0.1)
    assert learning.calibrate(x[:4], np.ones(4, dtype=np.int64)) == ([0.0, 0.0], pytest.approx(math.log(5)))


@pytest.mark.parametrize("cells", [1, 7, 40, 1_000])
def test_chains_are_bounded_and_whole(cells):
    counts = np.array([1, 9, 3, 3, 1, 20, 2])
    seen = []
    for some, at, mask in quality.chains(counts, 3, cells):
        assert mask.size <= cells or len(some) == 1
        assert len(some) <= 3
        assert mask.sum(axis=1).tolist() == counts[some].tolist()
        seen += at[mask].tolist()
    assert sorted(seen) == list(range(counts.sum()))
