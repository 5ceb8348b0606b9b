"""What the learning operators learn: seeds that grow, weights and thresholds."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from insightspark.llm import classifier, pii
from insightspark.llm.common import table_of
from insightspark.llm.spans import with_matches


def added(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: len(r.spans) - len(r.base) for r in pii.pii_spans(docs).collect()}


def test_mostly_unseen_shapes_in_a_context(spark):
    """Six plain addresses carry twenty obfuscated ones."""
    texts = [f"kindly write to user{i}@mail.org before noon" for i in range(6)] + [f"kindly write to person{i} (at) site{i} (dot) net before noon" for i in range(20)]
    got = added(spark, texts)
    assert all(got[i] == (i >= 6) for i in got)


def test_believed_identifiers_confirm_and_open_contexts(spark):
    """Four addresses believed through one context are found in a second; once six are seeds there, it is a pattern for others."""
    first = [f"kindly write to user{i}@mail.org before noon" for i in range(10)] + [f"kindly write to person{i} (at) site{i} (dot) net before noon" for i in range(6)]
    second = [f"our courier knows person{i} (at) site{i} (dot) net very well" for i in range(4)]
    got = added(spark, first + second)
    assert all(got[i] == 1 for i in range(10, 20))
    third = [f"our courier knows person{i} (at) site{i} (dot) net very well" for i in range(6)] + ["our courier knows stranger (at) far (dot) net very well", "nobody knew stranger (at) far (dot) net at all"]
    got = added(spark, first + third)
    assert [got[i] for i in range(16, 24)] == [1] * 7 + [0]


def test_lone_shapes_stay_out(spark):
    texts = [f"kindly write to user{i}@mail.org before noon" for i in range(10)] + ["some unrelated words with x (at) y (dot) z in them"] * 9
    assert set(added(spark, texts).values()) == {0}


def test_positions_of_very_many_matches(spark):
    text = "".join(f"é{'x' * (i % 5)}{i}-" for i in range(70_000))
    df = with_matches(spark.createDataFrame([(text,), ("",), ("none",)], "t string"), "t", "[0-9]+", "m", F.lit(True))
    got = {r.t: [(m.start, m.end) for m in r.m] for r in df.select("t", F.transform("m", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("m")).collect()}
    assert got == {t: [m.span() for m in re.finditer("[0-9]+", t)] for t in (text, "", "none")}


def test_weights_equal_gradient_descent():
    draw = np.random.default_rng(9)
    x = draw.normal(size=(300, classifier.N_FEATURES))
    label = (x[:, 0] - 0.5 * x[:, 3] + draw.normal(size=300) > 0).astype(int)
    ranker = classifier.fit(x, label, pairs=4000)
    z = np.clip((x - x.mean(0)) / x.std(0), -10, 10)
    pick = np.random.default_rng(3)
    d = z[pick.choice(np.nonzero(label == 1)[0], 4000)] - z[pick.choice(np.nonzero(label == 0)[0], 4000)]
    w = np.zeros(x.shape[1])
    for _ in range(4000):  # plain descent on the same pairs
        w += 0.3 * (d.T @ (1 / (1 + np.exp(d @ w))) / 4000 - classifier.RIDGE * w)
    assert ranker.weights == pytest.approx(w, abs=1e-4)


def test_cut_is_the_best_quantile():
    draw = np.random.default_rng(2)
    bins = np.arange(-300, 300)
    good, bad = draw.poisson(5 / (1 + np.exp(-bins / 60))), draw.poisson(5 / (1 + np.exp(bins / 60)))
    got = classifier.cut(bins, good, bad) * classifier.BINS
    balance = [good[bins >= b].sum() / good.sum() + bad[bins < b].sum() / bad.sum() for b in bins]
    assert balance[int(got) + 300] >= max(balance) - 0.01


def test_two_runs_learn_the_same(spark, small):
    docs, labels = table_of(spark, small, "documents"), table_of(spark, small, "labels")
    one = classifier.train(docs, labels, rows=30)
    two = classifier.train(docs.repartition(5), labels.repartition(3), rows=30)
    assert np.array_equal(one.weights, two.weights) and one.threshold == two.threshold
    known = {r.doc_id for r in labels.where(F.col("quality").isNotNull()).collect()}
    assert len(known) > 30  # more labels count for the threshold than for the weights
