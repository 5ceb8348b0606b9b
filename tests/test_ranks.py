"""Order statistics, prefix sums and slotted running values against brute force, with hot keys."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insightspark.functions.ranks import prefix_totals, quantiles, running_by_time, value_counts
from insightspark.operators.windows import average_ranks, global_rank, quintile_score


def frame(spark, groups):
    data = [(g, float(v) if v is not None else None) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(data, "g string, v double")


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"ties": [1] * 700 + list(range(300)), "one": [5.5], "two": [1, 2], "wide": rng.normal(size=2000).round(3).tolist(), "flat": [3.0] * 40}
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in quantiles(frame(spark, groups), ["g"], "v", probs).collect()}
    assert len(got) == len(groups) * len(probs)
    for g, vs in groups.items():
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(vs, p), abs=1e-9), (g, p)


def test_quantiles_skip_null_nan_free_and_empty(spark):
    df = frame(spark, {"a": [None, None], "b": [1, None, 3]})
    got = {r["g"]: r["quantile"] for r in quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {"b": 2.0}
    assert quantiles(df.where("g = 'none'"), [], "v", [0.5]).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.sampled_from([0.05, 0.5, 0.77]))
def test_quantiles_property(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert quantiles(df, [], "v", [p]).first()["quantile"] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_prefix_totals(spark):
    df = frame(spark, {"a": [1, 1, 2, 5, 5, 5], "b": list(range(500))})
    got = prefix_totals(value_counts(df, ["g"], "v"), ["g"], "v", {"before": "n"}, splits=16).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values("v")
        assert (part["before"].to_numpy() == np.concatenate([[0], part["n"].cumsum().to_numpy()[:-1]])).all()
        assert (part["before_all"] == part["n"].sum()).all()


def test_average_ranks_equal_pandas(spark):
    vals = [3, 1, 1, 2, 2, 2, 9]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    want = pd.Series(vals).rank().groupby(pd.Series(vals)).first().to_dict()
    assert {r["v"]: r["avg_rank"] for r in average_ranks(df, [], "v").collect()} == {float(k): v for k, v in want.items()}


def hot_events(spark, n=4000):
    """A third of all rows belongs to one user."""
    base = spark.range(n).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97 + 1).alias("user_id"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("id") * 7919) % 400000).alias("ts"), (F.col("id") % 11).alias("x"))
    return base


@pytest.mark.parametrize("slot", ["hour", "day", "month"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_by_time_equals_window(spark, slot, inclusive):
    df = hot_events(spark)
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    frame_ = w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    want = df.withColumn("s", F.coalesce(F.sum("x").over(frame_), F.lit(0))).withColumn(
        "p", F.last(F.when(F.col("x") > 8, F.col("x")), True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    got = running_by_time(df, ["user_id"], "ts", ["event_id"], {"s": F.col("x")}, slot=slot, inclusive=inclusive,
                          carry_last={"p": F.when(F.col("x") > 8, F.col("x"))})
    assert want.select("event_id", "s", "p").exceptAll(got.select("event_id", "s", "p")).count() == 0
    assert got.count() == df.count()


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("score"))
    got = global_rank(df, "score", "k").toPandas().sort_values("rank")
    want = got.sort_values(["score", "k"], ascending=[False, True])
    assert got["rank"].tolist() == list(range(1, 5001)) and got["k"].tolist() == want["k"].tolist()


@pytest.mark.parametrize("values, scores", [
    ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5]),
    ([7, 7, 7], [3, 3, 3]),                     # no usable split: the middle score
    ([1, 1, 1, 1, 1, 1, 2, 3, 4, 5], None),     # collapsed edges: fewer bins, leading labels
])
def test_quintile_score_fallback(spark, values, scores):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = [r["s"] for r in quintile_score(df, "v", "s").orderBy("i").collect()]
    if scores is None:
        for q in (5, 4, 3, 2):
            edges = np.quantile(values, [i / q for i in range(q + 1)])
            if len(set(edges)) == q + 1:
                scores = [1 + sum(v > e for e in edges[1:-1]) for v in values]
                break
        else:
            scores = [3] * len(values)
    assert got == scores


def test_results_do_not_depend_on_partitioning(spark):
    df = hot_events(spark)
    a = quantiles(df, ["user_id"], "x", [0.3, 0.5])
    b = quantiles(df.repartition(13), ["user_id"], "x", [0.3, 0.5])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
