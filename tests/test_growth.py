"""Steps whose work must not grow by the number of columns or ranges."""

import bisect
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from insightspark.functions import ranks as R
from insightspark.operators import profile as P
from insightspark.operators import textlogs as X

SCHEMA = "k long, x double, s string, day date, flag boolean, bits array<int>"


def mixed(spark):
    data = [(i % 7, [0.0, -0.0, float("nan"), None, 2.5][i % 5], ["a", "", None, "A"][i % 4], None, i % 2 == 0, [i % 3]) for i in range(60)]
    return spark.createDataFrame(data, SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_counts_columns_without_copies_of_rows(spark):
    df = mixed(spark)
    got = P.profile_columns(df)
    assert "Expand" not in plan(got)
    assert got.columns == P.profile_columns(df, exact_distinct=False).columns
    assert {r["column_name"]: (r["n_unique"], r["null_count"], r["row_count"]) for r in rows(got)} == {
        "k": (7, 0, 60), "x": (2, 24, 60), "s": (3, 15, 60), "day": (0, 60, 60), "flag": (2, 0, 60), "bits": (3, 0, 60)}
    assert {(r["row_count"], r["n_unique"], r["null_pct"]) for r in rows(P.profile_columns(df.where("k > 99")))} == {(0, 0, 0.0)}


def test_fingerprint_counts_columns_without_copies_of_rows(spark):
    got = P.frame_fingerprint(mixed(spark), "l")
    assert "Expand" not in plan(got)
    # NaN is a value here
    assert {r["column_name"]: r["value"] for r in rows(got) if r["metric"] == "distinct_count"} == {"k": 7, "x": 3, "s": 3, "day": 0, "flag": 2, "bits": 3}


@pytest.fixture
def many_ranges(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    yield 300
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_rows_are_not_held_against_every_range(spark, many_ranges):
    df = spark.createDataFrame([(float(i), 1, str(i)) for i in range(50)], "x double, n long, q string")
    claims = df.select(F.col("x").alias("v"))
    for made in (R.range_buckets(df, [], "x"), R.range_buckets(df, ["q"], "x"), X.value_bands(claims, df)):
        assert "filter(_bounds" not in plan(made)


def test_claims_that_span_most_of_many_ranges(spark, many_ranges):
    rng = random.Random(4)
    # bands over all the values, over parts of them and over none; a value with no id, and ids of several bytes
    held = [(f"{rng.choice('qé')}{rng.randrange(10**5):05d}", 1000 * (1 + 0.0018 * rng.random())) for _ in range(1500)] + [(None, 7.0), (None, 1000.0), ("a", 7.001), (None, 3.0)]
    claims = [(i, 1000 * (1 + 0.004 * rng.random() - 0.001)) for i in range(120)] + [(200, 7.0), (201, 3.0), (202, 50.0)]
    entries = spark.createDataFrame([(q, v, []) for q, v in held], "query_id string, result_value double, claim_ids array<long>")
    got = rows(X.match_claims(entries, spark.createDataFrame(claims, "claim_id long, value double")))
    met = {c: [q for q, x in held if abs(v - x) / abs(v) < 0.001] for c, v in claims}
    assert {r["claim_id"]: (r["n_matches"], r["first_query"]) for r in got} == {c: (len(m), min((q for q in m if q is not None), default=None)) for c, m in met.items()}


@pytest.mark.parametrize("splits", [2, 3, 64, 100])
def test_places_equal_bisection(spark, splits):
    rng = random.Random(splits)
    bounds = sorted(rng.choice([-1.5, 0.0, 2.0, rng.random()]) for _ in range(splits - 1))
    values = [*bounds, *[b + 0.01 for b in bounds], -9.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", F.array(*[F.lit(b) for b in bounds]))
    got = rows(df.select("v", R.places_in(F.col("b"), [F.col("v"), -F.col("v"), F.lit(float("nan"))], splits).alias("p")))
    assert [tuple(r["p"]) for r in got] == [(bisect.bisect_left(bounds, r["v"]), bisect.bisect_left(bounds, -r["v"]), splits - 1) for r in got] and len(got) == len(values)
