"""Checks on small frames with known faults and on the edge cases."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from insightspark.operators import business as B
from insightspark.operators import logical as L
from insightspark.operators import query_checks as Q
from insightspark.operators import structural as S
from insightspark.operators.profile import completeness_profile, profile_columns

ORDER = "order_id long, user_id long, order_date timestamp, amount double, status string"


@pytest.fixture(scope="module")
def dirty(spark):
    """100 orders: 10 NULL users, 10 NULL dates, odd amounts, one repeated id."""
    base = dt.datetime(2024, 1, 1)
    data = []
    for i in range(100):
        amount = {0: -10.0, 1: 0.0, 2: 1e7, 3: None, 4: None}.get(i, 50.0 + i)
        data.append((95 if i == 99 else i, None if 10 <= i < 20 else i % 7, None if 20 <= i < 30 else base + dt.timedelta(hours=4 * i), amount, "completed"))
    return spark.createDataFrame(data, ORDER)


def by(df, key="check_name"):
    return {r[key]: r for r in rows(df)}


def test_primary_key(dirty):
    got = by(S.primary_key(dirty, ["order_id"]))
    assert got["primary_key_duplicates"]["value"] == 1 and got["primary_key_duplicates"]["severity"] == "BLOCKER"
    assert got["primary_key_nulls"]["severity"] == "PASS"
    assert by(S.primary_key(dirty, ["user_id"]))["primary_key_nulls"]["value"] == 10


def test_completeness_levels(dirty):
    got = by(S.completeness(dirty, ["order_id", "user_id", "amount", "nope"]), "subject")
    assert got["order_id"]["severity"] == "PASS"
    assert got["user_id"]["severity"] == "WARNING" and got["user_id"]["value"] == pytest.approx(0.1)
    assert got["amount"]["ok"] and got["nope"]["severity"] == "BLOCKER"


def test_completeness_of_an_empty_frame_warns_but_is_ok(dirty):
    got = rows(S.completeness(dirty.where("false"), ["order_id"]))[0]
    assert got["ok"] and got["severity"] == "WARNING"


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert rows(profile_columns(df))[0]["null_count"] == 2
    assert rows(completeness_profile(df))[0]["null_count"] == 2


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    r = rows(profile_columns(df))[0]
    assert r["null_pct"] == 100.0 and r["n_unique"] == 0 and r["mean_value"] is None
    assert rows(completeness_profile(df))[0]["status"] == "CRITICAL"


def test_referential_integrity_bands(spark):
    parent = spark.range(100).withColumnRenamed("id", "k")
    few = spark.range(0, 102).withColumnRenamed("id", "k")
    many = spark.range(0, 200).withColumnRenamed("id", "k")
    assert rows(S.referential_integrity(few, "k", parent, "k"))[0]["severity"] == "WARNING"
    assert rows(S.referential_integrity(many, "k", parent, "k"))[0]["severity"] == "BLOCKER"
    assert rows(S.referential_integrity(parent, "k", parent, "k"))[0]["severity"] == "PASS"


def series(spark, values):
    base = dt.date(2024, 1, 1)
    return spark.createDataFrame([(base + dt.timedelta(days=i), v) for i, v in enumerate(values)], "d date, v double")


@pytest.mark.parametrize("values, severity", [([1, 1.1, 1.2], "PASS"), ([1, 2, 2], "WARNING"), ([1, 2, 4, 8], "BLOCKER"), ([0, 1, 1], "WARNING"), ([5], "PASS")])
def test_trend_continuity(spark, values, severity):
    assert rows(L.trend_continuity(series(spark, [float(v) for v in values]), "d", "v"))[0]["severity"] == severity


def test_monotonic_first_violation(spark):
    r = rows(L.monotonic(series(spark, [1.0, 2.0, 1.5, 3.0, 3.0]), "d", "v"))[0]
    assert r["value"] == 1 and r["detail"] == "2024-01-03"
    assert rows(L.monotonic(series(spark, [1.0, 2.0, 1.5, 3.0, 3.0]), "d", "v", strict=True))[0]["value"] == 2


def test_temporal_consistency_ignores_first_and_last_zero(spark):
    df = series(spark, [0.0] + [1.0] * 18 + [0.0])
    assert {r["severity"] for r in rows(L.temporal_consistency(df, "d", "v"))} == {"PASS"}
    gap = df.where("d <> '2024-01-05'")
    got = by(L.temporal_consistency(gap, "d", "v"))
    assert got["temporal_missing"]["value"] == 1 and got["temporal_missing"]["severity"] == "WARNING"


def test_segment_exhaustive_counts_null_segments(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 1.0)], "s string, v double")
    r = rows(L.segment_exhaustive(df, "s", "v"))[0]
    assert r["severity"] == "BLOCKER" and r["detail"] == "1"


def test_aggregation_by_group_missing_side(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    s = spark.createDataFrame([("a", 1.0), ("c", 5.0)], "g string, v double")
    assert {r["g"]: r["severity"] for r in rows(L.aggregation_by_group(d, s, ["g"], "v"))} == {"b": "BLOCKER", "c": "BLOCKER"}


def test_ranges_report_every_rule(dirty):
    got = by(B.ranges(dirty, [{"column": "amount", "min": 0, "max": 1e6, "label": "Amount"}, {"column": "gone", "min": 0, "max": 1, "label": "Gone"}]), "subject")
    assert got["Amount"]["severity"] == "WARNING" and got["Amount"]["detail"] == "2" and got["Gone"]["severity"] == "WARNING"


def test_metric_expression_is_restricted(spark):
    m = spark.createDataFrame([(10.0, 2.0, 5.0, 0.0)], "a double, b double, c double, z double")
    got = by(B.metric_relationships(m, [("ok", "b * c", "a"), ("skip", "x / a", "1"), ("zero", "a / z", "1")]), "subject")
    assert got["ok"]["ok"] and "skip" not in got and got["zero"]["value"] == 0.0
    with pytest.raises(ValueError):
        B.metric_expr("a; drop table x", ["a"])
    with pytest.raises(KeyError):
        B.metric_expr("current_user()", ["a"])


@pytest.mark.parametrize("cur, prior, severity", [(100, 100, "PASS"), (250, 100, "WARNING"), (400, 100, "BLOCKER"), (5, 0, "BLOCKER"), (0, 0, "PASS")])
def test_yoy(spark, cur, prior, severity):
    df = spark.createDataFrame([(2023, float(prior)), (2024, float(cur))], "y int, v double")
    assert rows(B.yoy(df, [], "y", "v"))[0]["severity"] == severity


def test_outlier_edges(spark):
    f = lambda vs: spark.createDataFrame([(float(v),) for v in vs], "v double")
    assert rows(Q.outliers(f([1, 2, 3]), "v"))[0]["severity"] == "WARN"
    assert rows(Q.outliers(f([2] * 10), "v"))[0]["severity"] == "PASS"
    assert rows(Q.outliers(f(list(range(20)) + [1000] * 2), "v"))[0]["severity"] == "WARN"


def test_gap_tolerance_drops_single_gaps(spark):
    df = series(spark, [1.0] * 30).where("d NOT IN ('2024-01-05', '2024-01-10', '2024-01-11')")
    r = rows(Q.temporal_coverage(df, "d"))[0]
    assert r["value"] == 90.0 and r["detail"] == "1" and r["severity"] == "FAIL"


def test_safe_wrapper_gives_an_error_row(dirty):
    r = rows(Q.safe(S.primary_key)(dirty, ["missing"]))[0]
    assert r["severity"] == "ERROR" and not r["ok"]


def test_run_logical_needs_a_check(dirty):
    assert not rows(L.run_logical(dirty, {}))[0]["ok"]


def test_shared_scan_reads_the_table_once(dirty):
    plan = S.run_structural(dirty, {"columns": ["order_id"], "domains": {"status": ["completed"]}})
    kinds = [r["check_name"] for r in rows(plan)]
    assert {"schema", "completeness", "row_count", "domain_values"} <= set(kinds)
    assert F is not None
