"""Paradox, scoring, statistics, forecasts, text and alerts on frames with known answers."""

import datetime as dt
import re

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from insightspark.operators import alerts as A
from insightspark.operators import cohorts as C
from insightspark.operators import forecast as FC
from insightspark.operators import paradox as P
from insightspark.operators import product as PR
from insightspark.operators import scoring as SC
from insightspark.operators import series as X
from insightspark.operators import statistics as ST
from insightspark.operators import textlogs as TL
from insightspark.plans.textlogs import ALIASES


def admissions(spark, cells):
    data = [(g, d, 1 if i < k else 0) for (d, g, k, n) in cells for i in range(n)]
    return spark.createDataFrame(data, "grp string, department string, admitted int")


def test_known_paradox(spark):
    df = admissions(spark, [("A", "A", 80, 100), ("A", "B", 46, 60), ("B", "A", 20, 100), ("B", "B", 3, 20)])
    r = rows(P.simpsons(df, "admitted", ["department"], "grp"))[0]
    # group A leads in both departments; overall A 50.0 % against B 61.25 %
    assert r["value_a"] == pytest.approx(0.5) and r["value_b"] == pytest.approx(0.6125)
    assert r["paradox_detected"] and r["n_reversals"] == 2 and r["severity"] == "high"


def test_no_paradox_and_one_sided_segment(spark):
    df = admissions(spark, [("A", "X", 35, 50), ("A", "Y", 15, 50), ("B", "X", 34, 50), ("B", "Y", 16, 50), ("C", "X", 5, 10)])
    r = rows(P.simpsons(df, "admitted", ["department"], "grp"))[0]
    assert not r["paradox_detected"] and r["n_segments"] == 2 and r["severity"] == "none"


def test_tied_segment_is_neutral(spark):
    df = admissions(spark, [("A", "X", 32, 40), ("A", "Y", 16, 20), ("B", "X", 1, 10), ("B", "Y", 6, 30)])
    r = rows(P.simpsons(df, "admitted", ["department"], "grp"))[0]
    assert r["n_segments"] == 1


def test_mix_and_rate_add_up(spark):
    df = spark.createDataFrame([("a", "prev", 10.0, 100.0), ("b", "prev", 40.0, 100.0), ("a", "curr", 30.0, 150.0), ("b", "curr", 10.0, 50.0)], "s string, p string, n double, d double")
    got = rows(P.mix_vs_rate(df, "s", "p", "n", "d"))
    assert sum(r["mix_effect"] + r["rate_effect"] for r in got) == pytest.approx(40 / 200 - 50 / 200)


INPUTS = ("run string, null_rate double, structural_severity string, agg_severity string, agg_diff double, missing_dates int, break_count int, trend_blocker boolean, business_severity string, "
          "paradox_count int, paradox_core boolean, row_count long, cv_score int, repro_status string")


@pytest.mark.parametrize("row, score, grade", [
    ((0.0, "PASS", "PASS", 0.0, 0, 0, False, "PASS", 0, True, 50000, 10, "PASS"), 100, "A"),
    ((0.0, "PASS", "PASS", 0.0, 0, 0, False, "PASS", 0, True, 50000, None, None), 100, "C"),        # layers missing: capped
    ((0.5, "BLOCKER", "BLOCKER", 0.2, 9, 3, True, "BLOCKER", 1, True, 10, 0, "FAIL"), 17, "F"),            # 19 of 115 points
    ((None,) * 13, 0, "F"),
])
def test_confidence(spark, row, score, grade):
    df = spark.createDataFrame([("r", *row)], INPUTS)
    r = rows(SC.confidence_score(df, ["run"]))[0]
    assert (r["score"], r["grade"]) == (score, grade)


def test_confidence_from_check_rows(spark):
    cols = "run int, check_name string, subject string, ok boolean, severity string, value double, expected string, detail string"
    row = lambda run, check, severity, value=None, detail=None: (run, check, "x", severity == "PASS", severity, value, None, detail)
    checks = [
        row(1, "completeness", "PASS", 0.0), row(1, "completeness", "WARNING", 0.08), row(1, "primary_key_nulls", "PASS", 0.0), row(1, "referential_integrity", "WARNING", 0.01),
        row(1, "aggregation_total", "PASS", 0.02), row(1, "temporal_missing", "PASS", 0.0), row(1, "trend_continuity", "BLOCKER", 3.0), row(1, "range", "FAIL", 0.5),
        row(1, "simpsons", "WARNING", 1.0), row(1, "simpsons", "PASS", 0.0), row(1, "row_count", "PASS", 1000.0), row(1, "cross_verification", "WARNING", 6.0), row(1, "reproducibility", "WARN"),
        row(2, "completeness", "BLOCKER", None, "missing column"), row(2, "completeness", "WARNING"), row(2, "simpsons", "BLOCKER", 1.0),
        row(3, "temporal_missing", "PASS", 0.0), row(3, "reproducibility", "SKIPPED")]
    got = {(r["run"], r["factor"]): (r["score"], r["status"]) for r in rows(SC.factors_from_checks(spark.createDataFrame(checks, cols), ["run"]))}
    assert {f: got[1, f] for f in SC.FACTOR_MAX} == {
        "data_completeness": (12, "PASS"), "structural_integrity": (10, "WARNING"), "aggregation_consistency": (8, "WARNING"), "temporal_consistency": (3, "BLOCKER"),
        "business_plausibility": (5, "BLOCKER"), "simpsons_paradox_risk": (8, "WARNING"), "sample_size": (5, "WARNING"), "cross_verification": (6, "WARNING"), "reproducibility": (3, "WARNING")}
    assert got[2, "data_completeness"] == (2, "BLOCKER") and got[2, "simpsons_paradox_risk"] == (2, "BLOCKER")
    assert got[3, "temporal_consistency"] == (15, "PASS") and got[3, "reproducibility"] == (5, "PASS")
    assert got[2, "structural_integrity"] == got[3, "data_completeness"] == (0, "MISSING")
    score = {r["run"]: r for r in rows(SC.score_from_checks(spark.createDataFrame(checks, cols), ["run"]))}
    assert (score[1]["score"], score[1]["grade"], score[1]["partial"]) == (52, "D", False) and score[3]["grade"] == "C" and score[3]["score"] == 100
    assert rows(SC.factors_from_checks(spark.createDataFrame([], cols), ["run"])) == []



def findings(spark, data):
    cols = "finding_id long, metric_name string, direction string, affected_pct double, confidence double, description string, category string, metric_value double, baseline_value double, actionable boolean, p_value double, effect_size double"
    return spark.createDataFrame(data, cols)


def test_finding_ladders(spark):
    f = findings(spark, [(1, "rev", "up", 0.6, 1.0, "checkout funnel", "", 160.0, 100.0, True, 0.01, 0.9), (2, "rev", "down", 0.01, 0.5, "x", "ops", 5.0, 0.0, False, None, None)])
    got = {r["finding_id"]: r for r in rows(SC.theme(SC.score_findings(f)))}
    assert [got[1][c] for c in ("magnitude", "breadth", "actionability", "confidence_points", "score")] == [25, 25, 25, 25, 100]
    assert [got[2][c] for c in ("magnitude", "breadth", "actionability", "confidence_points")] == [15, 5, 5, 12]
    assert got[1]["theme"] == "Funnel" and got[2]["theme"] == "Ops"


def test_contradictions_equal_pairwise_count(spark):
    rng = np.random.default_rng(3)
    data = [(i, ["", "rev", "dau", "Rev"][rng.integers(4)], ["up", "down", ""][rng.integers(3)], float(rng.random()), float(rng.random()), "", "", 1.0, 1.0, False, None, None) for i in range(60)]
    want = {}
    for a in data:
        for b in data:
            if a[0] < b[0] and {a[2], b[2]} == {"up", "down"}:
                down = a if a[2] == "down" else b
                if a[1] and b[1] and a[1].lower() == b[1].lower():
                    k = ("opposite_direction", a[1].lower())
                elif down[3] > 0.20:
                    k = ("segment_decline", None)
                elif a[4] >= 0.8 and b[4] >= 0.8:
                    k = ("confident_opposites", None)
                else:
                    continue
                want[k] = want.get(k, 0) + 1
    got = {(r["kind"], r["metric_name"]): r["n_pairs"] for r in rows(SC.contradictions(findings(spark, data), "finding_id"))}
    assert got == want


def test_welch_and_mann_whitney_by_hand(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "arm string, v double")
    r = rows(ST.welch_t(ST.arm_stats(df, [], "arm", "v", "a", "b")))[0]
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 5
    assert r["t_stat"] == pytest.approx((2.5 - 6) / np.sqrt(va + vb)) and r["diff"] == pytest.approx(3.5)
    assert 0.05 < r["p_value"] < 0.10
    m = rows(ST.mann_whitney(ST.side_counts(df, [], "arm", "v", "a", "b"), []))[0]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert m["u_stat"] == u and m["rank_biserial"] == pytest.approx(1 - 2 * u / 20)


def test_empty_arm_gives_nulls_not_errors(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "arm string, v double")
    s = ST.arm_stats(df, [], "arm", "v", "a", "b")
    assert rows(ST.welch_t(s))[0]["p_value"] is None
    assert rows(ST.proportion_z(s))[0]["z"] is None
    assert rows(ST.mann_whitney(ST.side_counts(df, [], "arm", "v", "a", "b"), []))[0]["rank_biserial"] is None
    assert rows(ST.mean_ci(df.where("false"), [], "v"))[0]["ci_low"] is None
    assert rows(ST.normality(df, [], "v"))[0]["p_value"] is None


def test_bootstrap_interval_matches_normal_theory(spark):
    df = spark.range(20000).select("id", (F.rand(3) * 10).alias("v"))
    r = rows(ST.bootstrap_mean_ci(df, "id", "v", replicates=400))[0]
    se = 10 / np.sqrt(12) / np.sqrt(20000)
    assert r["boot_se"] == pytest.approx(se, rel=0.15)
    assert r["ci_low"] < r["estimate"] < r["ci_high"]
    again = rows(ST.bootstrap_mean_ci(df.repartition(7), "id", "v", replicates=400))[0]
    assert again["ci_low"] == pytest.approx(r["ci_low"], abs=1e-9)


def test_bootstrap_median(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("v"))
    r = rows(ST.bootstrap_quantile_ci(df, "v"))[0]
    assert r["estimate"] == 5000 and r["ci_low"] == pytest.approx(5000 - 98, abs=2) and r["ci_high"] == pytest.approx(5000 + 98, abs=2)


def test_p_adjustment(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "id int, p double")
    got = {r["id"]: r for r in rows(ST.adjust_pvalues(df, "p", "id"))}
    assert [got[i]["benjamini_hochberg"] for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.02])
    assert [got[i]["holm"] for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])


def test_smoothing_modes():
    y = [10.0, 12.0, 11.0, 15.0]
    state, _, _ = FC.smooth(y, 0.5, mode="reference")
    assert state.tolist() == [10.0, 11.0, 11.0, 13.0]
    ahead, _, _ = FC.smooth(y, 0.5)
    assert ahead.tolist() == [10.0, 10.0, 11.0, 11.0]
    trend, _, _ = FC.smooth([1.0, 2.0, 3.0, 4.0], 0.4, beta=0.3, mode="reference")
    assert trend == pytest.approx([1, 2, 3, 4])
    assert FC.best_alpha(np.arange(30.0), mode="reference") > 0.98      # in-sample state always prefers the newest value


def test_seasonal_smoothing_follows_a_cycle():
    y = np.tile([1.0, 5.0, 3.0, 7.0], 10)
    fitted, _, _ = FC.smooth(y, 0.2, beta=0.1, period=4)
    assert np.abs(y - fitted)[8:].max() < 0.6


def test_smoothing_short_and_empty_series(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 1, None)], "k string, i int, v double")
    got = rows(FC.exponential_smoothing(df, ["k"], "i", "v", alpha=0.3))
    assert [(r["k"], r["fitted"]) for r in got] == [("a", 5.0)]


def test_seasonality_found(spark):
    base = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(days=i), float([3, 1, 1, 1, 1, 5, 9][i % 7])) for i in range(70)], "d date, v double")
    r = rows(X.dominant_period(df, [], "d", "v"))[0]
    assert r["dominant_period"] == 7 and r["label"] == "strong"
    flat = df.withColumn("v", F.lit(1.0))
    assert rows(X.dominant_period(flat, [], "d", "v"))[0]["label"] == "none"


def test_control_chart_rules(spark):
    vals = [0.0] * 10 + [1.0, -1.0] * 5 + [50.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = rows(X.control_chart(df, [], "i", "v"))
    assert ("beyond_limit", 20) in {(r["rule"], r["i"]) for r in got}
    assert any(r["rule"] == "8_one_side" for r in got)
    const = df.withColumn("v", F.lit(2.0))
    assert rows(X.control_chart(const, [], "i", "v")) == []


def test_unreached_cohort_cells_are_null(spark):
    data = [(1, "2024-01-05"), (1, "2024-03-02"), (2, "2024-02-01"), (3, "2024-03-01")]
    df = spark.createDataFrame(data, "u long, d string").withColumn("d", F.to_date("d"))
    got = {(str(r["cohort"]), r["offset"]): r["retention"] for r in rows(C.retention_matrix(df, "u", "d", max_offset=3))}
    assert got[("2024-01-01", 0)] == 1.0 and got[("2024-01-01", 1)] == 0.0 and got[("2024-01-01", 2)] == 1.0
    assert got[("2024-03-01", 1)] is None and got[("2024-02-01", 2)] is None


def test_dx_retention_counts_mature_users_only(spark):
    data = [(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-04"), (None, "2024-01-01")]
    df = spark.createDataFrame(data, "u long, d string").withColumn("d", F.to_date("d"))
    got = rows(C.dx_retention(C.user_days(df, "u", "d"), [1, 3], "2024-01-05"))
    assert [(r["offset"], r["mature_users"], r["retained"]) for r in got] == [(1, 1, 1), (3, 1, 0)]


def test_sessions_of_a_hot_user_across_midnight(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 50)
    data = [(1, i, t0 + dt.timedelta(minutes=10 * i)) for i in range(12)] + [(1, 99, t0 + dt.timedelta(hours=5))]
    df = spark.createDataFrame(data, "u long, e long, ts timestamp")
    got = rows(PR.sessionize(df, "u", "ts", "e"), "session_no")
    assert [r["n_events"] for r in got] == [12, 1]


def test_entity_tagging_equals_brute_force(spark, tables):
    docs = tables.documents.select("doc_id", "text")
    got = {}
    for r in TL.entity_tagging(docs, "doc_id", "text", ALIASES).collect():
        got.setdefault(r["doc_id"], []).append(r["alias"])
    for d in docs.collect():
        low, taken, want = (d["text"] or "").lower(), [], []
        for a in sorted((x["alias"] for x in ALIASES), key=len, reverse=True):
            for m in re.finditer(r"\b" + re.escape(a) + r"\b", low):
                if not any(m.start() < e and m.end() > s for s, e in taken):
                    taken.append(m.span())
                    want.append(a)
        assert sorted(got.get(d["doc_id"], [])) == sorted(want), d["doc_id"]


def test_entity_tagging_prefers_the_longer_alias(spark):
    aliases = [{"alias": "new york", "entity": "ny", "type": "place"}, {"alias": "york city hall", "entity": "hall", "type": "place"}]
    df = spark.createDataFrame([(1, "New York City Hall"), (2, "new york, york")], "id long, t string")
    got = [(r["id"], r["alias"]) for r in rows(TL.entity_tagging(df, "id", "t", aliases), "id")]
    assert got == [(1, "york city hall"), (2, "new york")]


def test_claims_match_within_tolerance(spark):
    e = spark.createDataFrame([("q1", 100.05, []), ("q2", -100.0, []), ("q3", 7.0, [3]), ("q4", 100.0999, [])], "query_id string, result_value double, claim_ids array<bigint>")
    c = spark.createDataFrame([(1, 100.0), (2, 0.0), (3, 100.0), (4, None)], "claim_id long, value double")
    got = {r["claim_id"]: (r["n_matches"], r["method"]) for r in rows(TL.match_claims(e, c))}
    assert got == {1: (2, "value"), 2: (0, "none"), 3: (1, "explicit"), 4: (0, "none")}


def test_alert_expressions_are_checked():
    with pytest.raises(ValueError):
        A.checked_expr("sum(secret)", ["revenue"])
    with pytest.raises(ValueError):
        A.checked_expr("java_method('x', 'y')", ["revenue"])


def test_relative_threshold_sides(spark):
    base = dt.date(2024, 1, 1)
    v = spark.createDataFrame([("a", base + dt.timedelta(days=i), None, None, x) for i, x in enumerate([100.0, 100.0, 100.0, 80.0, 130.0])], "alert string, validation_date date, dim1 string, dim2 string, value double")
    for rel, want in (("10", ["FAIL", "FAIL"]), ("10-", ["FAIL", "PASS"]), ("10+", ["PASS", "FAIL"])):
        d = A.definitions(spark, [A.Alert("a", "sum(x)", relative=rel, data_points=3)])
        got = [r["status"] for r in rows(A.relative_status(v, d), "validation_date")]
        assert got == ["INSUFFICIENT"] * 3 + want


def test_recovery_fires_once(spark):
    base = dt.date(2024, 1, 1)
    s = spark.createDataFrame([("a", base + dt.timedelta(days=i), "x", None, 1.0, st) for i, st in enumerate(["PASS", "FAIL", "FAIL", "PASS", "PASS"])],
                              "alert string, validation_date date, dim1 string, dim2 string, value double, status string")
    assert [r["notice"] for r in rows(A.recovery_filter(s), "validation_date")] == ["FIRED", "RECOVERED"]
