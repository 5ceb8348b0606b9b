"""Cases that the given tables do not hold: NULL keys, ties, NaN, long spans, swapped NULLs."""

import builtins
import importlib
import math
import sys

import pytest
from pyspark.sql import functions as F

from insightspark import session
from insightspark.functions.ranks import prefix_totals, quantiles
from insightspark.operators import cohorts, product, verification, windows


def test_checksum_sees_where_a_null_is(spark):
    a = spark.sql("SELECT CAST(NULL AS string) AS x, 'a' AS y")
    b = spark.sql("SELECT 'a' AS x, CAST(NULL AS string) AS y")
    assert verification.table_checksum(a).first() != verification.table_checksum(b).first()
    assert verification.reproducibility([a, b]).first().status == "FAIL"


def test_asof_takes_strictly_earlier_times(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 1, TIMESTAMP '2024-01-01 00:00:00', 5.0), (1, 2, TIMESTAMP '2024-01-01 00:00:00', NULL),
        (1, 3, TIMESTAMP '2024-01-01 02:00:00', NULL), (NULL, 4, TIMESTAMP '2024-01-01 00:00:00', 7.0), (NULL, 5, TIMESTAMP '2024-01-01 00:10:00', NULL), (NULL, 6, NULL, 1.0) AS v(k, id, ts, x)""")
    out = {r.id: r.seen for r in windows.asof(df, ["k"], "ts", ["id"], {"seen": F.col("x")}).collect()}
    assert out == {1: None, 2: None, 3: 5.0, 4: None, 5: 7.0, 6: None}


def test_trailing_hit_sees_the_same_time(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, TIMESTAMP '2024-01-01 00:00:00', 'buy'), (1, 2, TIMESTAMP '2024-01-01 00:00:00', 'view'), (1, 3, TIMESTAMP '2024-01-01 09:00:00', 'buy') AS v(k, id, ts, kind)")
    out = {r.id: r.hit for r in windows.trailing_hit(df, ["k"], "ts", ["id"], F.col("kind") == "view", 3).collect()}
    assert out == {1: True, 2: True, 3: False}


def test_rows_with_null_keys_stay(spark):
    df = spark.sql("SELECT * FROM VALUES (CAST(NULL AS int), 1, TIMESTAMP '2024-01-01 00:00:00'), (NULL, 2, TIMESTAMP '2024-01-01 05:00:00'), (3, 3, NULL) AS v(k, id, ts)")
    out = {r.id: r.n for r in windows.running(df, ["k"], "ts", ["id"], {"n": F.lit(1)}).collect()}
    assert out == {1: 1, 2: 2, 3: 1}
    got = prefix_totals(spark.sql("SELECT * FROM VALUES (NULL, 1.0, 2), (NULL, 3.0, 4), ('a', 1.0, 1) AS v(k, x, n)"), ["k"], "x", {"below": "n"}).collect()
    assert {(r.k, r.x): (r.below, r.below_all) for r in got} == {(None, 1): (0, 6), (None, 3): (2, 6), ("a", 1): (0, 1)}


def test_equal_times_are_one_session(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, TIMESTAMP '2024-01-01 00:00:00'), (1, 2, TIMESTAMP '2024-01-01 00:00:00'), (NULL, 3, TIMESTAMP '2024-01-01 00:00:00') AS v(user_id, id, ts)")
    assert sorted(r.n_events for r in product.sessionize(df, "user_id", "ts", "id").collect()) == [1, 2]


def test_nan_is_missing_in_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (math.nan,)], "x double")
    assert {r.prob: r.quantile for r in quantiles(df, [], "x", [0.5, 1.0]).collect()} == {0.5: 2.0, 1.0: 3.0}


def test_cohorts_reach_as_far_as_the_data(spark):
    months = spark.range(30).select(F.lit(1).alias("u"), F.add_months(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.lit(1.0).alias("v"))
    matrix = cohorts.retention_matrix(months, "u", "d")
    assert matrix.agg(F.max("offset"), F.min("retention")).first() == (29, 1.0)
    assert cohorts.ltv_maturity(cohorts.cohort_ltv(months, "u", "d", "v")).first().final_ltv == 30.0
    assert cohorts.retention_matrix(months, "u", "d", max_offset=5).count() == 6


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        session.shared_root(Fake)


def test_entry_works_without_the_training_data_part(monkeypatch):
    import __spark_entry__ as entry

    real = builtins.__import__
    for name in [m for m in sys.modules if m.startswith("insightspark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    def absent(name, *args):
        if name.startswith("insightspark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", absent)
    names = entry.queries()
    assert "y9_dx_retention" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)


def test_reproducibility_bands(spark):
    a = spark.range(1000)
    judge = lambda *runs, **kw: verification.reproducibility_bands(list(runs), **kw).first().status
    assert judge(a, a.repartition(3)) == "PASS" and judge(a, a, static=True) == "SKIPPED" and judge(a, None) == "FAIL"
    assert judge(a, a.limit(999), tolerance=0.001) == "PASS" and judge(a, a.limit(995), tolerance=0.001) == "WARN" and judge(a, a.limit(900), tolerance=0.001) == "FAIL"
    assert judge(a, a.selectExpr("id + 1 as id"), tolerance=0.5) == "FAIL"


def test_findings_are_as_sure_as_their_test(spark):
    from insightspark.operators.scoring import insight_scan

    rows = spark.range(4000).selectExpr("if(id % 2 = 0, 'curr', 'prev') as period", "'x' as d", "cast(id % 10 as double) as same", "cast(id % 10 + if(id % 2 = 0, 0.5, 0) as double) as moved")
    got = {r.metric_name: r for r in insight_scan(rows.withColumn("same", F.floor(F.rand(1) * 10).cast("double")), ["d"], {"same": "same", "moved": "moved"}, "period").collect()}
    assert got["moved"].p_value < 0.001 < 0.999 < got["moved"].confidence
    assert got["same"].confidence == pytest.approx(1 - got["same"].p_value) and got["same"].confidence < 0.999
