"""Readers, writers, fallbacks and late data on a stream."""

import pytest
from pyspark.sql import types as T

from insightspark.session import work_path
from insightspark.sources import tables as S


def test_missing_table_lists_what_is_there(spark, tables):
    folder = work_path(spark, "csv-test")
    S.write_table(tables.region, f"{folder}/region.csv", "csv")
    with pytest.raises(S.TableNotFound, match="region"):
        S.read_table(spark, "nope", folder)
    assert S.read_table(spark, "region", folder).count() == 5


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        S.read_source(spark, "/tmp/file.xyz")


def test_bad_log_lines_are_skipped(spark):
    path = work_path(spark, "log-test")
    spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ("plain",)], "v string").write.text(path)
    got = S.read_log(spark, path, T.StructType([T.StructField("a", T.LongType())]))
    assert [r["a"] for r in got.collect()] == [1]


def test_fallback_reports_the_source(spark, tables):
    label, df = S.first_available([("warehouse", lambda: spark.table("nowhere")), ("files", lambda: tables.nation)])
    assert label == "files" and df.count() == 25
    with pytest.raises(S.TableNotFound):
        S.first_available([("warehouse", lambda: spark.table("nowhere"))])


def test_preview_truncation(spark):
    df = spark.range(1000)
    assert S.preview(df, 100).count() == 100
    assert S.preview(df, 100).first()["truncated"]
    assert S.preview(df, 400, max_chars=10).count() == 100
    assert not S.preview(spark.range(3), 10).first()["truncated"]


def test_jdbc_partitioning_needs_bounds(spark):
    with pytest.raises(ValueError):
        S.read_jdbc(spark, "jdbc:x", "t", partition_column="id")


def test_late_rows_are_counted(spark, small):
    from insightspark.plans.catalog import queries

    r = queries()["st8_late_data"](spark, small).first()
    assert r["dropped_rows"] > 0 and r["input_rows"] > r["dropped_rows"]


def test_root_cause_search_finds_the_planted_segment(spark, small):
    from insightspark.plans.catalog import queries

    got = {(r["dimension"], r["top_value"]) for r in queries()["y24_root_cause_loop"](spark, small).collect()}
    assert ("c_mktsegment", "MACHINERY") in got and ("o_orderpriority", "1-URGENT") in got
