"""Scans, sinks and table metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.plans.registry import query
from insightspark.session import work_path
from insightspark.sources import tables as S

_ORDER_TOTALS = """
SELECT {src} count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
       round(sum(o_totalprice), 2) AS amount
FROM orders {group}"""


def _order_totals(df):
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"),
                  F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query("a1_scan_csv", _ORDER_TOTALS.format(src="", group=""))
def a1(t):
    folder = work_path(t.spark, "csv")
    S.write_table(t.orders, f"{folder}/orders.csv", "csv")
    return _order_totals(S.read_table(t.spark, "orders", folder, t.orders.schema))


@query("a2_scan_file", """
SELECT fmt, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, round(sum(o_totalprice), 2) AS amount
FROM orders, (VALUES ('csv'), ('json'), ('parquet')) f(fmt) GROUP BY fmt""")
def a2(t):
    folder = work_path(t.spark, "formats")
    frames = []
    for fmt in ("csv", "json", "parquet"):
        S.write_table(t.orders, f"{folder}/orders.{fmt}", fmt)
        frames.append(_order_totals(S.read_source(t.spark, f"{folder}/orders.{fmt}", t.orders.schema))
                      .withColumn("fmt", F.lit(fmt)))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]


@query("a4_list_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLES))
def a4(t):
    found = S.list_tables(t.spark, t.folder)
    sizes = [getattr(t, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n in S.table_names(t.spark, t.folder)]
    return found.join(reduce(DataFrame.unionByName, sizes), "table_name")


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("a5_describe", " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS position, '{c}' AS column_name, count({c}) AS filled FROM lineitem" for i, c in enumerate(LINEITEM)))
def a5(t):
    """The schema and, from the table, how many values of each column are filled."""
    names = t.lineitem.columns
    filled = t.lineitem.agg(*[F.count(c).alias(c) for c in names]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in names])))
    return S.describe(t.lineitem).join(filled, "column_name").select("position", "column_name", "filled")


@query("a6_source_fallback", """
SELECT 'files' AS source, count(*) AS n_rows, round(sum(c_acctbal), 2) AS balance FROM customer""")
def a6(t):
    df = S.with_fallback([
        ("warehouse", lambda: t.spark.table("warehouse_db.customer")),
        ("local", lambda: t.spark.table("customer_local_copy")),
        ("files", lambda: t.customer)])
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("a7_scan_jsonl", """
SELECT event_type, count(*) AS n_rows, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def a7(t):
    path = work_path(t.spark, "log")
    cols = ["event_id", "user_id", "event_type", "value"]
    S.append_log(t.events.select(*cols), path)
    t.events.where("event_type = 'error'").select(F.lit('{"event_id": broken').alias("value")).write.mode("append").text(path)
    log = S.read_log(t.spark, path, t.events.select(*cols).schema)
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))


@query("a8_sink_table", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_rows, round(sum(value), 2) AS total
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' GROUP BY 1""")
def a8(t):
    path = work_path(t.spark, "sink")
    S.write_table(t.events.withColumn("day", F.to_date("ts")).repartition("day"), path, partition_by=("day",))
    return (t.spark.read.parquet(path).where("day >= '2024-01-10' AND day < '2024-01-13'")
            .groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 2).alias("total")))


@query("a9_sink_append_log", """
SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys FROM orders""")
def a9(t):
    path = work_path(t.spark, "append")
    keys = t.orders.select("o_orderkey", "o_orderstatus")
    S.append_log(keys.where("o_orderstatus = 'O'"), path)
    S.append_log(keys.where("o_orderstatus <> 'O'"), path)
    return S.read_log(t.spark, path, keys.schema).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"))


@query("a10_row_preview", "SELECT CASE WHEN count(*) > 500 THEN true ELSE false END AS truncated, true AS within FROM lineitem")
def a10(t):
    shown = S.preview(t.lineitem, 500)
    return shown.agg(F.bool_or("truncated").alias("truncated"), (F.count(F.lit(1)) <= 500).alias("within"))


@query("a11_result_estimate", """
SELECT count(*) AS n_rows FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_quantity > 25""")
def a11(t):
    return S.result_estimate(t.lineitem.where("l_shipdate >= '1998-01-01' AND l_quantity > 25"))
