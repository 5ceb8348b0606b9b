"""Structured Streaming operators and a small runner for bounded runs.

Every function takes a streaming DataFrame with an event-time column of type
timestamp and returns a streaming DataFrame, unless it says otherwise.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from insightspark.functions.checks import check_row, emit
from insightspark.functions.columns import ratio
from insightspark.session import work_path
from insightspark.sources.tables import is_file

N = lambda: F.count(F.lit(1))
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str | None = "ts", **options) -> DataFrame:
    """Parquet files as a stream; the event time becomes a timestamp, which watermarks need.

    A single file is read as its folder with a name filter, since file streams
    watch folders.
    """
    reader = spark.readStream.schema(schema)
    if is_file(spark, path):
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.parquet(path)
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if ts else df


def run_available(stream: DataFrame, label: str, mode: str = "append", out: str | None = None) -> DataFrame:
    """Process what is there, write it to the shared folder and return it as a batch."""
    spark = stream.sparkSession
    out, ckpt = out or work_path(spark, f"{label}-out"), work_path(spark, f"{label}-ckpt")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, label: str, fn, mode: str = "update"):
    """Run ``fn(batch, batch_id)`` per micro-batch until the source is drained; returns the finished query."""
    spark = stream.sparkSession
    spark.conf.set(PROGRESS, 2**31 - 1)  # one small object for each micro-batch of the bounded run; the default forgets all but the last 100
    q = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", work_path(spark, f"{label}-ckpt"))
         .outputMode(mode).trigger(availableNow=True).start())
    spark.conf.unset(PROGRESS)
    q.awaitTermination()
    return q


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", late: str = "2 hours", user: str | None = None) -> DataFrame:
    """Events (and about how many users) per closed window."""
    aggs = [N().alias("n")] + ([F.approx_count_distinct(user, 0.02).alias("approx_users")] if user else [])
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[c for c in g.columns if c in ("n", "approx_users")])


def sliding_rate(events: DataFrame, ts: str, hit, width: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Share of rows that meet ``hit`` in overlapping windows."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w")).agg(N().alias("n"), F.count_if(hit).alias("hits"))
    return g.select(F.col("w.start").alias("window_start"), "n", "hits", ratio("hits", "n").alias("rate"))


def session_windows(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Closed sessions per user."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(N().alias("n_events"))
    return g.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def deduplicate(events: DataFrame, ts: str, key: str, late: str = "2 hours") -> DataFrame:
    """First arrival per key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def interval_join(left: DataFrame, right: DataFrame, user: str, lts: str, rts: str, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Right rows within ``within`` after a left row of the same user; state on both sides is bounded by the watermarks."""
    l, r = left.withWatermark(lts, late), right.withWatermark(rts, late)
    cond = (F.col(f"l.{user}") == F.col(f"r.{user}")) & (F.col(f"r.{rts}") >= F.col(f"l.{lts}")) & (F.col(f"r.{rts}") <= F.col(f"l.{lts}") + F.expr(f"INTERVAL {within}"))
    return l.alias("l").join(r.alias("r"), cond)


def per_user_state(events: DataFrame, user: str, ts: str, label: str, idle: str = "14 days", slot: str = "1 hour", late: str = "2 hours", folder: str | None = None) -> DataFrame:
    """Count, first and last time per user from keyed state that expires; drains the stream and returns (user, n_events, first_seen, last_seen, n_expired).

    Events are summed per user and ``slot`` by Spark's own aggregate, with its map-side combine, so that a hot user is one row per task and slot. Closed slots
    go to one value per user in the state store, with a timer ``idle`` after the user's last event: when the watermark passes it, the value leaves
    the state and becomes a row of ``folder``/expired; a user who comes back starts a new one. The result folds the open slots and the values,
    both read from the state store of the checkpoint, with what has expired. Called again with the same ``folder``, the stream goes on after
    the files it has read. Rows behind the watermark (``late``) are dropped, rows without a time are left out; NULL users share a state.
    """
    spark = events.sparkSession
    folder = folder or work_path(spark, label)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    out = T.StructType([T.StructField("k", events.schema[user].dataType), T.StructField("n", T.LongType()), T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType())])

    class Seen(StatefulProcessor):
        def init(self, handle):
            self.handle, self.seen = handle, handle.getValueState("seen", "n long, first_us long, last_us long")

        def handleInputRows(self, key, rows, timerValues):
            old = self.seen.get() if self.seen.exists() else None
            n, first, last = old or (0, 2**63 - 1, -(2**63))
            for frame in rows:
                n, first, last = n + int(frame["n"].sum()), min(first, int(frame["first_us"].min())), max(last, int(frame["last_us"].max()))
            self.seen.update((n, first, last))
            if old is None or last > old[2]:
                if old is not None:
                    self.handle.deleteTimer(old[2] // 1000 + wait)
                self.handle.registerTimer(last // 1000 + wait)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            n, first, last = self.seen.get()
            self.seen.clear()
            yield pd.DataFrame({"k": pd.Series([key[0]], dtype=object), "n": [n], "first_us": [first], "last_us": [last]})

        def close(self):
            pass

    us = F.unix_micros("at")
    slots = (events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(F.col(ts).alias("at"), F.col(user).alias("k")).groupBy(F.window("at", slot).alias("w"), "k")
             .agg(F.sum(F.lit(1)).alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us")))
    # the columns that the processor sees must not begin with an underscore
    gone = (slots.select("k", "n", "first_us", "last_us", F.window_time("w").alias("closed_at"))
            .groupBy("k").transformWithStateInPandas(Seen(), out, "Append", "EventTime"))
    with rocksdb_state(spark):
        q = (gone.writeStream.format("parquet").option("path", f"{folder}/expired").option("checkpointLocation", f"{folder}/checkpoint")
             .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    held = spark.read.format("state-metadata").load(f"{folder}/checkpoint")
    ids = {r["operatorName"]: r["operatorId"] for r in held.select("operatorName", "operatorId").distinct().collect()}  # two rows
    state = lambda op: spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("operatorId", ids[op])
    parts = [
        state("stateStoreSave").load().select("key.k", F.col("value.sum").alias("n"), F.col("value.min").alias("first_us"), F.col("value.max").alias("last_us"), F.lit(False).alias("gone")),
        state("transformWithStateInPandasExec").option("stateVarName", "seen").load().select("key.k", "value.*", F.lit(False).alias("gone")),
        spark.read.schema(out).parquet(f"{folder}/expired").withColumn("gone", F.lit(True))]
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("k").alias(user)).agg(
        F.sum("n").alias("n_events"), F.timestamp_micros(F.min("first_us")).alias("first_seen"), F.timestamp_micros(F.max("last_us")).alias("last_seen"),
        F.coalesce(F.sum(F.when(F.col("gone"), F.col("n"))), F.lit(0)).alias("n_expired"))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed state with timers needs; the session's setting comes back after it."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def with_thresholds(events: DataFrame, thresholds: DataFrame, key: str, value: str, limit: str) -> DataFrame:
    """Stream rows above the limit of a static table."""
    return events.join(thresholds, key).where(F.col(value) > F.col(limit))


def status_changes(statuses: DataFrame) -> DataFrame:
    """FIRED and RECOVERED notices from (alert, dim1, window_start, status) rows on a stream.

    State is the last window and its status per (alert, dim1): low volume by
    construction, since the input is one row per alert and window. A window that is
    not newer than the last one seen changes nothing. Spark allows no such state behind a
    streaming aggregate, so the windows come from the table another stream wrote.
    """
    out = T.StructType([T.StructField("alert", T.StringType()), T.StructField("dim1", T.StringType()), T.StructField("window_start", T.TimestampType()), T.StructField("notice", T.StringType())])
    state = T.StructType([T.StructField("last", T.StringType()), T.StructField("at", T.LongType())])

    def step(key, frames, st: GroupState):
        last, seen = st.get if st.exists else ("PASS", -(2**63))
        rows = pd.concat(list(frames)).sort_values("window_start")
        notes = []
        for at, status in zip(rows["window_start"], rows["status"]):
            if at.value <= seen:
                continue
            seen = at.value
            if status != last:
                notes.append((at, "FIRED" if status == "FAIL" else "RECOVERED"))
            last = status
        st.update((last, seen))
        if notes:
            yield pd.DataFrame({"alert": key[0], "dim1": key[1], "window_start": [n[0] for n in notes], "notice": [n[1] for n in notes]})

    return statuses.groupBy("alert", "dim1").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def dropped_late_rows(stream: DataFrame, label: str) -> DataFrame:
    """Rows that arrived behind the watermark, per run (reads the finished query's progress)."""
    q = run_batches(stream, label, lambda df, i: df.write.format("noop").mode("append").save(), "append")
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    seen = sum(p["numInputRows"] for p in q.recentProgress)
    return stream.sparkSession.createDataFrame([(int(seen), int(dropped))], "input_rows long, dropped_rows long")


def alert_step(changed: DataFrame, before: DataFrame | None, label: str, lower: float, late: str) -> DataFrame:
    """One step of an alert: windows that changed, laid over the open windows of the step before.

    ``changed`` holds (window_start, window_end, dim1, value) with the whole count of each window so far; ``before`` is the result of the step before
    (None: there is none). Phase 'open' windows may still change. Phase 'closed' windows end ``late`` before the newest window of the step before:
    rows for them would be dropped from now on, so their notice is final. Phase 'carried' is the last closed window of each dimension value, kept as the
    status that the next one is compared with. Size and work follow the windows within ``late`` and those that changed, not the age of the stream.
    """
    new = changed.select("window_start", "window_end", "dim1", "value", F.lit(False).alias("carried"))
    if before is None:
        rows, limit = new, F.lit(None).cast("timestamp")
    else:
        settled = F.col("phase") != "open"
        last = W.partitionBy("dim1", settled).orderBy(F.desc("window_start"))
        old = before.withColumn("_r", F.row_number().over(last)).where((F.col("phase") == "open") | (F.col("_r") == 1))
        rows = new.unionByName(old.select("window_start", "window_end", "dim1", "value", settled.alias("carried")))
        limit = before.agg((F.max("window_start") - F.expr(f"INTERVAL {late}")).alias("limit")).scalar()
    # a count only grows, so the largest is the newest
    rows = rows.groupBy("dim1", "window_start", "window_end").agg(F.max("value").alias("value"), F.bool_or("carried").alias("carried"))
    rows = rows.withColumn("status", F.when(F.col("value") < lower, "FAIL").otherwise("PASS"))
    previous = F.coalesce(F.lag("status").over(W.partitionBy("dim1").orderBy("window_start")), F.lit("PASS"))
    notice = F.when((F.col("status") != previous) & ~F.col("carried"), F.when(F.col("status") == "FAIL", "FIRED").otherwise("RECOVERED"))
    phase = F.when(F.col("carried"), "carried").when(F.col("window_end") <= limit, "closed").otherwise("open")
    return rows.select(F.lit(label).alias("alert"), "window_start", "window_end", "dim1", "value", "status", notice.alias("notice"), phase.alias("phase"))


def alert_stream(events: DataFrame, ts: str, dim: str, label: str, lower: float, width: str = "1 hour", late: str = "2 hours", folder: str | None = None) -> DataFrame:
    """Counts per window and dimension value, judged per micro-batch; returns the notices so far.

    The counts are kept by Spark's state store, which gives every batch the windows it changed and forgets those behind the watermark.
    :func:`alert_step` lays them over the step before, and its result is stored by batch id: a replayed batch reads the same step before and overwrites
    its own folder, so it changes nothing. Final notices come from all steps, those of open windows from the last one. Called again with the
    same ``folder``, the stream goes on after the files it has read.
    """
    spark = events.sparkSession
    folder = folder or work_path(spark, label)
    steps = f"{folder}/steps"
    w = F.window(ts, width)
    counts = events.withWatermark(ts, late).groupBy(w.alias("w"), F.col(dim).cast("string").alias("dim1")).agg(N().alias("value"))

    def evaluate(batch: DataFrame, batch_id: int):
        before = batch.sparkSession.read.parquet(f"{steps}/batch_id={batch_id - 1}") if batch_id else None
        alert_step(batch, before, label, lower, late).write.mode("overwrite").parquet(f"{steps}/batch_id={batch_id}")

    changed = counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "dim1", "value")
    q = (changed.writeStream.foreachBatch(evaluate).option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    done = spark.read.option("basePath", steps).parquet(steps)
    last = done.agg(F.max("batch_id")).scalar()
    final = (F.col("phase") == "closed") | ((F.col("phase") == "open") & (F.col("batch_id") == last))
    return done.where(F.col("notice").isNotNull() & final).select("alert", "window_start", "dim1", "value", "notice")


def quality_stream(events: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Row and NULL counts of every micro-batch, stored by batch id, as check rows; a replayed batch overwrites its own."""
    spark, path = events.sparkSession, work_path(events.sparkSession, f"{label}-quality")
    obs = [N().alias("n")] + [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]

    def store(batch: DataFrame, batch_id: int):
        batch.agg(*obs).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    run_batches(events, label, store, "append")
    seen = spark.read.schema("n long, " + ", ".join(f"null_{c} long" for c in columns) + ", batch_id long").option("recursiveFileLookup", True).parquet(path).where("n > 0")
    checks = [check_row("stream_nulls", c, F.col(f"null_{c}") <= 0.2 * F.col("n"), F.when(F.col(f"null_{c}") > 0.2 * F.col("n"), "FLAG").otherwise("PASS"), F.col(f"null_{c}"), "0.2", F.col("n")) for c in columns]
    return emit(seen, [check_row("stream_rows", "*", F.col("n") > 0, F.when(F.col("n") > 0, "PASS").otherwise("HALT"), F.col("n"), ">0"), *checks], ("batch_id",))
