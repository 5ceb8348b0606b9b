"""State that expires, streams that go on after what they have read, replayed batches."""

import glob
import os
from datetime import datetime, timedelta

import pytest

from helpers import rows
from insightspark.session import work_path
from insightspark.streaming import streams as S

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id string, kind string, ts timestamp_ntz"


@pytest.fixture(autouse=True)
def few_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(spark, path, events):
    data = [(i, u, k, START + timedelta(hours=h)) for i, u, k, h in events]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return S.read_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, maxFilesPerTrigger=1)


def test_idle_users_leave_the_state_and_come_back(spark):
    path, folder = work_path(spark, "in"), work_path(spark, "users")
    run = lambda: {r["user_id"]: (r["n_events"], r["n_expired"], round((r["last_seen"] - START).total_seconds() / 3600, 2)) for r in rows(
        S.per_user_state(stream(spark, path), "user_id", "ts", "users", idle="2 days", folder=folder))}
    put(spark, path, [(1, "idle", "a", 0), (2, "idle", "a", 1), (3, "busy", "a", 1), (4, None, "a", 2)] + [(10 + i, "busy", "a", 2 + i / 100) for i in range(50)])
    assert run() == {"idle": (2, 0, 1), "busy": (51, 0, 2.49), None: (1, 0, 2)}
    put(spark, path, [(5, "busy", "a", 40), (6, "new", "a", 41)])
    assert run() == {"idle": (2, 0, 1), "busy": (52, 0, 40), None: (1, 0, 2), "new": (1, 0, 41)}
    put(spark, path, [(7, "new", "a", 80)])
    assert run() == {"idle": (2, 2, 1), "busy": (52, 0, 40), None: (1, 1, 2), "new": (2, 0, 80)}
    live = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "seen").load()
    assert {r["k"] for r in live.select("key.k").collect()} == {"busy", "new"}
    put(spark, path, [(8, "idle", "a", 81)])
    assert run()["idle"] == (3, 2, 81)
    # four files in four batches that read one each: later runs did not read the earlier ones
    sources = [open(f).read() for f in sorted(glob.glob(f"{folder}/checkpoint/sources/0/[0-9]*"))]
    assert sum(text.count('"path"') for text in sources) == 4


def notices(events, lower):
    """Brute force over all events: (kind, hour, count, notice)."""
    n = {}
    for _, _, k, h in events:
        n[k, int(h)] = n.get((k, int(h)), 0) + 1
    out, last = set(), {}
    for k, h in sorted(n, key=lambda x: x[1]):
        now = n[k, h] < lower
        if now != last.get(k, False):
            out.add((k, h, n[k, h], "FIRED" if now else "RECOVERED"))
        last[k] = now
    return out


def as_set(df):
    return {(r["dim1"], int((r["window_start"] - START).total_seconds() // 3600), r["value"], r["notice"]) for r in rows(df)}


def test_alert_stream_goes_on_and_replays(spark):
    path, folder = work_path(spark, "in"), work_path(spark, "alerts")
    run = lambda: as_set(S.alert_stream(stream(spark, path), "ts", "kind", "low", 2, late="3 hours", folder=folder))
    seen = []
    for day in range(6):
        # the first row of each file is late: it completes the last hour of the file before
        late = [(0, "u", "a", 10 * day - 1)] if day else []
        fresh = [(0, "u", "ab"[(h + day) % 2], 10 * day + h) for h in range(10) for _ in range(1 + (h * 7 + day) % 3)]
        seen += late + fresh
        put(spark, path, late + fresh)
        assert run() == notices(seen, 2)
    steps = sorted(glob.glob(f"{folder}/steps/batch_id=*"), key=lambda p: int(p.rsplit("=", 1)[1]))
    sizes = [spark.read.parquet(p).count() for p in steps]
    assert max(sizes) <= 24 and max(sizes[-3:]) <= max(sizes[:6])
    before = rows(spark.read.parquet(steps[-1]), "dim1", "window_start")
    log = max(glob.glob(f"{folder}/checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(log)
    crc = os.path.join(os.path.dirname(log), f".{os.path.basename(log)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert run() == notices(seen, 2)
    assert rows(spark.read.parquet(steps[-1]), "dim1", "window_start") == before
    assert run() == notices(seen, 2)


def test_alert_step_keeps_the_last_closed_status(spark):
    make = lambda data: spark.createDataFrame([(START + timedelta(hours=h), START + timedelta(hours=h + 1), k, n) for k, h, n in data], "window_start timestamp, window_end timestamp, dim1 string, value long")
    first = S.alert_step(make([("a", 0, 1), ("a", 1, 5)]), None, "x", 2, "1 hour")
    assert {r["phase"] for r in rows(first)} == {"open"}
    second = S.alert_step(make([("b", 9, 9)]), first, "x", 2, "1 hour")
    assert {(r["dim1"], r["phase"]) for r in rows(second)} == {("a", "open"), ("b", "open")} or [r["phase"] for r in rows(second.where("dim1 = 'a'"), "window_start")][0] == "closed"
    third = S.alert_step(make([]), second, "x", 2, "1 hour")
    assert [r["phase"] for r in rows(third.where("dim1 = 'a'"), "window_start")] in (["carried", "closed"], ["closed", "closed"])
    fourth = S.alert_step(make([("a", 20, 1)]), third, "x", 2, "1 hour")
    got = [(r["phase"], r["notice"]) for r in rows(fourth.where("dim1 = 'a'"), "window_start")]
    assert got == [("carried", None), ("open", "FIRED")]
