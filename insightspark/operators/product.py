"""Funnels, progression, sessions, economy and engagement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insightspark.functions.columns import clean, ratio, with_totals
from insightspark.functions.ranks import quantiles_wide, running_by_time
from insightspark.operators.windows import by_period
from insightspark.session import cut_lineage

N = lambda: F.count(F.lit(1))


def funnel_times(df: DataFrame, user: str, ts: str, step: str, steps: list[str], within_hours: int | None = None, slot: str = "hour") -> DataFrame:
    """One row per user with the time of every step, each the first event at or after the step before.

    A step that comes later than ``within_hours`` after the one before counts as not reached, and so do all after it.

    Every (user, slot of time) is reduced to an automaton: for each step still waited for at its start, the times of the steps
    that the slot then reaches. These come from one sort of the slot, latest first: an event of a step goes on with the earliest later
    event of the next one. Automata of later slots follow one another, so a user is the fold of small rows in slot order, and a user
    with a third of all events is spread over as many tasks as they have slots.
    """
    last = len(steps)
    number = reduce(lambda acc, i: acc.when(F.col(step) == steps[i], i + 1), range(1, last), F.when(F.col(step) == steps[0], 1))
    rows = df.select(user, F.col(ts).alias("_t"), F.date_trunc(slot, F.col(ts)).alias("_slot"), number.alias("_s")).where(F.col("_s").isNotNull() & F.col("_t").isNotNull() & F.col(user).isNotNull())
    latest_first = W.partitionBy(user, "_slot").orderBy(F.desc("_t")).rangeBetween(W.unboundedPreceding, W.currentRow)
    own = F.array(F.col("_t"))
    rows = rows.withColumn(f"_p{last}", F.when(F.col("_s") == last, own))
    kind = rows.schema[f"_p{last}"].dataType
    for i in range(last - 1, 0, -1):
        onward = F.last(f"_p{i + 1}", ignorenulls=True).over(latest_first)
        rows = rows.withColumn(f"_p{i}", F.when(F.col("_s") == i, F.concat(own, F.coalesce(onward, F.array().cast(kind)))))
    slots = rows.groupBy(user, "_slot").agg(*[F.min_by(f"_p{i}", F.when(F.col("_s") == i, F.col("_t"))).alias(f"_p{i}") for i in range(1, last + 1)])
    path = F.array(*[F.coalesce(f"_p{i}", F.array().cast(kind)) for i in range(1, last + 1)])
    walked = slots.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(F.col("_slot"), path.alias("paths")))).alias("_slots"))  # one small row for each slot of the calendar
    done = F.aggregate("_slots", F.array().cast(kind), lambda acc, s: F.when(F.size(acc) < last, F.concat(acc, F.element_at(s["paths"], F.least(F.size(acc), F.lit(last - 1)) + 1))).otherwise(acc))
    out = walked.select(user, done.alias("_done")).where(F.size("_done") > 0).select(user, *[F.get("_done", F.lit(i - 1)).alias(f"t{i}") for i in range(1, last + 1)])
    if within_hours is not None:
        for i in range(2, last + 1):
            ok = F.col(f"t{i - 1}").isNotNull() & (F.col(f"t{i}") <= F.col(f"t{i - 1}") + F.expr(f"INTERVAL {int(within_hours)} HOURS"))
            out = out.withColumn(f"t{i}", F.when(ok, F.col(f"t{i}")))
    return out


def funnel(times: DataFrame, steps: list[str], keys: list[str] = ()) -> DataFrame:
    """Users, step and total conversion, drop-off and median minutes from the step before."""
    k = list(keys)
    times = cut_lineage(times.select(*k, *[f"t{i}" for i in range(1, len(steps) + 1)]))  # one row for each user, read several times below
    long = times.select(*k, F.inline(F.array(*[
        F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), F.col(f"t{i}").isNotNull().alias("hit"),
                 (F.lit(None).cast("double") if i == 1 else (F.unix_micros(F.col(f"t{i}").cast("timestamp")) - F.unix_micros(F.col(f"t{i - 1}").cast("timestamp"))) / 6e7).alias("minutes"))
        for i, s in enumerate(steps, start=1)])))
    g = long.groupBy(*k, "step_no", "step").agg(F.count_if("hit").alias("users"))
    med = quantiles_wide(long, [*k, "step_no"], "minutes", {"median_minutes": 0.5}, few_groups=not k)
    w = by_period(k, "step_no")
    prev, first = F.lag("users").over(w), F.first("users").over(w.rowsBetween(W.unboundedPreceding, 0))
    g = g.withColumn("step_rate", ratio("users", prev)).withColumn("total_rate", ratio("users", first)).withColumn("lost", prev - F.col("users"))
    whole = W.partitionBy(*k) if k else W.partitionBy(F.lit(0))
    g = g.withColumn("biggest_loss", F.coalesce(F.col("lost") == F.max("lost").over(whole), F.lit(False)))
    g = g.withColumn("worst_rate", F.coalesce(F.col("step_rate") == F.min("step_rate").over(whole), F.lit(False)))
    return g.join(med, [*k, "step_no"], "left")


def same_day_step_rate(df: DataFrame, user: str, ts: str, step: str, a: str, b: str) -> DataFrame:
    """Users at step B over users at step A on the same day, via one row per user-day."""
    d = df.where(F.col(step).isin(a, b)).groupBy(F.to_date(ts).alias("day"), user).agg(F.max(F.col(step) == a).alias("_a"), F.max(F.col(step) == b).alias("_b"))
    g = d.groupBy("day").agg(F.count_if("_a").alias("users_a"), F.count_if(F.col("_a") & F.col("_b")).alias("users_b"))
    return g.withColumn("rate", ratio("users_b", "users_a"))


def levels(df: DataFrame, user: str, ts: str, tie: str) -> DataFrame:
    """Numbered events per user: (user, level, level_time)."""
    r = running_by_time(df.select(user, ts, tie), [user], ts, [tie], {"level": F.lit(1)})
    return r.select(user, F.col("level").cast("long").alias("level"), F.col(ts).alias("level_time"))


def progression(lv: DataFrame, user: str, keys: list[str], days: list[int]) -> DataFrame:
    """Users who start a level and reach the next one within the given days.

    The next level is an equality join on (user, level), unique on both sides.
    """
    nxt = lv.select(user, (F.col("level") - 1).alias("level"), F.col("level_time").alias("_next"))
    j = lv.join(nxt, [user, "level"], "left")
    gap = (F.unix_micros(F.col("_next").cast("timestamp")) - F.unix_micros(F.col("level_time").cast("timestamp"))) / 8.64e10
    g = j.groupBy(*keys, "level").agg(N().alias("users_started"), *[F.count_if(gap <= d).alias(f"progressed_d{d}") for d in days])
    return g.select("*", *[ratio(f"progressed_d{d}", "users_started").alias(f"d{d}_progression") for d in days])


def segment_profile(df: DataFrame, dims: list[str], metric: str) -> DataFrame:
    """Size, share and mean of the metric per segment against the overall mean; ±20 % and small segments flagged."""
    long = df.select(clean(metric).alias("_v"), F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dims])))
    g = long.where("segment IS NOT NULL").groupBy("dimension", "segment").agg(N().alias("n"), F.sum("_v").alias("s"), F.count("_v").alias("c"))
    g = with_totals(g, ["dimension"], {"_n": "n", "_s": "s", "_c": "c"})
    g = g.withColumn("share", ratio("n", "_n")).withColumn("mean", ratio("s", "c")).withColumn("overall", ratio("_s", "_c")).drop("_n", "_s", "_c")
    g = g.withColumn("vs_average_pct", 100.0 * ratio(F.col("mean") - F.col("overall"), F.abs("overall")))
    return g.withColumn("flag", F.abs("vs_average_pct") > 20).withColumn("small", F.col("n") < 100).drop("s", "c")


def driver_correlations(df: DataFrame, outcome: str, drivers: list[str]) -> DataFrame:
    """Drivers ranked by |correlation| with the outcome, from one aggregate."""
    one = df.agg(*[F.corr(clean(d), clean(outcome)).alias(f"c{i}") for i, d in enumerate(drivers)])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(d).alias("driver"), F.col(f"c{i}").alias("r")) for i, d in enumerate(drivers)])))
    return long.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("r")), "driver")))


def top_bottom_difference(df: DataFrame, outcome: str, drivers: list[str], share: float = 0.25) -> DataFrame:
    """Mean of each driver in the top and the bottom part of the outcome."""
    q = quantiles_wide(df.select(clean(outcome).alias("_o")), [], "_o", {"lo": share, "hi": 1 - share}).select(F.struct("lo", "hi")).scalar()
    d = df.withColumn("_q", q).withColumn("_g", F.when(F.col(outcome) <= F.col("_q.lo"), "bottom").when(F.col(outcome) >= F.col("_q.hi"), "top"))
    long = d.where("_g IS NOT NULL").select("_g", F.inline(F.array(*[F.struct(F.lit(x).alias("driver"), clean(x).alias("v")) for x in drivers])))
    g = long.groupBy("driver").agg(F.avg(F.when(F.col("_g") == "top", F.col("v"))).alias("top_mean"), F.avg(F.when(F.col("_g") == "bottom", F.col("v"))).alias("bottom_mean"))
    return g.withColumn("difference", F.col("top_mean") - F.col("bottom_mean"))


def driver_importance(df: DataFrame, outcome: str, drivers: list[str], seed: int = 7) -> DataFrame:
    """Random-forest importance of each driver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    d = df.select(clean(outcome).alias("label"), *[clean(x).alias(x) for x in drivers]).dropna()
    model = RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed).fit(VectorAssembler(inputCols=drivers, outputCol="features").transform(d))
    rows = [(x, float(v)) for x, v in zip(drivers, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "driver string, importance double")


def economy_ratio(ledger: DataFrame, keys: list[str], quantity: str) -> DataFrame:
    """Sources, sinks and their ratio from signed quantities."""
    q = F.col(quantity)
    g = (ledger.groupBy(*keys) if keys else ledger.groupBy()).agg(F.sum(F.when(q > 0, q).otherwise(0.0)).alias("sources"), F.sum(F.when(q < 0, -q).otherwise(0.0)).alias("sinks"))
    return g.withColumn("ratio", ratio("sources", "sinks"))


def economy_curve(ledger: DataFrame, keys: list[str], period: str, quantity: str) -> DataFrame:
    """Running sources over running sinks per period."""
    g = economy_ratio(ledger, [*keys, period], quantity).drop("ratio")
    w = by_period(keys, period).rowsBetween(W.unboundedPreceding, 0)
    return g.select(*keys, period, F.sum("sources").over(w).alias("sources"), F.sum("sinks").over(w).alias("sinks")).withColumn("ratio", ratio("sources", "sinks"))


def milestone_economy(spans: DataFrame, facts: DataFrame, user: str, ts: str, start: str, end: str, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Facts inside each milestone span, summed per ``keys``; the user equality stays the join key."""
    j = facts.join(spans, user).where(F.col(ts).between(F.col(start), F.col(end)))
    return j.groupBy(*keys).agg(N().alias("n_facts"), *[F.sum(c).alias(n) for n, c in aggs.items()])


def event_window_activity(daily: DataFrame, calendar: DataFrame, day: str, group: str, value: str, span: int = 30) -> DataFrame:
    """Value per event, group and offset day around the event start, and pre/post means of the gap.

    ``daily`` is aggregated to (day, group); the calendar is exploded to offset
    days, so the join is an equality on the day.
    """
    off = calendar.select("event", "start", F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("offset")).withColumn(day, F.date_add("start", F.col("offset")))
    return daily.join(off, day).groupBy("event", group, "offset").agg(F.sum(value).alias("value"))


def gap_widening(window: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Mean gap between two groups before and after the event."""
    g = window.groupBy("event", "offset").agg((F.sum(F.when(F.col(group) == a, F.col("value"))) - F.sum(F.when(F.col(group) == b, F.col("value")))).alias("gap"))
    out = g.groupBy("event").agg(F.avg(F.when(F.col("offset") < 0, F.col("gap"))).alias("gap_pre"), F.avg(F.when(F.col("offset") >= 0, F.col("gap"))).alias("gap_post"))
    return out.withColumn("widening", F.col("gap_post") - F.col("gap_pre"))


def lapse_rate(days: DataFrame, as_of: str) -> DataFrame:
    """Share of user-days whose next 7 days have fewer active days than the last 7.

    Days whose next week is not complete are left out.
    """
    n = F.date_diff(F.col("day"), F.lit("1970-01-01").cast("date"))
    w = W.partitionBy("user_id").orderBy(n)
    d = days.select("user_id", "day", N().over(w.rangeBetween(-6, 0)).alias("_b"), N().over(w.rangeBetween(1, 7)).alias("_a"))
    d = d.where(F.date_diff(F.lit(as_of).cast("date"), F.col("day")) > 7)
    g = d.groupBy("day").agg(N().alias("users"), F.count_if(F.col("_a") < F.col("_b")).alias("lapsing"))
    return g.withColumn("lapse_rate", ratio("lapsing", "users"))


def engagement_span(facts: DataFrame, user: str, day: str, calendar: DataFrame) -> DataFrame:
    """Position (0 to 1) of each user's last activity inside every event."""
    per = facts.groupBy(user, F.to_date(day).alias("day")).agg(N().alias("_n"))
    c = calendar.select("event", "start", "end", F.explode(F.sequence("start", "end")).alias("day"))
    g = per.join(c, "day").groupBy("event", user, "start", "end").agg(F.max("day").alias("last"))
    return g.withColumn("position", ratio(F.date_diff("last", "start"), F.date_diff("end", "start")))


def iteration_compare(df: DataFrame, iteration: str, segment: str, num: str, den: str, prior: int = 3) -> DataFrame:
    """Rate per iteration, change against the mean of the previous ones, and the rate at constant composition."""
    seg = df.groupBy(iteration, segment).agg(F.sum(num).alias("n"), F.sum(den).alias("d"))
    base = seg.groupBy(segment).agg(F.sum("d").alias("b"))
    j = seg.join(base, segment)
    g = j.groupBy(iteration).agg(ratio(F.sum("n"), F.sum("d")).alias("rate"), ratio(F.sum(ratio("n", "d") * F.col("b")), F.sum("b")).alias("normalised_rate"))
    prev = F.avg("rate").over(by_period([], iteration).rowsBetween(-prior, -1))
    return g.withColumn("prior_mean", prev).withColumn("change_pct", 100.0 * ratio(F.col("rate") - F.col("prior_mean"), F.abs("prior_mean")))


def active_network_rate(actives: DataFrame, network: DataFrame, user: str, min_links: int = 4) -> DataFrame:
    """Share of active users with at least ``min_links`` distinct links; ``network`` has (user, n_links)."""
    j = actives.join(network, user, "left")
    return j.agg(N().alias("active_users"), F.count_if(F.col("n_links") >= min_links).alias("connected")).withColumn("rate", ratio("connected", "active_users"))


def time_to_first(df: DataFrame, user: str, ts: str, hit: Column, horizons: list[int], as_of: str) -> DataFrame:
    """Cumulative share of users whose first hit comes within X days of their first event; only mature users count."""
    u = df.groupBy(user).agg(F.min(F.to_date(ts)).alias("first"), F.min(F.when(hit, F.to_date(ts))).alias("win"))
    age, wait = F.date_diff(F.lit(as_of).cast("date"), F.col("first")), F.date_diff("win", "first")
    one = u.agg(*[c for h in horizons for c in (F.count_if(age >= h).alias(f"m{h}"), F.count_if((age >= h) & (wait <= h)).alias(f"w{h}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"m{h}").alias("mature_users"), F.col(f"w{h}").alias("winners"), ratio(f"w{h}", f"m{h}").alias("share")) for h in horizons])))


def sessionize(df: DataFrame, user: str, ts: str, tie: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions by inactivity gap: (user, session_no, session_start, session_end, n_events, seconds).

    Previous times and session numbers are carried over time slots, so a user
    with very many events is spread over many tasks.
    """
    base = df.select(user, ts, tie)
    prev = running_by_time(base, [user], ts, [tie], {}, carry_last={"_prev": F.col(ts)}, peers="by tie")
    new = F.col("_prev").isNull() | (F.col(ts) > F.col("_prev") + F.expr(f"INTERVAL {int(gap_minutes)} MINUTES"))
    flagged = prev.withColumn("_new", F.when(new, 1).otherwise(0))
    num = running_by_time(flagged, [user], ts, [tie], {"session_no": F.col("_new")})
    g = num.groupBy(user, "session_no").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), N().alias("n_events"))
    secs = (F.unix_micros(F.col("session_end").cast("timestamp")) - F.unix_micros(F.col("session_start").cast("timestamp"))) / 1e6
    return g.withColumn("seconds", secs)


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
