"""Confidence scores and findings, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insightspark.functions.columns import ratio
from insightspark.functions.ranks import quantiles_wide
from insightspark.operators.windows import by_period, global_rank

N = lambda: F.count(F.lit(1))

# Maximum points per confidence factor, grades and layers.
FACTOR_MAX = {
    "data_completeness": 15, "structural_integrity": 15, "aggregation_consistency": 15, "temporal_consistency": 15,
    "business_plausibility": 15, "simpsons_paradox_risk": 15, "sample_size": 10, "cross_verification": 10, "reproducibility": 5,
}
GRADES = [(85, "A"), (70, "B"), (55, "C"), (40, "D"), (0, "F")]
LAYERS = {
    "structural": ["null_rate", "structural_severity"], "logical": ["agg_severity", "missing_dates"], "business": ["business_severity"],
    "simpsons": ["paradox_count"], "cross_verification": ["cv_score"], "reproducibility": ["repro_status"],
}
#: Lowest score of a factor that passes, and that only warns.
BANDS = {
    "data_completeness": (12, 5), "structural_integrity": (15, 10), "aggregation_consistency": (15, 8), "temporal_consistency": (15, 5),
    "business_plausibility": (15, 10), "simpsons_paradox_risk": (15, 8), "sample_size": (8, 3), "cross_verification": (8, 4), "reproducibility": (5, 3),
}
#: Check names whose worst severity feeds a factor.
SEVERITY_OF = {
    "structural_severity": ["primary_key_nulls", "primary_key_duplicates", "referential_integrity", "schema", "schema_type"],
    "agg_severity": ["aggregation_total", "aggregation_group", "segment_exhaustive"],
    "business_severity": ["range", "rate", "yoy"],
}
# Theme keywords, dimension words.
THEME_KEYWORDS = {
    "Funnel": ["funnel", "conversion", "drop-off", "dropout", "drop off", "checkout", "cart"],
    "Segment": ["segment", "cohort", "group", "mobile", "desktop", "ios", "android", "plan", "tier"],
    "Trend": ["trend", "growth", "decline", "mom", "wow", "yoy", "month-over-month", "week-over-week", "year-over-year", "increasing", "decreasing"],
    "Anomaly": ["anomaly", "spike", "dip", "unusual", "outlier", "unexpected", "sudden"],
    "Engagement": ["retention", "churn", "engagement", "active", "session", "dau", "wau", "mau", "stickiness"],
}
DIMENSION_WORDS = ["mobile", "desktop", "ios", "android", "new user", "returning", "enterprise", "smb", "free", "paid", "web", "app"]


def grade(score):
    chain = F.lit("F")
    for low, letter in reversed(GRADES):
        chain = F.when(score >= low, letter).otherwise(chain)
    return chain


def inputs_from_checks(checks: DataFrame, run: list[str]) -> DataFrame:
    """The inputs of :func:`confidence_factors` from check rows of any number of runs, in one aggregate.

    ``checks`` holds ``run`` and the columns of a check row, as the structural, logical and business validators return them;
    other results join them through ``as_checks``: ``yoy`` and ``rate`` by their severity, ``simpsons`` (one row for each
    segment column, value 1 where a paradox was found, severity WARNING where the metric is no core metric), ``cross_verification``
    (value: score of 0 to 10), ``reproducibility`` (severity: its status). A column that is not there counts as wholly missing, a
    column of an empty table as complete. An input whose checks did not run is NULL, and its factor MISSING.
    """
    name, value, severity = F.col("check_name"), F.col("value"), F.upper("severity")
    rank = F.when(severity.isin("BLOCKER", "FAIL"), 3).when(severity.isin("WARNING", "WARN"), 2).otherwise(1)
    word = lambda r: F.when(r == 3, "BLOCKER").when(r == 2, "WARNING").when(r == 1, "PASS")
    among = lambda names, x: F.when(name.isin(names), x)
    ran = lambda names: F.count_if(name.isin(names)) > 0
    gone = F.coalesce(F.col("detail") == "missing column", F.lit(False))
    aggs = [F.avg(among(["completeness"], F.when(gone, 1.0).otherwise(F.coalesce(value, F.lit(0.0))))).alias("null_rate")]
    aggs += [word(F.max(among(names, rank))).alias(out) for out, names in SEVERITY_OF.items()]
    found = among(["simpsons"], value) > 0
    return checks.groupBy(*run).agg(
        *aggs, F.max(among(SEVERITY_OF["agg_severity"], value)).alias("agg_diff"),
        F.when(ran(["temporal_missing"]), F.coalesce(F.sum(among(["temporal_missing"], value)), F.lit(0.0))).cast("long").alias("missing_dates"),
        F.when(ran(["trend_continuity"]), F.coalesce(F.sum(among(["trend_continuity"], value)), F.lit(0.0))).cast("long").alias("break_count"),
        (F.count_if((name == "trend_continuity") & (rank == 3)) > 0).alias("trend_blocker"),
        F.when(ran(["simpsons"]), F.count_if(found)).alias("paradox_count"), (F.count_if(found & (severity != "WARNING")) > 0).alias("paradox_core"),
        F.max(among(["row_count"], value)).cast("long").alias("row_count"), F.min(among(["cross_verification"], value)).cast("int").alias("cv_score"),
        F.max_by(among(["reproducibility"], severity), among(["reproducibility"], rank)).alias("repro_status"))


def factors_from_checks(checks: DataFrame, run: list[str]) -> DataFrame:
    """The nine factors of each run from its check rows, with their status."""
    return confidence_factors(inputs_from_checks(checks, run), run)


def score_from_checks(checks: DataFrame, run: list[str]) -> DataFrame:
    """Score and grade of each run from its check rows."""
    return confidence_score(inputs_from_checks(checks, run), run)


def confidence_factors(inputs: DataFrame, run: list[str]) -> DataFrame:
    """(run, factor, score, max_score, status) rows; a NULL input is MISSING.

    ``inputs`` has one row per run with any of: null_rate, structural_severity,
    agg_severity, agg_diff, missing_dates, break_count, trend_blocker,
    business_severity, paradox_count, paradox_core, row_count, cv_score,
    repro_status.
    """
    c = F.col
    sev_score = lambda s, bad: F.when(s.isin("BLOCKER", "FAIL"), bad).when(s == "WARNING", 10).otherwise(15)
    null, struct, agg, biz = c("null_rate"), c("structural_severity"), c("agg_severity"), c("business_severity")
    diff = F.coalesce(c("agg_diff"), F.lit(0.0))
    breaks, gone = F.coalesce(c("break_count"), F.lit(0)), F.coalesce(c("missing_dates"), F.lit(0))
    temporal_known = c("missing_dates").isNotNull() | c("break_count").isNotNull()
    n = c("row_count")
    repro = F.when(c("repro_status").isin("PASS", "SKIPPED"), 5).when(c("repro_status") == "WARN", 3).otherwise(0)
    scores = {
        "data_completeness": F.when(null < 0.01, 15).when(null < 0.05, 12).when(null < 0.10, 9).when(null < 0.20, 5).when(null.isNotNull(), 2),
        "structural_integrity": F.when(struct.isNotNull(), sev_score(struct, 3)),
        "aggregation_consistency": F.when(agg.isNull(), None).when((agg == "BLOCKER") | (diff > 0.05), 3).when(diff > 0.01, 8)
                                    .when(agg == "PASS", 15).otherwise(12),
        "temporal_consistency": F.when(~temporal_known, None).when(F.coalesce(c("trend_blocker"), F.lit(False)), 3)
                                 .when((breaks > 0) | (gone > 5), 5).when(gone > 0, 10).otherwise(15),
        "business_plausibility": F.when(biz.isNotNull(), sev_score(biz, 5)),
        "simpsons_paradox_risk": F.when(c("paradox_count") == 0, 15).when(F.coalesce(c("paradox_core"), F.lit(True)) & (c("paradox_count") > 0), 2)
                                  .when(c("paradox_count") > 0, 8),
        "sample_size": F.when(n > 10000, 10).when(n > 1000, 8).when(n > 100, 5).when(n > 30, 3).when(n.isNotNull(), 1),
        "cross_verification": c("cv_score"),
        "reproducibility": F.when(c("repro_status").isNotNull(), repro),
    }
    structs = []
    for name, s in scores.items():
        s = s.cast("int")
        status = F.when(s.isNull(), "MISSING").when(s >= BANDS[name][0], "PASS").when(s >= BANDS[name][1], "WARNING").otherwise("BLOCKER")
        structs.append(F.struct(F.lit(name).alias("factor"), F.coalesce(s, F.lit(0)).alias("score"), F.lit(FACTOR_MAX[name]).alias("max_score"), status.alias("status")))
    return inputs.select(*run, F.inline(F.array(*structs)))


def confidence_score(inputs: DataFrame, run: list[str]) -> DataFrame:
    """0-100 score and grade per run over the factors that were checked; a missing layer caps A and B at C."""
    f = confidence_factors(inputs, run)
    known = F.col("status") != "MISSING"
    s = f.groupBy(*run).agg(F.sum(F.when(known, F.col("score"))).alias("got"), F.sum(F.when(known, F.col("max_score"))).alias("possible"),
                            F.count_if(F.col("status") == "BLOCKER").alias("n_blockers"), F.count_if(known).alias("n_factors"), F.min(F.when(known, F.col("score"))).alias("min_factor"))
    partial = F.lit(False)
    for cols in LAYERS.values():
        partial = partial | ~reduce(lambda a, b: a | b, [F.col(x).isNotNull() for x in cols])
    s = s.join(inputs.select(*run, partial.alias("partial")), run)
    score = F.coalesce(F.bround(100.0 * ratio("got", "possible"), 0), F.lit(0.0)).cast("int")
    g = grade(score)
    return s.select(*run, score.alias("score"), F.when(F.col("partial") & g.isin("A", "B"), "C").otherwise(g).alias("grade"),
                    F.col("n_blockers"), F.col("n_factors"), F.col("partial"))


def merge_scores(scores: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean score over runs; capped at C when any run is graded D or F."""
    g = (scores.groupBy(*keys) if keys else scores.groupBy()).agg(
        F.bround(F.avg("score"), 0).cast("int").alias("score"), N().alias("n_runs"), F.sum("n_blockers").alias("n_blockers"),
        F.max(F.col("grade").isin("D", "F")).alias("_low"))
    base = grade(F.col("score"))
    return g.withColumn("grade", F.when(F.col("_low") & base.isin("A", "B"), "C").otherwise(base)).drop("_low")


def merge_factors(factors: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Lowest score and worst status per factor."""
    order = F.when(F.col("status") == "BLOCKER", 0).when(F.col("status") == "WARNING", 1).when(F.col("status") == "MISSING", 2).otherwise(3)
    return factors.groupBy(*keys, "factor").agg(F.min("score").alias("score"), F.max("max_score").alias("max_score"), F.min_by("status", order).alias("status"))


def _ladder(x, steps, default):
    chain = F.lit(default)
    for limit, points in reversed(steps):
        chain = F.when(x > limit, points).otherwise(chain)
    return chain


def score_findings(findings: DataFrame) -> DataFrame:
    """Magnitude, breadth, actionability and confidence points (25 each) and their sum."""
    change = ratio(F.abs(F.col("metric_value") - F.col("baseline_value")), F.abs("baseline_value"))
    magnitude = (F.when(F.col("baseline_value") == 0, F.when(F.col("metric_value") != 0, 15).otherwise(5))
                  .otherwise(_ladder(change, [(.5, 25), (.2, 20), (.1, 15), (.05, 10)], 5)))
    breadth = _ladder(F.col("affected_pct"), [(.5, 25), (.3, 20), (.1, 15), (.05, 10)], 5)
    action = F.when(F.col("actionable"), 25).otherwise(5)
    action = F.when(F.coalesce(F.col("effect_size") > 0.5, F.lit(False)), F.least(action + 5, F.lit(25))).otherwise(action)
    conf = F.bround(25.0 * F.col("confidence"), 0).cast("int")
    conf = F.when(F.coalesce(F.col("p_value") < 0.05, F.lit(False)), F.least(conf + 5, F.lit(25))).otherwise(conf)
    conf = F.greatest(F.lit(0), F.least(F.lit(25), conf))
    out = (findings.withColumn("magnitude", magnitude).withColumn("breadth", breadth).withColumn("actionability", action).withColumn("confidence_points", conf))
    return out.withColumn("score", F.col("magnitude") + F.col("breadth") + F.col("actionability") + F.col("confidence_points"))


def rank_findings(scored: DataFrame, key: str) -> DataFrame:
    """Rank by score descending, ties by key."""
    return global_rank(scored, "score", key)


def theme(findings: DataFrame) -> DataFrame:
    """Add ``theme``: the category, or the first keyword class found in the description."""
    text = F.lower(F.coalesce("description", F.lit("")))
    chain = F.lit("Other")
    for name, words in reversed(list(THEME_KEYWORDS.items())):
        chain = F.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), name).otherwise(chain)
    named = F.coalesce(F.col("category"), F.lit("")) != ""
    return findings.withColumn("theme", F.when(named, F.initcap("category")).otherwise(chain))


def theme_groups(scored: DataFrame, key: str) -> DataFrame:
    """Themes with size, actionable count and their best finding."""
    top = F.max("score").alias("max_score")
    sized = theme(scored)
    groups = sized.groupBy("theme").agg(N().alias("n_findings"), F.count_if("actionable").alias("n_actionable"), top)
    best = sized.join(groups.select("theme", "max_score"), "theme").where(F.col("score") == F.col("max_score")).groupBy("theme").agg(F.min(key).alias("top_id"))
    return groups.join(best, "theme").select("theme", "n_findings", "n_actionable", "max_score", "top_id")


def contradictions(findings: DataFrame, key: str) -> DataFrame:
    """Contradicting findings, summarised per metric instead of as all pairs.

    One row per kind of contradiction and metric: how many pairs there are and
    the most confident finding on each side. Kinds: opposite directions of one
    metric; an upward finding against a downward one over more than 20 % of the
    population; two findings with confidence of at least 0.8 in opposite
    directions. A pair counts under the first kind that fits.
    """
    f = findings.where(F.col("direction").isin("up", "down")).withColumn("_m", F.lower(F.nullif(F.trim("metric_name"), F.lit(""))))
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    wide = down & (F.col("affected_pct") > 0.20)
    sure_up = up & (F.col("confidence") >= 0.8)
    sure_narrow = down & (F.col("confidence") >= 0.8) & ~F.coalesce(wide, F.lit(False))
    best = lambda cond: F.min_by(F.when(cond, F.col(key)), F.when(cond, F.struct(-F.col("confidence"), F.col(key))))
    counts = [F.count_if(up).alias("u"), F.count_if(wide).alias("w"), F.count_if(down).alias("d"), F.count_if(sure_up).alias("su"), F.count_if(sure_narrow).alias("sn"),
              best(up).alias("iu"), best(down).alias("i_d"), best(wide).alias("iw"), best(sure_up).alias("isu"), best(sure_narrow).alias("isn")]
    per = f.groupBy("_m").agg(*counts)
    same = per.where("_m IS NOT NULL AND u > 0 AND d > 0").select(
        F.lit("opposite_direction").alias("kind"), F.col("_m").alias("metric_name"), (F.col("u") * F.col("d")).alias("n_pairs"), F.col("iu").alias("finding_up"), F.col("i_d").alias("finding_down"))
    # pairs across metrics = all pairs minus the pairs inside one metric
    named = F.col("_m").isNotNull()
    tot = per.agg((F.sum("u") * F.sum("w") - F.coalesce(F.sum(F.when(named, F.col("u") * F.col("w"))), F.lit(0))).alias("wide"),
                  (F.sum("su") * F.sum("sn") - F.coalesce(F.sum(F.when(named, F.col("su") * F.col("sn"))), F.lit(0))).alias("sure"))
    whole = f.agg(*counts[5:])
    cross = whole.withColumn("_t", tot.select(F.struct("wide", "sure")).scalar())
    rows = cross.select(F.inline(F.array(
        F.struct(F.lit("segment_decline").alias("kind"), F.lit(None).cast("string").alias("metric_name"), F.col("_t.wide").alias("n_pairs"), F.col("iu").alias("finding_up"), F.col("iw").alias("finding_down")),
        F.struct(F.lit("confident_opposites").alias("kind"), F.lit(None).cast("string").alias("metric_name"), F.col("_t.sure").alias("n_pairs"), F.col("isu").alias("finding_up"), F.col("isn").alias("finding_down")))))
    return same.unionByName(rows.where("n_pairs > 0"))


def action_items(scored: DataFrame) -> DataFrame:
    """Actionable findings with a priority and the kind of action."""
    p = F.when(F.col("score") >= 70, "high").when(F.col("score") >= 40, "medium").otherwise("low")
    verb = F.when(F.col("direction") == "down", "Investigate and address").when(F.col("direction") == "up", "Capitalize on momentum").otherwise("Act on finding")
    return scored.where("actionable").withColumn("priority", p).withColumn("action", verb).withColumn("metric", F.coalesce(F.nullif("metric_name", F.lit("")), F.lit("unspecified")))


def meta_patterns(scored: DataFrame) -> DataFrame:
    """Dimension words in several findings, direction alignment, clusters of high impact."""
    text = F.lower(F.coalesce("description", F.lit("")))
    words = scored.agg(*[F.count_if(text.contains(w)).alias(f"w{i}") for i, w in enumerate(DIMENSION_WORDS)]).select(F.inline(F.array(*[
        F.struct(F.lit("dimension_word").alias("pattern"), F.lit(w).alias("subject"), F.col(f"w{i}").alias("n")) for i, w in enumerate(DIMENSION_WORDS)]))).where("n >= 2")
    d = scored.where("direction <> ''").agg(F.count_if(F.col("direction") == "up").alias("up"), F.count_if(F.col("direction") == "down").alias("down"), N().alias("n"))
    label = F.when((F.col("up") == F.col("n")) & (F.col("n") >= 2), "all up").when((F.col("down") == F.col("n")) & (F.col("n") >= 2), "all down").when((F.col("up") >= 2) & (F.col("down") >= 2), "mixed")
    direction = d.select(F.lit("direction").alias("pattern"), label.alias("subject"), F.col("n")).where("subject IS NOT NULL")
    clusters = theme(scored).where("score >= 60").groupBy("theme").agg(N().alias("n")).where("n >= 2").select(F.lit("theme_cluster").alias("pattern"), F.col("theme").alias("subject"), "n")
    return words.unionByName(direction).unionByName(clusters)


#: The steps to a two-sided p-value of Welch's test, as SQL over {m1} {m0} (means), {v1} {v0} (variances), {n1} {n0} (counts).
#: The t value is turned into a normal deviate by its degrees of freedom and the tail taken from a five-term polynomial
#: (error below 1e-7). NULL below two rows on a side.
WELCH_STEPS = [
    ("a", "{v1} / nullif({n1}, 0)"), ("b", "{v0} / nullif({n0}, 0)"), ("t", "abs({m1} - {m0}) / sqrt(nullif({a} + {b}, 0))"),
    ("dof", "({a} + {b}) * ({a} + {b}) / nullif({a} * {a} / nullif({n1} - 1, 0) + {b} * {b} / nullif({n0} - 1, 0), 0)"),
    ("z", "least({t} * (1 - 1 / (4 * {dof})) / sqrt(1 + {t} * {t} / (2 * {dof})), 37.0)"), ("k", "1 / (1 + 0.2316419 * {z})"),
    ("p", "CASE WHEN {a} + {b} = 0 THEN CASE WHEN {m1} = {m0} THEN 1.0 ELSE 0.0 END ELSE least(1.0, 2 * 0.3989422804014327 * exp(-{z} * {z} / 2) * {k}"
          " * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))) END"),
]


def with_welch_p(df: DataFrame, out: str, **names: str) -> DataFrame:
    """Add ``out``, the two-sided p-value of Welch's test; every step is a column of its own, so none is spelt out twice."""
    seen = {k: f"`{v}`" for k, v in names.items()}
    for step, text in WELCH_STEPS:
        column = out if step == "p" else f"_{out}_{step}"
        df = df.withColumn(column, F.expr(text.format(**seen)).cast("double"))
        seen[step] = f"`{column}`"
    return df.drop(*[f"_{out}_{step}" for step, _ in WELCH_STEPS if step != "p"])


def welch_p_sql(source: str, **names: str) -> str:
    """A SELECT over ``source`` that adds ``p_value`` by the same steps."""
    sql, seen = source, dict(names)
    for step, text in WELCH_STEPS:
        column = "p_value" if step == "p" else f"w_{step}"
        sql = f"SELECT *, {text.format(**seen)} AS {column} FROM ({sql})"
        seen[step] = column
    return sql


def insight_scan(df: DataFrame, dims: list[str], metrics: dict, period: str, topics: dict | None = None) -> DataFrame:
    """Findings from every (dimension, value, metric): current against previous period.

    ``metrics`` maps a name to a numeric column; one scan for all of them. ``topics`` may map a metric to the category
    of its findings. Confidence is one minus the p-value of Welch's test between the two periods (0 where there is none).
    """
    now = F.col(period) == "curr"
    long = df.select(F.col(period), *[F.col(c).alias(f"_{m}") for m, c in metrics.items()], F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dims])))
    aggs = [F.count_if(now).alias("n_curr"), F.count_if(~now).alias("n_prev")]
    for m in metrics:
        aggs += [F.avg(F.when(now, F.col(f"_{m}"))).alias(f"c_{m}"), F.avg(F.when(~now, F.col(f"_{m}"))).alias(f"p_{m}")]
        aggs += [F.var_samp(F.when(now, F.col(f"_{m}"))).alias(f"cv_{m}"), F.var_samp(F.when(~now, F.col(f"_{m}"))).alias(f"pv_{m}")]
        aggs += [F.count(F.when(now, F.col(f"_{m}"))).alias(f"cn_{m}"), F.count(F.when(~now, F.col(f"_{m}"))).alias(f"pn_{m}")]
    g = long.where("segment IS NOT NULL").groupBy("dimension", "segment").agg(*aggs)
    total = df.agg(F.count_if(now)).scalar()
    g = g.withColumn("affected_pct", ratio("n_curr", total))
    for m in metrics:
        g = with_welch_p(g, f"pp_{m}", m1=f"c_{m}", m0=f"p_{m}", v1=f"cv_{m}", v0=f"pv_{m}", n1=f"cn_{m}", n0=f"pn_{m}")
    rows = g.select("dimension", "segment", "n_curr", "affected_pct", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric_name"), F.col(f"c_{m}").alias("metric_value"), F.col(f"p_{m}").alias("baseline_value"),
                 F.col(f"pp_{m}").alias("p_value"), F.lit((topics or {}).get(m, "")).alias("category")) for m in metrics])))
    change = ratio(F.col("metric_value") - F.col("baseline_value"), F.abs("baseline_value"))
    return rows.where("metric_value IS NOT NULL AND baseline_value IS NOT NULL").select(
        F.concat_ws("|", "dimension", "segment", "metric_name").alias("finding_id"), "dimension", "segment", "metric_name", "metric_value", "baseline_value", "affected_pct",
        (F.abs(change) > 0.20).alias("actionable"), F.coalesce(1 - F.col("p_value"), F.lit(0.0)).alias("confidence"), (F.col("n_curr") < 100).alias("small_sample"),
        F.when(change > 0, "up").when(change < 0, "down").otherwise("").alias("direction"), F.col("p_value"), F.abs(change).alias("effect_size"),
        F.col("category"), F.concat_ws(" ", F.lit("segment"), "segment", F.lit("of"), "dimension", F.lit("moved on"), "metric_name").alias("description"))


def scorecard_status(df: DataFrame, value: str, benchmark: str) -> DataFrame:
    """green within 5 % of the benchmark or above, yellow to 15 % below, else red."""
    short = ratio(F.col(benchmark) - F.col(value), F.abs(benchmark))
    return df.withColumn("shortfall", short).withColumn("status", F.when(short <= 0.05, "green").when(short <= 0.15, "yellow").otherwise("red"))


def rank_and_outlier(series: DataFrame, kpi: str, iteration: str, value: str) -> DataFrame:
    """Per KPI: rank of each iteration, distance beyond 1.5 IQR of the median, runs of 3 moves in one direction."""
    q = quantiles_wide(series, [kpi], value, {"q1": .25, "med": .5, "q3": .75})
    s = series.join(q, kpi)
    w = by_period([kpi], iteration)
    step = F.signum(F.col(value) - F.lag(value).over(w))
    s = (s.withColumn("rank", F.rank().over(W.partitionBy(kpi).orderBy(F.desc(value))))
          .withColumn("outlier", F.abs(F.col(value) - F.col("med")) > 1.5 * (F.col("q3") - F.col("q1"))).withColumn("_s", step))
    run_id = F.sum(F.when(F.col("_s").eqNullSafe(F.col("_ps")), 0).otherwise(1)).over(w)
    s = s.withColumn("_ps", F.lag("_s").over(w)).withColumn("_r", run_id)
    length = F.row_number().over(W.partitionBy(kpi, "_r").orderBy(iteration))
    return (s.withColumn("run_length", F.when(F.col("_s").isNull() | (F.col("_s") == 0), 0).otherwise(length))
             .withColumn("trend_flag", F.col("run_length") >= 3).drop("q1", "med", "q3", "_s", "_ps", "_r"))
