"""Table and series profiling over full tables: no sampling, one row per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.functions.columns import as_col, clean, ratio, with_totals
from insightspark.functions.ranks import few, quantiles_wide
from insightspark.operators.windows import by_period, islands, missing_days

# Name parts that mark a date column.
DATE_HINTS = ["date", "time", "created", "updated", "timestamp", "_at", "_on", "_dt"]


def family(kind: T.DataType) -> str:
    """numeric, datetime, string, boolean or other."""
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.StringType):
        return "string"
    return "boolean" if isinstance(kind, T.BooleanType) else "other"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) == "numeric"]


def missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def distinct_counts(df: DataFrame, values: dict[int, str]) -> DataFrame:
    """(position, n_unique): number of distinct non-NULL values of each SQL expression over ``df``.

    Each expression is grouped by itself. Distinct counts that share an aggregate make a copy of every row, as wide as all the expressions, for each of
    them; here a column is read alone and equal values collapse in the map-side combine. So ``df`` is read once per expression. One shuffle adds up all counts.
    """
    one = [df.select(F.expr(v).alias("v")).where("v IS NOT NULL").distinct().select(F.lit(i).alias("position"), F.lit(1).alias("n")) for i, v in values.items()]
    none = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(i) for i in values])).alias("position"), F.lit(0).alias("n"))
    return reduce(DataFrame.unionByName, [none, *one]).groupBy("position").agg(F.sum("n").alias("n_unique"))


def profile_columns(df: DataFrame, exact_distinct: bool = True, samples: bool = False) -> DataFrame:
    """One row per column: type, nulls, distinct values and numeric or length statistics.

    ``exact_distinct=False`` uses a bounded sketch, the choice for wide tables at
    scale; ``samples`` adds frequent values from a bounded top-k sketch. Everything
    but the exact distinct values (see :func:`distinct_counts`) comes from one aggregate
    over the full table.
    """
    aggs, rows, values = ["count(1) AS n"], [], {}
    for i, f in enumerate(df.schema.fields):
        kind, col = family(f.dataType), f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = f"nullif({col}, double('NaN'))"
        aggs.append(f"count({col}) AS p{i}")
        values[i] = col
        if not exact_distinct:
            aggs.append(f"approx_count_distinct({col}, 0.02) AS u{i}")
        measure = {"numeric": f"double({col})", "string": f"double(length({col}))"}.get(kind)
        if measure:
            aggs += [f"min({measure}) AS a{i}", f"max({measure}) AS b{i}", f"avg({measure}) AS c{i}", f"stddev_samp({measure}) AS d{i}"]
        if samples and kind != "other":
            aggs.append(f"transform(approx_top_k(`{f.name}`, 5), s -> string(s.item)) AS s{i}")

        def pick(letter, want):
            return f"{letter}{i}" if kind == want else "double(NULL)"

        fields = {
            "position": str(i), "column_name": f"'{f.name}'", "data_type": f"'{f.dataType.simpleString()}'", "family": f"'{kind}'",
            "row_count": "n", "nullable": f"n > p{i}", "null_count": f"n - p{i}",
            "null_pct": f"round(coalesce(try_divide(100.0D * (n - p{i}), n), 0D), 2)", "n_unique": "bigint(NULL)" if exact_distinct else f"u{i}",
            "min_value": pick("a", "numeric"), "max_value": pick("b", "numeric"), "mean_value": pick("c", "numeric"),
            "std_value": pick("d", "numeric"), "min_len": pick("a", "string"), "max_len": pick("b", "string"),
            "avg_len": f"round({pick('c', 'string')}, 1)"}
        if samples:
            fields["sample_values"] = f"s{i}" if kind != "other" else "CAST(NULL AS array<string>)"
        rows.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")")
    out = df.agg(*[F.expr(x) for x in aggs]).selectExpr(f"inline(array({', '.join(rows)}))")
    if not exact_distinct:
        return out
    # one row per column on either side
    return out.drop("n_unique").join(F.broadcast(distinct_counts(df, values)), "position").select(*out.columns)


def profile_source(tables: dict[str, DataFrame], exact_distinct: bool = True) -> DataFrame:
    """Column profiles of every table, with the table name in front."""
    frames = [profile_columns(df, exact_distinct).withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, frames)


def detect_date_columns(df: DataFrame, min_rate: float = 0.8) -> DataFrame:
    """Date columns by type, by name, or by the share of text that parses (all rows)."""
    strings = [f.name for f in df.schema.fields if family(f.dataType) == "string"]
    aggs = [ratio(F.count(F.try_to_timestamp(F.col(c))), F.count(c)).alias(f"r_{c}") for c in strings]
    one = df.agg(F.lit(1).alias("_"), *aggs)
    rows = []
    for f in df.schema.fields:
        named = any(h in f.name.lower() for h in DATE_HINTS)
        typed = family(f.dataType) == "datetime"
        rate = F.col(f"r_{f.name}") if f.name in strings else F.lit(None).cast("double")
        parses = F.coalesce(rate >= min_rate, F.lit(False))
        reason = F.lit("type") if typed else F.when(parses, "parses").when(F.lit(named), "name")
        rows.append(F.struct(F.lit(f.name).alias("column_name"), rate.alias("parse_rate"),
                             reason.isNotNull().alias("is_date"), reason.alias("reason")))
    return one.select(F.inline(F.array(*rows)))


def date_span(df: DataFrame, cols: list[str]) -> DataFrame:
    """Earliest and latest day over the date columns of a table."""
    return df.agg(F.least(*[F.min(F.to_date(c)) for c in cols], F.lit(None).cast("date")).alias("first_day"),
                  F.greatest(*[F.max(F.to_date(c)) for c in cols], F.lit(None).cast("date")).alias("last_day"))


def compare_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Differences of two snapshots (table_name, column_name, data_type, row_count).

    Only removed tables and columns are breaking.
    """
    o = old.select("table_name", "column_name", F.col("data_type").alias("old_type"), F.col("row_count").alias("old_rows"))
    n = new.select("table_name", "column_name", F.col("data_type").alias("new_type"), F.col("row_count").alias("new_rows"))
    cols = o.join(n, ["table_name", "column_name"], "full_outer")
    per_table = W.partitionBy("table_name")
    has_old = F.max(F.col("old_type").isNotNull()).over(per_table)
    has_new = F.max(F.col("new_type").isNotNull()).over(per_table)
    marked = cols.withColumn("_o", has_old).withColumn("_n", has_new).withColumn(
        "change",
        F.when(~F.col("_n"), "table_removed").when(~F.col("_o"), "table_added")
         .when(F.col("new_type").isNull(), "column_removed").when(F.col("old_type").isNull(), "column_added")
         .when(F.col("old_type") != F.col("new_type"), "type_changed"))
    col_rows = marked.where("change IS NOT NULL").select(
        "table_name", F.when(F.col("change").startswith("table"), None).otherwise(F.col("column_name")).alias("column_name"),
        "change", F.lit(None).cast("double").alias("row_change_pct")).distinct()
    counts = marked.groupBy("table_name").agg(F.max("old_rows").alias("a"), F.max("new_rows").alias("b")).where("a <> b")
    row_rows = counts.select("table_name", F.lit(None).cast("string").alias("column_name"), F.lit("row_count").alias("change"),
                             F.round(100.0 * ratio(F.col("b") - F.col("a"), "a"), 2).alias("row_change_pct"))
    out = col_rows.unionByName(row_rows)
    return out.withColumn("breaking", F.col("change").isin("table_removed", "column_removed"))


def _name_candidates(columns: dict[str, list[str]]) -> list[tuple]:
    """Foreign-key candidates from table and column names (metadata only)."""
    found, seen = [], set()
    for table, cols in columns.items():
        for col in cols:
            stem = col[:-3].lower() if col.lower().endswith("_id") else None
            for other, other_cols in columns.items():
                if other == table:
                    continue
                score, targets = None, ()
                if stem is not None and other.lower() in (stem, stem + "s"):
                    score, targets = 0.8, ("id", col, f"{stem}_id")
                elif stem is not None and stem in other.lower():
                    score, targets = 0.5, ("id", col, f"{stem}_id")
                elif other.lower() in (col.lower(), col.lower() + "s"):
                    score, targets = 0.4, ("id", f"{col.lower()}_id", f"{other.lower()}_id")
                target = next((x for x in targets if x in other_cols), None)
                if target and (other, target, table, col) not in seen:
                    seen.add((table, col, other, target))
                    found.append((table, col, other, target, score))
    return found


def discover_relationships(tables: dict[str, DataFrame], keep: float = 0.3) -> DataFrame:
    """Candidate joins by name, confirmed by containment of the full distinct values."""
    frames = []
    for table, col, other, target, score in _name_candidates({n: d.columns for n, d in tables.items()}):
        a = tables[table].select(F.col(col).cast("string").alias("v")).where("v IS NOT NULL").distinct()
        b = tables[other].select(F.col(target).cast("string").alias("v")).where("v IS NOT NULL").distinct()
        both = (a.withColumn("f", F.lit(1)).join(b.withColumn("t", F.lit(1)), "v", "full_outer")
                 .agg(F.count("f").alias("n_from"), F.count("t").alias("n_to"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("n_both")))
        overlap = F.round(F.coalesce(ratio("n_both", "n_from"), F.lit(0.0)), 2)
        conf = F.when(overlap > 0, F.least(F.lit(1.0), (F.lit(score) + overlap) / 2 + 0.1)).otherwise(F.lit(score))
        frames.append(both.select(
            F.lit(table).alias("from_table"), F.lit(col).alias("from_column"), F.lit(other).alias("to_table"), F.lit(target).alias("to_column"),
            overlap.alias("containment"), F.round(conf, 2).alias("confidence"),
            F.when(overlap > 0, "both").otherwise("name_match").alias("method"),
            F.when(F.col("n_from") > 0.9 * F.col("n_to"), "one-to-one").otherwise("many-to-one").alias("cardinality")))
    return reduce(DataFrame.unionByName, frames).where(F.col("confidence") >= keep)


def melt(df: DataFrame, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """Numeric columns as (keys, column_name, value), NULL and NaN left out."""
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), clean(c).alias("value")) for c in cols])))
    return long.where("value IS NOT NULL")


def corrected_skew(g1, n) -> Column:
    """Bias-corrected skewness from the population form."""
    g, m = as_col(g1), as_col(n).cast("double")
    return F.when(m > 2, g * F.sqrt(m * (m - 1)) / (m - 2))


def corrected_kurtosis(g2, n) -> Column:
    """Bias-corrected excess kurtosis from the population form."""
    g, m = as_col(g2), as_col(n).cast("double")
    return F.when(m > 3, (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * g + 6))


def histogram(long: DataFrame, keys: list[str], value: str, bins: Column, bounds: DataFrame,
              few_groups: bool = False, weight: str | None = None) -> DataFrame:
    """Equal-width counts per group, the last bin closed, empty bins included.

    ``bounds`` has (keys, lo, hi) and whatever ``bins`` refers to; at most one row per group.
    ``weight`` names a count column when the input holds distinct values.
    """
    b = bounds.withColumn("n_bins", bins.cast("int"))
    width = (F.col("hi") - F.col("lo")) / F.col("n_bins")
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.col("n_bins") - 1)).otherwise(0)
    counts = long.join(few(b, few_groups), keys).groupBy(*keys, place.cast("int").alias("bin")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    spine = b.where("n_bins > 0").select(*keys, "lo", "hi", "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    return spine.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])


def two_peaks(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose smoothed histogram has two peaks with a valley below 60 % of the lower one."""
    w = W.partitionBy(*keys).orderBy("bin")
    near = F.coalesce(F.lag("n").over(w), F.lit(0)) + F.col("n") + F.coalesce(F.lead("n").over(w), F.lit(0))
    s = hist.withColumn("s", near / 3.0)
    peak = (F.col("s") > F.lag("s").over(w)) & (F.col("s") > F.lead("s").over(w))
    p = s.withColumn("peak", F.coalesce(peak, F.lit(False)))
    best = (p.where("peak").withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("s"), "bin")))
             .where("r <= 2").groupBy(*keys)
             .agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.min("s").alias("lower"), F.count(F.lit(1)).alias("k"))
             .where("k = 2"))
    valley = p.join(best, keys).where("bin BETWEEN b0 AND b1").groupBy(*keys).agg(F.min("s").alias("valley"), F.max("lower").alias("lower"))
    return valley.select(*keys, (F.col("valley") < 0.6 * F.col("lower")).alias("two_peaks"))


def count_peaks(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Number of local maxima, ends included."""
    w = W.partitionBy(*keys).orderBy("bin")
    left, right = F.lag("n").over(w), F.lead("n").over(w)
    peak = F.coalesce(F.col("n") > left, F.lit(True)) & F.coalesce(F.col("n") > right, F.lit(True)) & (left.isNotNull() | right.isNotNull())
    return hist.withColumn("peak", peak).groupBy(*keys).agg(F.count_if("peak").alias("n_peaks"))


def shape_label(skew, kurt, two_peaks_flag, n_unique) -> Column:
    s, k = as_col(skew), as_col(kurt)
    return (F.when((F.abs(s) < 0.5) & (k < -1.0), "uniform").when(k > 3.0, "heavy-tailed")
             .when((as_col(n_unique) > 10) & F.coalesce(as_col(two_peaks_flag), F.lit(False)), "bimodal")
             .when(s > 1.0, "right-skewed").when(s < -1.0, "left-skewed").otherwise("normal"))


def transform_hint(skew, minimum) -> Column:
    """log or sqrt for right-skewed data, else NULL."""
    return F.when((as_col(skew) > 1.0) & (as_col(minimum) > 0), "log").when((as_col(skew) > 1.0) & (as_col(minimum) >= 0), "sqrt")


def counted_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, c): every distinct value once. The one shuffle that the
    figures below share; it is no larger than what an exact distinct count needs."""
    return melt(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c"))


def weighted_moments(counts: DataFrame) -> DataFrame:
    """Count, distinct values, mean, sample deviation and population moments per column.

    Central sums are taken around the mean of a first pass, so large offsets do
    not cancel. The means are at most one row per column and are broadcast.
    """
    keys, v, c = ["column_name"], F.col("value"), F.col("c")
    base = counts.groupBy(*keys).agg(F.sum(c).alias("n"), F.count(F.lit(1)).alias("n_unique"), (F.sum(c * v) / F.sum(c)).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    d = v - F.col("mean")
    cen = counts.join(F.broadcast(base.select(*keys, "mean")), keys).groupBy(*keys).agg(
        F.sum(c * d * d).alias("_s2"), F.sum(c * d * d * d).alias("_s3"), F.sum(c * d * d * d * d).alias("_s4"))
    j = base.join(cen, keys)
    m2 = F.col("_s2") / F.col("n")
    return (j.withColumn("std", F.sqrt(ratio("_s2", F.col("n") - 1))).withColumn("g1", ratio(F.col("_s3") / F.col("n"), F.pow(m2, 1.5)))
             .withColumn("g2", ratio(F.col("_s4") / F.col("n"), m2 * m2) - 3).drop("_s2", "_s3", "_s4"))


def _stats_from_counts(counts: DataFrame) -> DataFrame:
    keys = ["column_name"]
    base = weighted_moments(counts)
    pct = quantiles_wide(counts, keys, "value", {"p1": .01, "p5": .05, "p25": .25, "median": .5, "p75": .75, "p95": .95, "p99": .99}, few_groups=True, weight="c")
    stats = base.join(pct, keys).withColumn("iqr", F.col("p75") - F.col("p25"))
    fences = pct.select(*keys, (F.col("p25") - 1.5 * (F.col("p75") - F.col("p25"))).alias("f0"), (F.col("p75") + 1.5 * (F.col("p75") - F.col("p25"))).alias("f1"))
    out = F.when((F.col("value") < F.col("f0")) | (F.col("value") > F.col("f1")), F.col("c")).otherwise(0)
    outliers = counts.join(F.broadcast(fences), keys).groupBy(*keys).agg(F.sum(out).alias("n_outliers"))
    return (stats.join(outliers, keys).withColumn("skewness", corrected_skew("g1", "n"))
                 .withColumn("kurtosis", corrected_kurtosis("g2", "n")).drop("g1", "g2"))


def distribution_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Moments, percentiles, IQR outliers of each numeric column."""
    return _stats_from_counts(counted_values(df, cols))


def profile_distributions(df: DataFrame, cols: list[str]) -> DataFrame:
    """:func:`distribution_stats` plus shape and suggested transform."""
    counts = counted_values(df, cols)
    bounds = counts.groupBy("column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n_unique"))
    hist = histogram(counts, ["column_name"], "value", F.least(F.lit(50), F.col("n_unique")), bounds, few_groups=True, weight="c")
    return (_stats_from_counts(counts).join(two_peaks(hist, ["column_name"]), "column_name", "left")
                 .withColumn("shape", shape_label("skewness", "kurtosis", "two_peaks", "n_unique"))
                 .withColumn("transform", transform_hint("skewness", "lo")).drop("two_peaks"))


def characterize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Summary with population moments, modality and words for the shape."""
    counts, keys = counted_values(df, cols), ["column_name"]
    base = weighted_moments(counts).withColumnRenamed("g1", "skewness").withColumnRenamed("g2", "kurtosis").drop("n_unique")
    pct = quantiles_wide(counts, keys, "value", {"p5": .05, "p25": .25, "median": .5, "p75": .75, "p95": .95}, few_groups=True, weight="c")
    bounds = counts.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("c").alias("n_rows"))
    hist = histogram(counts, keys, "value", F.least(F.greatest(F.floor(F.sqrt("n_rows")), F.lit(10)), F.lit(50)), bounds, few_groups=True, weight="c")
    peaks = count_peaks(hist, keys)
    modality = F.when(F.col("n_peaks") <= 1, "unimodal").when(F.col("n_peaks") == 2, "bimodal").otherwise("multimodal")
    s, k = F.col("skewness"), F.col("kurtosis")
    words = F.concat_ws(
        ", ", F.when(F.abs(s) < 0.5, "approximately symmetric").when(s > 0, "right-skewed").otherwise("left-skewed"),
        F.when(k > 1, "heavy-tailed").when(k < -1, "light-tailed"), F.when(F.col("modality") != "unimodal", F.col("modality")))
    return (base.join(pct, keys).join(peaks, keys).withColumn("modality", modality).withColumn("shape", words))


# -- time ------------------------------------------------------------------

def temporal_patterns(df: DataFrame, day: str) -> DataFrame:
    """Range, expected and actual days, coverage and gap count of a date column."""
    days = df.select(F.to_date(day).alias("day")).where("day IS NOT NULL").distinct()
    gaps = islands(missing_days(days, [], "day"), [], "day").agg(
        F.count(F.lit(1)).alias("n_gaps"), F.coalesce(F.sum("length"), F.lit(0)).alias("missing_days"))
    one = days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("actual"))
    one = one.withColumn("expected", F.date_diff("last_day", "first_day") + 1)
    g = gaps.select(F.struct("n_gaps", "missing_days")).scalar()
    return (one.withColumn("coverage_pct", F.round(100.0 * ratio("actual", "expected"), 2))
               .withColumn("_g", g).select("*", "_g.n_gaps", "_g.missing_days").drop("_g"))


def calendar_means(df: DataFrame, day: str, value: str) -> DataFrame:
    """Means by weekday and by month of a daily series."""
    long = df.select(F.inline(F.array(
        F.struct(F.lit("weekday").alias("part"), F.date_format(day, "EEEE").alias("label"), F.col(value).cast("double").alias("v")),
        F.struct(F.lit("month").alias("part"), F.date_format(day, "MMMM").alias("label"), F.col(value).cast("double").alias("v")))))
    return long.groupBy("part", "label").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def detect_trend(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """volatile, increasing, decreasing, stable or unknown per aggregated series."""
    idx = series.where(F.col(value).isNotNull()).withColumn("_x", F.row_number().over(by_period(keys, order)) - 1)
    idx = idx.withColumn("_y", F.col(value).cast("double"))
    fit = (idx.groupBy(*keys) if keys else idx.groupBy()).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.avg("_y").alias("mean"),
        F.regr_r2("_y", "_x").alias("_r2"), F.var_pop("_y").alias("_vy"))
    # residual variance of the least-squares line is (1 - R2) of the total
    cv = F.try_divide(F.sqrt(F.greatest(F.col("_vy") * (1 - F.coalesce("_r2", F.lit(0.0))), F.lit(0.0))), F.abs("mean"))
    rel = F.try_divide(F.col("slope"), F.abs("mean"))
    label = (F.when(F.col("n") < 5, "unknown").when(F.col("mean") == 0, "stable").when(cv > 0.5, "volatile")
              .when(rel > 0.01, "increasing").when(rel < -0.01, "decreasing").otherwise("stable"))
    return fit.select(*keys, "n", "slope", "mean", cv.alias("residual_cv"), label.alias("trend"))


def monthly_seasonality(series: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Seasonal when at least 3 month means vary by more than 20 % of their mean."""
    m = series.groupBy(*keys, F.month(day).alias("_m")).agg(F.avg(value).alias("_v"))
    g = (m.groupBy(*keys) if keys else m.groupBy()).agg(
        F.count(F.lit(1)).alias("n_months"), F.try_divide(F.stddev_pop("_v"), F.abs(F.avg("_v"))).alias("cv"))
    return g.withColumn("seasonal", (F.col("n_months") >= 3) & F.coalesce(F.col("cv") > 0.2, F.lit(False)))


def correlations(df: DataFrame, cols: list[str], threshold: float = 0.5) -> DataFrame:
    """Pearson pairs over pairwise complete rows from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = clean(a), clean(b)
        aggs += [F.corr(F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)).alias(f"c{i}")]
    rows = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(F.col(f"c{i}"), 4).alias("r")) for i, (a, b) in enumerate(pairs)]
    out = df.agg(*aggs).select(F.inline(F.array(*rows)))
    r = F.abs("r")
    return out.where(r >= threshold).withColumn(
        "strength", F.when(r >= 0.9, "very strong").when(r >= 0.7, "strong").when(r >= 0.5, "moderate").otherwise("weak"))


def completeness_profile(df: DataFrame) -> DataFrame:
    """Nulls, zeros, blanks and constants of every column."""
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(df.schema.fields):
        kind, gone = family(f.dataType), missing(df, f.name)
        aggs += [F.count_if(gone).alias(f"nul{i}"),
                 (F.coalesce(F.min(F.when(~gone, F.col(f.name))) == F.max(F.when(~gone, F.col(f.name))), F.lit(True))).alias(f"k{i}"),
                 (F.count_if(F.col(f.name) == 0) if kind == "numeric" else F.lit(0).cast("long")).alias(f"z{i}"),
                 (F.count_if(F.trim(F.col(f.name)) == "") if kind == "string" else F.lit(0).cast("long")).alias(f"e{i}")]
        pct = F.round(F.coalesce(100.0 * ratio(f"nul{i}", "n"), F.lit(0.0)), 2)
        status = F.when(pct == 0, "COMPLETE").when(pct < 5, "GOOD").when(pct < 50, "WARNING").otherwise("CRITICAL")
        rows.append(F.struct(
            F.lit(f.name).alias("column_name"), F.col("n").alias("total_rows"), (F.col("n") - F.col(f"nul{i}")).alias("non_null"),
            F.col(f"nul{i}").alias("null_count"), pct.alias("null_pct"), status.alias("status"), F.col(f"z{i}").alias("zero_count"),
            F.col(f"e{i}").alias("empty_string_count"), F.col(f"k{i}").alias("constant")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def anomaly_bands(series: DataFrame, order: str, metrics: list[str], window: int = 14, k: float = 2.0) -> DataFrame:
    """Spikes and drops outside rolling mean ± k deviations (current row included)."""
    long = series.select(order, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), clean(m).alias("value")) for m in metrics])))
    w = W.partitionBy("metric").orderBy(order).rowsBetween(-(window - 1), 0)
    enough = F.count("value").over(w) >= 3
    b = (long.withColumn("mean", F.when(enough, F.avg("value").over(w)))
             .withColumn("std", F.when(enough, F.stddev_samp("value").over(w))))
    kind = (F.when(F.col("value") > F.col("mean") + k * F.col("std"), "spike")
             .when(F.col("value") < F.col("mean") - k * F.col("std"), "drop"))
    return (b.withColumn("kind", kind).where("kind IS NOT NULL AND mean <> 0")
             .withColumn("pct", F.round(100.0 * F.abs(F.col("value") - F.col("mean")) / F.abs("mean"), 1))
             .select(order, "metric", "value", "kind", "pct"))


def frame_fingerprint(df: DataFrame, label: str) -> DataFrame:
    """(label, metric, column_name, value, text) rows that identify a table's content."""
    aggs, rows, values = [F.count(F.lit(1)).alias("n")], [], {}

    def row(metric, column, value, text=None):
        rows.append(F.struct(F.lit(label).alias("label"), F.lit(metric).alias("metric"), F.lit(column).alias("column_name"),
                             value.cast("double").alias("value"), (text if text is not None else F.lit(None)).cast("string").alias("text")))

    row("row_count", "*", F.col("n"))
    row("column_count", "*", F.lit(len(df.columns)))
    for i, f in enumerate(df.schema.fields):
        kind = family(f.dataType)
        aggs.append(F.count_if(missing(df, f.name)).alias(f"nul{i}"))
        values[i] = f"`{f.name}`"
        row("null_count", f.name, F.col(f"nul{i}"))
        row("distinct_count", f.name, F.col("u")[i])
        if kind == "numeric":
            aggs.append(F.sum(clean(f.name)).alias(f"s{i}"))
            row("numeric_sum", f.name, F.coalesce(F.col(f"s{i}"), F.lit(0.0)))
        elif kind == "datetime":
            aggs += [F.min(F.to_date(f.name)).alias(f"a{i}"), F.max(F.to_date(f.name)).alias(f"b{i}")]
            row("date_min", f.name, F.lit(None), F.col(f"a{i}"))
            row("date_max", f.name, F.lit(None), F.col(f"b{i}"))
    one = df.agg(*aggs)
    if values:  # one entry per column
        one = one.withColumn("u", distinct_counts(df, values).agg(F.map_from_entries(F.collect_list(F.struct("position", "n_unique")))).scalar())
    return one.select(F.inline(F.array(*rows)))


def dominant_values(df: DataFrame, cols: list[str], share: float = 0.5) -> DataFrame:
    """Values that make up more than ``share`` of a column."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])))
    n = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    whole = with_totals(n, ["column_name"], {"_all": "n"}).withColumn("share", ratio("n", "_all")).drop("_all")
    return whole.where((F.col("share") > share) & F.col("value").isNotNull())


def sigma_outliers(df: DataFrame, cols: list[str], k: float = 3.0) -> DataFrame:
    """Rows beyond ``k`` deviations per column, from two aggregate passes."""
    long = melt(df, cols)
    band = long.groupBy("column_name").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return long.join(F.broadcast(band), "column_name").groupBy("column_name").agg(
        F.count_if(F.abs(F.col("value") - F.col("m")) > k * F.col("s")).alias("n_outliers"), F.count(F.lit(1)).alias("n"))


def tracking_gaps(requirements: DataFrame, profile: DataFrame) -> DataFrame:
    """(analysis, column_name) requirements against a profile: available, partial or missing."""
    p = profile.select("table_name", "column_name", "null_pct")
    out = requirements.join(p, ["table_name", "column_name"], "left")
    return out.withColumn("status", F.when(F.col("null_pct").isNull(), "missing").when(F.col("null_pct") > 5, "partial").otherwise("available"))
