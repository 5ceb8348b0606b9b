"""Filters, joins, aggregates, samples and set operations of the analyst's toolkit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insightspark.functions.columns import as_col, bucketize, dates_between, ratio, with_totals

# Tenure and inactivity bands of the segmentation guide.
TENURE_EDGES = [6, 14, 30, 90, 180, 365]
TENURE_LABELS = ["D0-6", "D7-14", "D15-30", "D31-90", "D91-180", "D181-365", "D365+"]
INACTIVITY_EDGES = [5, 13, 20]
INACTIVITY_LABELS = ["active", "early", "mid", "late"]


# -- filters ---------------------------------------------------------------

def recent_window(df: DataFrame, ts: str, as_of: str, days: int, *conditions) -> DataFrame:
    """Rows of the ``days`` days before ``as_of`` that meet all conditions."""
    end = F.lit(as_of).cast("date")
    out = df.where((F.col(ts) >= F.date_sub(end, days)) & (F.col(ts) < end))
    for c in conditions:
        out = out.where(c)
    return out


def flag_population(df: DataFrame, user: str, bad_users: DataFrame, source: str, bad_sources: DataFrame) -> DataFrame:
    """Add ``population``: suspicious when the user or their source is listed, else rest."""
    users = bad_users.select(F.col(bad_users.columns[0]).alias(user)).distinct().withColumn("_bu", F.lit(True))
    srcs = bad_sources.select(F.col(bad_sources.columns[0]).alias(source)).distinct().withColumn("_bs", F.lit(True))
    return (df.join(users, user, "left").join(srcs, source, "left")
              .withColumn("population", F.when(F.col("_bu") | F.col("_bs"), "suspicious").otherwise("rest"))
              .drop("_bu", "_bs"))


def population_views(df: DataFrame, user: str, value: str) -> DataFrame:
    """Totals with and without the suspicious population and its share of users."""
    per_user = df.groupBy("population", user).agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    clean = F.col("population") == "rest"
    n_all = F.count_distinct(user)
    n_clean = F.count_distinct(F.when(clean, F.col(user)))
    one = per_user.agg(
        n_all.alias("n_all"), n_clean.alias("n_clean"),
        F.count_distinct(F.when(~clean, F.col(user))).alias("n_bad"),
        F.sum("_n").alias("r_all"), F.sum(F.when(clean, F.col("_n"))).alias("r_clean"),
        F.sum("_v").alias("v_all"), F.sum(F.when(clean, F.col("_v"))).alias("v_clean"))
    share = F.round(100.0 * ratio("n_bad", "n_all"), 4)
    return one.select(F.inline(F.array(
        F.struct(F.lit("all").alias("view"), F.col("n_all").alias("users"), F.col("r_all").alias("n_rows"),
                 F.col("v_all").alias("amount"), share.alias("contamination_pct")),
        F.struct(F.lit("clean").alias("view"), F.col("n_clean").alias("users"), F.col("r_clean").alias("n_rows"),
                 F.col("v_clean").alias("amount"), share.alias("contamination_pct")))))


def exclusion_stack(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """First exclusion rule that hits each row in ``excluded_by`` (NULL = kept)."""
    chain = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        chain = F.when(rule, F.lit(name)).otherwise(chain)
    return df.withColumn("excluded_by", chain)


def not_in(df: DataFrame, key: str, banned: DataFrame) -> DataFrame:
    """Rows whose key is not banned; a NULL among the banned keys removes nothing."""
    return df.join(banned.select(F.col(banned.columns[0]).alias(key)), key, "left_anti")


def two_flag_reason(df: DataFrame, keys: list[str], a: Column, b: Column, label_a: str, label_b: str) -> DataFrame:
    """Per group: both flags, the first, the second, or other."""
    has_a = F.max(F.when(a, 1).otherwise(0)) == 1
    has_b = F.max(F.when(b, 1).otherwise(0)) == 1
    reason = (F.when(has_a & has_b, f"Both {label_a} & {label_b}").when(has_a, label_a)
               .when(has_b, label_b).otherwise("Other"))
    return df.groupBy(*keys).agg(reason.alias("reason"))


def like_classify(text, classes: dict[str, str], default: str = "Other") -> Column:
    """First class whose LIKE pattern matches."""
    c = as_col(text)
    chain = F.lit(default)
    for label, pattern in reversed(list(classes.items())):
        chain = F.when(c.like(pattern), F.lit(label)).otherwise(chain)
    return chain


def like_filter(text, any_of: list[str], none_of: list[str]) -> Column:
    """At least one pattern matches and none of the others does."""
    c = as_col(text)
    hit, miss = F.lit(False), F.lit(False)
    for p in any_of:
        hit = hit | c.like(p)
    for p in none_of:
        miss = miss | c.like(p)
    return hit & ~miss


def config_validity(variant, config, control: str, control_configs: list[str], variant_configs: list[str]) -> Column:
    """Valid Config when the configuration belongs to the arm, else Bad Config."""
    v, c = as_col(variant), as_col(config)
    ok = ((v == control) & c.isin(control_configs)) | ((v != control) & c.isin(variant_configs))
    return F.when(ok, "Valid Config").otherwise("Bad Config")


def role_classify(df: DataFrame, keys: list[str], item: str, contributed, possible, counted: Column,
                  min_items: int = 3, threshold: float = 0.60, carry="Carry", other="Other") -> DataFrame:
    """Carry = at least ``min_items`` distinct counted items and a contribution share above the threshold."""
    g = df.groupBy(*keys).agg(
        F.count_distinct(F.when(counted, F.col(item))).alias("n_items"),
        ratio(F.sum(as_col(contributed)), F.sum(as_col(possible))).alias("contribution"))
    return g.withColumn("role", F.when((F.col("n_items") >= min_items) & (F.col("contribution") > threshold), carry)
                        .otherwise(other))


def lifecycle(df: DataFrame, first, last, as_of: str) -> DataFrame:
    """Tenure band from the first day and inactivity band from the last one."""
    end = F.lit(as_of).cast("date")
    return (df.withColumn("tenure_days", F.date_diff(end, as_col(first)))
              .withColumn("inactive_days", F.date_diff(end, as_col(last)))
              .withColumn("tenure", bucketize("tenure_days", TENURE_EDGES, TENURE_LABELS))
              .withColumn("inactivity", bucketize("inactive_days", INACTIVITY_EDGES, INACTIVITY_LABELS)))


def mature(anchor, as_of: str, days: int) -> Column:
    """True when ``as_of`` lies at least ``days`` full days after the anchor."""
    return F.date_diff(F.lit(as_of).cast("date"), as_col(anchor)) >= days


# -- joins -----------------------------------------------------------------

def offset_activity(user_days: DataFrame, anchors: DataFrame, user: str, day: str, anchor: str,
                    offsets: list[int]) -> DataFrame:
    """One join for all offsets: rows (user, anchor, offset) where the user was active."""
    joined = user_days.join(anchors.select(user, anchor), user)
    return (joined.withColumn("offset", F.date_diff(F.col(day), F.col(anchor)))
                  .where(F.col("offset").isin(offsets)))


def interval_join(facts: DataFrame, spans: DataFrame, keys: list[str], ts: str, start: str, end: str) -> DataFrame:
    """Facts inside a per-key span (both ends included); the equality stays the join key."""
    return facts.join(spans, keys).where(F.col(ts).between(F.col(start), F.col(end)))


def calendar_join(df: DataFrame, day: str, calendar: DataFrame, start: str, end: str, how: str = "inner") -> DataFrame:
    """Match a date against start-end ranges by exploding the calendar to days."""
    days = calendar.withColumn(day, F.explode(dates_between(F.col(start), F.col(end))))
    return df.join(days, day, how)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str) -> DataFrame:
    """Outer comparison of two aggregates: match, differs, only_left or only_right."""
    l = left.select(*keys, F.col(left_value).alias("left_value"), F.lit(True).alias("_l"))
    r = right.select(*keys, F.col(right_value).alias("right_value"), F.lit(True).alias("_r"))
    out = l.join(r, keys, "full_outer")
    state = (F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right")
              .when(F.abs(F.col("left_value") - F.col("right_value")) <= 1e-6 * F.abs(F.col("right_value")), "match")
              .otherwise("differs"))
    return out.withColumn("state", state).drop("_l", "_r")


def attributes_both_sides(pairs: DataFrame, user: str, partner: str, attrs: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Attach the same attributes to a user and to their partner."""
    mine = attrs.select(F.col(key).alias(user), *[F.col(c).alias(f"user_{c}") for c in cols])
    theirs = attrs.select(F.col(key).alias(partner), *[F.col(c).alias(f"partner_{c}") for c in cols])
    return pairs.join(mine, user, "left").join(theirs, partner, "left")


def pair_key(a, b, sep: str = "|") -> Column:
    """Same text for (a, b) and (b, a)."""
    x, y = as_col(a).cast("string"), as_col(b).cast("string")
    return F.concat_ws(sep, F.least(x, y), F.greatest(x, y))


def join_cardinality(before: DataFrame, after: DataFrame, expected: str = "same", cross: bool = False) -> DataFrame:
    """Rows before and after a join with a verdict on the growth."""
    b = before.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = after.agg(F.count(F.lit(1)).alias("rows_after")).withColumn("rows_before", b)
    growth = ratio("rows_after", "rows_before")
    as_expected = {"same": F.col("rows_after") == F.col("rows_before"),
                   "more": F.col("rows_after") >= F.col("rows_before"),
                   "fewer": F.col("rows_after") <= F.col("rows_before")}[expected]
    status = F.when(as_expected, "PASS").otherwise("WARN")
    if not cross:
        status = F.when(growth > 2.0, "FAIL").otherwise(status)
    return one.select("rows_before", "rows_after", growth.alias("growth"), F.lit(expected).alias("expected"),
                      status.alias("status"))


# -- aggregates ------------------------------------------------------------

def mix(df: DataFrame, dims: list[str]) -> DataFrame:
    """Share of rows per bucket for several dimensions from one scan."""
    g = (df.groupingSets([[d] for d in dims], *dims)
           .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid")))
    width = len(dims)
    dim = F.lit(None).cast("string")
    bucket = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        # every bit set except the one of the dimension kept
        gid = (1 << width) - 1 - (1 << (width - 1 - i))
        dim = F.when(F.col("_gid") == gid, F.lit(d)).otherwise(dim)
        bucket = F.when(F.col("_gid") == gid, F.col(d).cast("string")).otherwise(bucket)
    named = g.select(dim.alias("dimension"), bucket.alias("bucket"), "n")
    return with_totals(named, ["dimension"], {"_all": "n"}).withColumn("share", ratio("n", "_all")).drop("_all")


def top_values(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of every column, ties by value."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])))
    counts = long.where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, ["column_name"], [F.col("n").desc(), F.col("value")], k)


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. ``rank <= k`` lets Spark prune inside each task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def distinct_ratio(df: DataFrame, keys: list[str], unit: str, condition: Column) -> DataFrame:
    """Distinct units meeting the condition over distinct units, via one row per unit."""
    per = df.groupBy(*keys, unit).agg(F.max(F.when(condition, 1).otherwise(0)).alias("_hit"))
    return per.where(F.col(unit).isNotNull()).groupBy(*keys).agg(
        F.sum("_hit").alias("n_hit"), F.count(F.lit(1)).alias("n_units")).withColumn("rate", ratio("n_hit", "n_units"))


def recent_iterations(df: DataFrame, keys: list[str], iteration: str, n: int) -> DataFrame:
    """Rows of the last ``n`` iterations per key.

    The distinct iterations are ranked, not the rows.
    """
    its = df.select(*keys, iteration).distinct()
    w = W.partitionBy(*keys).orderBy(F.col(iteration).desc())
    last = its.withColumn("iteration_rank", F.row_number().over(w)).where(F.col("iteration_rank") <= n)
    return df.join(last, [*keys, iteration])


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` random rows: a Bernoulli sample sized from the row count."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.where((total <= n) | (F.rand(seed) < F.lit(float(n)) / total))
