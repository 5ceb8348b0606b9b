"""Structural checks: schema, keys, completeness, ranges, references, domains, row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.functions.checks import Probe, check_row, emit, run_probes, severity_scale, stack_rows, static_rows
from insightspark.functions.columns import ratio
from insightspark.operators.profile import family, missing
from insightspark.operators.windows import by_period

N = lambda: F.count(F.lit(1))


def schema_check(df: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Missing column = BLOCKER, other type family = WARNING, extra columns are listed."""
    rows = []
    for c in columns:
        there = c in df.columns
        rows.append(("schema", c, there, "PASS" if there else "BLOCKER", None, "present", None if there else "missing"))
    for c, want in (types or {}).items():
        if c in df.columns:
            have = family(df.schema[c].dataType)
            rows.append(("schema_type", c, have == want, "PASS" if have == want else "WARNING", None, want, have))
    for c in df.columns:
        if c not in columns:
            rows.append(("schema_extra", c, True, "PASS", None, None, "extra column"))
    return static_rows(df.sparkSession, rows)


def primary_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """NULL keys and number of distinct duplicated keys; any of them is a BLOCKER."""
    subject = ",".join(keys)
    per = df.groupBy(*keys).agg(N().alias("_n"))
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    one = per.agg(F.coalesce(F.sum(F.when(any_null, F.col("_n"))), F.lit(0)).alias("nulls"), F.count_if((F.col("_n") > 1) & ~any_null).alias("dups"))
    sev = lambda c: F.when(F.col(c) > 0, "BLOCKER").otherwise("PASS")
    return emit(one, [check_row("primary_key_nulls", subject, F.col("nulls") == 0, sev("nulls"), F.col("nulls"), "0"),
                      check_row("primary_key_duplicates", subject, F.col("dups") == 0, sev("dups"), F.col("dups"), "0")])


def duplicated_keys(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The most repeated keys, for the report."""
    return df.groupBy(*keys).agg(N().alias("n")).where("n > 1").orderBy(F.desc("n"), *keys).limit(n)


def completeness_probe(df: DataFrame, columns: list[str], threshold: float = 0.95) -> Probe:
    aggs, rows = {"_n": N()}, []
    for c in columns:
        if c in df.columns:
            aggs[f"_m_{c}"] = F.count_if(missing(df, c))

    def build():
        for c in columns:
            if c not in df.columns:
                rows.append(check_row("completeness", c, False, "BLOCKER", None, str(threshold), "missing column"))
                continue
            rate = ratio(f"_m_{c}", "_n")
            limit = 1.0 - threshold
            empty = F.col("_n") == 0
            ok = empty | (rate <= limit + 1e-12)
            sev = (F.when(empty, "WARNING").when(rate > 0.2, "BLOCKER").when(rate > limit + 1e-12, "WARNING").otherwise("PASS"))
            rows.append(check_row("completeness", c, ok, sev, rate, str(threshold)))
        return rows

    return Probe(aggs, build)


def completeness(df, columns, threshold=0.95) -> DataFrame:
    return run_probes(df, [completeness_probe(df, columns, threshold)])


def date_range(df: DataFrame, day: str, start: str | None = None, end: str | None = None, max_gap_days: int | None = None) -> DataFrame:
    """First and last day must equal the expected ones; gaps between distinct days stay within the limit."""
    days = df.select(F.to_date(day).alias("d")).where("d IS NOT NULL").groupBy("d").agg(N().alias("_n"))
    w = by_period([], "d")
    g = days.withColumn("gap", F.date_diff("d", F.lag("d").over(w)))
    one = g.agg(F.min("d").alias("a"), F.max("d").alias("b"), F.max("gap").alias("worst"),
                F.count_if(F.col("gap") > (max_gap_days or 0)).alias("n_gaps"))
    rows = []
    if start:
        ok = F.coalesce(F.col("a") == F.lit(start).cast("date"), F.lit(False))
        rows.append(check_row("date_start", day, ok, F.when(ok, "PASS").otherwise("WARNING"), None, start, F.col("a")))
    if end:
        ok = F.coalesce(F.col("b") == F.lit(end).cast("date"), F.lit(False))
        rows.append(check_row("date_end", day, ok, F.when(ok, "PASS").otherwise("WARNING"), None, end, F.col("b")))
    if max_gap_days is not None:
        ok = F.col("n_gaps") == 0
        rows.append(check_row("date_gaps", day, ok, F.when(ok, "PASS").otherwise("WARNING"), F.col("n_gaps"), str(max_gap_days), F.col("worst")))
    return emit(one, rows)


def referential_integrity(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Orphans over all child rows: above 5 % BLOCKER, above zero WARNING.

    Child rows are counted per key first, so a hot key joins as one row.
    """
    per = child.groupBy(F.col(child_key).alias("_k")).agg(N().alias("_n"))
    known = parent.select(F.col(parent_key).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    one = per.join(known, "_k", "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("_k").isNotNull() & F.col("_hit").isNull(), F.col("_n"))), F.lit(0)).alias("orphans"))
    rate = F.coalesce(ratio("orphans", "n"), F.lit(0.0))
    sev = severity_scale(rate, 0.05, 0.0)
    return emit(one, [check_row("referential_integrity", child_key, F.col("orphans") == 0, sev, rate, "0", F.col("orphans"))])


def domain_probe(column: str, values: list | None = None, low=None, high=None) -> Probe:
    c = F.col(column)
    aggs, rows = {}, []
    if values is not None:
        aggs[f"_ux_{column}"] = F.count_if(c.isNotNull() & ~c.isin(values))
    if low is not None:
        aggs[f"_lo_{column}"] = F.count_if(c < low)
    if high is not None:
        aggs[f"_hi_{column}"] = F.count_if(c > high)

    def build():
        for name, label, want in ((f"_ux_{column}", "domain_values", None if values is None else str(len(values))),
                                  (f"_lo_{column}", "domain_low", str(low)), (f"_hi_{column}", "domain_high", str(high))):
            if name in aggs:
                ok = F.col(name) == 0
                rows.append(check_row(label, column, ok, F.when(ok, "PASS").otherwise("WARNING"), F.col(name), want))
        return rows

    return Probe(aggs, build)


def value_domain(df, column, values=None, low=None, high=None) -> DataFrame:
    return run_probes(df, [domain_probe(column, values, low, high)])


def unexpected_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Unexpected categories with their counts."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values)).groupBy(column).agg(N().alias("n"))


def row_count_probe(low: int = 1, high: int | None = None) -> Probe:
    def build():
        n = F.col("_n")
        ok = n >= low if high is None else (n >= low) & (n <= high)
        return [check_row("row_count", "*", ok, F.when(ok, "PASS").otherwise("BLOCKER"), n, f"{low}..{'' if high is None else high}")]
    return Probe({"_n": N()}, build)


def row_count(df, low=1, high=None) -> DataFrame:
    return run_probes(df, [row_count_probe(low, high)])


def run_structural(df: DataFrame, config: dict | None = None) -> DataFrame:
    """Configured structural checks; all plain aggregates share one scan.

    Keys: columns, types, completeness (list), threshold, min_rows, max_rows,
    domains {column: values}, primary_key, date_range {column, start, end,
    max_gap_days}, references [(child key, parent frame, parent key)].
    """
    cfg = config or {}
    cols = cfg.get("columns", df.columns)
    probes = [completeness_probe(df, cfg.get("completeness", cols), cfg.get("threshold", 0.95)),
              row_count_probe(cfg.get("min_rows", 1), cfg.get("max_rows"))]
    probes += [domain_probe(c, v) for c, v in cfg.get("domains", {}).items()]
    frames = [schema_check(df, cols, cfg.get("types")), run_probes(df, probes)]
    if "primary_key" in cfg:
        frames.append(primary_key(df, cfg["primary_key"]))
    if "date_range" in cfg:
        r = cfg["date_range"]
        frames.append(date_range(df, r["column"], r.get("start"), r.get("end"), r.get("max_gap_days")))
    for child_key, parent, parent_key in cfg.get("references", []):
        frames.append(referential_integrity(df, child_key, parent, parent_key))
    return stack_rows(frames)
