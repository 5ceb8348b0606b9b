"""Business rules over tables of rules and metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.functions.checks import Probe, check_row, emit, run_probes, severity_scale, stack_rows
from insightspark.functions.columns import ratio, sign_label
from insightspark.functions.ranks import quantiles_wide
from insightspark.operators.logical import step_changes
from insightspark.operators.windows import by_period

N = lambda: F.count(F.lit(1))

# Default rules for common metric names.
DEFAULT_RULES = {
    "ranges": [
        {"column": "conversion_rate", "min": 0, "max": 1, "label": "Conversion Rate"},
        {"column": "bounce_rate", "min": 0, "max": 1, "label": "Bounce Rate"},
        {"column": "click_through_rate", "min": 0, "max": 1, "label": "Click-Through Rate"},
        {"column": "retention_rate", "min": 0, "max": 1, "label": "Retention Rate"},
        {"column": "churn_rate", "min": 0, "max": 1, "label": "Churn Rate"},
        {"column": "nps_score", "min": -100, "max": 100, "label": "NPS Score"},
    ],
    "no_negative": ["revenue", "orders", "sessions", "users", "page_views", "transactions", "quantity"],
    "cardinality": [{"column": "device", "min": 2, "max": 10}, {"column": "country", "min": 1, "max": 300}],
}
METRIC_REQUIRED = ["name", "display_name", "definition"]
METRIC_STATUSES = ["active", "deprecated", "draft"]


def range_probe(df: DataFrame, rules: list[dict]) -> Probe:
    aggs = {}
    for i, r in enumerate(rules):
        if r["column"] in df.columns:
            c = F.col(r["column"]).cast("double")
            bad = F.lit(False)
            if r.get("min") is not None:
                bad = bad | (c < r["min"])
            if r.get("max") is not None:
                bad = bad | (c > r["max"])
            aggs[f"_rg_n{i}"] = F.count(c)
            aggs[f"_rg_b{i}"] = F.count_if(bad)

    def build():
        out = []
        for i, r in enumerate(rules):
            want = f"{r.get('min')}..{r.get('max')}"
            if f"_rg_n{i}" not in aggs:
                out.append(check_row("range", r["label"], False, "WARNING", 0, want, "missing column"))
                continue
            pct = F.coalesce(ratio(f"_rg_b{i}", f"_rg_n{i}"), F.lit(0.0))
            empty = F.col(f"_rg_n{i}") == 0
            sev = F.when(empty, "WARNING").otherwise(severity_scale(pct, 0.05, 0.0))
            out.append(check_row("range", r["label"], sev == "PASS", sev, F.round(pct, 6), want, F.col(f"_rg_b{i}")))
        return out
    return Probe(aggs, build)


def ranges(df: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per rule, passing ones included."""
    return run_probes(df, [range_probe(df, rules)])


_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[-+*/() ]")


def metric_expr(text: str, columns: list[str]):
    """Arithmetic over known columns only; anything else is refused."""
    pieces = _TOKEN.findall(text)
    if "".join(pieces) != text:
        raise ValueError(f"unsupported characters in expression: {text}")
    for p in pieces:
        if p[0].isalpha() or p[0] == "_":
            if p not in columns:
                raise KeyError(p)
    return F.expr(re.sub(r"/\s*([A-Za-z_]\w*|\([^()]*\)|\d+(?:\.\d+)?)", r"/ nullif(\1, 0)", text)).cast("double")


def metric_relationships(metrics: DataFrame, rules: list[tuple], keys: list[str] = (), tolerance: float = 0.05) -> DataFrame:
    """left ≈ right for every (name, left, right) rule; rules on missing metrics are skipped."""
    rows = []
    for name, left, right in rules:
        try:
            l, r = metric_expr(left, metrics.columns), metric_expr(right, metrics.columns)
        except KeyError:
            continue
        gap = F.coalesce(ratio(F.abs(l - r), F.when(r != 0, F.abs(r)).otherwise(F.abs(l))), F.lit(0.0))
        ok = gap <= tolerance
        rows.append(check_row("metric_relationship", name, ok, F.when(ok, "PASS").otherwise("WARNING"), gap, f"{left} = {right}"))
    return emit(metrics, rows, tuple(keys))


def period_change_limit(series: DataFrame, order: str, value: str, max_pct: float = 200.0, keys: list[str] = ()) -> DataFrame:
    """Periods whose change exceeds ``max_pct`` percent."""
    out = step_changes(series, order, value, max_pct / 100.0, keys)
    return out.withColumn("change_pct", F.round(100.0 * F.col("change"), 2)).drop("change")


def segment_coverage(df: DataFrame, segment: str, expected: list, allow_other: bool = True) -> DataFrame:
    """Missing and unexpected segments from the distinct values."""
    have = df.where(F.col(segment).isNotNull()).select(F.col(segment).cast("string").alias("v")).distinct().withColumn("_h", F.lit(True))
    want = df.sparkSession.createDataFrame([(str(v),) for v in expected], "v string").withColumn("_w", F.lit(True))
    both = have.join(want, "v", "full_outer")
    state = F.when(F.col("_h").isNull(), "missing").when(F.col("_w").isNull(), "unexpected").otherwise("expected")
    ok = state == "expected" if not allow_other else state != "missing"
    return both.select(check_row("segment_coverage", F.col("v"), ok, F.when(ok, "PASS").otherwise("WARNING"), None, None, state).alias("r")).select("r.*")


def no_negative_probe(df: DataFrame, columns: list[str]) -> Probe:
    present = [c for c in columns if c in df.columns]
    aggs = {f"_neg_{c}": F.count_if(F.col(c) < 0) for c in present} | {f"_min_{c}": F.min(c) for c in present}

    def build():
        return [check_row("no_negative", c, F.col(f"_neg_{c}") == 0, F.when(F.col(f"_neg_{c}") == 0, "PASS").otherwise("WARNING"),
                          F.col(f"_neg_{c}"), "0", F.col(f"_min_{c}")) for c in present]
    return Probe(aggs, build)


def no_negative(df, columns) -> DataFrame:
    return run_probes(df, [no_negative_probe(df, columns)])


def cardinality_probe(df: DataFrame, rules: list[dict]) -> Probe:
    present = [r for r in rules if r["column"] in df.columns]
    aggs = {f"_card_{r['column']}": F.count_distinct(r["column"]) for r in present}

    def build():
        out = []
        for r in present:
            n = F.col(f"_card_{r['column']}")
            ok = F.lit(True)
            if r.get("min") is not None:
                ok = ok & (n >= r["min"])
            if r.get("max") is not None:
                ok = ok & (n <= r["max"])
            out.append(check_row("cardinality", r["column"], ok, F.when(ok, "PASS").otherwise("WARNING"), n, f"{r.get('min')}..{r.get('max')}"))
        return out
    return Probe(aggs, build)


def cardinality(df, rules) -> DataFrame:
    return run_probes(df, [cardinality_probe(df, rules)])


def rates(df: DataFrame, num: str, den: str, name: str = "rate", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Zero denominators, out-of-range rates and rate statistics of one ratio."""
    r = df.select(ratio(num, den).alias("r"), (F.col(den).isNull() | (F.col(den) == 0)).alias("z"))
    one = r.agg(N().alias("n"), F.count_if("z").alias("zero_denominators"), F.count("r").alias("n_rates"),
                F.count_if((F.col("r") < low) | (F.col("r") > high)).alias("out_of_range"),
                F.avg("r").alias("mean"), F.min("r").alias("min"), F.max("r").alias("max"))
    med = quantiles_wide(r, [], "r", {"median": 0.5})
    pct = F.coalesce(ratio("out_of_range", "n_rates"), F.lit(0.0))
    sev = (F.when(F.col("n") == 0, "PASS").when(F.col("n_rates") == 0, "BLOCKER")
            .when((F.col("zero_denominators") > 0) & (pct > 0.05), "BLOCKER")
            .when((F.col("out_of_range") > 0) | (F.col("zero_denominators") > 0), "WARNING").otherwise("PASS"))
    return one.withColumn("median", med.select("median").scalar()).select(
        F.lit(name).alias("rate_name"), "zero_denominators", "out_of_range", "mean", "median", "min", "max", sev.alias("severity"))


def yoy(series: DataFrame, keys: list[str], year: str, value: str, max_change: float = 2.0) -> DataFrame:
    """Year over year change per key: BLOCKER above the limit or from zero, WARNING above half of it."""
    prev = F.lag(value).over(by_period(keys, year)).cast("double")
    s = series.withColumn("prior", prev).where(F.col("prior").isNotNull())
    change = F.when((F.col("prior") == 0) & (F.col(value) == 0), F.lit(0.0)).otherwise(ratio(F.col(value) - F.col("prior"), F.abs("prior")))
    s = s.withColumn("change", change)
    size = F.abs("change")
    sev = (F.when(F.col("change").isNull() | (size > max_change), "BLOCKER").when(size > max_change / 2, "WARNING").otherwise("PASS"))
    return s.withColumn("direction", sign_label(F.coalesce("change", F.col(value)))).withColumn("severity", sev)


def run_business(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Range, sign, cardinality and coverage rules; plain aggregates share one scan."""
    cfg = DEFAULT_RULES if rules is None else rules
    probes = [range_probe(df, cfg.get("ranges", [])), no_negative_probe(df, cfg.get("no_negative", [])), cardinality_probe(df, cfg.get("cardinality", []))]
    frames = [run_probes(df, [p for p in probes if p.aggs or p.rows()])]
    for c, expected in cfg.get("segment_coverage", {}).items():
        frames.append(segment_coverage(df, c, expected))
    return stack_rows(frames)


def knowledge_rules(metrics: DataFrame, definitions: DataFrame) -> DataFrame:
    """Metric values (metric, value rows) against min/max of a definitions table; share out of range per metric."""
    d = definitions.select(F.col("name").alias("metric"), "min_value", "max_value")
    bad = (F.col("value") < F.col("min_value")) | (F.col("value") > F.col("max_value"))
    g = metrics.join(d, "metric").groupBy("metric").agg(F.count("value").alias("n"), F.count_if(bad).alias("n_out"))
    pct = F.coalesce(ratio("n_out", "n"), F.lit(0.0))
    return g.withColumn("severity", severity_scale(pct, 0.05, 0.0))


def metric_plausibility(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """ok = inside min/max; more than 50 % away from the target only warns."""
    d = definitions.select(F.col("name").alias("metric"), "min_value", "max_value", "target")
    v = values.join(d, "metric", "left")
    below, above = F.col("value") < F.col("min_value"), F.col("value") > F.col("max_value")
    far = 100.0 * ratio(F.abs(F.col("value") - F.col("target")), "target") > 50
    bad = F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))
    return v.withColumn("ok", ~bad).withColumn("warning", F.when(below, "below min").when(above, "above max").when(far, "far from target"))


def metric_definition_lint(definitions: DataFrame) -> DataFrame:
    """Errors per metric definition as text, NULL when clean."""
    errors = [F.when(F.coalesce(F.length(F.trim(f)), F.lit(0)) == 0, F.lit(f"missing {f}")) for f in METRIC_REQUIRED]
    errors.append(F.when(F.col("status").isNotNull() & ~F.col("status").isin(METRIC_STATUSES), "invalid status"))
    errors.append(F.when(F.col("min_value") > F.col("max_value"), "min above max"))
    joined = F.concat_ws("; ", *errors)
    warn = F.concat_ws("; ", F.when(F.col("grain").isNull(), "no grain"), F.when(F.col("owner").isNull(), "no owner"),
                       F.when(~F.col("name").rlike("^[A-Za-z0-9_]+$"), "name not snake_case"))
    return definitions.select("name", (joined == "").alias("ok"), F.nullif(joined, F.lit("")).alias("errors"), F.nullif(warn, F.lit("")).alias("warnings"))
