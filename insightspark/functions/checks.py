"""Check results as rows, and many checks over one scan.

A :class:`Probe` carries the aggregates a check needs and how its rows follow
from them. ``run_probes`` evaluates any number of probes in one aggregate job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECK_SCHEMA = T.StructType([
    T.StructField("check_name", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("severity", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("expected", T.StringType()),
    T.StructField("detail", T.StringType()),
])


def _text(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def check_row(check, subject, ok, severity, value=None, expected=None, detail=None) -> Column:
    """One check result as a struct column; literals or columns welcome."""
    ok = ok if isinstance(ok, Column) else F.lit(ok)
    value = value if isinstance(value, Column) else F.lit(value)
    return F.struct(
        _text(check).alias("check_name"), _text(subject).alias("subject"),
        ok.cast("boolean").alias("ok"), _text(severity).alias("severity"),
        value.cast("double").alias("value"), _text(expected).alias("expected"),
        _text(detail).alias("detail"))


def emit(df: DataFrame, rows: list[Column], keys: tuple = ()) -> DataFrame:
    """Turn one wide row into one row per check."""
    return df.select(*keys, F.inline(F.array(*rows)))


def as_checks(df: DataFrame, check: str, subject, severity, value=None, keys: tuple = ()) -> DataFrame:
    """Result rows of an operator with columns of its own, as check rows; only PASS counts as ok."""
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select(*keys, check_row(check, subject, severity == "PASS", severity, value).alias("_c")).select(*keys, "_c.*")


@dataclass
class Probe:
    """Aggregates by name plus the rows made from them."""

    aggs: dict[str, Column] = field(default_factory=dict)
    rows: Callable[[], list[Column]] = list


def run_probes(df: DataFrame, probes: list[Probe], keys: tuple = ()) -> DataFrame:
    """Evaluate all probes in one pass over ``df`` (per ``keys`` when given)."""
    wanted: dict[str, Column] = {}
    for i, p in enumerate(probes):
        wanted.update(p.aggs)
    rows = [r for p in probes for r in p.rows()]
    if not wanted:
        wanted = {"_n": F.count(F.lit(1))}
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return emit(grouped.agg(*[c.alias(n) for n, c in wanted.items()]), rows, keys)


def static_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Check rows known from metadata alone."""
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def stack_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def severity_scale(value, blocker, warning) -> Column:
    """BLOCKER above ``blocker``, WARNING above ``warning``, else PASS."""
    return (F.when(value > blocker, "BLOCKER").when(value > warning, "WARNING").otherwise("PASS"))
