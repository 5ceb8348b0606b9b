"""Small column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """Double with NaN turned into NULL."""
    d = as_col(c).cast("double")
    return F.when(~F.isnan(d), d)


def ratio(num, den) -> Column:
    """num / den as double; NULL on a zero or NULL denominator."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def bucketize(col, edges, labels, null_label=None, zero_label=None, right=True) -> Column:
    """Ordered buckets over ``edges``; ``labels`` has one more entry than ``edges``.

    ``right=True`` closes a bucket on its upper edge (``v <= edge``).
    NULL takes ``null_label`` and exact zero ``zero_label`` when these are given.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    c = as_col(col)
    out = F.lit(None).cast("string")
    chain = F.when(c.isNull(), F.lit(null_label).cast("string"))
    if zero_label is not None:
        chain = chain.when(c == 0, F.lit(zero_label))
    for edge, label in zip(edges, labels):
        chain = chain.when((c <= edge) if right else (c < edge), F.lit(label))
    out = chain.otherwise(F.lit(labels[-1]))
    return out


def pct_change(new, old) -> Column:
    """(new - old) / |old|; NULL when old is zero or NULL."""
    n, o = as_col(new).cast("double"), as_col(old).cast("double")
    return F.try_divide(n - o, F.abs(o))


def sign_label(delta) -> Column:
    d = as_col(delta)
    return F.when(d > 0, "up").when(d < 0, "down").otherwise("flat")


def worst(*severities) -> Column:
    """Most serious of several BLOCKER / WARNING / PASS columns."""
    hits = [as_col(s) for s in severities]
    blocker, warning = F.lit(False), F.lit(False)
    for s in hits:
        blocker = blocker | (s == "BLOCKER")
        warning = warning | (s == "WARNING")
    return F.when(blocker, "BLOCKER").when(warning, "WARNING").otherwise("PASS")


def dates_between(start, end, unit="day") -> Column:
    """Array of period starts from ``start`` to ``end``."""
    step = {"hour": F.expr("INTERVAL 1 HOUR"), "day": F.expr("INTERVAL 1 DAY"),
            "week": F.expr("INTERVAL 7 DAYS"), "month": F.expr("INTERVAL 1 MONTH")}[unit]
    return F.sequence(as_col(start), as_col(end), step)


def with_totals(df, keys, sums):
    """Add totals over ``keys`` (output name -> column summed) to a table of groups.

    For keys that name dimensions or columns: the totals are then a few rows, which
    metadata bounds, so they are broadcast, and the values of one dimension need not meet
    in one task as they would in a window.
    """
    named = {k: f"_t_{k}" for k in keys}
    totals = df.groupBy(*[F.col(k).alias(t) for k, t in named.items()]).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    same = F.lit(True)
    for k, t in named.items():
        same = same & F.col(k).eqNullSafe(F.col(t))
    return df.join(F.broadcast(totals), same).drop(*named.values())
