"""Customer value: RFM segments and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.functions.columns import ratio
from insightspark.functions.ranks import prefix_totals, quantiles

N = lambda: F.count(F.lit(1))
_PROBS = sorted({i / q for q in (5, 4, 3, 2) for i in range(q + 1)})


def _usable_edges(edges):
    """Edges of the split with the most bins that has no repeated edge; NULL when none has."""
    chosen = F.lit(None).cast("array<double>")
    for q in (2, 3, 4, 5):
        cut = F.array(*[edges[_PROBS.index(i / q)] for i in range(q + 1)])
        chosen = F.when(F.size(F.array_distinct(cut)) == q + 1, cut).otherwise(chosen)
    return chosen


def _score(cut, value, labels):
    """Label of the right-closed bin; 3 for everyone without usable edges."""
    inner = F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 2, F.lit(0)))
    pos = F.size(F.filter(inner, lambda x: x < value)) + 1
    return F.when(cut.isNull(), F.lit(3)).otherwise(F.element_at(F.array(*[F.lit(x) for x in labels]), pos))


def rfm(df: DataFrame, customer: str, day: str, revenue: str, reference: str | None = None) -> DataFrame:
    """Recency, frequency, monetary scores and segment per customer.

    The quantile edges of all three measures come from one exact pass over the
    customers; the edges themselves are three short arrays.
    """
    base = df.where(F.col(customer).isNotNull()).groupBy(customer).agg(F.max(F.to_date(day)).alias("_last"), F.count(day).alias("frequency"), F.coalesce(F.sum(revenue), F.lit(0.0)).alias("monetary"))
    ref = F.date_add(base.agg(F.max("_last")).scalar(), 1) if reference is None else F.lit(reference).cast("date")
    base = base.withColumn("recency", F.date_diff(ref, F.col("_last"))).drop("_last")
    measures = ["recency", "frequency", "monetary"]
    long = base.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])))
    q = quantiles(long, ["measure"], "v", _PROBS, few_groups=True)
    per = q.groupBy("measure").agg(F.transform(F.array_sort(F.collect_list(F.struct("prob", "quantile"))), lambda s: s["quantile"]).alias("e"))
    per = per.select("measure", _usable_edges(F.col("e")).alias("cut"))
    edges = per.agg(F.map_from_entries(F.collect_list(F.struct("measure", "cut")))).scalar()
    s = base.withColumn("_e", edges)
    for name, m, labels in (("r", "recency", [5, 4, 3, 2, 1]), ("f", "frequency", [1, 2, 3, 4, 5]), ("m", "monetary", [1, 2, 3, 4, 5])):
        s = s.withColumn(name, _score(F.col("_e")[m], F.col(m).cast("double"), labels))
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    seg = (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions").when((f >= 3) & (m >= 3), "Loyal").when((r <= 2) & (f >= 3), "At Risk")
            .when((r <= 2) & (f <= 2) & (m <= 2), "Lost").otherwise("Other"))
    return s.withColumn("rfm_score", F.concat(r.cast("string"), f.cast("string"), m.cast("string"))).withColumn("segment", seg).drop("_e")


def rfm_summary(scored: DataFrame) -> DataFrame:
    """Size, share and averages per segment."""
    g = scored.groupBy("segment").agg(N().alias("customers"), F.round(F.avg("monetary"), 2).alias("avg_monetary"), F.round(F.avg("frequency"), 2).alias("avg_frequency"))
    return g.withColumn("pct", F.round(100.0 * ratio("customers", g.agg(F.sum("customers")).scalar()), 1))


def _prefix(df: DataFrame, entity: str | None, value: str) -> DataFrame:
    """Distinct entity totals with counts and running totals of everything smaller."""
    v = df.groupBy(entity).agg(F.sum(value).cast("double").alias("v")) if entity else df.select(F.col(value).cast("double").alias("v"))
    c = v.where("v IS NOT NULL").groupBy("v").agg(N().alias("n")).withColumn("nv", F.col("n") * F.col("v"))
    return prefix_totals(c, [], "v", {"n_before": "n", "v_before": "nv"})


def concentration(df: DataFrame, value: str, entity: str | None = None) -> DataFrame:
    """Gini, top 10/20/50 % shares and the share of entities that makes 80 % of the value.

    Works on distinct totals with prefix sums; within a run of equal totals every
    figure has a closed form, so entities are never ranked one by one.
    """
    p = _prefix(df, entity, value)
    n, total, c, m, v = F.col("n_before_all"), F.col("v_before_all"), F.col("n_before"), F.col("n"), F.col("v")
    ranks = m * c + m * (m + 1) / 2.0
    top = lambda pct: F.sum(F.greatest(F.lit(0), F.least(m, c + m - (n - F.ceil(n * pct / 100.0)))) * v)
    above_n, above_v = n - c - m, total - F.col("v_before") - m * v
    need = F.ceil((0.8 * total - above_v) / v)
    reach = F.when((above_v + m * v >= 0.8 * total) & (v > 0), above_n + F.greatest(need, F.lit(1)))
    one = p.agg(F.max(n).alias("n_entities"), F.max(total).alias("total"), F.sum(ranks * v).alias("_w"), top(10).alias("_t10"), top(20).alias("_t20"), top(50).alias("_t50"), F.min(reach).alias("_k"))
    gini = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.col("_w") / (F.col("n_entities") * F.col("total")) - (F.col("n_entities") + 1) / F.col("n_entities")))
    return one.select("n_entities", "total", F.coalesce(F.when(F.col("total") != 0, gini), F.lit(0.0)).alias("gini"),
                      *[F.coalesce(ratio(f"_t{k}", "total"), F.lit(0.0)).alias(f"top_{k}_share") for k in (10, 20, 50)],
                      F.when(F.col("total") == 0, 100.0).otherwise(100.0 * ratio("_k", "n_entities")).alias("pareto_pct"))


def lorenz_curve(df: DataFrame, value: str, entity: str | None = None, points: int = 10) -> DataFrame:
    """Cumulative share of value held by the lowest x of the entities, at equal steps of x."""
    p = _prefix(df, entity, value)
    step = p.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(points)))).withColumn("k", F.floor(F.col("n_before_all") * F.col("i") / points))
    inside = F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - F.col("n_before")))
    return step.groupBy("i").agg(F.sum(inside * F.col("v")).alias("cum"), F.max("v_before_all").alias("t")).select(
        (F.col("i") / points).alias("entity_share"), ratio("cum", "t").alias("value_share"))
