"""Statistics and experiment queries. SQL covers the statistics; tail
probabilities need special functions SQL lacks and are tested separately."""

from __future__ import annotations

from pyspark.sql import functions as F

from insightspark.functions.scalars import week_start
from insightspark.operators import experiments as E
from insightspark.operators import statistics as S
from insightspark.plans.registry import query

N = lambda: F.count(F.lit(1))


def users(t):
    """One row per user: arm, platform, KPIs, first day, pre-period activity."""
    e = t.events
    on = lambda k, v: F.sum(F.when(F.col("event_type") == k, v).otherwise(0.0))
    u = e.groupBy("user_id").agg(
        N().cast("double").alias("events"), on("purchase", F.col("value")).alias("revenue"), on("click", F.lit(1.0)).alias("clicks"),
        F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 45), 1.0).otherwise(0.0)).alias("big_buyer"),
        F.min(F.to_date("ts")).alias("first_day"), F.sum(F.when(F.col("ts") < "2024-01-08", 1.0).otherwise(0.0)).alias("pre_events"))
    return u.withColumn("arm", F.when(F.col("user_id") % 2 == 0, "control").otherwise("variant")).withColumn("platform", F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")))


_U = """u AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS events, sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS revenue, CAST(sum(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS DOUBLE) AS clicks,
 max(CASE WHEN event_type='purchase' AND value > 45 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS big_buyer, min(CAST(ts AS DATE)) AS first_day, CAST(sum(CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 1 ELSE 0 END) AS DOUBLE) AS pre_events,
 CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'variant' END AS arm, 'p' || CAST(user_id % 3 AS VARCHAR) AS platform FROM events GROUP BY user_id)"""


def _arms(m, src="u", by=""):
    b = f"{by}, " if by else ""
    return f"""SELECT {b}count(CASE WHEN arm='control' THEN {m} END) AS n_a, count(CASE WHEN arm='variant' THEN {m} END) AS n_b, sum(CASE WHEN arm='control' THEN {m} END) AS sum_a, sum(CASE WHEN arm='variant' THEN {m} END) AS sum_b,
 avg(CASE WHEN arm='control' THEN {m} END) AS mean_a, avg(CASE WHEN arm='variant' THEN {m} END) AS mean_b, var_samp(CASE WHEN arm='control' THEN {m} END) AS var_a, var_samp(CASE WHEN arm='variant' THEN {m} END) AS var_b FROM {src}""" + (f" GROUP BY {by}" if by else "")


_T = "(mean_a - mean_b)/nullif(sqrt(var_a/n_a + var_b/n_b), 0)"
_Z = "1.959963984540054"


@query("k1_proportion_z", f"""WITH {_U}, s AS ({_arms('big_buyer', by='platform')}), p AS (SELECT *, (sum_a + sum_b)/(n_a + n_b) AS pool FROM s)
SELECT platform, n_a, n_b, round(mean_b - mean_a, 6) AS diff, round((mean_b - mean_a)/nullif(sqrt(pool*(1-pool)*(1.0/n_a + 1.0/n_b)), 0), 6) AS z,
 round(mean_b - mean_a - {_Z}*sqrt(mean_a*(1-mean_a)/n_a + mean_b*(1-mean_b)/n_b), 6) AS ci_low, round(mean_b - mean_a + {_Z}*sqrt(mean_a*(1-mean_a)/n_a + mean_b*(1-mean_b)/n_b), 6) AS ci_high FROM p""")
def k1(t):
    s = S.arm_stats(users(t), ["platform"], "arm", "big_buyer", "control", "variant")
    return S.proportion_z(s).select("platform", "n_a", "n_b", "diff", "z", "ci_low", "ci_high")


@query("k2_welch_t", f"""WITH {_U}, s AS ({_arms('revenue', by='platform')})
SELECT platform, n_a, n_b, round(mean_b - mean_a, 4) AS diff, round({_T}, 4) AS t_stat, round(pow(var_a/n_a + var_b/n_b, 2)/(pow(var_a/n_a, 2)/(n_a-1) + pow(var_b/n_b, 2)/(n_b-1)), 4) AS df,
 round((mean_b - mean_a)/sqrt(((n_a-1)*var_a + (n_b-1)*var_b)/(n_a+n_b-2)), 4) AS cohens_d FROM s""", digits=4)
def k2(t):
    s = S.arm_stats(users(t), ["platform"], "arm", "revenue", "control", "variant")
    return S.welch_t(s, with_p=False).select("platform", "n_a", "n_b", "diff", "t_stat", "df", "cohens_d")


@query("k2_welch_t_full")
def k2b(t):
    s = S.welch_t(S.arm_stats(users(t), ["platform"], "arm", "revenue", "control", "variant"))
    return s.withColumn("verdict", S.significance(F.col("p_value"))).withColumn("effect", S.effect_label(F.col("cohens_d")))


@query("k3_mann_whitney", """
WITH d AS (SELECT l_returnflag AS rf, l_extendedprice AS v, CASE WHEN l_linestatus = 'F' THEN 'a' ELSE 'b' END AS side FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY rf ORDER BY v) + (count(*) OVER (PARTITION BY rf, v) - 1)/2.0 AS ar, count(*) OVER (PARTITION BY rf, v) AS t FROM d),
g AS (SELECT rf, CAST(count(CASE WHEN side='a' THEN 1 END) AS DOUBLE) AS na, CAST(count(CASE WHEN side='b' THEN 1 END) AS DOUBLE) AS nb, sum(CASE WHEN side='a' THEN ar END) AS ra, sum(CAST(t AS DOUBLE)*t - 1) AS ties FROM r GROUP BY 1),
u AS (SELECT *, ra - na*(na+1)/2 AS u FROM g)
SELECT rf, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(u, 1) AS u_stat, round(1 - 2*u/(na*nb), 6) AS rank_biserial,
 round((greatest(u, na*nb - u) - na*nb/2 - 0.5)/sqrt(na*nb/12*((na+nb+1) - ties/((na+nb)*(na+nb-1)))), 6) AS z FROM u""")
def k3(t):
    df = t.lineitem.select(F.col("l_returnflag").alias("rf"), "l_linestatus", "l_extendedprice")
    c = S.side_counts(df, ["rf"], "l_linestatus", "l_extendedprice", "F", "O")
    return S.mann_whitney(c, ["rf"], with_p=False).withColumn("u_stat", F.round("u_stat", 1))


@query("k4_mean_ci", """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(stddev_samp(o_totalprice)/sqrt(count(*)), 4) AS se FROM orders GROUP BY 1""", digits=4)
def k4(t):
    return S.mean_ci(t.orders, ["o_orderpriority"], "o_totalprice", with_ci=False)


_CHI = """WITH c AS (SELECT {r} AS r, {c} AS c, count(*) AS o FROM {t} GROUP BY 1, 2), m AS (SELECT *, sum(o) OVER (PARTITION BY r) * CAST(sum(o) OVER (PARTITION BY c) AS DOUBLE) / sum(o) OVER () AS e FROM c)"""


@query("k5_chi_squared", _CHI.format(r="o_orderpriority", c="o_orderstatus", t="orders") + """
SELECT round(sum((o-e)*(o-e)/e), 6) AS chi2, CAST((count(DISTINCT r)-1)*(count(DISTINCT c)-1) AS BIGINT) AS dof, CAST(sum(o) AS BIGINT) AS n FROM m""")
def k5(t):
    return S.chi_squared(t.orders, "o_orderpriority", "o_orderstatus", with_p=False)


@query("k5_chi_squared_yates", _CHI.format(r="l_linestatus", c="l_quantity > 20", t="lineitem") + """
SELECT round(sum(pow(abs(o-e) - least(0.5, abs(o-e)), 2)/e), 6) AS chi2, 1::BIGINT AS dof, CAST(sum(o) AS BIGINT) AS n FROM m""")
def k5b(t):
    return S.chi_squared(t.lineitem.withColumn("big", F.col("l_quantity") > 20), "l_linestatus", "big", with_p=False)


_STEPS = " + ".join(f"CAST(drawn >= {step} AS INT)" for step in S.POISSON_STEPS)


def _mix(start, name):
    """The 32-bit finalizer of an expression, in steps that are columns."""
    return f"""CAST({start} AS UBIGINT) AS {name}_0, xor({name}_0, {name}_0 >> 16) * 2146121005::UBIGINT % 4294967296 AS {name}_1, xor({name}_1, {name}_1 >> 15) * 2221713035::UBIGINT % 4294967296 AS {name}_2, xor({name}_2, {name}_2 >> 16) AS {name}"""


def _boot_sql(num, den):
    """Every row and replicate with its Poisson weight, from the same hash of key and replicate."""
    return f"""WITH k AS (SELECT CAST(event_id % 4294967296 AS UBIGINT) AS low, CAST(event_id // 4294967296 AS UBIGINT) AS high, {num} AS x, {den} AS w FROM events),
a AS (SELECT *, {_mix("xor(high, 7::UBIGINT)", "z")}, {_mix("xor(low, z)", "one")}, {_mix("(one + low + 1) % 4294967296", "two")} FROM k),
h AS (SELECT b, x, w, {_mix("xor(one, CAST(b AS UBIGINT) * 2654435769::UBIGINT % 4294967296)", "turn")}, {_mix("(turn + two) % 4294967296", "drawn")} FROM (SELECT x, w, one, two FROM a), range(1, 1001) r(b)),
s AS (SELECT b, sum(x * k) / sum(w * k) AS stat FROM (SELECT b, x, w, {_STEPS} AS k FROM h) GROUP BY 1)
SELECT round(quantile_cont(stat, 0.025), 6) AS ci_low, round(quantile_cont(stat, 0.975), 6) AS ci_high, round(stddev_samp(stat), 6) AS boot_se, count(*) AS replicates, (SELECT round(sum(x) / sum(w), 6) FROM k) AS estimate FROM s"""


@query("k6_bootstrap_ci", _boot_sql("coalesce(value, 0)", "CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END"))
def k6(t):
    return S.bootstrap_mean_ci(t.events, "event_id", "value")


@query("k6_bootstrap_ratio_ci", _boot_sql("CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END", "CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END"))
def k6c(t):
    """Revenue for each view."""
    e = t.events.select("event_id", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0).alias("revenue"), (F.col("event_type") == "view").cast("double").alias("views"))
    return S.bootstrap_mean_ci(e, "event_id", "revenue", "views")


@query("k6_bootstrap_median_ci")
def k6b(t):
    return S.bootstrap_quantile_ci(t.lineitem, "l_extendedprice", 0.5)


@query("k7_adjust_pvalues", """
WITH p AS (SELECT l_suppkey AS id, count(CASE WHEN l_returnflag='R' THEN 1 END) / CAST(count(*) AS DOUBLE) / 20 AS p FROM lineitem GROUP BY 1),
r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, id) AS r FROM p)
SELECT id, round(p, 6) AS p, round(least(p*m, 1), 6) AS bonferroni, round(least(max((m-r+1)*p) OVER (ORDER BY r), 1), 6) AS holm, round(least(min(p*m/r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS benjamini_hochberg FROM r""")
def k7(t):
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg((F.count_if(F.col("l_returnflag") == "R") / N() / 20).alias("p"))
    return S.adjust_pvalues(p, "p", "id")


@query("k8_normality", """
WITH g AS (SELECT l_returnflag AS rf, CAST(count(*) AS DOUBLE) AS n, avg(pow(l_quantity - m, 3))/pow(max(sd), 3) AS g1, max(k) AS g2 FROM lineitem JOIN (SELECT l_returnflag AS f, avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd, kurtosis_pop(l_quantity) AS k FROM lineitem GROUP BY 1) ON f = l_returnflag GROUP BY 1),
a AS (SELECT *, g1*sqrt((n+1)*(n+3)/(6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS b, (g2 + 3 - 3*(n-1)/(n+1))/sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x,
 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS rb FROM g),
c AS (SELECT *, sqrt(2*(b-1)) - 1 AS w2, 6 + 8/rb*(2/rb + sqrt(1 + 4/(rb*rb))) AS aa FROM a),
z AS (SELECT rf, n, 1/sqrt(0.5*ln(w2))*asinh(y/sqrt(2/(w2-1))) AS zs, (1 - 2/(9*aa) - cbrt((1-2/aa)/(1 + x*sqrt(2/(aa-4)))))/sqrt(2/(9*aa)) AS zk FROM c)
SELECT rf, n, round(zs, 4) AS z_skew, round(zk, 4) AS z_kurt, round(zs*zs + zk*zk, 2) AS k2 FROM z""", digits=4)
def k8(t):
    out = S.normality(t.lineitem.withColumnRenamed("l_returnflag", "rf"), ["rf"], "l_quantity", with_p=False)
    return out.select("rf", "n", "z_skew", "z_kurt", F.round("k2", 2).alias("k2"))


def _dim(d):
    return f"""SELECT '{d}' AS dimension, (SELECT count(*) FROM (SELECT 1 FROM oc GROUP BY {d} HAVING count(*) >= 2)) AS n_groups,
 sum(n*(m-grand)*(m-grand))/max(sst) AS eta, (sum(n*(m-grand)*(m-grand))/(count(*)-1))/(sum(n*v)/(sum(n)-count(*))) AS f FROM (SELECT {d}, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM oc GROUP BY 1 HAVING count(*) >= 2),
 (SELECT avg(o_totalprice) AS grand, var_pop(o_totalprice)*count(*) AS sst FROM oc)"""


@query("k9_rank_dimensions", "WITH oc AS (SELECT o.*, c_mktsegment, c_nationkey FROM orders o JOIN customer ON o_custkey = c_custkey), r AS (" + " UNION ALL ".join(
    _dim(d) for d in ("c_mktsegment", "c_nationkey", "o_orderpriority", "o_orderstatus")) + """)
SELECT dimension, n_groups, round(eta, 6) AS eta_squared, round(f, 4) AS f_stat, CASE WHEN eta < 0.01 THEN 'negligible' WHEN eta < 0.06 THEN 'small' WHEN eta < 0.14 THEN 'medium' ELSE 'large' END AS effect, row_number() OVER (ORDER BY eta DESC) AS rank FROM r""")
def k9(t):
    oc = t.orders.join(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    out = S.rank_dimensions(oc, "o_totalprice", ["c_mktsegment", "c_nationkey", "o_orderpriority", "o_orderstatus"], with_p=False)
    return out.withColumn("f_stat", F.round("f_stat", 4)).withColumn("rank", F.col("rank").cast("long"))


_ZZ = "7.848879734349091"


@query("k10_sample_size_proportion", f"""
WITH b AS (SELECT o_orderpriority, count(CASE WHEN o_orderstatus='F' THEN 1 END)/CAST(count(*) AS DOUBLE) AS p FROM orders GROUP BY 1)
SELECT o_orderpriority, round(p, 6) AS rate, ceil({_ZZ}*(p*(1-p) + p*1.1*(1-p*1.1))/pow(p*0.1, 2)) AS n_per_group FROM b""")
def k10(t):
    b = t.orders.groupBy("o_orderpriority").agg((F.count_if(F.col("o_orderstatus") == "F") / N()).alias("rate"))
    return S.sample_size_proportion(b, "rate", 0.1)


@query("k10_sample_size_mean", f"""
WITH b AS (SELECT c_mktsegment, stddev_samp(c_acctbal) AS std, abs(avg(c_acctbal))*0.05 AS mde FROM customer GROUP BY 1)
SELECT c_mktsegment, round(std, 4) AS std, round(mde, 4) AS mde, ceil({_ZZ}*2*std*std/(mde*mde)) AS n_per_group, round(mde/std, 4) AS effect_d FROM b""", digits=4)
def k10b(t):
    b = t.customer.groupBy("c_mktsegment").agg(F.stddev_samp("c_acctbal").alias("std"), (F.abs(F.avg("c_acctbal")) * 0.05).alias("mde"))
    return S.sample_size_mean(b, "std", "mde")


@query("k11_detectable_effect", f"""
WITH b AS (SELECT o_orderpriority, count(*) AS n, count(CASE WHEN o_orderstatus='F' THEN 1 END)/CAST(count(*) AS DOUBLE) AS p FROM orders GROUP BY 1)
SELECT o_orderpriority, n, round(p, 6) AS rate, round(sqrt({_ZZ})*sqrt(2*p*(1-p)/n), 6) AS mde_absolute, round(sqrt({_ZZ})*sqrt(2*p*(1-p)/n)/p, 6) AS mde_relative FROM b""")
def k11(t):
    b = t.orders.groupBy("o_orderpriority").agg(N().alias("n"), (F.count_if(F.col("o_orderstatus") == "F") / N()).alias("rate"))
    return S.detectable_effect(b, "n", rate="rate")


@query("k12_labels", """
WITH p AS (SELECT l_suppkey, avg(l_discount) / 2 AS p, (avg(l_quantity) - 25.5) / 2 AS d FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN p < 0.001 THEN 'highly significant' WHEN p < 0.025 THEN 'significant' ELSE 'not significant' END AS verdict, CASE WHEN abs(d) < 0.2 THEN 'small' WHEN abs(d) <= 0.8 THEN 'medium' ELSE 'large' END AS effect FROM p""")
def k12(t):
    p = t.lineitem.groupBy("l_suppkey").agg((F.avg("l_discount") / 2).alias("p"), ((F.avg("l_quantity") - 25.5) / 2).alias("d"))
    return p.select("l_suppkey", S.significance(F.col("p"), 0.025).alias("verdict"), S.effect_label(F.col("d")).alias("effect"))


_NORMAL = """n8 AS (SELECT s, CAST(count(*) AS DOUBLE) AS n, avg(pow(v - m, 3))/pow(max(sd), 3) AS g1, max(k) AS g2 FROM d JOIN (SELECT s, avg(v) AS m, stddev_pop(v) AS sd, kurtosis_pop(v) AS k FROM d GROUP BY 1) USING (s) GROUP BY 1),
a8 AS (SELECT *, g1*sqrt((n+1)*(n+3)/(6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS b, (g2 + 3 - 3*(n-1)/(n+1))/sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x,
 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS rb FROM n8),
b8 AS (SELECT *, sqrt(2*(b-1)) - 1 AS w2, 6 + 8/rb*(2/rb + sqrt(1 + 4/(rb*rb))) AS a FROM a8),
odd AS (SELECT s, n < 30 OR exp(-(pow(1/sqrt(0.5*ln(w2))*ln(y/sqrt(2/(w2-1)) + sqrt(y/sqrt(2/(w2-1))*y/sqrt(2/(w2-1)) + 1)), 2) + pow((1 - 2/(9*a) - cbrt((1 - 2/a)/(1 + x*sqrt(2/(a-4)))))/sqrt(2/(9*a)), 2))/2) < 0.05 AS odd FROM b8)"""


@query("k13_compare_segments", f"""
WITH d AS (SELECT c_mktsegment AS s, c_acctbal AS v FROM customer), {_NORMAL}, p AS (SELECT DISTINCT a.s AS sa, b.s AS sb FROM d a JOIN d b ON a.s < b.s),
x AS (SELECT sa, sb, v, s = sa AS is_a FROM p JOIN d ON s = sa OR s = sb), r AS (SELECT *, rank() OVER (PARTITION BY sa, sb ORDER BY v) + (count(*) OVER (PARTITION BY sa, sb, v) - 1)/2.0 AS ar FROM x),
g AS (SELECT sa, sb, count(CASE WHEN is_a THEN 1 END) AS na, count(CASE WHEN NOT is_a THEN 1 END) AS nb, sum(CASE WHEN is_a THEN ar END) - count(CASE WHEN is_a THEN 1 END)*(count(CASE WHEN is_a THEN 1 END)+1)/2.0 AS u,
 avg(CASE WHEN is_a THEN v END) AS ma, avg(CASE WHEN NOT is_a THEN v END) AS mb, var_samp(CASE WHEN is_a THEN v END) AS va, var_samp(CASE WHEN NOT is_a THEN v END) AS vb FROM r GROUP BY 1, 2)
SELECT sa AS seg_a, sb AS seg_b, na AS n_a, nb AS n_b, round((ma - mb)/sqrt(va/na + vb/nb), 6) AS t_stat, round(u, 1) AS u_stat, round((ma - mb)/sqrt(((na-1)*va + (nb-1)*vb)/(na + nb - 2)), 6) AS effect_size,
 round(1 - 2*u/(CAST(na AS DOUBLE)*nb), 6) AS rank_biserial, CASE WHEN o.odd OR q.odd THEN 'mann-whitney' ELSE 'welch-t' END AS advised FROM g JOIN odd o ON o.s = sa JOIN odd q ON q.s = sb""")
def k13(t):
    return S.compare_segments(t.customer, "c_mktsegment", "c_acctbal", with_p=False).withColumn("u_stat", F.round("u_stat", 1))


@query("k13_compare_segments_auto")
def k13b(t):
    return S.compare_segments(t.customer, "c_mktsegment", "c_acctbal")


@query("k13_segment_summary", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(var_samp(c_acctbal), 2) AS var, round(median(c_acctbal), 4) AS median FROM customer GROUP BY 1", digits=4)
def k13c(t):
    return S.segment_summary(t.customer, "c_mktsegment", "c_acctbal").withColumn("var", F.round("var", 2))


@query("k14_srm_check", f"""WITH {_U}, s AS (SELECT arm, count(*) AS o, CASE arm WHEN 'control' THEN 0.5 ELSE 0.5 END * (SELECT count(*) FROM u) AS e FROM u GROUP BY 1)
SELECT round(sum(pow(o - e, 2)/e), 6) AS chi2, 1.0::DOUBLE AS dof, CAST(sum(o) AS BIGINT) AS n FROM s""")
def k14(t):
    return E.srm_check(users(t), "arm", {"control": 1, "variant": 1}, with_p=False)


@query("k15_covariate_balance", f"""WITH {_U}, x AS ({_arms('pre_events')}), y AS (SELECT arm, platform, count(*) AS o FROM u GROUP BY 1, 2), z AS (SELECT o, sum(o) OVER (PARTITION BY arm) * CAST(sum(o) OVER (PARTITION BY platform) AS DOUBLE)/sum(o) OVER () AS e FROM y)
SELECT 'pre_events' AS covariate, 'welch' AS test, round({_T}, 6) AS stat FROM x UNION ALL SELECT 'platform', 'chi2', round(sum((o-e)*(o-e)/e), 6) FROM z""")
def k15(t):
    return E.covariate_balance(users(t), "arm", ["pre_events"], ["platform"], "control", "variant", with_p=False)


def _read(kpi, by=""):
    b = f"{by}, " if by else ""
    return f"SELECT {b}'{kpi}' AS kpi, n_a, n_b, round(mean_a, 4) AS control, round(mean_b, 4) AS variant, round(mean_b - mean_a, 4) AS diff, round(100*(mean_b - mean_a)/nullif(abs(mean_a), 0), 4) AS lift_pct, round({_T}, 4) AS t_stat FROM ({_arms(kpi, by=by)})"


@query("k16_experiment_readout", f"WITH {_U} " + " UNION ALL ".join(_read(k) for k in ("revenue", "clicks", "big_buyer")), digits=4)
def k16(t):
    return E.readout(users(t), "arm", ["revenue", "clicks", "big_buyer"], "control", "variant", with_p=False)


@query("k17_hetero_effects", f"WITH {_U}, s AS (" + " UNION ALL ".join(_read(k, "platform") for k in ("revenue", "clicks")) + "), o AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS kpi, mean_b - mean_a AS od FROM ({_arms(k)})" for k in ("revenue", "clicks")) + """)
SELECT kpi, platform, diff, lift_pct, CASE WHEN sign(diff)*sign(od) > 0 THEN 'same' WHEN sign(diff)*sign(od) < 0 THEN 'reversed' ELSE 'flat' END AS direction FROM s JOIN o USING (kpi)""", digits=4)
def k17(t):
    return E.hetero_effects(users(t), "arm", ["revenue", "clicks"], "platform", "control", "variant", with_p=False).select("kpi", "platform", "diff", "lift_pct", "direction")


@query("k18_effect_over_time", """
WITH u AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'variant' END AS arm, sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS rev FROM events GROUP BY 1, 2),
g AS (SELECT week, count(CASE WHEN arm='control' THEN 1 END) AS n_a, count(CASE WHEN arm='variant' THEN 1 END) AS n_b, avg(CASE WHEN arm='control' THEN rev END) AS mean_a, avg(CASE WHEN arm='variant' THEN rev END) AS mean_b FROM u GROUP BY 1),
l AS (SELECT *, 100*(mean_b-mean_a)/abs(mean_a) AS lift FROM g)
SELECT CAST(week AS VARCHAR) AS week, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_b - mean_a, 6) AS diff, round(lift, 6) AS lift_pct, round(last_value(lift) OVER w - first_value(lift) OVER w, 6) AS novelty FROM l
WINDOW w AS (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def k18(t):
    u = t.events.groupBy("user_id", week_start("ts").alias("week")).agg(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("rev"))
    u = u.withColumn("arm", F.when(F.col("user_id") % 2 == 0, "control").otherwise("variant"))
    return E.effect_over_time(u, "arm", "week", "rev", "control", "variant")


@query("k19_posthoc_power", f"""WITH {_U}, s AS ({_arms('revenue', by='platform')})
SELECT platform, round(sqrt({_ZZ})*sqrt(var_a/n_a + var_b/n_b), 4) AS mde_absolute, round(abs(mean_b - mean_a)/sqrt(var_a/n_a + var_b/n_b), 4) AS observed_z FROM s""", digits=4)
def k19(t):
    s = S.arm_stats(users(t), ["platform"], "arm", "revenue", "control", "variant")
    return E.posthoc_power(s, with_power=False).select("platform", "mde_absolute", "observed_z")


def daily_arms(t):
    """Daily revenue by arm with the day number and period; summed in whole cents, so that the order of summing decides nothing."""
    d = t.events.groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 2).alias("k")).agg(F.sum(F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long")).otherwise(0)).alias("cents"))
    return d.select("day", F.when(F.col("k") == 1, "treated").otherwise("control").alias("grp"), F.when(F.col("day") < "2024-01-16", "pre").otherwise("post").alias("period"),
                    F.date_diff("day", F.lit("2024-01-01").cast("date")).alias("i"), (F.col("cents") / 100).alias("rev"))


_DA = """d AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN user_id % 2 = 1 THEN 'treated' ELSE 'control' END AS grp, sum(CASE WHEN event_type='purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) / 100.0 AS rev FROM events GROUP BY 1, 2),
a AS (SELECT *, day >= DATE '2024-01-16' AS post, day - DATE '2024-01-01' AS i FROM d)"""


@query("k20_diff_in_diff", f"""WITH {_DA}, g AS (SELECT avg(CASE WHEN grp='treated' AND NOT post THEN rev END) AS t_pre, avg(CASE WHEN grp='treated' AND post THEN rev END) AS t_post, avg(CASE WHEN grp='control' AND NOT post THEN rev END) AS c_pre,
 avg(CASE WHEN grp='control' AND post THEN rev END) AS c_post, regr_slope(CASE WHEN grp='treated' AND NOT post THEN rev END, i) AS t_slope, regr_slope(CASE WHEN grp='control' AND NOT post THEN rev END, i) AS c_slope FROM a)
SELECT round(t_pre, 7) AS t_pre, round(t_post, 7) AS t_post, round(c_pre, 7) AS c_pre, round(c_post, 7) AS c_post, round(t_slope, 7) AS t_slope, round(c_slope, 7) AS c_slope, round((t_post - t_pre) - (c_post - c_pre), 7) AS did, round(t_slope - c_slope, 7) AS pre_trend_gap FROM g""", digits=7)
def k20(t):
    return E.diff_in_diff(daily_arms(t), "grp", "period", "rev", "i")


@query("k21_pre_post", """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS rev FROM events GROUP BY 1),
s AS (SELECT *, CASE WHEN day BETWEEN DATE '2024-01-06' AND DATE '2024-01-15' THEN 'control' WHEN day BETWEEN DATE '2024-01-16' AND DATE '2024-01-25' THEN 'variant' END AS arm FROM d)
""" + f"SELECT n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(mean_b - mean_a, 4) AS diff, round({_T}, 4) AS t_stat FROM ({_arms('rev', 's')})", digits=4)
def k21(t):
    from insightspark.plans.windows import daily
    return E.pre_post(daily(t), "day", "2024-01-16", 10, "revenue", with_p=False).select("n_a", "n_b", "mean_a", "mean_b", "diff", "t_stat")


@query("k22_interrupted_series", """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS rev FROM events GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY day) AS x FROM d),
f AS (SELECT regr_slope(rev, x) AS b, regr_intercept(rev, x) AS a FROM x WHERE day < DATE '2024-01-16')
SELECT CAST(day AS VARCHAR) AS day, round(rev, 2) AS actual, round(a + b*x, 4) AS expected, round(rev - (a + b*x), 4) AS excess FROM x, f WHERE day >= DATE '2024-01-16'""", digits=4)
def k22(t):
    import datetime
    from insightspark.plans.windows import daily
    out = E.interrupted_series(daily(t), "day", "revenue", datetime.date(2024, 1, 16))
    return out.withColumn("actual", F.round("actual", 2))


@query("k23_matching", f"""WITH {_U}, g AS (SELECT platform, CAST(floor(pre_events / 5) AS BIGINT) AS band, count(CASE WHEN arm='variant' THEN 1 END) AS nt, count(CASE WHEN arm='control' THEN 1 END) AS nc, avg(CASE WHEN arm='variant' THEN revenue END) AS mt, avg(CASE WHEN arm='control' THEN revenue END) AS mc FROM u GROUP BY 1, 2)
SELECT count(CASE WHEN nt > 0 AND nc > 0 THEN 1 END) AS n_strata, count(CASE WHEN nt = 0 OR nc = 0 THEN 1 END) AS n_unmatched, CAST(sum(CASE WHEN nc > 0 AND nt > 0 THEN nt END) AS BIGINT) AS n_treated,
 round(sum(CASE WHEN nc > 0 AND nt > 0 THEN nt*(mt-mc) END)/sum(CASE WHEN nc > 0 AND nt > 0 THEN nt END), 4) AS att FROM g""", digits=4)
def k23(t):
    u = users(t).withColumn("band", F.floor(F.col("pre_events") / 5))
    return E.matched_strata(u, ["platform", "band"], "arm", "revenue", "variant", "control")


@query("k23_propensity_matching")
def k23b(t):
    return E.propensity_strata(users(t), ["pre_events", "clicks"], "arm", "revenue", "variant", "control")


@query("k24_ci_business_impact", f"""WITH {_U}, s AS ({_arms('big_buyer', by='platform')}), v AS (SELECT platform, count(*) AS volume, avg(revenue) AS value FROM u GROUP BY 1),
c AS (SELECT platform, mean_b - mean_a AS d, {_Z}*sqrt(mean_a*(1-mean_a)/n_a + mean_b*(1-mean_b)/n_b) AS h FROM s)
SELECT platform, round((d-h)*volume*value, 2) AS impact_low, round(d*volume*value, 2) AS impact_mid, round((d+h)*volume*value, 2) AS impact_high FROM c JOIN v USING (platform)""", digits=2)
def k24(t):
    u = users(t)
    ci = S.proportion_z(S.arm_stats(u, ["platform"], "arm", "big_buyer", "control", "variant"))
    j = ci.join(u.groupBy("platform").agg(N().alias("volume"), F.avg("revenue").alias("value")), "platform")
    return E.business_impact(j, "ci_low", "diff", "ci_high", "volume", "value").select("platform", "impact_low", "impact_mid", "impact_high")


@query("k25_decision_rule", f"""WITH {_U}, r AS (SELECT platform, CASE WHEN mean_b - mean_a > 20 THEN 'positive' WHEN mean_b - mean_a < -20 THEN 'negative' ELSE 'null' END AS primary_result FROM ({_arms('revenue', by='platform')})),
g AS (SELECT platform, CASE WHEN mean_b < mean_a THEN 'degraded' ELSE 'ok' END AS guardrail FROM ({_arms('clicks', by='platform')}))
SELECT platform, primary_result, guardrail, CASE WHEN primary_result='positive' AND guardrail='ok' THEN 'SHIP' WHEN primary_result='positive' THEN 'INVESTIGATE' ELSE 'DON''T SHIP' END AS decision FROM r JOIN g USING (platform)""")
def k25(t):
    u = users(t)
    p = S.arm_stats(u, ["platform"], "arm", "revenue", "control", "variant").withColumn("d", F.col("mean_b") - F.col("mean_a"))
    p = p.select("platform", F.when(F.col("d") > 20, "positive").when(F.col("d") < -20, "negative").otherwise("null").alias("primary_result"))
    g = S.arm_stats(u, ["platform"], "arm", "clicks", "control", "variant").select("platform", F.when(F.col("mean_b") < F.col("mean_a"), "degraded").otherwise("ok").alias("guardrail"))
    return E.decision_rule(p.join(g, "platform"), "primary_result", "guardrail")


@query("k26_runtime_estimate", f"""
WITH b AS (SELECT o_orderpriority, count(CASE WHEN o_orderstatus='F' THEN 1 END)/CAST(count(*) AS DOUBLE) AS p, count(*)/CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS DOUBLE) AS daily FROM orders GROUP BY 1),
n AS (SELECT *, ceil({_ZZ}*(p*(1-p) + p*1.5*(1-p*1.5))/pow(p*0.5, 2)) AS n FROM b)
SELECT o_orderpriority, n AS n_per_group, round(2*n/daily, 4) AS days, CASE WHEN 2*n/daily <= 14 THEN 'VIABLE' WHEN 2*n/daily <= 28 THEN 'VIABLE WITH PATIENCE' WHEN 2*n/daily <= 56 THEN 'MARGINAL' ELSE 'NOT VIABLE' END AS viability FROM n""", digits=4)
def k26(t):
    b = t.orders.groupBy("o_orderpriority").agg((F.count_if(F.col("o_orderstatus") == "F") / N()).alias("rate"), (N() / F.count_distinct(F.to_date("o_orderdate"))).alias("daily"))
    return E.runtime_estimate(S.sample_size_proportion(b, "rate", 0.5), "n_per_group", "daily").select("o_orderpriority", "n_per_group", "days", "viability")
