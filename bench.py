"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the headline set).
"""

from __future__ import annotations

import json
import os
import time

from insightspark.plans import catalog
from insightspark.session import build_session

HEADLINE = [
    "y9_dx_retention", "y10_dx_arpi_conversion", "y4_retention_matrix", "y19_funnel", "y40_sessionize", "y14_weekly_scorecard", "y1_rfm", "y2_concentration",
    "y23_root_cause_step", "y32_milestone_economy", "c4_interval_join", "c7_asof_lookup", "c12_double_attribute_join", "d1_grouped_agg", "d7_multi_dimension_mix", "d9_percentile",
    "e1_running_count", "e3_running_sums", "e12_rank", "e13_average_rank", "i1_profile_columns", "i6_profile_distributions", "i13_correlations", "i14_completeness_profile",
    "l2_primary_key", "l5_referential_integrity", "l8_run_structural", "m2_aggregation_by_group", "n1_ranges", "q11_tier_gate", "r2_simpsons_scan", "r3_weighted_vs_unweighted",
    "k3_mann_whitney", "k9_rank_dimensions", "k16_experiment_readout", "x6_control_chart", "u4_algebraic_identity", "u7_compare_profiles", "v1_confidence_score", "w5_entity_tagging",
    "w6_credential_scan", "z1_alert_eval", "z3_relative_threshold", "st1_tumbling_counts",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(max(8, int(cpus))), "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
