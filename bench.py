"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run twice after a warm-up scan; the better time counts. Rows are produced in full
and discarded by the no-op sink, so nothing is pruned away and nothing reaches the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelforge.plans.catalog import QUERIES  # noqa: E402
from panelforge.session import local_session  # noqa: E402

HEADLINE = [
    "incidence_band",
    "enroll_by_category",
    "multi_signal_join",
    "lag_shift_join",
    "redistribute_negatives",
    "impute_from_lookup",
    "local_slope",
    "spline_fit",
    "growth_coefficient",
    "feature_table",
    "offset_feature_table",
    "lag_increment",
    "centered_rollmean",
    "anova_oneway",
    "anova_cutoff_sweep",
    "ols_multi",
    "kruskal_wallis",
    "posthoc_pairs",
    "boxplot_stats",
    "polygon_centroid",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "panelforge-bench", spark__sql__shuffle__partitions=cpus)
    QUERIES["group_count"].run(spark, folder).collect()
    times = {}
    for name in names:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
