"""Time the registered queries: one JSON line on stdout.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores, BENCH_QUERIES (optional) a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lakeledger.checks.queries import QUERIES  # noqa: E402
from lakeledger.session import local_session  # noqa: E402

HEADLINE = (
    "weekly_quantiles", "region_summary", "qa_funnel", "weekly_record_counts", "weekly_site_counts", "state_counts",
    "dedupe_first", "dedupe_results", "duplicate_count", "convert_units", "keep_lake_sites", "summary_counts",
    "count_grid", "records_share", "yearly_trend", "trend_panels", "target_sites", "select_sites", "constituent_counts",
    "paged_rows", "normalize_results", "extract_by_state", "site_locations", "point_in_polygon", "assign_polygon",
    "sites_in_waterbodies", "huc_counts", "huc_bins_auto", "site_density_panel", "weekly_median_geo", "tukey_smooth",
    "incremental_counts", "secchi_pipeline", "secchi_pipeline_funnel", "geo_pipeline",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = local_session("bench", cores=cores)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    names = chosen.split(",") if chosen else HEADLINE
    run(names[0])  # starts the JVM's compilers; not counted
    seconds = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(directory).name,
                "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
