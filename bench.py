"""Headline timings. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local cores. Every query is run to a no-op sink; the reported
time is the median of the warm runs, and ``value`` is their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES, pitch
from ratebook.session import configure

HEADLINE = [
    "leaderboard", "entity_rates", "entity_quantile_nearest", "group_quantiles", "distinct_with_null",
    "multi_grain", "hitters", "pitchers", "pitch_types", "team_hitting", "league_hitting",
    "team_pitching", "feed_hitters", "feed_pitch_types", "hitter_pctiles", "pctile_qcut",
    "feed_hitter_pctiles", "rate_constants", "mean_constants", "max_constants_exact",
    "quantile_constants_boot", "hitter_constants", "shrink_rate", "regressed_hitters",
    "regressed_hitters_from_table", "grade_thresholds", "grade_20_80", "grade_composite_pitchers",
    "comps_topk", "vector_comps", "anchored_score", "pitch_features", "group_mean_backjoin",
    "primary_context", "merge_regressed", "dedupe_latest", "source_join", "score_linear",
    "score_chain", "evaluate", "stratified_sample",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("ratebook-bench"),
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="shared-"),
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    start = time.time()
    pitch(spark, sf_dir)  # the products start from the written fact
    times["write_scored_fact"] = round(time.time() - start, 3)
    for name in names:
        took = []
        for _ in range(runs):
            start = time.time()
            run(QUERIES[name](spark, sf_dir))
            took.append(time.time() - start)
        times[name] = round(statistics.median(took[1:] or took), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )


if __name__ == "__main__":
    main()
