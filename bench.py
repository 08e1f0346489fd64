"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: local cores. Each query's rows
are all computed (a no-op write), once after a warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from swardshift import build_session
from verification import load_all
from verification.registry import QUERIES

HEADLINE = [
    "covariate_shares",
    "normalised_by_reference",
    "rollup_codes",
    "share_pivot",
    "dup_resolution",
    "assemble_features",
    "clean_derive",
    "month_pivot",
    "group_quantiles",
    "top_k_per_group",
    "lump_one_hot",
    "profile",
    "spearman_pairs",
    "kde_binned",
    "point_in_polygon",
    "nearest_within",
    "region_key",
    "knn_other_class",
    "raster_sample",
    "area_of_applicability",
    "bootstrap_ci",
    "rf_predict",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    load_all()
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g", spark__driver__maxResultSize="2g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # Warm-up: class loading and the tables' first read are not part of any query.
    QUERIES["tally_share"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
