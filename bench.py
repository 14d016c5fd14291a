"""Times headline queries; prints one JSON line.

Transforms go to a ``noop`` sink; the ``engine_`` queries write Parquet through stored tables on the way.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from millrace.queries import QUERIES
from millrace.session import local_session

HEADLINE = [
    "full_load_dedup_single_pk",
    "full_load_dedup_multi_pk",
    "full_load_no_pk",
    "full_load_ctas",
    "full_load_string_null_keys",
    "incremental_upsert_distinct",
    "incremental_upsert_small_source",
    "incremental_upsert_multi_pk",
    "incremental_upsert_empty_eq_null",
    "incremental_upsert_string_ne",
    "incremental_append_no_pk",
    "staging_delete_matched",
    "changed_rows",
    "unique_pk_count",
    "null_to_empty",
    "empty_to_null",
    "string_cast_projection",
    "typed_cast_from_string",
    "variant_from_json",
    "vector_size_check",
    "select_source_bindings",
    "constraint_violations",
    "export_csv_lines",
    "engine_export_and_file_load",
    "engine_full_load",
    "engine_incremental_load",
    "engine_append_load",
    "engine_create_as_select",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = local_session("bench", cpus, **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus})
    times: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for k in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took), 4)
    spark.stop()
    print(json.dumps({"metric": "total of median query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "runs": runs, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
