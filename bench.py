"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

The roles a query starts from (staged, damaged or seed tables derived from the given
ones) are written down before the clock starts: they stand for tables that exist. Every query
runs BENCH_REPEATS times and its least time counts; ``calibration`` is the least time of one
fixed job, the same each round, to tell a slower machine from a slower query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from carryover import session  # noqa: E402

HEADLINE = ["table_digest", "copy_value_parity", "merge_seed_wins", "idmap_twins", "one_live_per_key", "jaccard_template",
            "mojibake_census", "fk_remap", "multiset_parity", "disambiguate_duplicates", "numeric_capacity",
            "html_asset_refs"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    import workload
    from workload.roles import write_down

    write_down(spark, sf, "st_text", "st_pages", "st_orders", "seed_orders", "bad_orders", "tgt_lineitem", "bad_lineitem",
               "st_decisions", "st_files", "staged_matrix", "seed_matrix")
    spark.range(1000).selectExpr("sum(id)").collect()
    def least(run) -> float:
        taken = []
        for _ in range(int(os.environ.get("BENCH_REPEATS", "3"))):
            started = time.time()
            run().write.format("noop").mode("overwrite").save()
            taken.append(time.time() - started)
        return round(min(taken), 3)

    fixed = least(lambda: spark.range(20_000_000).selectExpr("sha2(string(id), 256) AS h").selectExpr("max(h)"))
    times = {name: least(lambda: workload.QUERIES[name](spark, sf)) for name in HEADLINE}  # noqa: B023
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf).name, "calibration": fixed}))
    spark.stop()


if __name__ == "__main__":
    main()
