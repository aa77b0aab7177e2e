"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores, BENCH_QUERIES (optional, comma-separated)
the queries. Each query is planned and run to the end without collecting; the time of a query
includes the actions it takes while it is built. Before, every query runs once on the smallest data
folder beside it, so that the figures are those of a running cluster and not of a starting JVM, and
the catalogs, snapshots and the changelog that stand for stored tables are derived.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import REGISTERED
from tidemark import testdata as td
from tidemark.session import session

HEADLINE = [
    "build_changesets",
    "changesets_all_entities",
    "changesets_hot_entity",
    "transaction_groups",
    "classify_transactions",
    "capture_snapshot_diff",
    "capture_change_feed",
    "changelog_roundtrip",
    "field_diff",
    "render_text",
    "changesets_json",
    "nested_changesets",
    "entity_history",
    "profile_keys",
    "resolve_entities",
    "schema_drift",
    "schema_timeline",
    "stream_sessions",
    "stream_changesets",
    "capture_stream",
    "stream_late_rows",
    "field_diff_numbers",
    "find_keys",
    "refresh_roundtrip",
]


def run(spark, name: str, folder: str) -> None:
    REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = session(
        "tidemark-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = names.split(",") if names else HEADLINE
    smallest = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest):
        for name in chosen:
            run(spark, name, smallest)
    for derive in (td.fleet_catalog, td.fleet_foreign_keys, td.fleet_snapshots,
                   td.fleet_live_catalog, td.fleet_watched):
        td.stored(spark, folder, derive)
    td.stored_changelog(spark, folder)
    timed = {}
    for name in chosen:
        start = time.perf_counter()
        run(spark, name, folder)
        timed[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timed[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
