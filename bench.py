"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS
(default 8) the threads. Every query is run once to warm up, then BENCH_RUNS
times (default 1); the median counts. All rows are produced and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from clubhouse.binding import bound_tables  # noqa: E402
from clubhouse.session import local_session  # noqa: E402

HEADLINE = [
    "top_players",
    "wins_by_event_name",
    "player_stats",
    "player_results",
    "event_scores",
    "event_with_teams",
    "score_list",
    "event_list",
    "latest_event_top5",
    "latest_podiums",
    "leaderboard_snippet",
    "home_summary",
    "homepage",
    "hydrated_names",
    "distinct_raw_names",
    "upsert_events",
    "insert_scores",
    "load_from_staging",
    "refresh_to_par",
    "orphans",
    "duplicate_team_keys",
    "update_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(
        cpus, "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    )
    tables = bound_tables(spark, sf_dir)

    def seconds(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](tables).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        seconds(name)
        times[name] = round(statistics.median(seconds(name) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
