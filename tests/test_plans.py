"""What the physical plans must and must not hold."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from clubhouse import schemas
from clubhouse.binding import bound_name_map, bound_sheet, bound_tables
from clubhouse.operators import load
from clubhouse.plans import leaderboards, players, presentation, wins
from clubhouse.sources import store
from clubhouse.tables import conform, empty_tables

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


REPORTS = [
    "top_players", "player_stats", "player_results", "event_scores", "event_with_teams",
    "score_list", "latest_podiums", "refresh_to_par", "orphans", "hydrated_names",
]


@pytest.mark.parametrize("name", REPORTS)
def test_no_pairwise_joins_and_no_python(spark, no_broadcast, name):
    for broadcast_rows in (0, 100_000):
        text = plan(QUERIES[name](bound_tables(spark, SF_DIR, broadcast_rows)))
        # Positions are numbered by event, where the event's rows meet.
        bad = ["NestedLoop", "CartesianProduct", "Python"] + ["Window"] * (name != "event_with_teams")
        assert not [b for b in bad if b in text]


def test_scan_reads_only_what_a_report_needs(spark):
    text = plan(wins.career_wins(bound_tables(spark, SF_DIR)))
    assert "l_extendedprice" not in text and "l_shipdate" not in text


def test_small_tables_are_broadcast_large_ones_shuffled(league, large, no_broadcast):
    text = plan(leaderboards.event_scores(league, ordered=False))
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text
    text = plan(leaderboards.event_scores(large, ordered=False))
    assert "SortMergeJoin" in text and "approx_top_k" in text


def test_rows_move_once_for_the_names_of_a_large_table(spark, large, no_broadcast):
    reports = [
        leaderboards.event_scores(large), leaderboards.score_list(large), leaderboards.event_with_teams(large, 10),
        players.player_scores(large), players.player_results(large), presentation.score_labels(large),
        bound_sheet(bound_tables(spark, SF_DIR, 0)),
    ]
    for report in reports:
        text = plan(report)
        assert "hashpartitioning(__team" in text
        assert not [i for i in (1, 2, 3, 4) if f"hashpartitioning(player{i}" in text]


def moved_by(text: str, column: str) -> list[str]:
    """The columns of every exchange by a column."""
    return re.findall(rf"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\({column}#", text)


def test_rows_move_once_for_large_events_and_names(large, no_broadcast):
    reports = [
        leaderboards.event_scores(large), leaderboards.score_list(large),
        players.player_scores(large), players.player_results(large),
    ]
    for report in reports:
        text = plan(report)
        assert not [c for c in moved_by(text, "event_id") if "player1_id" in c]
        assert len([c for c in moved_by(text, "__team") if "player1_id" in c]) == 1


def test_names_of_a_large_sheet_move_its_rows_once(spark, no_broadcast):
    tables = bound_tables(spark, SF_DIR, 0)
    text = plan(load.staged_scores(bound_sheet(tables), bound_name_map(tables), tables))
    assert "hashpartitioning(player4_full" not in text and "hashpartitioning(__team" in text


def test_staged_events_are_written_once(spark):
    tables = bound_tables(spark, SF_DIR)
    assert "course_city" not in plan(load.upsert_events(bound_sheet(tables), tables))


def test_distinct_counts_do_not_expand_rows(spark):
    text = plan(players.player_stats(bound_tables(spark, SF_DIR)))
    assert "Expand" not in text


def test_one_event_is_a_pushed_filter(spark, league, tmp_path):
    root = str(tmp_path)
    store.save_tables(league, root)
    saved = store.load_tables(spark, root)
    one = plan(leaderboards.event_scores(saved, 1))
    assert "EqualTo(event_id,1)" in one
    snippet = plan(leaderboards.leaderboard_snippet(saved))
    assert "EqualTo(event_id,ScalarSubquery" in snippet
    assert "TakeOrderedAndProject" in snippet


def test_podiums_and_one_player_prune_the_scan(spark, league, tmp_path):
    root = str(tmp_path)
    store.save_tables(league, root)
    saved = store.load_tables(spark, root)
    podium = plan(leaderboards.latest_podiums(saved))
    assert "In(event_id, [1,2])" in podium or "In(event_id, [2,1])" in podium
    for report in (players.player_stats, players.player_results, players.player_scores):
        text = plan(report(saved, player_id=3))
        assert "EqualTo(player1_id,3)" in text and "EqualTo(player4_id,3)" in text


def test_teams_are_shuffled_once(spark, league, tmp_path, no_broadcast):
    """Numbering, nesting and the join of the events share one shuffle by event."""
    store.save_tables(league, str(tmp_path))
    saved = store.load_tables(spark, str(tmp_path))
    text = plan(leaderboards.event_with_teams(saved, 10))
    scores = text[: text.index("\n\n")]
    assert "Checkpoint" not in text and "rangepartitioning" not in text
    assert text.count("Arguments: hashpartitioning(event_id") == 1 and "Window" in scores
    # The events are the other side of the only join that is not broadcast.
    assert text.count("Arguments: hashpartitioning(id") == 1
    podium = plan(leaderboards.podium_rows(saved))
    assert "Checkpoint" not in podium and "Scan ExistingRDD" not in podium


def test_filters_on_players_skip_row_groups(spark, tmp_path):
    """1,500 players of whom each plays in a few events: most files hold none of a player's teams."""
    n = 60_000
    event = F.col("id") % 3000
    # Events next to each other have players from all over the table.
    of = lambda slot: F.pmod(F.xxhash64(F.floor(event / 50)) + F.pmod(F.xxhash64("id", F.lit(slot)), F.lit(20)) * 77, F.lit(1500))
    scores = spark.range(n).select(
        "id", event.alias("event_id"), of(1).alias("player1_id"), of(2).alias("player2_id"),
        *[F.when(F.col("id") % 2 == 0, of(i)).alias(f"player{i}_id") for i in (3, 4)],
        F.lit(False).alias("disqualified"),
    )
    tables = empty_tables(spark).with_tables(scores=conform(scores, "scores"))
    before, schemas.SLICE_WIDTH["scores"] = schemas.SLICE_WIDTH["scores"], 50
    try:
        store.save_tables(tables, str(tmp_path))
    finally:
        schemas.SLICE_WIDTH["scores"] = before
    saved = store.load_tables(spark, str(tmp_path))
    player = scores.first().player1_id
    one = saved.scores.where(" OR ".join(f"{slot} = {player}" for slot in schemas.SLOT_IDS))
    want = scores.where(" OR ".join(f"{slot} = {player}" for slot in schemas.SLOT_IDS)).count()
    assert one.count() == want > 0
    # Rows that the scan hands to the filter: whole row groups.
    one.write.format("noop").mode("overwrite").save()
    read = rows_scanned(spark)
    assert want <= read < n / 4


def rows_scanned(spark) -> int:
    """Rows that the scans of the last query read."""
    state = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    last = state.executionsList().last()
    metrics = state.executionMetrics(last.executionId())
    nodes = state.planGraph(last.executionId()).allNodes()
    total = 0
    for i in range(nodes.size()):
        node = nodes.apply(i)
        if node.name().startswith("Scan parquet"):
            for j in range(node.metrics().size()):
                metric = node.metrics().apply(j)
                if metric.name() == "number of output rows":
                    total += int(metrics.apply(metric.accumulatorId()).replace(",", ""))
    return total
