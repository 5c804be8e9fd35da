from __future__ import annotations

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from clubhouse import schemas
from clubhouse.operators import changes, quality
from clubhouse.operators.quality import IntegrityError


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


def test_duplicate_keys(league):
    twice = league.players.unionByName(league.players.where("id = 1").withColumn("id", F.lit(9)))
    assert rows(quality.duplicate_keys(twice, "players")) == [("Ada", "Birch", 2)]
    # A missing city equals an empty one; a missing slot equals a missing slot.
    again = league.courses.where("id = 2").withColumns({"id": F.lit(9), "state": F.lit("")})
    found = quality.duplicate_keys(league.courses.unionByName(again), "courses")
    assert rows(found) == [("Short Meadow", "Oak Hill", "", 2)]
    teams = league.scores.unionByName(league.scores.where("id = 12"))
    assert rows(quality.duplicate_keys(teams, "scores")) == [(1, 2, 0, 0, 0, 2)]


def test_orphans(league):
    assert quality.orphans(league).isEmpty()
    less = league.with_tables(
        players=league.players.where("id <> 2"), events=league.events.where("id <> 3"),
        courses=league.courses.where("id <> 2"),
    )
    assert sorted(rows(quality.orphans(less))) == [
        ("events", "course_id", 2, 2), ("scores", "event_id", 3, 1),
        ("scores", "player1_id", 2, 2), ("scores", "player2_id", 2, 1),
    ]


def test_missing_values_and_lengths(league):
    holes = {"courses": league.courses.withColumn("par", F.when(F.col("id") == 1, F.col("par")))}
    assert sorted(rows(quality.missing_values(holes))) == [
        ("courses", "name", 0), ("courses", "par", 1),
    ]
    long = {"courses": league.courses.withColumn("city", F.repeat(F.lit("x"), 101))}
    found = dict((r[1], r[2:]) for r in rows(quality.text_lengths(long)))
    assert found == {"name": (12, 100, True), "city": (101, 100, False), "state": (2, 100, True)}


def test_insert_takes_defaults_only_for_absent_columns(spark, league):
    row = spark.createDataFrame([("New", day(9), 1, 2025)], "name string, date date, course_id long, season int")
    change = changes.insert_rows(league, "events", row)
    assert rows(change.affected, "id", "is_team_event", "is_major", "finalized") == [
        (5, True, False, False)
    ]
    assert change.tables.events.count() == 5
    with pytest.raises(IntegrityError, match="required value"):
        changes.insert_rows(league, "events", row.withColumn("is_major", F.lit(None)))


@pytest.mark.parametrize(
    "table, rows_, columns, complaint",
    [
        ("players", [("Ada", "Birch")], "first_name string, last_name string", "duplicate key"),
        ("players", [("Zoe", "Z" * 51)], "first_name string, last_name string", "too long"),
        ("scores", [(1, 99)], "event_id long, player1_id long", "missing row"),
        ("scores", [(9, 1)], "event_id long, player1_id long", "missing row"),
        ("scores", [(1, 2)], "event_id long, player1_id long", "duplicate key"),
        ("events", [("Open", day(9), 7, 2025)],
         "name string, date date, course_id long, season int", "missing row"),
    ],
)
def test_refused_inserts(spark, league, table, rows_, columns, complaint):
    with pytest.raises(IntegrityError, match=complaint):
        changes.insert_rows(league, table, spark.createDataFrame(rows_, columns))


def test_update_scores(spark, either):
    new = spark.createDataFrame(
        [(12, 80, None, "recount"), (99, 1, 1, None)],
        "id long, strokes int, placement int, notes string",
    )
    # Stored to-par first, to see that it goes stale without a refresh.
    stored = either.with_tables(scores=either.scores.withColumn("to_par", F.lit(0)))
    change = changes.update_rows(stored, "scores", new)
    assert rows(change.affected, "id", "strokes", "placement", "notes", "to_par") == [
        (12, 80, None, "recount", 0)
    ]
    assert rows(change.not_found) == [(99,)]
    fresh = changes.update_rows(stored, "scores", new, refresh=True).tables.scores
    assert rows(fresh.where("id = 12"), "to_par") == [(8,)]
    assert {r[0] for r in rows(fresh.where("id <> 12"), "to_par")} == {0}  # not changed, kept


def test_a_large_update_moves_the_table_once(spark, large):
    new = spark.createDataFrame(
        [(12, 80, None, "recount"), (22, 70, 2, None)], "id long, strokes int, placement int, notes string"
    )
    after = changes.update_rows(large, "scores", new).tables.scores
    # The rows are written down by now: whoever reads them joins nothing any more.
    assert "Join" not in after._jdf.queryExecution().optimizedPlan().toString()
    assert len(after.inputFiles()) > 0
    assert sorted(rows(after, "id", "strokes")) == [
        (11, 70), (12, 80), (13, 75), (21, 66), (22, 70), (23, None), (31, 71),
    ]


def test_updates_where_ids_repeat_or_are_missing(spark, either):
    again = either.scores.where("id IN (12, 13)").withColumn("id", F.when(F.col("id") == 12, F.col("id")))
    odd = either.with_tables(scores=either.scores.unionByName(again).unionByName(either.scores.where("id = 12")))
    new = spark.createDataFrame(
        [(12, 80, None, "recount"), (None, 1, 1, None)], "id long, strokes int, placement int, notes string"
    )
    for refresh in (False, True):
        after = changes.update_rows(odd, "scores", new, refresh=refresh).tables.scores
        assert sorted(map(str, rows(after, "id", "strokes"))) == sorted(map(str, [
            (11, 70), (12, 80), (12, 80), (12, 80), (13, 75), (21, 66), (22, 70), (23, None), (31, 71), (None, 75),
        ]))


def test_update_players_overwrites_with_nulls(spark, league):
    new = spark.createDataFrame(
        [(1, "Ada", "Ash")], "id long, first_name string, last_name string"
    )
    after = changes.update_rows(league, "players", new).tables.players
    assert rows(after.where("id = 1"), "last_name", "hof_inducted") == [("Ash", None)]
    assert after.count() == 4
    with pytest.raises(IntegrityError, match="duplicate key"):
        changes.update_rows(league, "players", new.withColumns(
            {"first_name": F.lit("Ben"), "last_name": F.lit("Cole")}
        ))
    with pytest.raises(IntegrityError, match="changed twice"):
        changes.update_rows(league, "players", new.union(new))
    with pytest.raises(ValueError):
        changes.update_rows(league, "events", new)


def test_delete(spark, either):
    after = changes.delete_rows(either, "events", ids(spark, 1, 77))
    assert sorted(rows(after.tables.scores, "id")) == [(21,), (22,), (23,), (31,)]
    assert after.tables.events.count() == 3 and rows(after.not_found) == [(77,)]
    assert rows(after.affected, "name") == [("Open",)]
    for table, used, free in (("players", 2, 4), ("courses", 1, None)):
        with pytest.raises(IntegrityError, match="still referred to"):
            changes.delete_rows(either, table, ids(spark, used))
        if free:
            change = changes.delete_rows(either, table, ids(spark, free))
            assert getattr(change.tables, table).count() == 3
    assert changes.delete_rows(either, "scores", ids(spark, 11)).tables.scores.count() == 6


def test_players_in_use_go_by_the_lenient_rules(spark, either):
    """Player 2 is first in score 12 and 22, and second in 13."""
    with pytest.raises(IntegrityError, match="still referred to"):
        changes.delete_rows(either, "players", ids(spark, 2))
    change = changes.delete_rows(either, "players", ids(spark, 2, 4, 99), schemas.LENIENT_REFERENCES)
    assert sorted(rows(change.tables.scores, "id", "player1_id", "player2_id")) == [
        (11, 1, 1), (13, 3, None), (21, 1, 3), (23, 3, None), (31, 1, None),
    ]
    assert sorted(rows(change.tables.players, "id")) == [(1,), (3,)]
    assert sorted(rows(change.also["scores"], "id", "player2_id")) == [(12, None), (13, 2), (22, None)]
    assert sorted(rows(change.affected, "id")) == [(2,), (4,)] and rows(change.not_found) == [(99,)]


def test_a_row_in_both_roles_is_deleted(spark, either):
    # Player 1 is both members of score 11, first in 21 and 31.
    after = changes.delete_rows(either, "players", ids(spark, 1), schemas.LENIENT_REFERENCES).tables
    assert sorted(rows(after.scores, "id")) == [(12,), (13,), (22,), (23,)]


def test_rules_that_empty_what_is_needed_or_unique_are_refused(spark, league):
    twins = league.with_tables(scores=league.scores.where("id IN (13, 23)").withColumns(
        {"event_id": F.lit(2).cast("long"), "player1_id": F.lit(3).cast("long")}))
    # Without its second player the team of score 13 is that of score 23.
    with pytest.raises(IntegrityError, match="duplicate key"):
        changes.delete_rows(twins, "players", ids(spark, 2), schemas.LENIENT_REFERENCES)
    nulls = {"scores": [("player1_id", "players", "set null")]}
    with pytest.raises(IntegrityError, match="required value"):
        changes.delete_rows(league, "players", ids(spark, 2), nulls)


def test_cascades_go_on(spark, either):
    rules = {**schemas.REFERENCES, "events": [("course_id", "courses", "cascade")]}
    change = changes.delete_rows(either, "courses", ids(spark, 1), rules)
    assert sorted(rows(change.tables.events, "id")) == [(2,), (4,)]
    assert sorted(rows(change.tables.scores, "event_id")) == [(2,), (2,), (2,)]
    assert sorted(rows(change.also["events"], "id")) == [(1,), (3,)]
    assert sorted(rows(change.also["scores"], "id")) == [(11,), (12,), (13,), (31,)]
