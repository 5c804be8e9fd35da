"""Player events that are kept up to date equal those computed anew."""

from __future__ import annotations

import os
import random

import pytest
from conftest import day, rows

from clubhouse import schemas
from clubhouse.operators import changes
from clubhouse.plans import players, upkeep, wins
from clubhouse.sources import store

CHANGES = int(os.environ.get("CHANGES", "8"))


def same(a, b) -> bool:
    return sorted(map(str, rows(a))) == sorted(map(str, rows(b)))


def check(tables, states) -> None:
    assert same(upkeep.career_wins(tables, states), wins.career_wins(tables))
    assert same(upkeep.wins_by_event_name(tables, states), wins.wins_by_event_name(tables))
    assert same(upkeep.player_stats(tables, states), players.player_stats(tables))


def test_reports_from_player_events(either):
    check(either, upkeep.player_events(either))


def _change(rng: random.Random, number: int):
    """A random change set, as a function of the tables."""

    def some(t, table):
        return rng.choice([r.id for r in getattr(t, table).select("id").orderBy("id").collect()])

    def frame_of(t, values, columns):
        return t.spark.createDataFrame([values], columns)

    def new_score(t):
        team = rng.sample([r.id for r in t.players.select("id").orderBy("id").collect()], 2)
        rows_ = frame_of(t, (some(t, "events"), *team, rng.randint(60, 80), rng.choice([1, 1, 2, None]), number),
                         "event_id long, player1_id long, player2_id long, strokes int, placement int, to_par int")
        return changes.insert_rows(t, "scores", rows_)

    def new_strokes(t):
        rows_ = frame_of(t, (some(t, "scores"), rng.randint(60, 80), rng.choice([1, 2, 3])),
                         "id long, strokes int, placement int")
        return changes.update_rows(t, "scores", rows_, refresh=rng.random() < 0.5)

    def less(table):
        def drop(t):
            return changes.delete_rows(t, table, frame_of(t, (some(t, table),), "id long"), schemas.LENIENT_REFERENCES)

        return drop

    def new_event(t):
        rows_ = frame_of(t, (f"Extra {number}", day(rng.randint(1, 28)), some(t, "courses"), 2024 + number % 3, True),
                         "name string, date date, course_id long, season int, finalized boolean")
        return changes.insert_rows(t, "events", rows_)

    def new_par(t):
        wanted = t.courses.where(f"id = {some(t, 'courses')}").selectExpr("*", f"{rng.randint(68, 74)} as p")
        return changes.update_rows(t, "courses", wanted.drop("par").withColumnRenamed("p", "par"))

    def new_player(t):
        return changes.insert_rows(t, "players", frame_of(t, (f"P{number}", "Q"), "first_name string, last_name string"))

    kinds = [new_score] * 4 + [new_strokes] * 3 + [less("scores"), less("events"), less("players"), new_event, new_par, new_player]
    apply = rng.choice(kinds)
    return lambda t: apply(t).tables


def test_after_every_change_set(spark, league, tmp_path, monkeypatch):
    """CHANGES change sets, each saved as a version (50 with CHANGES=50)."""
    for name in ("scores", "player_events"):
        monkeypatch.setitem(schemas.SLICE_WIDTH, name, 1)
    rng, root = random.Random(11), str(tmp_path)
    store.save_tables(league, root, player_events=True)
    for number in range(CHANGES):
        change = _change(rng, number)
        try:
            store.commit(spark, root, change, player_events=True)
        except ValueError:  # a change that the tables' rules refuse
            continue
        tables = store.load_tables(spark, root)
        check(tables, store.load_player_events(tables))


def test_only_changed_events_are_read_and_written(spark, league, tmp_path, monkeypatch):
    for name in ("scores", "player_events"):
        monkeypatch.setitem(schemas.SLICE_WIDTH, name, 1)
    root = str(tmp_path)
    store.save_tables(league, root, player_events=True)
    first = store.load_tables(spark, root)
    assert sorted(first.base.files["player_events"]) == [1, 2, 3]
    new = spark.createDataFrame([(22, 69, 1, None)], "id long, strokes int, placement int, notes string")
    change = changes.update_rows(first, "scores", new).tables
    assert rows(upkeep.changed_events(change)) == [(2,)]
    store.save_tables(change, root, player_events=True)
    second = store.load_tables(spark, root)
    kept = {k: v for k, v in first.base.files["player_events"].items() if k != 2}
    assert {k: v for k, v in second.base.files["player_events"].items() if k != 2} == kept
    check(second, store.load_player_events(second))
    # A version without them: the next one that has them computes them all.
    store.save_tables(second, root)
    third = store.load_tables(spark, root)
    with pytest.raises(FileNotFoundError):
        store.load_player_events(third)
    store.save_tables(third, root, player_events=True)
    check(third, store.load_player_events(store.load_tables(spark, root)))
