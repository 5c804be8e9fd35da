"""Scores of events: leaderboards, podiums, snippets, score lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubhouse.functions.names import TEAM_SEPARATOR, compact_team_name, player_ids
from clubhouse.functions.scoring import is_counted, to_par
from clubhouse.operators.nesting import ordered_list, page_of, with_positions
from clubhouse.operators.slots import add_facts_and_names, add_names_to_few, add_player_names, hydrate_names
from clubhouse.plans.events import (
    EVENT_COLUMNS,
    event_facts,
    event_list_with_location,
    latest_event,
    latest_finalized,
    pick_finalized,
    pick_latest,
)
from clubhouse.schemas import SLOT_IDS, SLOT_NAMES
from clubhouse.tables import Tables


def _id_and_name_columns() -> list[str]:
    return [c for pair in zip(SLOT_IDS, SLOT_NAMES) for c in pair]


def event_scores(tables: Tables, event_id: int | None = None, ordered: bool = True) -> DataFrame:
    """Leaderboards with names and to-par, of all events or of one.

    Rows come by event, placement, to-par, strokes and id, NULLs last. The
    order is a sort over all those columns, so a large event is sorted by many
    tasks.
    """
    scores = tables.scores.drop("notes")
    if event_id is not None:
        scores = scores.where(F.col("event_id") == event_id)
    par = event_facts(tables).select("event_id", "course_par")
    board = add_facts_and_names(scores, tables, par, keys_from=scores.select("event_id")).select(
        "id", "event_id", *_id_and_name_columns(), "strokes",
        to_par("to_par", "strokes", "course_par").alias("to_par"),
        "placement", "disqualified",
    )
    if not ordered:
        return board
    order = ["event_id", "placement", "to_par", "strokes", "id"]
    return board.orderBy(*[F.asc_nulls_last(c) for c in order])


def event_places(tables: Tables, event_id: int | None = None) -> DataFrame:
    """Leaderboards with each score's line on its event's board, from 1, in the
    order of ``event_scores``: placement, to-par, strokes and id, NULLs last."""
    board = event_scores(tables, event_id, ordered=False)
    placed = with_positions(
        board, "event_id", ["placement", "to_par", "strokes", "id"], counted_in=tables.scores
    )
    return placed.withColumnRenamed("position", "line")


def score_list(tables: Tables, ordered: bool = True) -> DataFrame:
    """All scores with event name and date; names are NULL for an empty slot."""
    events = tables.events.select(
        F.col("id").alias("event_id"), F.col("name").alias("event_name"), "date"
    )
    scores = tables.scores.select("id", "event_id", *SLOT_IDS, "strokes", "placement", "notes")
    listed = add_facts_and_names(scores, tables, events, "strict", tables.scores.select("event_id")).select(
        "id", "event_id", "event_name", "date", "strokes", "placement", "notes", *SLOT_NAMES
    )
    if not ordered:
        return listed
    return listed.orderBy(
        F.desc_nulls_first("date"), F.asc_nulls_last("placement"), F.asc_nulls_last("id")
    )


def latest_event_top(tables: Tables, as_of: dt.date, n: int = 5) -> DataFrame:
    """The first n scores of the latest event, disqualified ones included."""
    # One value: the scan of the scores gets it as a pushed filter.
    event = pick_latest(tables, as_of).select("id").scalar()
    order = [F.asc_nulls_last("placement"), F.asc_nulls_last("id")]
    top = tables.scores.where(F.col("event_id") == event).orderBy(*order).limit(n)
    par = latest_event(tables, as_of).select("course_par").scalar()
    return add_names_to_few(top, tables).select(
        "id", "placement", "strokes", to_par("to_par", "strokes", par).alias("to_par"),
        *SLOT_NAMES,
    ).orderBy(*order)


def _team_columns() -> list[Column]:
    return [
        player_ids(*SLOT_IDS).alias("player_ids"),
        compact_team_name(*SLOT_NAMES).alias("team_name"),
    ]


def _podium_scores(tables: Tables, events: DataFrame, n: int) -> DataFrame:
    """Counted scores on places 1 to 3 of the last n finalized events."""
    named = events.select(F.col("id").alias("event_id"), "name", "date", "course")
    # n values at most: the scan of the scores gets them as a pushed filter.
    ids = [row.id for row in pick_finalized(tables, n).select("id").collect()]
    placed = tables.scores.where(
        F.col("event_id").isin(ids) & F.col("placement").isin(1, 2, 3) & is_counted()
    )
    return placed.join(F.broadcast(named), "event_id")


def latest_podiums(tables: Tables, n: int = 3, ordered: bool = True) -> DataFrame:
    """Podium rows of the last n finalized events, with compact team names."""
    rows = _podium_scores(tables, latest_finalized(tables, n), n)
    podium = add_player_names(rows, tables, "compact").select(
        "event_id", "name", "date", "course", "id", "placement", "strokes", "to_par",
        *_team_columns(),
    )
    if not ordered:
        return podium
    return podium.orderBy(
        F.desc_nulls_first("date"), F.desc_nulls_first("event_id"),
        F.asc_nulls_last("placement"), F.asc_nulls_last("id"),
    )


def latest_podiums_hydrated(tables: Tables, n: int = 5) -> DataFrame:
    """Variant over five events whose names come from the id list, with
    "Player #id" for an id that is not in the table."""
    rows = _podium_scores(tables, latest_finalized(tables, n), n).select(
        "event_id", "name", "date", "course", "id", "placement", "strokes", "to_par",
        player_ids(*SLOT_IDS).alias("player_ids"),
    )
    named = hydrate_names(rows, tables, ["event_id", "id"])
    return named.withColumnRenamed("names", "team_name")


def podium_rows(tables: Tables, n: int = 3) -> DataFrame:
    """Podium rows of the last n finalized events with their ``position``, from
    1, by placement and id."""
    podium = _podium_scores(tables, latest_finalized(tables, n), n)
    placed = with_positions(podium, "event_id", ["placement", "id"])
    return add_player_names(placed, tables, "compact", podium)


def podium_documents(tables: Tables, page_size: int, n: int = 3) -> DataFrame:
    """One row per event and page with a nested, ordered ``podium``; an event
    without a podium row is left out. Page 0 holds the first positions."""
    entry = [
        "placement", "strokes", F.col("to_par").alias("toPar"),
        player_ids(*SLOT_IDS).alias("playerIds"),
        compact_team_name(*SLOT_NAMES).alias("teamName"),
    ]
    return (
        podium_rows(tables, n)
        .withColumn("page", page_of("position", page_size))
        .groupBy(F.col("event_id").alias("id"), "name", "date", "course", "page")
        .agg(ordered_list(entry, ["position"]).alias("podium"))
    )


def _snippet_order() -> list[Column]:
    return [F.asc_nulls_last(c) for c in ("placement", "strokes", "id")]


def leaderboard_snippet(tables: Tables, n: int = 5) -> DataFrame:
    """The first n counted scores of the newest finalized event."""
    latest = F.col("event_id") == pick_finalized(tables, 1).select("id").scalar()
    top = tables.scores.where(latest & is_counted()).orderBy(*_snippet_order()).limit(n)
    event = latest_finalized(tables, 1).select(F.struct("name", "date", "course")).scalar()
    return (
        add_names_to_few(top, tables, "compact")
        .select("*", event.alias("event"))
        .select(
            "event_id", "event.name", "event.date", "event.course", "id", "placement",
            "strokes", "to_par", *_team_columns(),
        )
        .orderBy(*_snippet_order())
    )


def leaderboard_snippet_outer(tables: Tables, n: int = 5) -> DataFrame:
    """Variant that keeps the event: without any score it yields one row of
    NULLs. An event whose scores are all disqualified still yields none. Names
    fall back to "Player #id"."""
    latest = latest_finalized(tables, 1)
    event = F.col("event_id") == pick_finalized(tables, 1).select("id").scalar()
    # Counted rows sort before disqualified ones, so that this frame is empty
    # only if the event has no score at all.
    top = (
        tables.scores.where(event)
        .withColumn("counted", is_counted())
        .orderBy(F.desc("counted"), *_snippet_order())
        .limit(n)
    )
    shown = [
        F.coalesce(name, F.concat(F.lit("Player #"), F.col(slot).cast("string")))
        for slot, name in zip(SLOT_IDS, SLOT_NAMES)
    ]
    rows = add_names_to_few(top, tables, "compact").select(
        "event_id", "id", "placement", "strokes", "to_par",
        player_ids(*SLOT_IDS).alias("player_ids"),
        F.concat_ws(TEAM_SEPARATOR, *shown).alias("team_name"),
        "counted",
    )
    return (
        latest.select(F.col("id").alias("event_id"), "name", "date", "course")
        .join(F.broadcast(rows), "event_id", "left")
        .where(F.coalesce("counted", F.lit(True)))
        .select(
            "event_id", "name", "date", "course", "id", "placement", "strokes", "to_par",
            F.coalesce("player_ids", F.array().cast("array<bigint>")).alias("player_ids"),
            F.coalesce("team_name", F.lit("")).alias("team_name"),
        )
        .orderBy(*_snippet_order())
    )


def event_team_rows(tables: Tables, event_id: int | None = None) -> DataFrame:
    """Teams of all events or of one with their ``position`` in the event, from
    1, by id; names are NULL for an empty slot."""
    scores = tables.scores.select("id", "event_id", *SLOT_IDS, "strokes", "placement", "notes")
    if event_id is not None:
        scores = scores.where(F.col("event_id") == event_id)
    placed = with_positions(scores, "event_id", ["id"])
    return add_player_names(placed, tables, "strict", scores)


def event_with_teams(tables: Tables, page_size: int, event_id: int | None = None) -> DataFrame:
    """Events with their teams nested, sorted by id; [] for an event without.

    One row per event and page; page 0 holds the first positions. The flat
    ``event_team_rows`` has all teams of an event without pages.
    """
    listed = event_list_with_location(tables, ordered=False)
    if event_id is not None:
        listed = listed.where(F.col("id") == event_id)
    team = [
        "id", "strokes", "placement", "notes",
        *[F.col(n).alias(n.removesuffix("_name")) for n in SLOT_NAMES],
    ]
    teams = (
        event_team_rows(tables, event_id)
        .groupBy(F.col("event_id").alias("id"), page_of("position", page_size).alias("page"))
        .agg(ordered_list(team, ["position"]).alias("teams"))
    )
    no_teams = F.array().cast(teams.schema["teams"].dataType)
    # A page exists because a team is on it; an event without teams has page 0.
    return listed.join(teams, "id", "left").select(
        *EVENT_COLUMNS, "course_name", "course_location", "course_par",
        F.coalesce("page", F.lit(0).cast("long")).alias("page"),
        F.coalesce("teams", no_teams).alias("teams"),
    )
