"""The homepage's totals, summary and feed as documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubhouse.operators.nesting import ordered_list
from clubhouse.plans.events import (
    BRIEF_COLUMNS,
    latest_event,
    next_event,
    upcoming_events,
)
from clubhouse.plans.leaderboards import (
    latest_event_top,
    leaderboard_snippet,
    podium_documents,
)
from clubhouse.plans.wins import top_players
from clubhouse.schemas import SLOT_NAMES
from clubhouse.tables import Tables


def _one_row(tables: Tables) -> DataFrame:
    return tables.spark.range(1)


def league_totals(tables: Tables) -> DataFrame:
    """Players, events and distinct seasons, as one row."""
    rows = F.count(F.lit(1))
    return _one_row(tables).select(
        tables.players.agg(rows).scalar().alias("players"),
        tables.events.agg(rows).scalar().alias("events"),
        tables.events.agg(F.countDistinct("season")).scalar().alias("seasons"),
    )


def home_summary(tables: Tables, as_of: dt.date, n: int = 5) -> DataFrame:
    """Totals, latest event with its first n results, and next event, as one row.

    An event that does not exist is NULL.
    """
    event = F.struct(*BRIEF_COLUMNS, "course_name", "course_par")
    results = ordered_list(
        ["id", "placement", "strokes", "to_par", *SLOT_NAMES], ["placement", "id"]
    )
    parts = _one_row(tables).select(
        league_totals(tables).select(F.struct("players", "events", "seasons")).scalar()
        .alias("totals"),
        latest_event(tables, as_of).select(event).scalar().alias("latest_event"),
        latest_event_top(tables, as_of, n).agg(results).scalar().alias("top_results"),
        next_event(tables, as_of).select(event).scalar().alias("next_event"),
    )
    latest = F.col("latest_event").withField("top_results", F.col("top_results"))
    return parts.select("totals", latest.alias("latest_event"), "next_event")


def homepage(
    tables: Tables,
    as_of: dt.date,
    page_size: int,
) -> DataFrame:
    """Upcoming events, latest podiums, leaderboard snippet and top players.

    One document row, ``page`` 0. Only if a podium holds more than
    ``page_size`` rows do further pages follow, with podium rows alone.
    """
    newest_first = [-F.unix_date("date"), -F.col("id")]
    podiums = (
        podium_documents(tables, page_size)
        .groupBy("page")
        .agg(
            ordered_list(["id", "name", "date", "course", "podium"], newest_first)
            .alias("latestEvents")
        )
    )
    upcoming = upcoming_events(tables, as_of).agg(
        ordered_list(["id", "name", "date", "course"], ["date", "id"])
    )
    line = [
        "placement", "strokes", F.col("to_par").alias("toPar"),
        F.col("player_ids").alias("playerIds"), F.col("team_name").alias("teamName"),
    ]
    snippet = (
        leaderboard_snippet(tables)
        .groupBy(F.col("event_id").alias("id"), "name", "date", "course")
        .agg(ordered_list(line, ["placement", "strokes", "id"]).alias("rows"))
        .select(
            F.struct(
                F.struct("id", "name", "date", "course").alias("event"), F.col("rows")
            )
        )
    )
    best = top_players(tables).agg(
        ordered_list(
            ["player_id", "name", "career_wins", "events_played", "major_wins"],
            [-F.col("career_wins"), -F.col("events_played"), "name", "player_id"],
        )
    )
    first = F.col("page") == 0
    no_events = F.array().cast(podiums.schema["latestEvents"].dataType)
    return (
        _one_row(tables)
        .select(F.col("id").alias("page"))
        .join(podiums, "page", "full")
        .select(
            "page",
            F.when(first, upcoming.scalar()).alias("upcomingEvents"),
            F.coalesce("latestEvents", no_events).alias("latestEvents"),
            F.when(first, snippet.scalar()).alias("leaderboardSnippet"),
            F.when(first, best.scalar()).alias("topPlayers"),
        )
    )
