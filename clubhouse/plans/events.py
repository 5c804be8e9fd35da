"""Event lists and the events around a date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubhouse.functions.scoring import location
from clubhouse.operators.joins import lookup
from clubhouse.tables import Tables

EVENT_COLUMNS = [
    "id", "name", "date", "course_id", "is_team_event", "notes", "season",
    "is_major", "major_label", "finalized",
]
BRIEF_COLUMNS = ["id", "name", "date", "course_id", "season"]


def newest_first() -> list[Column]:
    return [F.desc_nulls_first("date"), F.desc_nulls_first("id")]


def oldest_first() -> list[Column]:
    return [F.asc_nulls_last("date"), F.asc_nulls_last("id")]


def with_course(events: DataFrame, tables: Tables, *columns: str) -> DataFrame:
    """Add course columns, prefixed ``course_``, to rows with a ``course_id``."""
    courses = tables.courses.select(
        F.col("id").alias("course_id"), *[F.col(c).alias(f"course_{c}") for c in columns]
    )
    return lookup(events, courses, ["course_id"], small=tables.is_small("courses"))


def with_course_of_few(events: DataFrame, tables: Tables, *columns: str) -> DataFrame:
    """``with_course`` for a frame that a LIMIT keeps to a few rows: of a large
    course table only the courses they name are broadcast, at most one per row."""
    if tables.is_small("courses"):
        return with_course(events, tables, *columns)
    wanted = events.select(F.col("course_id").alias("id")).distinct()
    picked = tables.courses.join(F.broadcast(wanted), "id", "left_semi").select(
        F.col("id").alias("course_id"), *[F.col(c).alias(f"course_{c}") for c in columns]
    )
    return lookup(events, picked, ["course_id"], small=True)


def event_facts(tables: Tables) -> DataFrame:
    """What reports need to know about a score's event, keyed by ``event_id``."""
    events = tables.events.select(
        F.col("id").alias("event_id"), F.col("name").alias("event_name"), "date", "season",
        "course_id",
    )
    return with_course(events, tables, "name", "par").drop("course_id")


def event_list(tables: Tables, ordered: bool = True) -> DataFrame:
    """All events with course name and par, newest first."""
    listed = with_course(tables.events.select(*EVENT_COLUMNS), tables, "name", "par")
    return listed.orderBy(*newest_first()) if ordered else listed


def event_list_with_location(tables: Tables, ordered: bool = True) -> DataFrame:
    """The event list with a "city, state" label, NULL if either part is."""
    listed = with_course(
        tables.events.select(*EVENT_COLUMNS), tables, "name", "city", "state", "par"
    )
    listed = listed.select(
        *EVENT_COLUMNS,
        "course_name",
        location("course_city", "course_state").alias("course_location"),
        "course_par",
    )
    return listed.orderBy(*newest_first()) if ordered else listed


def event_by_id(tables: Tables, event_id: int) -> DataFrame:
    """One event with its course; no row means not found."""
    one = tables.events.where(F.col("id") == event_id).select(*EVENT_COLUMNS).limit(1)
    return with_course_of_few(one, tables, "name", "par")


def with_ids(listed: DataFrame, ids: DataFrame) -> DataFrame:
    """A listing narrowed to a frame of ids: one row per id, ``found`` or not."""
    wanted = ids.select("id").where(F.col("id").isNotNull()).distinct()
    found = listed.withColumn("found", F.lit(True))
    return wanted.join(found, "id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def pick_latest(tables: Tables, as_of: dt.date) -> DataFrame:
    """The last event on or before a date, without its course."""
    past = tables.events.where(F.col("date") <= F.lit(as_of)).select(*BRIEF_COLUMNS)
    return past.orderBy(*newest_first()).limit(1)


def pick_finalized(tables: Tables, n: int) -> DataFrame:
    """The last n finalized events, without their courses."""
    done = tables.events.where("finalized").select("id", "name", "date", "course_id")
    return done.orderBy(*newest_first()).limit(n)


def latest_event(tables: Tables, as_of: dt.date) -> DataFrame:
    """The last event on or before a date, finalized or not."""
    return with_course_of_few(pick_latest(tables, as_of), tables, "name", "par")


def next_event(tables: Tables, as_of: dt.date) -> DataFrame:
    """The first event after a date."""
    coming = tables.events.where(F.col("date") > F.lit(as_of)).select(*BRIEF_COLUMNS)
    return with_course_of_few(coming.orderBy(*oldest_first()).limit(1), tables, "name", "par")


def _named_with_course(picked: DataFrame, tables: Tables) -> DataFrame:
    return with_course_of_few(picked, tables, "name").select(
        "id", "name", "date", F.col("course_name").alias("course")
    )


def upcoming_events(tables: Tables, as_of: dt.date, n: int = 3) -> DataFrame:
    """The next n events on or after a date that are not finalized."""
    open_events = tables.events.where(~F.col("finalized") & (F.col("date") >= F.lit(as_of)))
    picked = open_events.select("id", "name", "date", "course_id").orderBy(*oldest_first()).limit(n)
    return _named_with_course(picked, tables).orderBy(*oldest_first())


def latest_finalized(tables: Tables, n: int) -> DataFrame:
    """The last n finalized events with their course names, newest first."""
    return _named_with_course(pick_finalized(tables, n), tables).orderBy(*newest_first())
