"""Listings with the texts a results page shows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clubhouse.functions import labels
from clubhouse.plans.events import event_list
from clubhouse.plans.leaderboards import event_scores
from clubhouse.plans.players import player_list
from clubhouse.schemas import SLOT_IDS, SLOT_NAMES
from clubhouse.tables import Tables


def event_labels(tables: Tables) -> DataFrame:
    """Every event with its date, course and major texts."""
    return event_list(tables, ordered=False).select(
        "id",
        labels.date_label("date").alias("date_label"),
        labels.course_label("course_name", "course_par", "course_id").alias("course_label"),
        labels.course_or_unknown("course_name").alias("course"),
        labels.course_or_undecided("course_name").alias("venue"),
        labels.major_title("is_major", "major_label").alias("major_title"),
        labels.event_title("name").alias("title"),
        labels.date_or_none("date").alias("shown_date"),
    )


def player_labels(tables: Tables) -> DataFrame:
    """Every player with title, list line and detail line."""
    return player_list(tables, ordered=False).select(
        "id",
        labels.player_title("full_name", "nickname").alias("title"),
        labels.player_line("hometown", "debut_year").alias("line"),
        labels.player_detail_line("hometown", "debut_year", "hof_inducted", "hof_year").alias(
            "detail_line"
        ),
    )


def score_labels(tables: Tables) -> DataFrame:
    """Every score with its medal, team, strokes and to-par texts."""
    return event_scores(tables, ordered=False).select(
        "id",
        "event_id",
        labels.medal("placement").alias("medal"),
        labels.value_or_dash("placement").alias("place"),
        labels.team_label(*SLOT_NAMES).alias("team"),
        labels.team_label(*SLOT_NAMES, separator=", ").alias("members"),
        labels.members_label(SLOT_NAMES, SLOT_IDS).alias("linked_members"),
        labels.value_or_dash("strokes").alias("strokes_label"),
        labels.to_par_label("to_par").alias("to_par_label"),
    )
