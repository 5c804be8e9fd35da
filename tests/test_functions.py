from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clubhouse.functions import labels, names, scoring


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def text(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    "function, first, last, expected",
    [
        (names.full_name, "Ada", "Birch", "Ada Birch"),
        (names.full_name, None, "Birch", "Birch"),
        (names.full_name, None, None, ""),
        (names.strict_full_name, "Ada", "Birch", "Ada Birch"),
        (names.strict_full_name, None, "Birch", None),
        (names.tidy_full_name, "", "Birch", "Birch"),
        (names.tidy_full_name, " Ada", "Birch ", "Ada Birch"),
        (names.joined_name, None, "Birch", " Birch"),
        (names.compact_name, "Ada", "Birch", "A. Birch"),
        (names.compact_name, None, "Birch", ". Birch"),
    ],
)
def test_person_names(spark, function, first, last, expected):
    assert value(spark, function(text(first), text(last))) == expected


def test_team_names(spark):
    team = names.compact_team_name(text("A. Birch"), text(None), text("B. Cole"), text(None))
    assert value(spark, team) == "A. Birch / B. Cole"
    assert value(spark, names.compact_team_name(text(None), text(None))) == ""
    # Blanks and slashes are trimmed as characters, not as the separator.
    assert value(spark, names.compact_team_name(text("/ A. Birch /"))) == "A. Birch"
    label = labels.team_label(text("A"), text(""), text(None), text("B"), separator=", ")
    assert value(spark, label) == "A, B"


def test_player_ids_keep_order_and_repeats(spark):
    ids = [F.lit(v).cast("long") for v in (3, None, 1, 3)]
    assert value(spark, names.player_ids(*ids)) == [3, 1, 3]
    assert value(spark, names.is_member(F.lit(1), *ids)) is True
    assert value(spark, names.is_member(F.lit(9), *ids)) is None


@pytest.mark.parametrize(
    "stored, strokes, par, expected",
    [(-3, 70, 72, -3), (None, 70, 72, -2), (None, None, 72, None), (None, 70, None, None)],
)
def test_to_par(spark, stored, strokes, par, expected):
    args = [F.lit(v).cast("int") for v in (stored, strokes, par)]
    assert value(spark, scoring.to_par(*args)) == expected


@pytest.mark.parametrize(
    "strokes, notes, expected",
    [(70, None, False), (None, None, True), (70, "late, Dq'd", True), (70, "fine", False)],
)
def test_disqualified_on_load(spark, strokes, notes, expected):
    column = scoring.disqualified_on_load(F.lit(strokes).cast("int"), text(notes))
    assert value(spark, column) is expected


def test_flags_and_comparison(spark):
    null = F.lit(None).cast("boolean")
    assert value(spark, scoring.is_counted(null)) is True
    assert value(spark, scoring.is_win(F.lit(None).cast("int"), null)) is False
    assert value(spark, scoring.differs(F.lit(None), F.lit(None))) is False
    assert value(spark, scoring.differs(F.lit(1), F.lit(None))) is True
    assert value(spark, scoring.location(text("Oak Hill"), text(None))) is None


@pytest.mark.parametrize("raw, expected", [("68.0", 68), ("68.50", 69), ("67", 67)])
def test_whole_strokes(spark, raw, expected):
    assert value(spark, scoring.whole_strokes(F.lit(raw).cast("decimal(5,2)"))) == expected


@pytest.mark.parametrize(
    "total, count, expected",
    [(34497, 100000, "0.34"), (1, 8, "0.13"), (-1, 8, "-0.13"), (2849, 40, "71.23")],
)
def test_averages_are_rounded_once(spark, total, count, expected):
    column = scoring.exact_average(F.lit(total).cast("long"), F.lit(count).cast("long"))
    assert value(spark, column) == Decimal(expected)
    assert value(spark, scoring.exact_average(F.lit(None).cast("long"), F.lit(0))) is None


def test_labels(spark):
    def number(v):
        return F.lit(v).cast("int")

    shown = [value(spark, labels.to_par_label(number(v))) for v in (None, 0, 3, -2)]
    assert shown == ["—", "E", "+3", "-2"]
    assert [value(spark, labels.medal(number(v))) for v in (1, 2, 3, 4)] == ["🥇", "🥈", "🥉", "#4"]
    assert value(spark, labels.date_label(F.lit(dt.date(2025, 4, 12)))) == "Apr 12, 2025"
    course = labels.course_label
    assert value(spark, course(text("Long Meadow"), number(72), number(1))) == "Long Meadow (Par 72)"
    assert value(spark, course(text("Long Meadow"), number(None), number(1))) == "Long Meadow"
    assert value(spark, course(text(""), number(72), number(7))) == "Course #7"
    assert value(spark, course(text(None), number(72), number(None))) == "Course #—"
    assert value(spark, labels.major_title(F.lit(True), text(""))) == "Major Tournament"
    assert value(spark, labels.major_title(F.lit(True), text("Masters"))) == "Masters"
    assert value(spark, labels.major_title(F.lit(False), text("Masters"))) is None
    assert value(spark, labels.course_or_unknown(text(None))) == "Unknown Course"
    assert value(spark, labels.course_or_undecided(text(""))) == "TBD"
    assert value(spark, labels.two_decimal_label(F.lit("1234.5").cast("decimal(10,2)"))) == "1234.50"


def test_lines_about_players_events_and_members(spark):
    df = spark.createDataFrame(
        [
            ("Ada Birch", "Ace", "Oak Hill", 2001, True, 2010, "Open"),
            ("Ben Cole", "", None, 2003, False, None, None),
            ("Cy Drake", None, "Elm", None, True, None, ""),
            ("Di Elm", None, None, None, None, None, "Cup"),
        ],
        "n string, nick string, home string, debut int, hof boolean, year int, event string",
    )
    shown = df.select(
        labels.player_title("n", "nick"), labels.player_line("home", "debut"),
        labels.player_detail_line("home", "debut", "hof", "year"), labels.event_title("event"),
    )
    assert [tuple(r) for r in shown.collect()] == [
        ("Ada Birch (“Ace”)", "Oak Hill · Debut 2001",
         "Oak Hill · Debut 2001 · Hall of Fame (2010)", "Open"),
        ("Ben Cole", "Debut 2003", "Debut 2003", "(Unnamed Event)"),
        ("Cy Drake", "Elm", "Elm ·  · Hall of Fame", "(Unnamed Event)"),
        ("Di Elm", "", "", "Cup"),
    ]
    teams = spark.createDataFrame([("Ada", "", 1, 2), ("", "", None, None)], "a string, b string, i int, j int")
    assert [r[0] for r in teams.select(labels.members_label(["a", "b"], ["i", "j"])).collect()] == [
        "Ada / #2", "—",
    ]
    none = spark.sql("SELECT CAST(NULL AS DATE) AS d")
    assert none.select(labels.date_or_none("d")).first()[0] == "No date"
