"""Column types, keys and limits of the league tables.

Everything in this module is a fixed value of the data model: other modules
read the rules from here instead of repeating them.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, dtype) for name, dtype in fields.items()])


PLAYERS = _struct(
    id=LongType(),
    first_name=StringType(),
    last_name=StringType(),
    nickname=StringType(),
    hometown=StringType(),
    debut_year=IntegerType(),
    image_url=StringType(),
    hof_inducted=BooleanType(),
    hof_year=IntegerType(),
    accolades=StringType(),
)

COURSES = _struct(
    id=LongType(),
    name=StringType(),
    city=StringType(),
    state=StringType(),
    par=IntegerType(),
)

EVENTS = _struct(
    id=LongType(),
    name=StringType(),
    date=DateType(),
    course_id=LongType(),
    is_team_event=BooleanType(),
    notes=StringType(),
    season=IntegerType(),
    is_major=BooleanType(),
    major_label=StringType(),
    finalized=BooleanType(),
)

SCORES = _struct(
    id=LongType(),
    event_id=LongType(),
    player1_id=LongType(),
    player2_id=LongType(),
    player3_id=LongType(),
    player4_id=LongType(),
    strokes=IntegerType(),
    to_par=IntegerType(),
    placement=IntegerType(),
    notes=StringType(),
    disqualified=BooleanType(),
)

TABLES = {"players": PLAYERS, "courses": COURSES, "events": EVENTS, "scores": SCORES}

# A sheet holds one row per team score. Strokes arrive as "68.0" or as "67" in
# the same file, and an INT reader would turn the former into NULL, which means
# "disqualified". They are therefore read as decimals.
SHEET = _struct(
    season=IntegerType(),
    event_date=DateType(),
    event_name=StringType(),
    course_name=StringType(),
    course_city=StringType(),
    course_state=StringType(),
    course_par=IntegerType(),
    is_team_event=BooleanType(),
    is_major=BooleanType(),
    major_label=StringType(),
    finalized=BooleanType(),
    player1_full=StringType(),
    player2_full=StringType(),
    player3_full=StringType(),
    player4_full=StringType(),
    strokes=DecimalType(5, 2),
    placement=IntegerType(),
    notes=StringType(),
)

# What a sheet's row must say about the event it names.
SHEET_REQUIRED = ["event_name", "event_date", "season"]

NAME_MAP = _struct(raw_full=StringType(), first_name=StringType(), last_name=StringType())

SLOT_IDS = ["player1_id", "player2_id", "player3_id", "player4_id"]
SLOT_NAMES = ["player1_name", "player2_name", "player3_name", "player4_name"]
SHEET_NAMES = ["player1_full", "player2_full", "player3_full", "player4_full"]

# Unique keys. A column listed in NULL_AS takes part with NULL read as that value.
UNIQUE_KEYS = {
    "players": ["first_name", "last_name"],
    "courses": ["name", "city", "state"],
    "events": ["name", "date", "course_id"],
    "scores": ["event_id", *SLOT_IDS],
    "name_map": ["raw_full"],
}
NULL_AS = {
    "city": "",
    "state": "",
    "player1_id": 0,
    "player2_id": 0,
    "player3_id": 0,
    "player4_id": 0,
}

REQUIRED = {
    "players": ["first_name", "last_name"],
    "courses": ["name", "par"],
    "events": [
        "name", "date", "course_id", "is_team_event", "season", "is_major", "finalized",
    ],
    "scores": ["event_id", "player1_id", "disqualified"],
    "name_map": ["raw_full"],
}

MAX_LENGTH = {
    "players": {"first_name": 50, "last_name": 50, "nickname": 50, "hometown": 100},
    "courses": {"name": 100, "city": 100, "state": 100},
    "events": {"name": 100, "major_label": 50},
}

# Saved tables are kept in slices of this many values of a column, and a change
# rewrites the slices it touches. A table without one is a single slice.
SLICED_BY = {"events": "season", "scores": "event_id", "player_events": "event_id"}
SLICE_WIDTH = {"events": 1, "scores": 1 << 14, "player_events": 1 << 14}

# What is remembered of changed rows: the slice and the event they belong to.
TOLD_APART_BY = {"players": ["id"], "courses": ["id"], "events": ["season", "id"], "scores": ["event_id"]}

# table -> (column, referenced table, what deleting the referenced row does:
# restrict, cascade or set null)
REFERENCES = {
    "events": [("course_id", "courses", "restrict")],
    "scores": [
        ("event_id", "events", "cascade"),
        ("player1_id", "players", "restrict"),
        ("player2_id", "players", "restrict"),
        ("player3_id", "players", "restrict"),
        ("player4_id", "players", "restrict"),
    ],
}

# The other set of rules: deleting a team's first player deletes its scores, and
# deleting another member empties the slot.
LENIENT_REFERENCES = {
    "events": [("course_id", "courses", "restrict")],
    "scores": [
        ("event_id", "events", "cascade"),
        ("player1_id", "players", "cascade"),
        ("player2_id", "players", "set null"),
        ("player3_id", "players", "set null"),
        ("player4_id", "players", "set null"),
    ],
}

DEFAULTS = {
    "players": {"hof_inducted": False},
    "courses": {},
    "events": {"is_team_event": True, "is_major": False, "finalized": False},
    "scores": {"disqualified": False},
}

DEFAULT_PAR = 72
