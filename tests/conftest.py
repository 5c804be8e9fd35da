from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clubhouse import schemas  # noqa: E402
from clubhouse.session import local_session  # noqa: E402
from clubhouse.tables import Tables, conform  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # The tables are tiny, so few and small tasks.
    settings = {
        "spark.sql.shuffle.partitions": "2",
        "spark.default.parallelism": "2",
        "spark.driver.memory": "6g",
    }
    session = local_session(8, "tests", **settings)
    yield session
    session.stop()


def frame(spark, table: str, rows: list[dict]):
    """Rows of a table given by some of their columns; the rest is NULL."""
    schema = schemas.TABLES[table]
    full = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return conform(spark.createDataFrame(full, schema), table)


def day(n: int) -> dt.date:
    return dt.date(2025, 4, n)


@pytest.fixture(scope="session")
def league(spark) -> Tables:
    """Four players and four events that meet every special case of the reports.

    Event 1 is a finalized major won by two tied teams, one of which names its
    member twice. Event 2 is finalized and has a disqualified first place.
    Event 3 is not finalized. Event 4 has no scores. Player 4 never plays.
    """
    players = frame(spark, "players", [
        {"id": 1, "first_name": "Ada", "last_name": "Birch", "hof_inducted": False},
        {"id": 2, "first_name": "Ben", "last_name": "Cole", "hof_inducted": False},
        {"id": 3, "first_name": "Cy", "last_name": "Drake", "hof_inducted": True},
        {"id": 4, "first_name": "Di", "last_name": "Elm", "hof_inducted": False},
    ])
    courses = frame(spark, "courses", [
        {"id": 1, "name": "Long Meadow", "city": "Oak Hill", "state": "MN", "par": 72},
        {"id": 2, "name": "Short Meadow", "city": "Oak Hill", "par": 70},
    ])
    flags = {"is_team_event": True, "season": 2025}
    events = frame(spark, "events", [
        {"id": 1, "name": "Open", "date": day(1), "course_id": 1, "is_major": True,
         "finalized": True, **flags},
        {"id": 2, "name": "Cup", "date": day(2), "course_id": 2, "is_major": False,
         "finalized": True, **flags},
        {"id": 3, "name": "Open", "date": day(3), "course_id": 1, "is_major": False,
         "finalized": False, **flags},
        {"id": 4, "name": "Final", "date": day(4), "course_id": 2, "is_major": False,
         "finalized": False, **flags},
    ])

    def score(id, event, ids, strokes, placement, to_par=None, dq=False):
        slots = dict(zip(schemas.SLOT_IDS, ids))
        return {"id": id, "event_id": event, **slots, "strokes": strokes, "to_par": to_par,
                "placement": placement, "disqualified": dq}

    scores = frame(spark, "scores", [
        score(11, 1, [1, 1], 70, 1),
        score(12, 1, [2], 70, 1),
        score(13, 1, [3, 2], 75, 3, to_par=9),
        score(21, 2, [1, 3], 66, 1, dq=True),
        score(22, 2, [2], 70, 2),
        score(23, 2, [3], None, None, dq=True),
        score(31, 3, [1], 71, 1),
    ])
    return Tables(players=players, courses=courses, events=events, scores=scores)


@pytest.fixture(scope="session")
def large(league) -> Tables:
    """The same league, treated as too large to broadcast anything."""
    return Tables(**league.as_dict(), broadcast_rows=0)


@pytest.fixture(params=["broadcast", "shuffled"])
def either(request, league, large) -> Tables:
    return league if request.param == "broadcast" else large


def rows(df, *columns: str) -> list[tuple]:
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
