from __future__ import annotations

import glob
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from clubhouse.operators import load, quality
from clubhouse.operators.quality import IntegrityError
from clubhouse.plans import leaderboards
from clubhouse.schemas import SHEET
from clubhouse.sources import files
from clubhouse.tables import Tables, empty_tables

# Invented rows. Line by line: strokes as "68.0" and as "67"; a first player
# that is not mapped; an unmapped partner; no strokes; "dq" in the notes; a
# course without city and par; the same team again with a worse place.
SHEET_CSV = """\
2025,2025-04-12,Pairs,Long Meadow,Oak Hill,MN,72,True,False,,True,Ada Birch,Ben Cole,,,68.0,1,
2025,2025-04-12,Pairs,Long Meadow,Oak Hill,MN,72,True,False,,True,Nobody Known,Ben Cole,,,70,2,
2025,2025-04-12,Pairs,Long Meadow,Oak Hill,MN,72,True,False,,True,Cy Drake,Some Guest,,,67,1,
2025,2025-04-12,Pairs,Long Meadow,Oak Hill,MN,72,True,False,,True,Di Elm,,,,,12,
2025,2025-04-12,Pairs,Long Meadow,Oak Hill,MN,72,True,False,,True,Ben Cole,,,,75,4,late Dq
2025,2025-05-01,Solo,Short Meadow,,,,,,,,ada birch,,,,71.0,1,
2025,2025-04-12,Pairs,Long Meadow,Oak Hill,MN,72,True,False,,True,Ada Birch,Ben Cole,,,80,9,
"""
NAMES_CSV = """\
Ada Birch,Ada,Birch
ada birch,Ada,Birch
Ben Cole,Ben,Cole
Cy Drake,Cy,Drake
Di Elm,Di,Elm
No Last,No,
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("sheets")


@pytest.fixture(scope="module")
def sheet(spark, folder):
    return read_sheet(spark, folder, SHEET_CSV)


def read_sheet(spark, folder, text, name="sheet"):
    path = folder / f"{name}.csv"
    path.write_text(",".join(SHEET.names) + "\n" + text)
    return load.stage(files.read_results(spark, str(path)))


@pytest.fixture(scope="module")
def names(spark, folder):
    path = folder / "names.csv"
    path.write_text("raw_full,first_name,last_name\n" + NAMES_CSV)
    return load.stage(files.read_name_map(spark, str(path)))


@pytest.fixture(scope="module", params=["broadcast", "shuffled"])
def empty(request, spark):
    rows = 100_000 if request.param == "broadcast" else 0
    return Tables(**empty_tables(spark).as_dict(), broadcast_rows=rows)


@pytest.fixture(scope="module")
def loaded(sheet, names, empty):
    return load.load_from_staging(sheet, names, empty)


def test_sheet_types(sheet):
    assert sorted(r[0] for r in rows(sheet, "strokes") if r[0] is not None) == [
        67, 68, 70, 71, 75, 80,
    ]
    assert rows(sheet.where("event_name = 'Solo'"), "is_major", "notes") == [(None, None)]


def test_a_bad_sheet_fails(spark, tmp_path):
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        read_sheet(spark, tmp_path, SHEET_CSV.replace("2025-05-01", "first of May"))


def test_distinct_raw_names(sheet):
    assert sorted(rows(load.distinct_raw_names(sheet))) == [
        ("Ada Birch",), ("Ben Cole",), ("Cy Drake",), ("Di Elm",), ("Nobody Known",),
        ("Some Guest",), ("ada birch",),
    ]


def natural(tables: Tables):
    board = leaderboards.event_scores(tables, ordered=False)
    return sorted(
        rows(board, "player1_name", "player2_name", "strokes", "to_par", "placement",
             "disqualified"),
        key=str,
    )


def test_load(loaded):
    assert sorted(rows(loaded.courses, "id", "name", "city", "par")) == [
        (1, "Long Meadow", "Oak Hill", 72), (2, "Short Meadow", None, 72),
    ]
    assert sorted(rows(loaded.players, "id", "first_name", "hof_inducted")) == [
        (1, "Ada", False), (2, "Ben", False), (3, "Cy", False), (4, "Di", False),
    ]
    assert sorted(rows(loaded.events, "name", "is_team_event", "is_major", "finalized")) == [
        ("Pairs", True, False, True), ("Solo", True, False, False),
    ]
    assert natural(loaded) == [
        ("Ada Birch", "", 71, -1, 1, False),
        ("Ada Birch", "Ben Cole", 68, -4, 1, False),
        ("Ben Cole", "", 75, 3, 4, True),
        ("Cy Drake", "", 67, -5, 1, False),
        ("Di Elm", "", None, None, 12, True),
    ]
    assert sorted(rows(loaded.scores, "id")) == [(i,) for i in range(1, 6)]


def test_loading_again_changes_nothing(sheet, names, loaded):
    again = load.load_from_staging(sheet, names, loaded)
    for name, df in loaded.as_dict().items():
        other = getattr(again, name)
        assert df.exceptAll(other).isEmpty() and other.exceptAll(df).isEmpty()


def test_corrections(spark, tmp_path, names, loaded):
    once = loaded.with_tables(events=loaded.events.withColumn("notes", F.lit("kept")))
    changed = read_sheet(
        spark, tmp_path,
        "2026,2025-04-12,Pairs,Long Meadow,Oak Hill,MN,70,False,True,Masters,,"
        "Ada Birch,Ben Cole,,,60,5,\n",
        "changed",
    )
    after = load.load_from_staging(changed, names, once)
    # The event and the par follow the sheet, the score keeps its strokes.
    assert rows(
        after.events.where("name = 'Pairs'"), "id", "season", "is_team_event", "is_major",
        "major_label", "finalized", "notes",
    ) == [(1, 2026, False, True, "Masters", False, "kept")]
    assert rows(after.courses.where("id = 1"), "par") == [(70,)]
    assert ("Ada Birch", "Ben Cole", 68, -2, 1, False) in natural(after)
    assert after.scores.count() == 5


def test_of_several_pars_the_highest_counts(spark, tmp_path):
    two = read_sheet(
        spark, tmp_path,
        "2025,2025-04-12,A,Long Meadow,,MN,70,True,False,,True,Ada Birch,,,,68,1,\n"
        "2025,2025-04-12,A,Long Meadow,,MN,71,True,False,,True,Ben Cole,,,,69,2,\n"
        "2025,2025-04-12,A,Long Meadow,,MN,,True,False,,True,Cy Drake,,,,70,3,\n",
    )
    courses = load.insert_courses(empty_tables(spark).courses, two)
    assert rows(courses, "name", "state", "par") == [("Long Meadow", "MN", 71)]
    lower = courses.withColumn("par", F.lit(70))
    assert rows(load.update_course_par(lower, two), "par") == [(71,)]


@pytest.mark.parametrize(
    "line, complaint",
    [
        ("2024,2025-04-12,Pairs,Long Meadow,Oak Hill,MN,72,True,False,,True,Di Elm,,,,70,3,",
         "different ways"),
        (",2025-06-01,Late,Long Meadow,Oak Hill,MN,72,True,False,,True,Di Elm,,,,70,3,",
         "lacks a required value"),
    ],
)
def test_refused_sheets(spark, tmp_path, names, empty, line, complaint):
    bad = read_sheet(spark, tmp_path, SHEET_CSV + line + "\n", "bad")
    with pytest.raises(IntegrityError, match=complaint):
        load.load_from_staging(bad, names, empty)


def test_a_raw_name_may_be_mapped_once(spark, tmp_path):
    path = tmp_path / "twice.csv"
    path.write_text("raw_full,first_name,last_name\nA B,A,B\nA B,A,C\n")
    with pytest.raises(IntegrityError, match="given twice"):
        files.read_name_map(spark, str(path))


@pytest.mark.skipif("GOLDEN_DIR" not in os.environ, reason="no sheet with its loaded tables")
def test_golden_load(spark):
    """A real sheet must load into the tables that were backed up after it."""
    folder = os.environ["GOLDEN_DIR"]

    def path(pattern):
        return glob.glob(f"{folder}/**/{pattern}", recursive=True)[0]

    sheet = load.stage(files.read_results(spark, path("*results*.csv")))
    names = load.distinct_raw_names(sheet).select(
        "raw_full",
        F.substring_index("raw_full", " ", 1).alias("first_name"),
        F.expr("substr(raw_full, instr(raw_full, ' ') + 1)").alias("last_name"),
    )
    loaded = load.load_from_staging(sheet, load.stage(names), empty_tables(spark))

    def facts(events, scores):
        about = events.select(F.col("id").alias("event_id"), "name", "date", "season",
                              "is_team_event", "is_major", "finalized")
        return scores.drop("id", "player1_id", "player2_id", "player3_id", "player4_id").join(
            about, "event_id"
        ).drop("event_id")

    want = facts(
        files.read_backup(spark, "events", path("events_backup*.csv")),
        files.read_backup(spark, "scores", path("scores_backup*.csv")),
    )
    have = facts(loaded.events, loaded.scores)
    assert have.count() == want.count() > 0
    assert have.exceptAll(want).isEmpty() and want.exceptAll(have).isEmpty()


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_ambiguous_names_are_refused_at_any_size(spark, league, sheet, broadcast_rows):
    twins = spark.createDataFrame([(9, "Ada", "Birch")], "id long, first_name string, last_name string")
    two = Tables(
        **{**league.as_dict(), "players": league.players.unionByName(twins, allowMissingColumns=True)},
        broadcast_rows=broadcast_rows,
    )
    once = spark.createDataFrame([("Ada Birch", "Ada", "Birch")], "raw_full string, first_name string, last_name string")
    with pytest.raises(IntegrityError, match="several players"):
        load.insert_scores(sheet, once, two)
    one = Tables(**league.as_dict(), broadcast_rows=broadcast_rows)
    with pytest.raises(IntegrityError, match="given twice"):
        load.insert_scores(sheet, once.union(once), one)


def test_a_table_is_checked_by_its_write(spark, league):
    """Values are observed while the rows are written; an empty table is fine."""
    kept = quality.written_checked(league.players, "players")
    assert sorted(rows(kept)) == sorted(rows(league.players))
    assert quality.written_checked(league.players.limit(0), "players").count() == 0
    for broken, complaint in (
        (league.players.withColumn("last_name", F.when(F.col("id") > 1, F.col("last_name"))), "last_name: required value"),
        (league.players.withColumn("nickname", F.repeat(F.lit("x"), 51)), "nickname: text too long"),
        (league.players.unionByName(league.players), "duplicate key"),
    ):
        with pytest.raises(quality.IntegrityError, match=complaint):
            quality.written_checked(broken, "players")


@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_of_equally_placed_rows_of_a_team_missing_values_come_first(spark, league, broadcast_rows):
    """A missing place or missing strokes rank as the greatest number, missing notes as empty ones;
    where that leaves a tie, the row without the value stands."""
    last = 2**31 - 1
    tables = Tables(**league.as_dict(), broadcast_rows=broadcast_rows)
    event, course = tables.events.where("id = 1").first(), tables.courses.where("id = 1").first()
    names = spark.createDataFrame([("A", "Ada", "Birch"), ("B", "Ben", "Cole")], ["raw_full", "first_name", "last_name"])
    options = [(p, s, n) for p in (None, last, 3) for s in (None, 70) for n in (None, "", "b")]
    for given in ([(None, 70, ""), (last, 70, ""), (last, 70, None)], [(3, None, "b"), (3, 70, "b")], options, options[:12]):
        lines = [
            {"event_name": event.name, "event_date": event.date, "course_name": course.name, "course_city": course.city,
             "course_state": course.state, "player1_full": "A", "player3_full": "B", "strokes": s, "placement": p, "notes": n}
            for p, s, n in given
        ]
        sheet = spark.createDataFrame([tuple(r.get(c) for c in SHEET.names) for r in lines], ", ".join(
            f"{f.name} {'int' if f.name == 'strokes' else f.dataType.simpleString()}" for f in SHEET.fields
        ))
        (found,) = rows(
            load.staged_scores(sheet, names, tables), "player1_id", "player2_id", "player3_id", "placement", "strokes", "notes", "par"
        )
        least = min(given, key=lambda r: (
            last if r[0] is None else r[0], last if r[1] is None else r[1], r[2] or "",
            r[1] is not None, r[0] is not None, r[2] is not None,
        ))
        assert found == (1, None, 2, *least, course.par)
