from __future__ import annotations

import json
from decimal import Decimal as D

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from clubhouse import schemas
from clubhouse.operators import changes
from clubhouse.plans import homepage, leaderboards
from clubhouse.sources import files, store
from clubhouse.sources.folders import Folder


def test_save_and_load(spark, league, tmp_path):
    root = str(tmp_path / "league")
    with pytest.raises(FileNotFoundError):
        store.load_tables(spark, root)
    assert store.save_tables(league, root) == 1
    loaded = store.load_tables(spark, root)
    for name, df in league.as_dict().items():
        other = getattr(loaded, name)
        assert other.schema == df.schema
        assert df.exceptAll(other).isEmpty() and other.exceptAll(df).isEmpty()

    # Tables read from a version can be saved as the next one.
    less = loaded.with_tables(scores=loaded.scores.where("event_id = 1"))
    assert store.save_tables(less, root) == 2
    assert store.load_tables(spark, root).scores.count() == 3
    assert store.load_tables(spark, root, version=1).scores.count() == 7


def test_seed(spark, tmp_path):
    root = str(tmp_path / "league")
    tables = store.seed(spark, root)
    counts = {name: df.count() for name, df in tables.as_dict().items()}
    assert counts == {"players": 7, "courses": 2, "events": 3, "scores": 6}
    board = leaderboards.event_scores(store.load_tables(spark, root))
    assert rows(board, "event_id", "player1_name", "strokes", "to_par", "placement", "disqualified") == [
        (1, "Ines Quill", 64, -7, 1, False),
        (1, "Katja Stone", 64, -7, 1, False),
        (1, "Mira Umber", 69, -2, 3, False),
        (1, "Nils Vale", None, None, 4, True),
        (2, "Ines Quill", 61, -9, 1, False),
        (2, "Jonah Reed", 66, -4, 2, False),
    ]


def test_the_second_of_two_savers_is_told(spark, league, tmp_path):
    root = str(tmp_path / "league")
    store.save_tables(league, root)
    mine, other = store.load_tables(spark, root), store.load_tables(spark, f"file:{root}/")
    new = spark.createDataFrame([("Third Meadow", 71)], "name string, par int")
    assert store.save_tables(changes.insert_rows(other, "courses", new).tables, root) == 2
    late = changes.delete_rows(mine, "scores", mine.scores.where("id = 11")).tables
    with pytest.raises(store.VersionConflict, match="from version 1, but version 2"):
        store.save_tables(late, root)
    now = store.load_tables(spark, root)
    assert now.courses.count() == 3 and now.scores.count() == 7
    # Tables from elsewhere are no version of these, unless they are to replace them.
    with pytest.raises(store.VersionConflict):
        store.save_tables(league, root)
    assert store.save_tables(league, root, replace=True) == 3
    assert store.load_tables(spark, root).courses.count() == 2


def test_savers_at_one_moment(spark, league, tmp_path, monkeypatch):
    """Both see the same newest version; only one entry can be created."""
    root = str(tmp_path / "league")
    store.save_tables(league, root)
    first, second = store.load_tables(spark, root), store.load_tables(spark, root)
    seen = store.current_version
    monkeypatch.setattr(store, "current_version", lambda *_: 1)
    less = first.with_tables(scores=first.scores.where("event_id = 1"))
    assert store.save_tables(less, root) == 2
    with pytest.raises(store.VersionConflict):
        store.save_tables(second.with_tables(scores=second.scores.limit(0)), root)
    monkeypatch.setattr(store, "current_version", seen)
    assert store.current_version(spark, root) == 2 and store.load_tables(spark, root).scores.count() == 3
    assert len(list((tmp_path / "league").glob("version=2-*"))) == 1  # the other one's rows are gone
    assert not [p for p in (tmp_path / "league" / "versions").iterdir() if not p.name.startswith("00")]


def test_an_entry_is_created_once(spark, tmp_path, monkeypatch):
    for kind in ("file", "other"):
        folder = Folder(spark, str(tmp_path / kind))
        if kind == "other":  # the way of stores whose rename does not replace

            class Uri:
                def getScheme(self):
                    return "other"

            system = folder._system

            class System:
                def __getattr__(self, name):
                    return Uri if name == "getUri" else getattr(system, name)

            folder._system = System()
        assert [folder.create("log/1", text) for text in ("a", "b")] == [True, False]
        assert (tmp_path / kind / "log" / "1").read_text() == "a"
        assert sorted(p.name for p in (tmp_path / kind / "log").iterdir() if not p.name.endswith(".crc")) == ["1"]


def test_commit_applies_the_change_to_the_newer_version(spark, league, tmp_path):
    root = str(tmp_path / "league")
    store.save_tables(league, root)
    tried = []

    def add(name):
        new = spark.createDataFrame([(name, 71)], "name string, par int")
        return lambda t: changes.insert_rows(t, "courses", new).tables

    def disturbed(t):
        tried.append(t.base.version)
        if len(tried) == 1:
            store.commit(spark, root, add("Between"))
        return add("Mine")(t)

    assert store.commit(spark, root, disturbed) == 3 and tried == [1, 2]
    names = sorted(rows(store.load_tables(spark, root).courses, "id", "name"))
    assert names[2:] == [(3, "Between"), (4, "Mine")]

    def always(t):
        store.commit(spark, root, add(f"Again {len(tried)}"))
        tried.append(t.base.version)
        return add("Never")(t)

    with pytest.raises(store.VersionConflict):
        store.commit(spark, root, always, attempts=2)


def _files(folder, table: str) -> dict[str, set[str]]:
    """Names of the data files by slice."""
    return {
        p.name: {f.name for f in p.glob("part-*")} for p in folder.glob(f"version=*/{table}/slice=*")
    }


def test_a_change_writes_the_slices_it_touches(spark, league, tmp_path, monkeypatch):
    monkeypatch.setitem(schemas.SLICE_WIDTH, "scores", 1)  # an event each
    root = tmp_path / "league"
    store.save_tables(league, str(root))
    before = _files(root, "scores")
    assert sorted(before) == ["slice=1", "slice=2", "slice=3"]

    new = spark.createDataFrame([(22, 69, 2, None)], "id long, strokes int, placement int, notes string")
    saved = store.load_tables(spark, str(root))
    store.save_tables(changes.update_rows(saved, "scores", new, refresh=True).tables, str(root))
    (version,) = root.glob("version=2-*")
    assert [p.relative_to(version).as_posix() for p in version.glob("*/slice=*")] == ["scores/slice=2"]
    now = store.load_tables(spark, str(root))
    assert rows(now.scores.where("id = 22"), "strokes", "to_par") == [(69, -1)]
    assert now.scores.count() == 7
    # What is read is the old files and the new slice's.
    used = {f.split("/")[-1] for f in now.scores.inputFiles()}
    assert used == before["slice=1"] | before["slice=3"] | {p.name for p in version.glob("scores/*/part-*")}

    gone = changes.delete_rows(now, "events", spark.createDataFrame([(3,)], "id long"))
    store.save_tables(gone.tables, str(root))
    last = store.load_tables(spark, str(root))
    assert sorted(last.base.files["scores"]) == [1, 2] and last.scores.count() == 6
    assert sorted(rows(last.events, "id")) == [(1,), (2,), (4,)]
    assert not list(root.glob("version=3-*/scores/slice=*"))
    # Nothing changed: nothing is written, and all is there.
    assert store.save_tables(last, str(root)) == 4 and not list(root.glob("version=4-*"))
    assert store.load_tables(spark, str(root)).scores.count() == 6


def test_slices_after_many_changes_equal_whole_tables(spark, league, tmp_path, monkeypatch):
    monkeypatch.setitem(schemas.SLICE_WIDTH, "scores", 2)
    root = str(tmp_path / "league")
    store.save_tables(league, root)
    plain = league
    steps = [
        lambda t: changes.insert_rows(t, "scores", spark.createDataFrame(
            [(4, 4, 70), (2, 4, 71)], "event_id long, player1_id long, strokes int")).tables,
        lambda t: changes.delete_rows(t, "scores", t.scores.where("id IN (12, 31)")).tables,
        lambda t: changes.insert_rows(t, "events", spark.createDataFrame(
            [("Late", day(9), 1, 2026)], "name string, date date, course_id long, season int")).tables,
        lambda t: changes.delete_rows(t, "players", spark.createDataFrame([(2,)], "id long"),
                                      schemas.LENIENT_REFERENCES).tables,
        lambda t: t.with_tables(courses=t.courses.withColumn("par", F.lit(71))),
    ]
    for step in steps:
        plain = step(plain)
        store.commit(spark, root, step)
        now = store.load_tables(spark, root)
        for name, df in plain.as_dict().items():
            assert sorted(map(str, rows(df))) == sorted(map(str, rows(getattr(now, name)))), name


def test_headers_must_be_in_order(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text("raw_full,last_name,first_name\nAda Birch,Birch,Ada\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        files.read_name_map(spark, str(path)).collect()


def test_backups(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text(
        "id,name,date,course_id,is_team_event,notes,season,is_major,major_label,finalized\n"
        "7,Pairs,2025-04-12,3,t,,2025,f,,t\n"
    )
    (event,) = files.read_backup(spark, "events", str(path)).collect()
    assert (event.id, event.date, event.is_team_event, event.is_major, event.finalized) == (
        7, day(12), True, False, True,
    )
    assert event.notes is None


def test_compressed_sheets_and_documents(spark, league, tmp_path):
    names = league.players.select(
        F.concat_ws(" ", "first_name", "last_name").alias("raw_full"), "first_name", "last_name"
    )
    files.write_csv(names, str(tmp_path / "names"), compression="gzip")
    assert all(f.endswith(".csv.gz") for f in spark.read.text(str(tmp_path / "names")).inputFiles())
    assert sorted(rows(files.read_name_map(spark, str(tmp_path / "names")))) == sorted(rows(names))
    files.write_documents(league.events, str(tmp_path / "events"), compression="gzip")
    assert all(f.endswith(".json.gz") for f in spark.read.text(str(tmp_path / "events")).inputFiles())
    read = files.read_documents(spark, str(tmp_path / "events"), league.events.schema)
    assert sorted(map(str, rows(read))) == sorted(map(str, rows(league.events)))


def test_documents(league, tmp_path):
    page = homepage.homepage(league, day(3), 10)
    text = json.loads(files.as_json(page).first().value)
    assert [e["id"] for e in text["upcomingEvents"]] == [3, 4]
    assert text["latestEvents"][0]["podium"][0] == {
        "placement": 2, "strokes": 70, "toPar": None, "playerIds": [2], "teamName": "B. Cole",
    }
    path = tmp_path / "page"
    files.write_documents(page, str(path))
    (line,) = [p.read_text() for p in path.glob("part-*") if p.stat().st_size]
    assert json.loads(line) == text


def test_rows_of_a_sheet_that_cannot_be_loaded(spark, tmp_path):
    header = ",".join(schemas.SHEET.names)
    good = "2025,2025-04-12,Pairs,Links,Town,MN,72,True,False,,True,Ada Birch,,,,68.0,1,"
    path = tmp_path / "results.csv"
    lines = [
        good, good.replace("68.0", "67"), good.replace(",68.0,1,", ",,,DQ"),
        good.replace("68.0", "sixty"), good.replace("2025-04-12", "12.4.2025"), good.replace("72,True", "72,maybe"),
        good.replace("2025,2025-04-12,Pairs", ",2025-04-12,"), good + ",more", "2025,2025-04-12",
        good.replace("Links", "").replace("2025,2025-04-12,Pairs", ",,"),
    ]
    path.write_text("\n".join([header, *lines]) + "\n")
    accepted, rejects = files.read_results_checked(spark, str(path))
    assert accepted.schema == schemas.SHEET
    assert sorted(map(str, rows(accepted, "season", "strokes", "placement", "notes", "finalized"))) == sorted(map(str, [
        (2025, D("68.00"), 1, None, True), (2025, D("67.00"), 1, None, True), (2025, None, None, "DQ", True),
        (None, D("68.00"), 1, None, True),
    ]))
    assert sorted(rows(rejects, "reasons")) == sorted([
        (["strokes: not decimal(5,2)"],), (["event_date: not date", "event_date: missing"][:1],),
        (["is_team_event: not boolean"],), (["event_name: missing", "season: missing"],),
        (["wrong number of fields"],), (["wrong number of fields"],),
    ])
    assert [r.line for r in rejects.where("line is not null").orderBy("line").collect()] == ["2025,2025-04-12", good + ",more"]
    assert rows(rejects.where("strokes = 'sixty'"), "event_name", "season") == [("Pairs", "2025")]
    whole = tmp_path / "whole.csv"
    whole.write_text(header + "\n" + good + "\n")
    strict = files.read_results(spark, str(whole))
    assert rows(strict) == rows(files.read_results_checked(spark, str(whole))[0])
    assert files.read_results_checked(spark, str(whole))[1].isEmpty()
