"""The four tables as Parquet: versions, saved one after the other.

A version is an entry in the ``versions`` folder that names, for every slice of
every table, the folder with its rows. It is created whole and never replaced, so
all tables change together, and of two savers who start from one version only
one creates the next. The other learns of it, and ``commit`` applies its
change to the newer version instead.

A slice is a season of the events or a range of event ids of the scores. A
version writes the slices that its changes touch and shares all others with the
version it comes from.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clubhouse import schemas
from clubhouse.operators.quality import check_table
from clubhouse.plans import upkeep
from clubhouse.session import written
from clubhouse.sources.folders import Folder
from clubhouse.tables import Base, Tables, conform, empty_tables

_LOG = "version bigint, slices map<string,map<string,string>>"
# How the rows of a slice are laid out. Range partitioning splits a crowded event or
# season between files, and row group statistics then serve filters on it.
CLUSTERED_BY = {"events": ["id"], "scores": ["event_id", "id"], "player_events": ["event_id", "player_id"]}
# Scores are clustered by event; these filters tell which row groups hold a player.
# (Where nobody at all fills a slot there is none for it, and no row group is skipped.)
_PLAYER_FILTERS = {
    "parquet.bloom.filter.adaptive.enabled": "true",
    **{f"parquet.bloom.filter.enabled#{slot}": "true" for slot in schemas.SLOT_IDS},
}
WRITER_OPTIONS = {"scores": _PLAYER_FILTERS}
# Up to this many touched slices are told to the scan as ranges of values.
_RANGES = 64
# The slice of a missing value.
_NO_VALUE = -1


class VersionConflict(RuntimeError):
    """The tables come from a version that is no longer the newest one."""


def _entry(spark: SparkSession, root: str, version: int | None = None):
    """A version's entry, by default the newest; None if there is none."""
    try:
        log = spark.read.schema(_LOG).json(f"{root}/versions")
        if version is None:
            version = log.agg(F.max("version")).first()[0]
        return log.where(F.col("version") == version).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_version(spark: SparkSession, root: str) -> int:
    """The newest visible version, 0 if there is none."""
    entry = _entry(spark, root)
    return entry.version if entry else 0


def _slice(name: str) -> Column:
    by = schemas.SLICED_BY.get(name)
    if by is None:
        return F.lit(0).cast("long")
    number = F.floor(F.col(by) / schemas.SLICE_WIDTH[name]).cast("long")
    return F.coalesce(number, F.lit(_NO_VALUE))


def _within(name: str, slices: list[int]) -> Column:
    """Rows of some slices, also as ranges, which Parquet's statistics can serve."""
    chosen = _slice(name).isin(slices)
    if not slices or _NO_VALUE in slices or len(slices) > _RANGES:
        return chosen
    by, width = F.col(schemas.SLICED_BY[name]), schemas.SLICE_WIDTH[name]
    ranges = [(by >= k * width) & (by < (k + 1) * width) for k in slices]
    return chosen & reduce(or_, ranges)


def _touched(tables: Tables, name: str) -> list[int] | None:
    """The slices of a table that may differ from its base; None: all of them."""
    if tables.base is None:
        return None
    if getattr(tables, name) is tables.base.read[name]:
        return []
    if name not in tables.touched:
        return None
    changed = reduce(DataFrame.union, tables.touched[name]).select(_slice(name).alias("slice"))
    return [row.slice for row in changed.distinct().collect()]


def _write(tables: Tables, name: str, folder: Folder, place: str) -> dict[int, str]:
    """Write the slices of a table that changed; returns the folders of all."""
    rows, slices = conform(getattr(tables, name), name), _touched(tables, name)
    if slices is None:
        return _write_slices(rows, name, folder, place)
    kept = {k: v for k, v in tables.base.files[name].items() if k not in slices}
    if not slices:
        return kept
    rows = rows.where(_within(name, slices)) if name in schemas.SLICED_BY else rows
    return kept | _write_slices(rows, name, folder, place)


def _write_player_events(tables: Tables, folder: Folder, place: str) -> dict[int, str]:
    """Write what players did in the events that changed; returns the folders of all."""
    name = "player_events"
    events = upkeep.changed_events(tables)
    if events is None or name not in tables.base.files:
        return _write_slices(upkeep.player_events(tables), name, folder, place)
    events = written(events)
    files = tables.base.files[name]
    slices = [row.slice for row in events.select(_slice(name).alias("slice")).distinct().collect()]
    kept = {k: v for k, v in files.items() if k not in slices}
    if not slices:
        return kept
    near = tables.with_tables(scores=tables.scores.where(_within("scores", slices)))
    rows = upkeep.player_events(near, events)
    if before := [f"{folder.path}/{files[k]}" for k in slices if k in files]:
        rows = upkeep.refreshed(tables.spark.read.parquet(*before).select(*rows.columns), near, events)
    return kept | _write_slices(rows, name, folder, place)


def _write_slices(rows: DataFrame, name: str, folder: Folder, place: str) -> dict[int, str]:
    rows = rows.withColumn("slice", _slice(name))
    order = ["slice", *CLUSTERED_BY.get(name, ["id"])]
    if name in schemas.SLICED_BY:
        rows = rows.repartitionByRange(*order)
    writer = rows.sortWithinPartitions(*order).write.partitionBy("slice").options(**WRITER_OPTIONS.get(name, {}))
    writer.parquet(f"{folder.path}/{place}/{name}")
    new = folder.children(f"{place}/{name}")
    return {int(x.removeprefix("slice=")): f"{place}/{name}/{x}" for x in new if x.startswith("slice=")}


def save_tables(tables: Tables, root: str, replace: bool = False, player_events: bool = False) -> int:
    """Save tables as the version after the one they were read from.

    Raises VersionConflict if there is a newer one by now: the change has to be
    applied to that. Tables that were not read from here can only be the first
    version, unless ``replace`` says that they replace whatever there is.
    With ``player_events`` the version has those too, see ``plans.upkeep``: of
    events that did not change they are those of the version before.
    """
    spark = tables.spark
    folder = Folder(spark, root)
    newest = current_version(spark, folder.path)
    here = tables.base is not None and tables.base.root == folder.path
    if not here:
        tables = tables.with_base(None)
    base = newest if replace else tables.base.version if here else 0

    def conflict() -> VersionConflict:
        now = current_version(spark, folder.path)
        return VersionConflict(f"read from version {base}, but version {now} has been saved since")

    if newest != base:
        raise conflict()
    version = base + 1
    place = f"version={version}-{uuid.uuid4().hex}"
    slices = {name: _write(tables, name, folder, place) for name in schemas.TABLES}
    if player_events:
        slices["player_events"] = _write_player_events(tables, folder, place)
    entry = json.dumps({"version": version, "slices": slices})
    if not folder.create(f"versions/{version:010d}.json", entry):
        folder.delete(place)
        raise conflict()
    return version


def load_tables(spark: SparkSession, root: str, version: int | None = None) -> Tables:
    """Read a version, by default the newest visible one."""
    folder = Folder(spark, root)
    entry = _entry(spark, folder.path, version)
    if entry is None:
        raise FileNotFoundError(f"no such saved tables under {root}")

    def read(name: str) -> DataFrame:
        paths = [f"{folder.path}/{place}" for place in entry.slices[name].values()]
        if not paths:
            return spark.createDataFrame([], schemas.TABLES[name])
        return conform(spark.read.schema(schemas.TABLES[name]).parquet(*paths), name)

    frames = {name: read(name) for name in schemas.TABLES}
    files = {name: {int(k): v for k, v in places.items()} for name, places in entry.slices.items()}
    return Tables(**frames, base=Base(folder.path, entry.version, frames, files))


def load_player_events(tables: Tables) -> DataFrame:
    """What players did in events, as saved with the version the tables were read from."""
    if tables.base is None or "player_events" not in tables.base.files:
        raise FileNotFoundError("no player events were saved with these tables")
    places = tables.base.files["player_events"].values()
    if not places:
        return upkeep.player_events(tables).limit(0)
    return tables.spark.read.parquet(*[f"{tables.base.root}/{place}" for place in places])


def commit(
    spark: SparkSession,
    root: str,
    change: Callable[[Tables], Tables],
    attempts: int = 5,
    player_events: bool = False,
) -> int:
    """Apply a change to the newest version and save it as the next one.

    If somebody else saves first, the change is applied anew, to their version;
    after some attempts the conflict is raised.
    """
    for left in reversed(range(attempts)):
        tables = change(load_tables(spark, root))
        try:
            return save_tables(tables, root, player_events=player_events)
        except VersionConflict:
            if not left:
                raise
    raise ValueError("at least one attempt is needed")


# Invented demonstration rows: a club's autumn, with a shared first place, a
# disqualified team, teams of one, two and four, and an event still to come.
SEED_PLAYERS = [
    ("Ines", "Quill", "Mulligan", 2008),
    ("Jonah", "Reed", None, 2011),
    ("Katja", "Stone", None, 2011),
    ("Leo", "Thorn", "Birdie", 2014),
    ("Mira", "Umber", None, 2016),
    ("Nils", "Vale", None, None),
    ("Oona", "Weld", "Ace", 2017),
]
SEED_COURSES = [
    ("Harbour Links", "Port Wend", None, 70),
    ("Pine Ridge", "Upper Marl", "WI", 71),
]
SEED_EVENTS = [
    ("Harvest Cup", dt.date(2018, 9, 2), 2, 2018, True, "Club Championship", True),
    ("Fog Bowl", dt.date(2018, 10, 21), 1, 2018, False, None, True),
    ("First Frost", dt.date(2018, 11, 25), 2, 2018, False, None, False),
]
SEED_SCORES = [
    (1, 1, 2, None, None, 64, 1, False, None),
    (1, 3, 4, None, None, 64, 1, False, "level after extra holes"),
    (1, 5, None, None, None, 69, 3, False, None),
    (1, 6, 7, None, None, None, 4, True, "card not handed in"),
    (2, 1, 3, 5, 7, 61, 1, False, None),
    (2, 2, 4, 6, None, 66, 2, False, None),
]


def seed(spark: SparkSession, root: str | None = None) -> Tables:
    """Start over with the demonstration rows, numbered from 1.

    With ``root`` the rows become the newest saved version.
    """
    rows = {
        "players": (
            SEED_PLAYERS,
            "first_name string, last_name string, nickname string, debut_year int",
        ),
        "courses": (SEED_COURSES, "name string, city string, state string, par int"),
        "events": (
            SEED_EVENTS,
            "name string, date date, course_id bigint, season int, is_major boolean,"
            " major_label string, finalized boolean",
        ),
        "scores": (
            SEED_SCORES,
            "event_id bigint, player1_id bigint, player2_id bigint, player3_id bigint,"
            " player4_id bigint, strokes int, placement int, disqualified boolean, notes string",
        ),
    }
    tables = empty_tables(spark)
    for name, (values, columns) in rows.items():
        # Ids follow the order of the columns, events refer to them: keep it.
        numbered = spark.createDataFrame([(i, *v) for i, v in enumerate(values, 1)], f"id bigint, {columns}")
        defaults = {c: F.lit(x) for c, x in schemas.DEFAULTS[name].items() if c not in numbered.columns}
        filled = conform(numbered.withColumns(defaults) if defaults else numbered, name)
        tables = tables.with_tables(**{name: filled})
        check_table(filled, name)
    if root is not None:
        save_tables(tables, root, replace=True)
    return tables
