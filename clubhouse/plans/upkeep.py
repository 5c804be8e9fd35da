"""Reports from what every player did in every event, kept up to date.

``player_events`` has one row per player and event, with sums and counts that
add up to career wins and statistics. A change set makes the rows of some
events wrong, and of no others: those are dropped and computed anew from the
scores of these events. The reports then add rows up; they join no scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubhouse.functions.scoring import is_win, to_par
from clubhouse.operators.joins import lookup
from clubhouse.plans.events import event_facts
from clubhouse.plans.players import stats_of
from clubhouse.plans.wins import win_shares, with_players
from clubhouse.schemas import SLOT_IDS
from clubhouse.tables import Tables


def _of_events(df: DataFrame, column: str, events: DataFrame | None, few: bool) -> DataFrame:
    """The rows of some events, all if none are given."""
    if events is None:
        return df
    wanted = events.select(F.col("event_id").alias(column))
    return df.join(F.broadcast(wanted) if few else wanted, column, "left_semi")


def _members(scores: DataFrame) -> DataFrame:
    """A row per filled slot; ``again`` marks a player who was in an earlier slot."""
    entries = []
    for i, slot in enumerate(SLOT_IDS):
        earlier = [F.col(slot) == F.col(s) for s in SLOT_IDS[:i]]
        again = F.coalesce(reduce(Column.__or__, earlier), F.lit(False)) if earlier else F.lit(False)
        entries.append(F.struct(F.col(slot).alias("player_id"), again.alias("again")))
    # An unknown comparison (an empty slot) is no repetition, but hides one after it.
    kept = [c for c in scores.columns if c not in SLOT_IDS]
    return scores.select(*kept, F.explode(F.array(*entries)).alias("m")).select(*kept, "m.*").where(
        F.col("player_id").isNotNull()
    )


def player_events(tables: Tables, events: DataFrame | None = None) -> DataFrame:
    """What every player did in every event, or in some: frame of ``event_id``."""
    few = events is not None and events.count() <= tables.broadcast_rows
    mine = tables.with_tables(
        events=_of_events(tables.events, "id", events, few), scores=_of_events(tables.scores, "event_id", events, few)
    )
    small = few or tables.is_small("events")
    facts = event_facts(mine).select("event_id", "event_name", "date", "season", "course_par")
    shares = win_shares(mine).select("event_id", "finalized", "is_major", "share")
    about = facts.join(shares, "event_id")
    scores = mine.scores.select(
        "event_id", *SLOT_IDS, "strokes", "to_par", "placement", is_win().alias("won_shared")
    )
    found = lookup(scores, about, ["event_id"], "inner", small=small, keys_from=scores.select("event_id"))
    rows = _members(found.withColumn("relative", to_par("to_par", "strokes", "course_par")))
    once = ~F.col("again")

    def of(column: str) -> Column:
        return F.when(once, F.col(column))

    return rows.groupBy("event_id", "player_id").agg(
        *[F.any_value(c).alias(c) for c in ("event_name", "date", "season", "finalized", "is_major")],
        F.count_if(once & (F.col("placement") == 1)).alias("won"),
        F.count_if(once & (F.col("placement") <= 3)).alias("podiums"),
        F.min("placement").alias("best"),
        F.sum(of("strokes")).alias("strokes"),
        F.count(of("strokes")).alias("n_strokes"),
        F.sum(of("relative")).alias("relative"),
        F.count(of("relative")).alias("n_relative"),
        F.sum(F.when(F.col("won_shared"), F.col("share"))).alias("shares"),
    )


def changed_events(tables: Tables) -> DataFrame | None:
    """Events whose rows may differ from the version the tables come from, as
    ``event_id``; None if that is not known."""
    if tables.base is None:
        return None
    found = []
    for name, df in tables.as_dict().items():
        if name == "players" or df is tables.base.read[name]:
            continue
        if name not in tables.touched:
            return None
        for rows in tables.touched[name]:
            if name == "courses":
                ids = rows.select(F.col("id").alias("course_id"))
                for events in (tables.events, tables.base.read["events"]):
                    found.append(events.join(ids, "course_id", "left_semi").select(F.col("id").alias("event_id")))
            else:
                found.append(rows.select(F.col("id" if name == "events" else "event_id").alias("event_id")))
    if not found:
        return tables.spark.createDataFrame([], "event_id bigint")
    return reduce(DataFrame.union, found).distinct()


def refreshed(kept: DataFrame, tables: Tables, events: DataFrame) -> DataFrame:
    """Rows of an earlier state, those of some events computed anew."""
    return kept.join(events, "event_id", "left_anti").unionByName(player_events(tables, events))


def career_wins(tables: Tables, rows: DataFrame) -> DataFrame:
    """``wins.career_wins`` from the rows of ``player_events``."""
    totals = rows.where("finalized").groupBy("player_id").agg(
        F.sum("shares").alias("career_wins"),
        F.count(F.lit(1)).alias("events_played"),
        F.sum(F.when(F.col("is_major"), F.col("shares"))).alias("major_wins"),
    )
    return with_players(tables, totals)


def wins_by_event_name(tables: Tables, rows: DataFrame) -> DataFrame:
    """``wins.wins_by_event_name`` from the rows of ``player_events``."""
    totals = rows.groupBy("player_id", "event_name").agg(
        F.sum("shares").alias("career_wins"),
        F.count_if("finalized").alias("events_played"),
        F.sum(F.when(F.col("is_major"), F.col("shares"))).alias("major_wins"),
    )
    return with_players(tables, totals, "event_name")


def player_stats(tables: Tables, rows: DataFrame) -> DataFrame:
    """``players.player_stats`` from the rows of ``player_events``."""
    return stats_of(tables, rows)
