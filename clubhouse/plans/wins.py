"""Career wins: first places in finalized events, shared between tied teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clubhouse.functions.labels import two_decimal_label
from clubhouse.functions.names import in_order_of, joined_name
from clubhouse.functions.scoring import is_win, two_decimals
from clubhouse.operators.joins import lookup
from clubhouse.operators.slots import members
from clubhouse.schemas import SLOT_IDS
from clubhouse.tables import Tables


def win_shares(tables: Tables) -> DataFrame:
    """One row per event: what a first place is worth there.

    ``share`` is 1 divided by the number of winning teams, as a decimal so that
    three thirds make one; NULL where the event is not finalized or has no
    winner.
    """
    winners = (
        tables.scores.where(is_win())
        .groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("winners"))
    )
    events = tables.events.select(F.col("id").alias("event_id"), "name", "is_major", "finalized")
    return events.join(winners, "event_id", "left").select(
        "event_id",
        F.col("name").alias("event_name"),
        "finalized",
        "is_major",
        F.when(F.col("finalized"), F.lit(1).cast("decimal(2,1)") / F.col("winners")).alias("share"),
    )


def _entries(tables: Tables, shares: DataFrame, how: str) -> DataFrame:
    teams = tables.scores.select("event_id", *SLOT_IDS, is_win().alias("won"))
    valued = lookup(
        teams,
        shares,
        ["event_id"],
        how,
        small=tables.is_small("events"),
        keys_from=tables.scores.select("event_id"),
    )
    return members(valued)


def _totals() -> list[Column]:
    won = F.when(F.col("won"), F.col("share"))
    return [
        F.sum(won).alias("career_wins"),
        F.countDistinct(F.when(F.col("finalized"), F.col("event_id"))).alias("events_played"),
        F.sum(F.when(F.col("is_major"), won)).alias("major_wins"),
    ]


def with_players(tables: Tables, totals: DataFrame, *extra: str) -> DataFrame:
    zero = F.lit(0)
    return (
        tables.players.select(
            F.col("id").alias("player_id"), joined_name("first_name", "last_name").alias("name")
        )
        .join(totals, "player_id", "left")
        .select(
            "player_id",
            "name",
            *extra,
            two_decimals(F.coalesce("career_wins", zero)).alias("career_wins"),
            F.coalesce("events_played", zero).alias("events_played"),
            two_decimals(F.coalesce("major_wins", zero)).alias("major_wins"),
        )
    )


def career_wins(tables: Tables) -> DataFrame:
    """Wins, events and major wins of every player, zeros included.

    Each member of a winning team gets the team's whole share. Disqualified
    entries count as events played. Only finalized events matter, so the
    others are left out before the join.
    """
    shares = win_shares(tables).where("finalized").drop("event_name")
    entries = _entries(tables, shares, "inner")
    return with_players(tables, entries.groupBy("player_id").agg(*_totals()))


def wins_by_event_name(tables: Tables) -> DataFrame:
    """The same figures per player and event name.

    Unfinalized events appear with zeros, players without scores with a NULL
    event name.
    """
    entries = _entries(tables, win_shares(tables), "left")
    return with_players(
        tables, entries.groupBy("player_id", "event_name").agg(*_totals()), "event_name"
    )


def _best_first(df: DataFrame, *ties: str, collation: str | None = None) -> DataFrame:
    return df.orderBy(
        F.desc_nulls_first("career_wins"),
        F.desc_nulls_first("events_played"),
        in_order_of("name", collation),
        *[F.asc_nulls_last(t) for t in ties],
    )


def top_players(tables: Tables, n: int = 10, collation: str | None = None) -> DataFrame:
    """The n players with the most career wins; equal ones by name, in the order
    of bytes or of a collation."""
    return _best_first(career_wins(tables), "player_id", collation=collation).limit(n)


def top_by_event_name(tables: Tables, n: int = 10) -> DataFrame:
    return _best_first(wins_by_event_name(tables), "player_id", "event_name").limit(n)


def ranked_top_players(tables: Tables, n: int = 10) -> DataFrame:
    """The top players with their place in the list and wins as two-decimal text."""
    # The window sees the n rows of the list only.
    place = Window.orderBy(
        F.desc("career_wins"), F.desc("events_played"), F.asc_nulls_last("name"), "player_id"
    )
    return top_players(tables, n).select(
        F.row_number().over(place).alias("rank"),
        "player_id",
        "name",
        two_decimal_label("career_wins").alias("wins"),
        two_decimal_label("major_wins").alias("majors"),
        F.col("events_played").alias("events"),
    )
