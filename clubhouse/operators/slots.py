"""Team rows have four player slots; these operators turn slots into rows and back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubhouse.functions import names
from clubhouse.operators.joins import HOT_SHARE, hot_key_hashes, lookup
from clubhouse.schemas import SLOT_IDS, SLOT_NAMES
from clubhouse.tables import Tables

NAME_STYLES: dict[str, Callable[..., Column]] = {
    "full": names.full_name,
    "strict": names.strict_full_name,
    "compact": names.compact_name,
}


def members(scores: DataFrame, distinct: bool = False) -> DataFrame:
    """One row per score and filled slot, with ``player_id`` in place of the slots.

    A player who fills two slots of a row counts twice unless ``distinct``.
    """
    kept = [c for c in scores.columns if c not in SLOT_IDS]
    return explode_slots(scores, SLOT_IDS, "player_id", distinct).select(*kept, "player_id")


def explode_slots(
    df: DataFrame, slots: list[str], output: str, distinct: bool = False
) -> DataFrame:
    """One row per filled slot, all columns kept. With ``distinct`` a slot that
    repeats an earlier one of its row counts as empty."""
    values = [F.col(slot) for slot in slots]
    if distinct:
        for i in range(1, len(slots)):
            repeats = reduce(or_, [F.col(slots[i]).eqNullSafe(F.col(s)) for s in slots[:i]])
            values[i] = F.when(~repeats, values[i])
    # Filtering after the explode stays in generated code; array functions that
    # drop NULLs beforehand do not.
    exploded = df.select("*", F.explode(F.array(*values)).alias(output))
    return exploded.where(F.col(output).isNotNull())


def fill_slots(
    df: DataFrame,
    dim: DataFrame,
    slots: list[str],
    outputs: list[str],
    small: bool,
    keys_from: DataFrame | None = None,
    keep: bool = True,
) -> DataFrame:
    """Look up every slot column in ``dim`` (its columns: key, value).

    With a small ``dim`` that is one broadcast join per slot, otherwise one
    shuffled lookup per slot, all with the frequent keys of one sketch over
    all slots. Rows with an empty slot travel spread out. ``keys_from`` is a cheaper frame
    with the slots to take frequent keys from. Without ``keep`` a slot that was looked
    up is left out, so that it does not travel on to the next lookup.
    """
    key, value = dim.columns
    hot = None
    if not small:
        keys = df if keys_from is None else keys_from
        hot = hot_key_hashes(explode_slots(keys.select(*slots), slots, "__key_of_slot"), ["__key_of_slot"])
    for slot, output in zip(slots, outputs):
        side = dim.select(F.col(key).alias(slot), F.col(value).alias(output))
        df = lookup(df, side, [slot], small=small, hot=hot)
        df = df if keep else df.drop(slot)
    return df


def fill_slots_at_once(
    df: DataFrame,
    dim: DataFrame,
    slots: list[str],
    outputs: list[str],
    asked: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """``fill_slots`` for a large ``dim``: rows move once instead of once per slot.

    Only keys travel to ``dim``, each with the hash of its team. What was found
    comes back as one map per hash, and a row takes its own keys out of that, so
    teams of one hash do not disturb each other. A team with very many rows has
    several hashes. A ``dim`` with a key twice is looked up slot by slot.

    ``asked`` is a cheaper frame to take the keys from: it has a row for every
    row of ``df``, alike in all columns that both have.

    ``facts`` is another large table, looked up on the same way by its first
    column, which ``df`` has as well: rows without an entry drop out, and the
    other columns of ``facts`` come before the outputs.
    """
    key, value = dim.columns
    asked = df if asked is None else asked
    dim = dim.where(F.col(key).isNotNull())
    on, others = ([], []) if facts is None else (facts.columns[:1], facts.columns[1:])
    if facts is not None and _repeats(facts, on[0]):
        df, facts, others = lookup(df, facts, on, "inner", keys_from=asked.select(*on)), None, []
    if _repeats(dim, key):
        if facts is not None:
            df = lookup(df, facts, on, "inner", keys_from=asked.select(*on))
        return fill_slots(df, dim, slots, outputs, small=False, keys_from=asked)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alike = [c for c in asked.columns if c in df.columns]
    part = F.pmod(F.xxhash64(*alike), F.lit(HOT_SHARE * partitions))
    team = F.hash(*slots, *on, part).alias("__team")
    keys = explode_slots(asked.select(team, *slots), slots, key).select("__team", key)
    found = lookup(keys, dim, [key], "inner", keys_from=keys.select(key))
    entries = {"__entry": F.when(F.col(key).isNotNull(), F.struct(key, value))}
    if facts is not None:
        # Both travel flat, and a row has one of them: structs would take more room.
        about = lookup(asked.select(team, *on), facts, on, "inner", keys_from=asked.select(*on))
        found = found.unionByName(about, allowMissingColumns=True)
        entries["__fact"] = F.when(F.col(on[0]).isNotNull(), F.struct(*on, F.struct(*others).alias("row")))
    maps = [F.map_from_entries(F.collect_set(e)).alias(c) for c, e in entries.items()]
    maps = found.repartition("__team").groupBy("__team").agg(*maps)
    joined = df.select("*", team).join(maps, "__team", "left")
    if facts is not None:
        joined = joined.withColumn("__fact", F.try_element_at("__fact", F.col(on[0]))).where("__fact IS NOT NULL")
    return joined.select(
        *df.columns,
        *[F.col("__fact").getField(c).alias(c) for c in others],
        *[F.try_element_at("__entry", F.col(s)).alias(o) for s, o in zip(slots, outputs)],
    )


def _repeats(dim: DataFrame, key: str) -> bool:
    """True if a key occurs twice; rows without one do not count."""
    return not dim.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()


def add_player_names(
    df: DataFrame,
    tables: Tables,
    style: str = "full",
    asked: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Add ``player1_name`` .. ``player4_name`` to rows with the four id columns.

    "full" gives '' for an empty slot, the other styles NULL. ``asked`` is a
    cheaper frame to take the ids from, ``facts`` a large table to look up on
    the same way, see ``fill_slots_at_once``.
    """
    label = NAME_STYLES[style]("first_name", "last_name")
    labels = tables.players.select(F.col("id").alias("__player"), label.alias("__label"))
    if facts is None and tables.has_short("players", "first_name", "last_name"):
        named = fill_slots(df, labels, SLOT_IDS, SLOT_NAMES, small=True)
    else:
        named = fill_slots_at_once(df, labels, SLOT_IDS, SLOT_NAMES, asked, facts)
    if style != "full":
        return named
    return named.withColumns({n: F.coalesce(n, F.lit("")) for n in SLOT_NAMES})


def add_facts_and_names(
    scores: DataFrame, tables: Tables, facts: DataFrame, style: str = "full", keys_from: DataFrame | None = None
) -> DataFrame:
    """Add the facts of their event, which are keyed by ``event_id``, and names to
    scores; scores without an event drop out. Where both tables are large, rows
    move once for both.

    ``keys_from`` is a cheaper frame with the events of the scores.
    """
    if not tables.is_small("events") and not tables.has_short("players", "first_name", "last_name"):
        return add_player_names(scores, tables, style, facts=facts)
    found = lookup(scores, facts, ["event_id"], "inner", small=tables.is_small("events"), keys_from=keys_from)
    return add_player_names(found, tables, style, asked=scores)


def add_names_to_few(df: DataFrame, tables: Tables, style: str = "full") -> DataFrame:
    """As ``add_player_names`` for a frame that a LIMIT keeps to a few rows.

    The ids of those rows pick their players out of the table; the picked
    labels, at most four per row, come back as one map value.
    """
    label = NAME_STYLES[style]("first_name", "last_name")
    wanted = explode_slots(df.select(*SLOT_IDS), SLOT_IDS, "id").select("id").distinct()
    labels = (
        tables.players.join(F.broadcast(wanted), "id", "left_semi")
        .agg(F.map_from_entries(F.collect_list(F.struct("id", label.alias("label")))).alias("m"))
        .scalar()
    )
    found = [F.try_element_at(labels, F.col(slot)) for slot in SLOT_IDS]
    if style == "full":
        found = [F.coalesce(name, F.lit("")) for name in found]
    return df.select("*", *[c.alias(out) for c, out in zip(found, SLOT_NAMES)])


def hydrate_names(
    df: DataFrame, tables: Tables, key: list[str], ids: str = "player_ids"
) -> DataFrame:
    """Add ``names``, "F. Last / G. Other", to rows with an array of player ids.

    An id without a player reads "Player #id". ``key`` identifies a row.
    """
    label = names.compact_name("first_name", "last_name")
    others = [c for c in df.columns if c not in (*key, ids)]
    placed = df.select(*key, *others, F.posexplode_outer(ids).alias("__pos", "__player"))
    found = lookup(
        placed,
        tables.players.select(F.col("id").alias("__player"), label.alias("__label")),
        ["__player"],
        small=tables.has_short("players", "first_name", "last_name"),
    )
    number = F.concat(F.lit("Player #"), F.col("__player").cast("string"))
    entry = F.struct("__pos", "__player", F.coalesce("__label", number).alias("__label"))
    # A list holds the entries of one row's array, so it is never longer than that.
    entries = F.sort_array(F.collect_list(F.when(F.col("__pos").isNotNull(), entry)))
    return (
        found.groupBy(*key)
        .agg(entries.alias("__entries"), *[F.any_value(c).alias(c) for c in others])
        .withColumns(
            {
                ids: F.col("__entries").getField("__player"),
                "names": F.array_join(
                    F.col("__entries").getField("__label"), names.TEAM_SEPARATOR
                ),
            }
        )
        .select(*df.columns, "names")
    )
