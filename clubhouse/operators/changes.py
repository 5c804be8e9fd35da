"""Change sets: frames of new, changed or deleted rows applied to a table.

Each function returns a ``Change``: the table afterwards, the rows touched (as
they are now, or as they were for a deletion) and the ids asked for but not
found.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubhouse import schemas
from clubhouse.operators.ids import with_new_ids
from clubhouse.operators.load import refresh_to_par
from clubhouse.operators.quality import (
    check_changed_rows,
    delete_with_rules,
    duplicate_ids,
    refuse,
)
from clubhouse.session import written
from clubhouse.tables import Tables, conform

# What an update may set.
UPDATABLE = {
    "players": [c for c in schemas.PLAYERS.names if c != "id"],
    "courses": [c for c in schemas.COURSES.names if c != "id"],
    "scores": ["strokes", "placement", "notes"],
}
# An update of up to this many rows is broadcast to the table. Beyond that the table
# moves by id once and is written down.
FEW_CHANGES = 10_000


@dataclass(frozen=True)
class Change:
    tables: Tables
    affected: DataFrame
    not_found: DataFrame | None = None
    # Rows of other tables that a deletion changed, as they were.
    also: dict[str, DataFrame] = field(default_factory=dict)


def insert_rows(tables: Tables, table: str, rows: DataFrame) -> Change:
    """Add rows under new ids, after checking keys, references and required values.

    A column that ``rows`` lacks altogether takes its default. A NULL in a
    column it has stays NULL and fails where a value is required.
    """
    defaults = {
        c: F.lit(value) for c, value in schemas.DEFAULTS[table].items() if c not in rows.columns
    }
    filled = conform(rows.withColumns(defaults) if defaults else rows, table)
    current = getattr(tables, table)
    # Rows that differ in nothing sort next to each other in any order.
    order = [c for c in filled.columns if c != "id"]
    added = conform(with_new_ids(filled, current, order), table)
    after = tables.with_rows_changed(table, conform(current, table).unionByName(added), added)
    check_changed_rows(after, table, added, added.columns)
    return Change(after, added)


def not_found(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids asked for that the table does not have."""
    return ids.select("id").distinct().join(table.select("id"), "id", "left_anti")


def update_rows(
    tables: Tables, table: str, changes: DataFrame, refresh: bool = False
) -> Change:
    """Overwrite the updatable columns of the rows named by ``id``, NULLs included.

    A changed stroke count leaves a score's stored to-par as it is, which the
    reports prefer; ``refresh`` recomputes it, for the changed rows only.
    """
    if table not in UPDATABLE:
        raise ValueError(f"{table} rows cannot be updated")
    refuse(duplicate_ids(changes), f"{table}: an id is changed twice")
    columns = UPDATABLE[table]
    current = conform(getattr(tables, table), table)
    new = conform(changes, table).select("id", F.struct(*columns).alias("__new"))
    few = new.count() <= min(FEW_CHANGES, tables.broadcast_rows)
    told = current.join(F.broadcast(new) if few else new, "id", "left")
    if not few:
        # Several steps look at the rows, each at other ones.
        told = written(told)
    is_changed = F.col("__new").isNotNull()
    stays, changes_now = told.where(~is_changed).drop("__new"), told.where(is_changed)
    before = changes_now.drop("__new")
    affected = changes_now.select(
        *[F.col(f"__new.{c}").alias(c) if c in columns else c for c in current.columns]
    )
    if refresh and table == "scores":
        affected = refresh_to_par(tables.with_tables(scores=affected))
    after = tables.with_rows_changed(table, stays.unionByName(affected), before)
    check_changed_rows(after, table, affected, columns)
    return Change(after, affected, not_found(current, changes))


def delete_rows(
    tables: Tables, table: str, ids: DataFrame, references: dict = schemas.REFERENCES
) -> Change:
    """Delete rows by id, and what refers to them as the rules of ``references`` say.

    By default deleting an event deletes its scores, and a course or a player
    that is still referred to is refused; see ``delete_with_rules``.
    """
    current = getattr(tables, table)
    affected = current.join(ids.select("id").distinct(), "id", "left_semi")
    after, also = delete_with_rules(tables, table, ids, references)
    return Change(after, affected, not_found(current, ids), also)
