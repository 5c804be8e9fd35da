"""Surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clubhouse.session import written

# monotonically_increasing_id() holds the partition number above this many
# bits and the row's position in its partition below them.
_POSITION_BITS = 33


def dense_index(df: DataFrame, order: list[str], column: str = "index") -> DataFrame:
    """Number the rows 1, 2, 3, … in the order of the given columns.

    The rows are sorted over many tasks and written down once, each with its
    place; numbering then needs only the row count of every partition. ``order``
    should identify a row, so that the numbers do not depend on the partitioning.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = written(
        rows.select(
            "*",
            F.shiftright(place, _POSITION_BITS).alias("__partition"),
            place.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("__position"),
        )
    )
    # One row per partition, so the unpartitioned window and the broadcast are
    # bounded by the number of partitions.
    sizes = placed.groupBy("__partition").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__partition", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    return placed.join(F.broadcast(starts), "__partition").select(
        *df.columns, (F.col("__start") + F.col("__position") + 1).alias(column)
    )


def highest_id(existing: DataFrame) -> Column:
    """The highest id of a table as one value, 0 for an empty table."""
    return existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()


def with_new_ids(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Give new rows ids that follow the highest existing one, in key order."""
    numbered = dense_index(new.drop("id"), order, "__index")
    ids = (highest_id(existing) + F.col("__index")).cast("long").alias("id")
    return numbered.select(ids, *[c for c in numbered.columns if c != "__index"])
