"""Ordered lists of rows inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clubhouse.functions.names import _col

# A group of more rows is parted, and into how many parts at most.
CROWD = 1_000_000
MOST_PARTS = 256


def ordered_list(fields: list, order: list) -> Column:
    """Aggregate: the rows of a group as structs, in ascending order, NULLs last.

    Only for groups of bounded size: a LIMIT's rows, or one page.
    """
    keys = [k for o in order for k in (_col(o).isNull(), _col(o))]
    entry = F.struct(F.struct(*keys).alias("key"), F.struct(*fields).alias("value"))
    return F.sort_array(F.collect_list(entry)).getField("value")


def crowded_groups(rows: DataFrame, group: str, by: str, most: int) -> list[tuple]:
    """Groups of more than ``most`` rows, each with values of ``by`` that part it.

    Rows are counted before they move, and quantiles come from mergeable
    sketches, so a crowded group is never in one place. There is less than one such
    group for every ``most`` rows, with MOST_PARTS values at most.
    """
    if rows.select(group).count() <= most:
        return []
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > most)
    crowded = {r[0]: r[1] for r in sizes.collect()}
    if not crowded:
        return []
    kind = rows.schema[group].dataType.simpleString()
    listed = rows.sparkSession.createDataFrame([(g,) for g in crowded], f"__g {kind}")
    shares = [(i + 1) / MOST_PARTS for i in range(MOST_PARTS - 1)]
    marks = (
        rows.join(F.broadcast(listed), F.col(group).eqNullSafe(F.col("__g")), "left_semi")
        .groupBy(group)
        .agg(F.percentile_approx(by, shares, 10 * MOST_PARTS))
    )
    found = []
    for g, values in marks.collect():
        parts = min(-(-2 * crowded[g] // most), MOST_PARTS)
        # As many values as there are parts less one, evenly chosen.
        chosen = {values[i * MOST_PARTS // parts - 1] for i in range(1, parts)} if values else set()
        found.append((g, sorted(chosen)))
    return found


def with_positions(
    rows: DataFrame, group: str, order: list[str], crowd: int = CROWD,
    counted_in: DataFrame | None = None,
) -> DataFrame:
    """Add ``position``: 1, 2, 3, … in the order of each group, NULLs last.

    A group is sorted where its rows meet, in one shuffle by group that later steps
    by group can use. Groups of more than ``crowd`` rows are parted at quantiles of the first
    numeric column of ``order`` from which on it decides; a position there is the one
    within the part, and the sizes of the parts before it are added. ``counted_in`` is a
    cheaper frame with the group and that column, to look for such groups in; which ones
    it names changes the work per task, never the positions.
    """
    keys = [F.asc_nulls_last(c) for c in order]
    local = Window.partitionBy(group).orderBy(*keys)
    marked = crowded_groups(rows if counted_in is None else counted_in, group, order[0], crowd)
    if not marked:
        return rows.withColumn("position", F.row_number().over(local).cast("long"))
    spark = rows.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    marks = spark.createDataFrame(marked, f"__g {kinds[group]}, __marks array<{kinds[order[0]]}>")
    told = rows.join(F.broadcast(marks), F.col(group).eqNullSafe(F.col("__g")), "left")
    first = F.col(order[0])
    below = F.size(F.filter("__marks", lambda m: m < first))
    part = F.when(F.col("__marks").isNull(), 0).when(first.isNull(), MOST_PARTS).otherwise(below)
    parted = told.withColumn("__part", part).drop("__g", "__marks")
    sizes = parted.where(F.col("__part").isNotNull()).join(
        F.broadcast(marks.select("__g")), F.col(group).eqNullSafe(F.col("__g")), "left_semi"
    ).groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), "__rows").withColumn(
        "__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))
    ).drop("__rows")
    within = Window.partitionBy(group, "__part").orderBy(*keys)
    numbered = parted.withColumn("__local", F.row_number().over(within))
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))
    placed = numbered.join(F.broadcast(before), same, "left")
    position = (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("long")
    return placed.select(*rows.columns, position.alias("position"))


def page_of(position: str, page_size: int) -> Column:
    """The page, from 0, that holds a position."""
    return F.floor((F.col(position) - 1) / page_size).cast("long")
