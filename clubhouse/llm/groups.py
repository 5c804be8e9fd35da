"""Handing bounded groups of rows to Python one at a time, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubhouse.session import written


def by_group(
    rows: DataFrame,
    keys: list[str],
    apply: Callable[[pa.Table], Iterator[pa.RecordBatch]],
    schema: str,
    order: list[str] | None = None,
) -> DataFrame:
    """Apply a function to the rows of every key, in the given order.

    The caller makes the groups small: a task holds one of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows, bool)
            changed[0] = bool(waiting) and any(
                waiting[-1].column(k)[-1] != batch.column(k)[0] for k in keys
            )
            for k in keys:
                values = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
                changed[1:] |= values[1:] != values[:-1]
            cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if i and waiting:
                    yield from apply(pa.Table.from_batches(waiting))
                    waiting = []
                if b > a:
                    waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from apply(pa.Table.from_batches(waiting))

    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *(order or []))
    return sorted_rows.mapInArrow(run, schema)


def bit_map(hashes: DataFrame, size: int) -> np.ndarray:
    """A map of ``size`` bits (a power of two) with those of all hashes (m) set.

    At most ``size / 64`` rows reach the driver, however many hashes there are.
    """
    place = F.shiftright("m", 6).bitwiseAND(F.lit(size // 64 - 1))
    bit = F.expr("shiftleft(1L, cast(m & 63 as int))")
    rows = hashes.select(place.alias("p"), bit.alias("b")).groupBy("p").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[rows["p"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return bits


def in_bit_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) may be in the map; those in it always."""
    place = ((hashes >> np.uint64(6)) & np.uint64(len(bits) - 1)).astype(np.int64)
    return (bits[place] >> (hashes & np.uint64(63)) & np.uint64(1)).astype(bool)


def forest(linked: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The least index reachable from each of n nodes over pairs of index arrays."""
    label = np.arange(n)
    if not linked:
        return label
    a = np.concatenate([x for x, _ in linked])
    b = np.concatenate([y for _, y in linked])
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): id, component (the least id).

    Only ids that occur in a link are returned. Rounds of large and small stars:
    every node links its greater neighbours, then its smaller ones, to the least
    node it sees, until nothing changes. Neighbours are never gathered; a node's
    least neighbour is an aggregate that joins back to its links.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    stars = written(
        links.where("a <> b").select(high.alias("u"), low.alias("v")).distinct()
    )
    state = None
    while True:
        new = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if new == state or new[0] == 0:
            break
        state = new
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        stars = written(small.select("e.u", "e.v").where("u <> v").distinct())
    # Each node now has one link, to the least of its component.
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
