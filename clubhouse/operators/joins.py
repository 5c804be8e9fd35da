"""Looking a table up by its key, whatever the sizes and however uneven the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is frequent if it holds more rows than a quarter of an even share of a
# partition. There are at most HOT_SHARE keys like that for every partition, and
# the sketch that finds them tracks some times as many.
HOT_SHARE = 4
_TRACKED = 8
_MOST_KEYS, _MOST_TRACKED = 100_000, 1_000_000  # the sketch's own limits

_KEY, _HIT, _FOUND = "__key", "__hit", "__found"
# What travels with a row that has yet to meet its key: so many bits of the key's
# hash. Rows that are settled have a value that these bits cannot have.
_BITS = 1


def hot_key_hashes(fact: DataFrame, on: list[str]) -> DataFrame:
    """Hashes of all frequent keys, HOT_SHARE for every partition at most.

    One pass over the key columns; each task sends a sketch, not its keys.
    """
    partitions = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = min(HOT_SHARE * partitions, _MOST_KEYS)
    tracked = min(max(4096, _TRACKED * keys), _MOST_TRACKED)
    top = F.expr(f"approx_top_k(key, {keys}, {tracked})")
    return (
        fact.select(F.xxhash64(*on).alias("key"))
        .agg(top.alias("top"), F.count(F.lit(1)).alias("rows"))
        .select(F.explode("top").alias("found"), "rows")
        .where((F.col("found.count") * keys > F.col("rows")) & F.col("found.item").isNotNull())
        .select(F.col("found.item").alias(_KEY))
    )


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    small: bool = False,
    keys_from: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``fact`` to ``dim``, a table with one row per key.

    ``small`` says that the caller has checked the size of ``dim``: it is
    broadcast. Otherwise both sides are shuffled, except for the most frequent
    keys: their few ``dim`` rows are broadcast, and their ``fact`` rows are
    spread over all partitions, so that no task receives one key's rows. Which
    keys the sketch names changes the work per task, never the result.

    ``keys_from`` is a cheaper frame with the same key columns to take the
    frequent keys from; ``hot`` has their hashes where they are known already.
    ``how`` is "left" or "inner".
    """
    values = [c for c in dim.columns if c not in on]
    if small:
        return fact.join(F.broadcast(dim), on, how).select(*fact.columns, *values)

    def travels(*columns: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*columns), 64 - _BITS)

    hashed = dim.withColumn(_KEY, F.xxhash64(*on))
    if hot is None:
        hot = hot_key_hashes(fact if keys_from is None else keys_from, on)
    hot_rows = hashed.join(F.broadcast(hot), _KEY, "left_semi").select(
        *on, F.struct(*values, F.lit(True).alias(_FOUND)).alias(_HIT)
    )

    no_key = F.lit(False)
    for column in on:
        no_key = no_key | F.col(column).isNull()
    # Rows that are settled (or cannot match) travel under a hash of the whole
    # row: evenly spread, and matching nothing.
    marked = fact.join(F.broadcast(hot_rows), on, "left").withColumn(
        _KEY,
        F.when(
            F.col(_HIT).isNotNull() | no_key, F.xxhash64(*fact.columns).bitwiseOR(F.lit(1 << _BITS))
        ).otherwise(travels(*on)),
    )
    joined = marked.join(
        dim.select(
            *on, travels(*on).alias(_KEY), F.struct(*values, F.lit(True).alias(_FOUND)).alias("__row")
        ),
        [*on, _KEY],
        "left",
    ).withColumn(_HIT, F.coalesce(_HIT, "__row"))
    if how == "inner":
        joined = joined.where(F.col(_HIT).isNotNull())
    elif how != "left":
        raise ValueError(f"lookup joins are left or inner, not {how}")
    return joined.select(*fact.columns, *[F.col(f"{_HIT}.{v}").alias(v) for v in values])
