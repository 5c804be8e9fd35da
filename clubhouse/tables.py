"""The four league tables, passed around together."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubhouse import schemas

# A table may be broadcast up to this many rows. Its text columns are length
# limited (schemas.MAX_LENGTH) and only a few of them are ever broadcast, so
# the bound is some tens of megabytes per executor.
BROADCAST_ROWS = 100_000
# The names of more players than that may be broadcast as well, if they were measured
# and take no more than this for every row that may be: 64 MB. A row of a
# broadcast has four fields of eight bytes besides its text.
BROADCAST_ROW_BYTES = 640
_ROW_BYTES = 32


@dataclass(frozen=True)
class Base:
    """The saved version that tables were read from, and its frames as read."""

    root: str
    version: int
    read: dict[str, DataFrame] = field(repr=False)
    files: dict[str, dict[int, str]] = field(repr=False)


@dataclass(frozen=True)
class Tables:
    players: DataFrame
    courses: DataFrame
    events: DataFrame
    scores: DataFrame
    broadcast_rows: int = BROADCAST_ROWS
    base: Base | None = field(default=None, repr=False, compare=False)
    # For changed tables: frames of the rows that differ from the base, as far as
    # schemas.TOLD_APART_BY has columns. A changed table that is not here may differ anywhere.
    touched: dict[str, tuple[DataFrame, ...]] = field(default_factory=dict, repr=False, compare=False)
    _rows: dict[str, int] = field(default_factory=dict, repr=False, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.scores.sparkSession

    def rows(self, name: str) -> int:
        """Row count of a table, counted once (Parquet answers it from footers)."""
        if name not in self._rows:
            self._rows[name] = getattr(self, name).count()
        return self._rows[name]

    def is_small(self, name: str) -> bool:
        """True if the table was counted and may be broadcast."""
        return self.rows(name) <= self.broadcast_rows

    def has_short(self, name: str, *texts: str) -> bool:
        """True if the table may be broadcast with its id and these texts alone: it
        is small, or its texts were measured and are short enough."""
        return self.fits(getattr(self, name), self.rows(name), *texts)

    def fits(self, df: DataFrame, rows: int, *texts: str) -> bool:
        """``has_short`` for a frame that was counted, such as a name map."""
        if rows <= self.broadcast_rows:
            return True
        most = self.broadcast_rows * BROADCAST_ROW_BYTES
        return rows * _ROW_BYTES <= most and texts_size(df, *texts) <= most

    def with_tables(self, **changed: DataFrame) -> Tables:
        """A copy with some tables exchanged; only their counts are forgotten."""
        kept = {name: n for name, n in self._rows.items() if name not in changed}
        touched = {name: t for name, t in self.touched.items() if name not in changed}
        return replace(self, _rows=kept, touched=touched, **changed)

    def with_rows_changed(self, name: str, df: DataFrame, *rows: DataFrame) -> Tables:
        """A copy with one table exchanged that differs from the present one only in
        the given rows: those that are new, and those that are gone, as they were."""
        known = name in self.touched or (self.base is not None and getattr(self, name) is self.base.read[name])
        after = self.with_tables(**{name: df})
        if not known:
            return after
        told = (r.select(*schemas.TOLD_APART_BY[name]) for r in rows)
        return replace(after, touched={**after.touched, name: (*self.touched.get(name, ()), *told)})

    def with_base(self, base: Base | None) -> Tables:
        """A copy that counts as read from another version, or from none."""
        return replace(self, base=base, touched={})

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in schemas.TABLES}


def texts_size(df: DataFrame, *texts: str) -> int:
    """Bytes that a broadcast of a key and these texts takes, by one pass over them."""
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(_ROW_BYTES))
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select a table's columns in order, cast to their types; absent ones are NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.TABLES[name].fields
        ]
    )


def empty_tables(spark: SparkSession) -> Tables:
    return Tables(
        **{name: spark.createDataFrame([], schema) for name, schema in schemas.TABLES.items()}
    )
