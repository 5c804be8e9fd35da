"""Integrity checks: keys, references, required values, text lengths."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clubhouse import schemas
from clubhouse.operators.slots import fill_slots
from clubhouse.session import written
from clubhouse.tables import Tables


class IntegrityError(ValueError):
    """Data that the tables' rules refuse."""


def key_columns(table: str) -> list[Column]:
    """A table's unique key, NULLs read as the key reads them."""
    return [
        F.coalesce(F.col(c), F.lit(schemas.NULL_AS[c])).alias(c)
        if c in schemas.NULL_AS
        else F.col(c)
        for c in schemas.UNIQUE_KEYS[table]
    ]


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows.

    A key with a NULL that the rule does not replace never equals another key.
    """
    keys = key_columns(table)
    names = schemas.UNIQUE_KEYS[table]
    return (
        df.select(*keys)
        .dropna(subset=names)
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
    )


def duplicate_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def reference_counts(tables: Tables, table: str, target: str) -> DataFrame:
    """How many rows refer to which id of ``target``: (column, id, rows).

    Slots are melted first. The result is aggregated, so a frequently named id
    is one row from here on.
    """
    df = getattr(tables, table)
    columns = [c for c, to, _ in schemas.REFERENCES[table] if to == target]
    named = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("id")) for c in columns]
    )
    return (
        df.select(F.explode(named).alias("ref"))
        .select("ref.column", "ref.id")
        .where(F.col("id").isNotNull())
        .groupBy("column", "id")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def orphans(tables: Tables, of: list[str] = ("events", "scores")) -> DataFrame:
    """References to rows that do not exist: (table, column, id, rows)."""
    found = []
    for table in of:
        references = schemas.REFERENCES[table]
        for target in dict.fromkeys(to for _, to, _ in references):
            counts = reference_counts(tables, table, target)
            missing = counts.join(getattr(tables, target).select("id"), "id", "left_anti")
            found.append(missing.select(F.lit(table).alias("table"), "column", "id", "rows"))
    return reduce(DataFrame.unionByName, found)


def _per_column(df: DataFrame, table: str, columns: list[str], aggregate) -> DataFrame:
    """One pass over ``df``, one output row per column: (table, column, value)."""
    one_row = df.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), aggregate(c).alias("value"))
                for c in columns
            ]
        ).alias("all")
    )
    return one_row.select(F.explode("all").alias("one")).select(
        F.lit(table).alias("table"), "one.column", "one.value"
    )


def missing_values(tables: dict[str, DataFrame]) -> DataFrame:
    """NULLs in required columns: (table, column, rows), zeros included."""
    found = [
        _per_column(df, name, schemas.REQUIRED[name], lambda c: F.count_if(F.col(c).isNull()))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("value", "rows")


def text_lengths(tables: dict[str, DataFrame]) -> DataFrame:
    """Longest text against the limit: (table, column, longest, allowed, fits)."""
    found = []
    for name, df in tables.items():
        limits = schemas.MAX_LENGTH.get(name)
        if limits:
            longest = _per_column(df, name, list(limits), lambda c: F.max(F.length(c)))
            allowed = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
            found.append(longest.withColumn("allowed", allowed[F.col("column")]))
    return (
        reduce(DataFrame.unionByName, found)
        .withColumnRenamed("value", "longest")
        .withColumn("fits", F.coalesce(F.col("longest") <= F.col("allowed"), F.lit(True)))
    )


def refuse(bad: DataFrame, message: str, shown: int = 5) -> None:
    """Raise with a few examples if there is any bad row."""
    examples = bad.limit(shown).collect()
    if examples:
        listed = "; ".join(str(row.asDict()) for row in examples)
        raise IntegrityError(f"{message}: {listed}")


def check_values(df: DataFrame, table: str) -> None:
    """Required values and text lengths of some rows of a table, or raise."""
    found = {
        c: F.when(F.count_if(F.col(c).isNull()) > 0, f"{c}: required value missing")
        for c in schemas.REQUIRED[table]
    }
    for c, limit in schemas.MAX_LENGTH.get(table, {}).items():
        long = F.when(F.max(F.length(c)) > limit, f"{c}: text too long")
        found[c] = F.coalesce(found[c], long) if c in found else long
    # One pass for all columns.
    problems = df.agg(F.array_compact(F.array(*found.values())).alias("problems"))
    refuse(problems.where(F.size("problems") > 0), table)


def written_checked(df: DataFrame, table: str) -> DataFrame:
    """Write a whole table down and check it, or raise.

    Required values and text lengths are observed by the write itself; only the
    key columns are read again, to find keys that occur twice.
    """
    watch = Observation(f"values of {table}")
    missing = {f"{c}: required value missing": F.count_if(F.col(c).isNull()) for c in schemas.REQUIRED[table]}
    long = {
        f"{c}: text too long": F.count_if(F.length(c) > limit) for c, limit in schemas.MAX_LENGTH.get(table, {}).items()
    }
    counts = [rows.alias(problem) for problem, rows in {**missing, **long}.items()]
    rows = written(df.observe(watch, *counts))
    problems = [f"{problem} ({n} rows)" for problem, n in watch.get.items() if n]
    if problems:
        raise IntegrityError(f"{table}: {'; '.join(problems)}")
    refuse(duplicate_keys(rows, table), f"{table}: duplicate key")
    return rows


def check_table(df: DataFrame, table: str) -> None:
    """Required values, text lengths and unique key of a whole table, or raise."""
    check_values(df, table)
    refuse(duplicate_keys(df, table), f"{table}: duplicate key")


def check_changed_rows(tables: Tables, table: str, changed: DataFrame, columns: list[str]) -> None:
    """What new or changed rows of a table could break, or raise.

    ``tables`` already holds them. Keys and references are looked at only if
    one of their ``columns`` was set, and then only those of the changed rows.
    """
    check_values(changed, table)
    key = schemas.UNIQUE_KEYS[table]
    if set(key) & set(columns):
        keys = changed.select(*key_columns(table)).distinct()
        rivals = getattr(tables, table).select(*key_columns(table))
        refuse(
            duplicate_keys(rivals.join(keys, key, "left_semi"), table), f"{table}: duplicate key"
        )
    if any(c in columns for c, _, _ in schemas.REFERENCES.get(table, [])):
        refuse(
            orphans(tables.with_tables(**{table: changed}), [table]),
            f"{table}: reference to a missing row",
        )


def rows_in_use(tables: Tables, target: str, ids: DataFrame, references: dict = schemas.REFERENCES) -> DataFrame:
    """Ids among ``ids`` that a restricting reference still names."""
    used = []
    for table, listed in references.items():
        columns = [c for c, to, rule in listed if to == target and rule == "restrict"]
        if columns:
            counts = reference_counts(tables, table, target)
            used.append(counts.where(F.col("column").isin(columns)).select("id"))
    if not used:
        return ids.select("id").limit(0)
    return ids.select("id").distinct().join(reduce(DataFrame.union, used), "id", "left_semi")


def _marked(tables: Tables, table: str, columns: list[str], gone: DataFrame, few: bool) -> DataFrame:
    """The rows of a table with a flag per column: does it refer to a row that goes?"""
    rows = getattr(tables, table)
    named = gone.select("id", F.lit(True).alias("gone"))
    return fill_slots(rows, named, columns, [f"__{c}" for c in columns], small=few, keys_from=rows.select(*columns))


def _any(columns: list[str]) -> Column:
    return reduce(or_, [F.col(f"__{c}").isNotNull() for c in columns], F.lit(False))


def delete_with_rules(
    tables: Tables, target: str, ids: DataFrame, references: dict = schemas.REFERENCES
) -> tuple[Tables, dict[str, DataFrame]]:
    """Delete rows by id and do what the rules say to rows that refer to them.

    "restrict" refuses the deletion, "cascade" deletes the row that refers (and,
    by their own rules, rows that refer to that one), "set null" empties the column. All
    columns of a table are decided in one pass over it; if several of its columns refer to rows that go,
    restrict counts before cascade, and cascade before set null. Refused as well
    is a NULL where a value is required, and a key that occurs twice once its
    column is empty. Ids that are not there do nothing.

    Returns the tables afterwards and, by table, the other rows touched, as they were.
    """
    gone = ids.select("id").distinct()
    few = gone.count() <= tables.broadcast_rows
    refuse(rows_in_use(tables, target, gone, references), f"{target}: still referred to")
    touched: dict[str, DataFrame] = {}
    after = tables
    for table, listed in references.items():
        rules = {c: rule for c, to, rule in listed if to == target and rule != "restrict"}
        if not rules:
            continue
        dropped = [c for c, rule in rules.items() if rule == "cascade"]
        emptied = [c for c, rule in rules.items() if rule == "set null"]
        current = getattr(after, table)
        marked = _marked(after, table, list(rules), gone, few)
        kept = marked.where(~_any(dropped)) if dropped else marked
        values = {c: F.when(F.col(f"__{c}").isNull(), F.col(c)).alias(c) for c in emptied}
        left = kept.select(*[values.get(c, F.col(c)) for c in current.columns])
        touched[table] = marked.where(_any(list(rules))).select(*current.columns)
        if table == target or any(to == table for other in references.values() for _, to, _ in other):
            # Its rows are referred to in turn.
            lost = marked.where(_any(dropped)).select("id") if dropped else current.select("id").limit(0)
            after, deeper = delete_with_rules(after, table, lost, references)
            touched = {**deeper, **touched}
        after = after.with_rows_changed(table, left, touched[table])
        if emptied:
            changed = kept.where(_any(emptied)).select(*[values.get(c, F.col(c)) for c in current.columns])
            check_changed_rows(after, table, changed, [c for c in emptied if c in schemas.UNIQUE_KEYS[table]])
    current = getattr(after, target)
    kept = current.join(F.broadcast(gone) if few else gone, "id", "left_anti")
    return after.with_rows_changed(target, kept, current.join(gone, "id", "left_semi")), touched
