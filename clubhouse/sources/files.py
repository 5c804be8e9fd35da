"""Reading sheets, name maps and table backups; writing documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, StringType, StructField, StructType

from clubhouse import schemas
from clubhouse.operators.quality import duplicate_keys, refuse


# The header must name the columns in their order, and a row that does not fit
# them fails the read.
_STRICT = {"header": True, "enforceSchema": False, "mode": "FAILFAST"}


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results sheet."""
    return spark.read.schema(schemas.SHEET).options(**_STRICT, dateFormat="yyyy-MM-dd").csv(path)


def _typed(column: str, kind: DataType) -> Column:
    """A text as a value of its column, NULL if it is none."""
    text = F.col(column)
    if isinstance(kind, StringType):
        return text
    if isinstance(kind, DateType):
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast(kind)
    if isinstance(kind, BooleanType):
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    return text.try_cast(kind)


def read_results_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A results sheet in two parts: rows that can be loaded, and the others.

    Rejected are rows with too many or too few fields, with a text that is no value of its
    column, and with a course but without what every event must have. They come as
    they stand in the sheet, each field as text, with the whole ``line`` if its
    fields do not fit, and with all ``reasons``. The header must be right.
    """
    names = schemas.SHEET.names
    text = StructType([StructField(c, StringType()) for c in [*names, "line"]])
    # Fields are only counted where all are parsed, whichever of them a caller selects.
    options = {
        "header": True, "enforceSchema": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "line",
        "columnPruning": False,
    }
    rows = spark.read.schema(text).options(**options).csv(path)
    values = {f.name: _typed(f.name, f.dataType) for f in schemas.SHEET.fields}
    broken = F.when(F.col("line").isNotNull(), F.lit("wrong number of fields"))
    unread = [
        F.when(F.col("line").isNull() & F.col(c).isNotNull() & value.isNull(), F.lit(f"{c}: not {kind}"))
        for (c, value), kind in zip(values.items(), (f.dataType.simpleString() for f in schemas.SHEET.fields))
        if kind != "string"
    ]
    lacking = [
        F.when(F.col("line").isNull() & F.col("course_name").isNotNull() & F.col(c).isNull(), F.lit(f"{c}: missing"))
        for c in schemas.SHEET_REQUIRED
    ]
    told = rows.withColumn("reasons", F.array_compact(F.array(broken, *unread, *lacking)))
    good = told.where(F.size("reasons") == 0).select(*[v.alias(c) for c, v in values.items()])
    return good, told.where(F.size("reasons") > 0).select(*names, "line", "reasons")


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """The raw-name map; a raw name may occur once."""
    names = spark.read.schema(schemas.NAME_MAP).options(**_STRICT).csv(path)
    refuse(duplicate_keys(names, "name_map"), "name map: raw name given twice")
    return names


def read_backup(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A table backup as CSV. Its booleans are t and f, so text is read first."""
    target = schemas.TABLES[table]
    text = StructType([StructField(f.name, StringType()) for f in target.fields])
    rows = spark.read.schema(text).options(**_STRICT).csv(path)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])


def as_json(document: DataFrame) -> DataFrame:
    """Document rows as JSON text, NULLs written out."""
    return document.select(
        F.to_json(F.struct(*document.columns), {"ignoreNullFields": "false"}).alias("value")
    )


def write_documents(document: DataFrame, path: str, compression: str | None = None) -> None:
    """One JSON object per line; ``compression`` as Spark names it, such as gzip."""
    document.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)


def write_csv(rows: DataFrame, path: str, short_flags: bool = False, compression: str | None = None) -> None:
    """Rows as CSV files with a header; ``short_flags`` writes booleans as t and
    f, as backups have them. ``compression`` as Spark names it, such as gzip."""
    flags = {
        f.name: F.when(F.col(f.name), "t").when(~F.col(f.name), "f")
        for f in rows.schema.fields
        if short_flags and f.dataType.typeName() == "boolean"
    }
    (rows.withColumns(flags) if flags else rows).write.option("header", True).csv(path, compression=compression)


def read_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Documents that were written one JSON object per line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
