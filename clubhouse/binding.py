"""The driver's generated tables read as league tables.

Suppliers are courses, customers players, orders events and line items scores.
The projection is fixed; the oracle queries repeat it in SQL.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubhouse.functions.names import full_name
from clubhouse.operators.slots import fill_slots, fill_slots_at_once
from clubhouse.schemas import SHEET_NAMES, SLOT_IDS
from clubhouse.tables import BROADCAST_ROWS, Tables, conform

AS_OF = dt.date(1999, 6, 30)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """On one machine, give every core some rows of a file that a single task
    has to read. A cluster's tables have files enough and stay as they are."""
    context = df.sparkSession.sparkContext
    if not context.master.startswith("local["):
        return df
    cores = context.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _courses(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        (F.col("s_suppkey") + 1).alias("id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("city"),
        F.when(F.col("s_suppkey") % 10 != 0, "MN").alias("state"),
        (70 + F.col("s_suppkey") % 3).alias("par"),
    )


def _players(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (key + 1).alias("id"),
        F.substring("c_name", 1, 8).alias("first_name"),
        F.expr("substr(c_name, 10)").alias("last_name"),
        F.when(key % 5 == 0, F.col("c_mktsegment")).alias("nickname"),
        F.col("n_name").alias("hometown"),
        F.when(key % 4 != 0, 1990 + key % 30).alias("debut_year"),
        (F.col("c_acctbal") > 9000).alias("hof_inducted"),
    )


def _events(orders: DataFrame) -> DataFrame:
    return orders.select(
        (F.col("o_orderkey") + 1).alias("id"),
        F.concat(F.lit("Open "), "o_orderpriority").alias("name"),
        F.col("o_orderdate").cast("date").alias("date"),
        (F.col("o_custkey") % 10 + 1).alias("course_id"),
        (F.col("o_orderpriority") != "5-LOW").alias("is_team_event"),
        F.when(F.col("o_orderstatus") == "P", "weather").alias("notes"),
        F.year("o_orderdate").alias("season"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_major"),
        F.when(
            (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 2 == 0), "Masters"
        ).alias("major_label"),
        (F.col("o_orderstatus") != "O").alias("finalized"),
    )


def _scores(lineitem: DataFrame) -> DataFrame:
    line, supp, qty = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity")
    whole = qty.cast("int")
    order_line = F.col("l_orderkey") * 10 + line
    return lineitem.select(
        ((order_line * 100000 + F.col("l_partkey")) * 10000 + supp).alias("id"),
        (F.col("l_orderkey") + 1).alias("event_id"),
        (F.floor(F.col("l_partkey") * 3 / 4).cast("long") + 1).alias("player1_id"),
        F.when(line >= 2, supp * 15 + line + 1).alias("player2_id"),
        F.when(line >= 5, supp * 15 + 10).alias("player3_id"),
        F.when(line == 7, supp * 15 + 13).alias("player4_id"),
        F.when(qty != 50, 60 + whole % 30).alias("strokes"),
        F.when((qty < 50) & (line % 2 == 0), whole % 30 - 12).alias("to_par"),
        F.when(qty != 50, whole % 5 + 1).alias("placement"),
        F.when((F.col("l_returnflag") == "R") & (line % 3 == 0), "late card, Dq by rule")
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("wind "), F.col("l_linestatus")))
        .alias("notes"),
        ((qty == 50) | ((qty == 46) & (F.col("l_returnflag") == "R"))).alias("disqualified"),
    )


@lru_cache(maxsize=16)
def _bound(spark: SparkSession, application: str, sf_dir: str, broadcast_rows: int) -> Tables:
    nation = _read(spark, sf_dir, "nation")
    return Tables(
        players=conform(_players(_read(spark, sf_dir, "customer"), nation), "players"),
        courses=conform(_courses(_read(spark, sf_dir, "supplier"), nation), "courses"),
        events=conform(_events(_spread(_read(spark, sf_dir, "orders"))), "events"),
        scores=conform(_scores(_spread(_read(spark, sf_dir, "lineitem"))), "scores"),
        broadcast_rows=broadcast_rows,
    )


def bound_tables(
    spark: SparkSession, sf_dir: str, broadcast_rows: int = BROADCAST_ROWS
) -> Tables:
    """League tables over ``sf_dir``; one object per session, so counts are kept."""
    return _bound(spark, spark.sparkContext.applicationId, sf_dir, broadcast_rows)


def sheet_events(tables: Tables) -> DataFrame:
    """The bound events under the names that the sheet gives them."""
    name = F.concat("name", F.lit(" #"), F.col("id").cast("string"))
    return tables.events.withColumn("name", name)


def bound_sheet(tables: Tables) -> DataFrame:
    """Write the bound tables back out as one wide results sheet.

    A sheet knows an event by name, date and course, and those repeat among the
    bound events; so the sheet names every event by its id as well.
    """
    course = tables.courses.select(
        F.col("id").alias("course_id"),
        F.col("name").alias("course_name"),
        F.col("city").alias("course_city"),
        F.col("state").alias("course_state"),
        F.col("par").alias("course_par"),
    )
    facts = sheet_events(tables).join(course, "course_id").select(
        F.col("id").alias("event_id"), "season", F.col("date").alias("event_date"),
        F.col("name").alias("event_name"), "course_name", "course_city", "course_state",
        "course_par", "is_team_event", "is_major", "major_label", "finalized",
    )
    names = tables.players.select(
        F.col("id").alias("__player"), full_name("first_name", "last_name").alias("__name")
    )
    scores = tables.scores.drop("id", "to_par", "disqualified")
    small = tables.has_short("players", "first_name", "last_name")

    # What moves for its names should not have the wide facts with it yet.
    if small:
        named = fill_slots(scores.join(facts, "event_id"), names, SLOT_IDS, SHEET_NAMES, small=True, keep=False)
    else:
        named = fill_slots_at_once(scores, names, SLOT_IDS, SHEET_NAMES).drop(*SLOT_IDS).join(facts, "event_id")
    return named.select(
        "season", "event_date", "event_name", "course_name", "course_city", "course_state",
        "course_par", "is_team_event", "is_major", "major_label", "finalized",
        "player1_full", "player2_full", "player3_full", "player4_full",
        F.col("strokes").cast("decimal(5,2)").alias("strokes"), "placement", "notes",
    )


def bound_name_map(tables: Tables) -> DataFrame:
    return tables.players.select(
        full_name("first_name", "last_name").alias("raw_full"), "first_name", "last_name"
    )
