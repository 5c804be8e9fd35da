from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from clubhouse.operators.ids import dense_index, with_new_ids
from clubhouse.operators.joins import hot_key_hashes, lookup
from clubhouse.operators.nesting import ordered_list, page_of, with_positions
from clubhouse.operators.slots import (
    add_names_to_few,
    add_player_names,
    explode_slots,
    fill_slots,
    fill_slots_at_once,
    hydrate_names,
    members,
)
from clubhouse.schemas import SLOT_IDS, SLOT_NAMES


@pytest.fixture(scope="module")
def uneven(spark):
    """A third of the rows have one key, some have none, many keys are unknown."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 7).when(n % 11 != 0, n % 5000)
    return spark.range(30_000).select("id", key.alias("key"))


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.range(0, 5000, 2).union(spark.range(7, 8)).select(
        F.col("id").alias("key"), (F.col("id") * 10).alias("ten"), F.lit(None).alias("nothing")
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_gives_the_plain_join(uneven, keyed, how):
    plain = uneven.join(keyed, "key", how).select("id", "key", "ten", "nothing")
    for small in (True, False):
        found = lookup(uneven, keyed, ["key"], how, small=small)
        assert found.columns == plain.columns
        assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_lookup_refuses_other_joins(uneven, keyed):
    with pytest.raises(ValueError):
        lookup(uneven, keyed, ["key"], "full")


def test_the_frequent_key_is_found_and_spread(spark, uneven, keyed):
    hashed = spark.range(7, 8).select(F.xxhash64("id").alias("h")).first().h
    assert hashed in [r[0] for r in hot_key_hashes(uneven, ["key"]).collect()]
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, setting in settings.items():
        spark.conf.set(name, setting)
    try:
        found = lookup(uneven, keyed, ["key"]).where("key = 7")
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 8
        assert max(r["count"] for r in tasks) < 2 * 10_000 / 8
    finally:
        for name, setting in before.items():
            spark.conf.set(name, setting)


def test_lookup_by_several_columns(spark):
    fact = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "b", 6)], "id int, x string, y int")
    dim = spark.createDataFrame([("b", 5, "hit"), ("a", 1, "no")], "x string, y int, v string")
    for small in (True, False):
        assert sorted(rows(lookup(fact, dim, ["x", "y"], small=small), "id", "v")) == [
            (1, None), (2, "hit"), (3, None),
        ]


def test_members(league):
    pairs = sorted(rows(members(league.scores), "id", "player_id"))
    assert pairs.count((11, 1)) == 2 and (13, 2) in pairs and len(pairs) == 10
    once = sorted(rows(members(league.scores, distinct=True), "id", "player_id"))
    assert once.count((11, 1)) == 1 and len(once) == 9


def test_distinct_slots_keep_later_players(spark):
    df = spark.createDataFrame([(1, None, 2, 2), (None, 3, None, 3)], "a int, b int, c int, d int")
    found = explode_slots(df, ["a", "b", "c", "d"], "p", distinct=True)
    assert sorted(rows(found, "p")) == [(1,), (2,), (3,)]


def test_tables_of_short_names_are_broadcast_by_their_measured_size(spark, league):
    from clubhouse.plans.leaderboards import event_scores
    from clubhouse.tables import Tables

    few = Tables(**league.as_dict(), broadcast_rows=1)
    assert not few.is_small("players") and few.has_short("players", "first_name", "last_name")
    long = few.with_tables(players=few.players.withColumn("last_name", F.repeat("last_name", 200)))
    assert not long.has_short("players", "first_name", "last_name")
    names = spark.createDataFrame([("Ada Birch",), ("Ben Cole",)], "raw_full string")
    assert few.fits(names, 2, "raw_full") and not few.fits(names.select(F.repeat("raw_full", 200).alias("r")), 2, "r")
    none = Tables(**league.as_dict(), broadcast_rows=0)
    assert not none.fits(names, 2, "raw_full")
    assert not none.has_short("players", "first_name", "last_name")
    want = sorted(rows(event_scores(league)), key=str)
    for tables in (few, none):
        assert sorted(rows(event_scores(tables)), key=str) == want


def test_rows_travel_to_their_key_with_few_bits_of_its_hash(uneven, keyed):
    """A whole hash per row does not compress: the row's exchange has to do without."""
    spark = uneven.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookup(uneven, keyed, ["key"])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = [line for line in plan.splitlines() if "isnotnull(__hit" in line and "AS __key" in line]
    assert keys and all("shiftrightunsigned" in line for line in keys)


@pytest.mark.parametrize("other", ["fewer", "more"])
def test_positions_do_not_depend_on_where_crowds_are_counted(spark, other):
    board = spark.range(400).selectExpr("id", "id % 2 AS event", "CAST(id % 7 AS INT) AS place")
    counted = board.where("event = 1") if other == "fewer" else board.unionAll(board)
    plain = with_positions(board, "event", ["place", "id"])
    parted = with_positions(board, "event", ["place", "id"], crowd=50, counted_in=counted)
    assert sorted(rows(parted)) == sorted(rows(plain))


def test_both_ways_to_fill_slots_agree(spark, league):
    dim = league.players.select(F.col("id").alias("k"), F.col("last_name").alias("v"))
    # Two rows share their id, as broken data might.
    scores = league.scores.select(
        F.when(F.col("id") == 12, 11).otherwise(F.col("id")).alias("id"), *SLOT_IDS
    )
    few = fill_slots(scores, dim, SLOT_IDS, SLOT_NAMES, small=True)
    many = fill_slots(scores, dim, SLOT_IDS, SLOT_NAMES, small=False)
    assert few.columns == many.columns
    assert sorted(rows(few), key=str) == sorted(rows(many), key=str)
    assert (11, 1, 1, None, None, "Birch", "Birch", None, None) in rows(many)


@pytest.mark.parametrize("style, empty", [("full", ""), ("strict", None), ("compact", None)])
def test_name_styles(either, style, empty):
    named = add_player_names(either.scores.where("id = 13"), either, style)
    first, second, third, _ = rows(named, *SLOT_NAMES)[0]
    assert third == empty
    shown = {"compact": ("C. Drake", "B. Cole")}.get(style, ("Cy Drake", "Ben Cole"))
    assert (first, second) == shown
    few = add_names_to_few(either.scores.where("id = 13").limit(1), either, style)
    assert rows(few, *SLOT_NAMES) == rows(named, *SLOT_NAMES)


def test_hydrate_names(spark, either):
    df = spark.createDataFrame(
        [("x", 1, [3, 99, 1]), ("y", 2, []), ("z", 3, [2, 2])], "k string, n int, ids array<bigint>"
    )
    found = hydrate_names(df, either, ["k"], "ids")
    assert sorted(rows(found)) == [
        ("x", 1, [3, 99, 1], "C. Drake / Player #99 / A. Birch"),
        ("y", 2, [], ""),
        ("z", 3, [2, 2], "B. Cole / B. Cole"),
    ]


def test_dense_index_is_gapless_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"))
    numbered = dense_index(df, ["n"])
    assert sorted(rows(numbered, "index", "n")) == [(i + 1, i) for i in range(1000)]
    assert dense_index(df.limit(0), ["n"]).count() == 0


def test_new_ids_follow_the_highest(spark, league):
    new = spark.createDataFrame([("Zoe",), ("Abe",)], "first_name string")
    assert sorted(rows(with_new_ids(new, league.players, ["first_name"]))) == [
        (5, "Abe"), (6, "Zoe"),
    ]


def test_ordered_lists_put_nulls_last(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (1, 3)], "a int, id int")
    listed = df.agg(ordered_list(["id"], ["a"]).alias("l")).first().l
    assert [e.id for e in listed] == [3, 2, 1]


@pytest.mark.parametrize("crowd", [1_000_000, 100, 7])
def test_positions_follow_the_order_of_each_group(spark, crowd):
    df = spark.range(1000).select(
        "id", F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("g"),
        F.when(F.col("id") % 9 != 0, -F.col("id")).alias("rank"),
    )
    placed = with_positions(df, "g", ["rank", "id"], crowd)
    ids = [i for i in range(900)]
    wanted = sorted(ids, key=lambda i: (i % 9 == 0, -i if i % 9 else 0, i))
    assert rows(placed.where("g = 1").orderBy("position"), "position", "id") == list(enumerate(wanted, 1))
    assert rows(placed.where("g <> 1").select("position").distinct()) == [(1,)]
    pages = placed.where("g = 1").select("position", page_of("position", 100).alias("page"))
    assert sorted(rows(pages.groupBy("page").count())) == [(i, 100) for i in range(9)]


def test_many_heavy_keys_are_all_found(spark):
    """A hundred keys with a hundredth of the rows each."""
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        fact = spark.range(20_000).select((F.col("id") % 100).alias("k"), "id")
        assert hot_key_hashes(fact, ["k"]).count() == 100
        dim = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        found = lookup(fact, dim, ["k"])
        assert found.where("v = 2 * k").count() == 20_000
        sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) < 3 * 20_000 / len(sizes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_slots_that_were_looked_up_do_not_travel_on(league, large):
    dim = league.players.select(F.col("id").alias("player"), F.col("last_name").alias("label"))
    found = fill_slots(large.scores.select("id", *SLOT_IDS), dim, SLOT_IDS, SLOT_NAMES, small=False, keep=False)
    assert found.columns == ["id", *SLOT_NAMES]
    assert sorted(rows(found, "id", "player1_name", "player2_name"))[:3] == [
        (11, "Birch", "Birch"), (12, "Cole", None), (13, "Drake", "Cole"),
    ]


@pytest.mark.parametrize("repeated", [False, True])
def test_slots_are_filled_at_once_as_one_by_one(spark, repeated):
    """Broken data too: equal rows, null and repeated ids, unknown players, a team with most rows."""
    teams = [(i % 5 or None, 2, 3, i % 7 or None, 99 if i % 2 else None) for i in range(60)] + [(1, 4, None, None, None)] * 200
    scores = spark.createDataFrame([(*t, "x") for t in teams], ["id", *SLOT_IDS, "notes"]).where("id IS NULL OR id < 9")
    listed = [(2, "B"), (3, None), (4, "D"), (5, "E"), (None, "nobody")] + [(2, "Bb")] * repeated
    dim = spark.createDataFrame(listed, "k long, v string")
    by_one = fill_slots(scores, dim, SLOT_IDS, SLOT_NAMES, small=True)
    for asked in (None, scores.drop("notes").union(scores.drop("notes").limit(3))):
        at_once = fill_slots_at_once(scores, dim, SLOT_IDS, SLOT_NAMES, asked)
        assert at_once.columns == by_one.columns
        assert sorted(rows(at_once), key=str) == sorted(rows(by_one), key=str)


@pytest.mark.parametrize("repeated", [(False, False), (True, False), (False, True), (True, True)])
def test_facts_and_slots_at_once_as_one_after_the_other(spark, repeated):
    """Null, unknown and repeated events, repeated players, a team with most rows, an event with most rows."""
    teams = [(i, i % 4 or None, i % 5 or None, 2, i % 7 or None, None) for i in range(60)]
    teams += [(60 + i, 3 if i % 2 else i % 9, 1, 4, None, None) for i in range(200)]
    columns = ", ".join(f"{c} long" for c in ["id", "event_id", *SLOT_IDS])
    scores = spark.createDataFrame(teams, columns).drop("id").withColumn("notes", F.lit("x"))
    events = [(1, "One", 70), (2, None, None), (3, "Three", 72), (None, "none", 1)] + [(3, "Again", 71)] * repeated[0]
    facts = spark.createDataFrame(events, "event_id long, event_name string, par int")
    listed = [(1, "A"), (2, "B"), (3, None), (4, "D"), (None, "nobody")] + [(2, "Bb")] * repeated[1]
    dim = spark.createDataFrame(listed, "k long, v string")
    one = fill_slots(lookup(scores, facts, ["event_id"], "inner", small=True), dim, SLOT_IDS, SLOT_NAMES, small=True)
    both = fill_slots_at_once(scores, dim, SLOT_IDS, SLOT_NAMES, facts=facts)
    assert both.columns == one.columns
    assert sorted(rows(both), key=str) == sorted(rows(one), key=str)


def test_numbering_keeps_its_rows_as_compressed_columns(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"))
    assert "parquet" in dense_index(df, ["n"])._jdf.queryExecution().toString()
