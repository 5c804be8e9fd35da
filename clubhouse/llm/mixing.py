"""Mixing sources to target weights, with DataFrame operations only.

Every source wants a share of the mix in proportion to its weight but gives at
most ``max_epochs`` times its own words. Sources that want more are clamped to
that, and what they leave is shared by the others in proportion to their
weights, until no source is above its limit (capped water-filling). The mix is
as large as all sources together, so it always exists.

A document is then taken whole as often as its source's target holds the whole
source. For the rest, the documents of a source are lined up in an order fixed
by the seed and taken once more until the target is met; the document at the
end gives its first words only. So every source meets its target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from clubhouse.operators.ids import dense_index
from clubhouse.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix"
#: Documents of one source that are lined up by one task, about.
LINE_ROWS = 20_000

WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Target words of every source.

    ``sizes`` has (source, source_size), a row per source. Sources in ascending
    order of code points, null last, get the weights in turn. Returns source,
    source_size, weight, target (double), target_words (long), whole (long: how
    often the target holds all of the source) and rest (long: words beyond that).
    A source without words has target 0. No rows give no rows.
    """
    ranked = dense_index(
        sizes.select("source", "source_size", F.col("source").isNull().alias("unnamed")),
        ["unnamed", "source"],
        "place",
    )
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = written(
        ranked.select(
            "source",
            "source_size",
            F.element_at(turn, ((F.col("place") - 1) % len(weights) + 1).cast("int"))
            .cast("long")
            .alias("weight"),
            (F.col("source_size") * max_epochs).alias("most"),
        )
    )
    start = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total = words = int(start[0] or 0)
    shares, clamped = int(start[1] or 0), 0

    def above(words: int, shares: int) -> Column:
        wanted = F.col("weight").cast("decimal(18,0)") * F.lit(words).cast("decimal(20,0)")
        return wanted > F.col("most").cast("decimal(20,0)") * F.lit(shares).cast("decimal(18,0)")

    while shares:
        over = above(words, shares)
        left = ranked.agg(
            F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if left[0] == clamped:
            break
        clamped, words, shares = left[0], total - int(left[1] or 0), int(left[2] or 0)
    even = F.col("weight") * F.lit(words) / F.lit(max(shares, 1))
    is_over = above(words, shares) if shares else F.lit(True)
    target = F.when(is_over, F.col("most").cast("double")).otherwise(even.cast("double"))
    target_words = F.floor(F.col("target") + 0.5).cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    return (
        ranked.withColumn("target", target)
        .withColumn("target_words", target_words)
        .withColumn("whole", F.expr("target_words div greatest(source_size, 1)"))
        .withColumn("rest", F.col("target_words") - F.col("whole") * size)
        .drop("most")
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    tag: Column | None = None,
) -> DataFrame:
    """What the mix takes of every document.

    Returns one row per row of ``docs``: doc_id, size (words), source,
    source_size, target (of its source), whole (times it is taken in full),
    first_words (words taken once more from its beginning, up to its size) and
    taken = whole * size + first_words. Documents without words or with null
    text are taken with 0 words. Null sources form one source. Rows with the
    same id are documents of their own; rows that are equal in all columns used
    share the outcome in any order. A null id counts as a text of its own in the
    seeded order. Other columns of ``docs`` are not looked at. Reruns agree.
    ``tag`` is a value to be handed through as column tag.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("none"))))
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            key.alias("order_key"),
            (F.lit(None).cast("long") if tag is None else tag).alias("tag"),
        )
    )
    rows = sized.count()
    digits = 1
    while rows > LINE_ROWS * 16**digits and digits < 8:
        digits += 1
    sized = sized.withColumn("line", F.substring("order_key", 1, digits))
    lines = written(sized.groupBy("source", "line").agg(F.sum("size").alias("line_size")))
    targets = source_targets(
        lines.groupBy("source").agg(F.sum("line_size").alias("source_size")), weights, max_epochs
    )
    along = (
        Window.partitionBy("source")
        .orderBy("line")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    planned = (
        lines.withColumn("before", F.sum("line_size").over(along) - F.col("line_size"))
        .alias("a")
        .join(targets.alias("b"), same)
        .select("a.source", "line", "before", "source_size", "target", "whole", "rest")
    )
    within = (
        Window.partitionBy("source", "line")
        .orderBy("order_key", "doc_id", "size", "tag")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    begun = F.col("before") + F.col("run") - F.col("size")
    first_words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - begun))
    return (
        sized.withColumn("run", F.sum("size").over(within))
        .alias("a")
        .join(planned.alias("b"), same & (F.col("a.line") == F.col("b.line")))
        .select(
            "doc_id",
            "size",
            "a.source",
            "source_size",
            "target",
            "whole",
            first_words.cast("long").alias("first_words"),
            (F.col("whole") * F.col("size") + first_words).cast("long").alias("taken"),
            *([] if tag is None else ["tag"]),
        )
    )


def _row_digest(docs: DataFrame) -> Column:
    """A digest of a whole row, in which a NULL differs from every value and a
    value from the same one in the next column."""
    parts = []
    for field in docs.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            column = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat(*parts))


def materialized(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, all columns kept.

    A document that is taken in part keeps that many of its words, joined by one
    space. (At most one document of a source is.) Documents that are not taken
    are left out; a repeated row is taken as often as all its repetitions are. Rows
    that differ in any column, if only by which one is NULL, are different.
    """
    row_tag = _row_digest(docs)
    plan = mixed(docs, text_col=text_col, tag=row_tag, **options)
    in_part = (F.col("first_words") > 0) & (F.col("first_words") < F.col("size"))
    in_full = F.col("whole") + ((F.col("first_words") > 0) & ~in_part).cast("long")
    plan = plan.where("taken > 0").groupBy("tag").agg(
        F.sum(in_full).alias("__full"), F.max(F.when(in_part, F.col("first_words"))).alias("__part")
    )
    # Each copy as the number of its words that are kept, null for all.
    whole = F.array_repeat(F.lit(None).cast("long"), F.col("__full").cast("int"))
    none = F.array().cast("array<long>")
    last = F.when(F.col("__part").isNull(), none).otherwise(F.array("__part"))
    copies = F.concat(whole, last)
    rows = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), row_tag.alias("tag"))
        .join(plan, "tag")
        .dropDuplicates(["tag"])
        .withColumn("__words", F.explode(copies))
    )
    cut = _first_words(F.col(f"__row.`{text_col}`"), F.col("__words"))
    text = F.when(F.col("__words").isNull(), F.col(f"__row.`{text_col}`")).otherwise(cut)
    return rows.select(
        *[(text if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns]
    )


def _first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, joined by one space."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")
