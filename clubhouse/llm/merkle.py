"""Document fingerprints: a Merkle tree over paragraphs and sections.

With DataFrame operations only. The leaves are the clauses of a paragraph: cuts
follow white space after a word that ends in a punctuation mark or in one of
some common letters, so they depend on the text around them and not on its
position, and an edit changes the leaves it touches only. A paragraph is a line.
A section ends after a paragraph whose hash is a multiple of SECTION, so that an
inserted paragraph changes one section and moves the others as they are. Every
node hashes its children, the root hashes the sections. Cutting loses no
character, so equal texts have equal roots and other texts other roots.

A fingerprint is one string: the root, then each section with its paragraphs and
their leaves: ``root|section:paragraph.leaf.leaf,paragraph.leaf|section:...``.
Two fingerprints are compared without the texts: ``likeness`` counts shared
leaves, ``edits`` walks down the branches that differ and names the paragraphs
that are deleted or inserted. Equal roots and equal sections are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clubhouse.session import written

#: Paragraphs of a section, on average.
SECTION = 16
#: Where a paragraph is cut into leaves: white space after these characters.
CLAUSE = r"(?<=[.,;:!?)\]}%&*#$|enos]\s)(?=\S)"
#: Ranges of documents for every shuffle partition, in finding the next document.
RANGES_PER_PARTITION = 2


def _hex32(value: Column) -> Column:
    return F.right(F.hex(value), F.lit(8))


def leaf_hashes(text: Column) -> Column:
    """The leaf hashes of every paragraph. A null text counts as empty; an empty
    text is one paragraph with one leaf."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(
        lines, lambda line: F.transform(F.split(line, CLAUSE, -1), lambda leaf: F.xxhash64(leaf))
    )


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add ``name`` (the fingerprint) and ``name_leaves`` (distinct leaf hashes)."""
    hashes, nodes, ends, sections = (f"__{name}_{c}" for c in "hpes")
    count = F.size(F.col(nodes))
    cuts = F.filter(
        F.sequence(F.lit(0), count - 1),
        lambda i: (F.pmod(F.get(F.col(nodes), i)["hash"], F.lit(SECTION)) == 0) | (i == count - 1),
    )

    def block(end: Column, j: Column) -> Column:
        begin = F.when(j == 0, F.lit(0)).otherwise(F.get(F.col(ends), j - 1) + 1)
        return F.slice(F.col(nodes), begin + 1, end - begin + 1)

    blocks = F.transform(F.col(ends), block)
    digest = lambda node: F.hex(F.xxhash64(node))
    section = lambda block: F.concat(
        digest(F.transform(block, lambda p: p["hash"])),
        F.lit(":"),
        F.array_join(F.transform(block, lambda p: p["text"]), ","),
    )
    return (
        df.withColumn(hashes, leaf_hashes(text))
        .withColumn(
            nodes,
            F.transform(
                F.col(hashes),
                lambda p: F.struct(
                    F.xxhash64(p).alias("hash"),
                    F.concat(
                        digest(p), F.lit("."), F.array_join(F.transform(p, _hex32), ".")
                    ).alias("text"),
                ),
            ),
        )
        .withColumn(ends, cuts)
        .withColumn(sections, F.array_join(F.transform(blocks, section), "|"))
        .withColumn(name, F.concat(F.md5(F.col(sections)), F.lit("|"), F.col(sections)))
        .withColumn(f"{name}_leaves", F.array_distinct(F.flatten(F.col(hashes))))
        .drop(hashes, nodes, ends, sections)
    )


def leaf_likeness(one: Column, other: Column) -> Column:
    """Twice the shared leaves over all leaves, for arrays of distinct leaves."""
    shared = F.size(F.array_intersect(one, other))
    return 2.0 * shared / (F.size(one) + F.size(other))


def _tail(array: Column) -> Column:
    """An array without its first element."""
    return F.slice(array, F.lit(2), F.size(array))


def leaves_of(fingerprint: Column) -> Column:
    """The distinct leaves that a fingerprint string holds."""
    paragraphs = F.split(F.regexp_replace(fingerprint, r"^[^|]*\||[0-9A-F]+:", ""), r"[|,]")
    return F.array_distinct(
        F.flatten(F.transform(paragraphs, lambda p: _tail(F.split(p, r"\."))))
    )


def likeness(one: Column, other: Column) -> Column:
    """Likeness of two fingerprints from 0 to 1; 1 for equal texts."""
    return leaf_likeness(leaves_of(one), leaves_of(other))


def _unmatched(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes (side, digest, place) without an equal one on the other side.

    The n-th of several equal nodes matches the n-th on the other side.
    """
    nth = Window.partitionBy(*keys, "side", "digest").orderBy("place")
    both = Window.partitionBy(*keys, "digest", "nth")
    return (
        nodes.withColumn("nth", F.row_number().over(nth))
        .withColumn("sides", F.count(F.lit(1)).over(both))
        .where("sides = 1")
        .drop("nth", "sides")
    )


def edits(df: DataFrame, keys: list[str], one: str, other: str) -> DataFrame:
    """The paragraphs by which two fingerprints of a row differ.

    ``keys`` identify a row. Returns them with edit ("deleted": a paragraph of
    ``one`` that ``other`` lacks; "inserted": one that only ``other`` has) and
    place (from 0, in its own text). A changed paragraph is both, one that only
    moved is none. Equal fingerprints give no row; a null one is no text at all.
    """
    # Written down: a filter on fingerprints must not compute them a second time.
    df = written(df.select(*keys, one, other))
    root = lambda c: F.substring_index(c, "|", 1)
    sides = F.array(
        F.struct(F.lit("deleted").alias("side"), F.col(one).alias("f")),
        F.struct(F.lit("inserted").alias("side"), F.col(other).alias("f")),
    )
    sections = (
        df.where(~root(F.col(one)).eqNullSafe(root(F.col(other))))
        .select(*keys, F.explode(sides).alias("s"))
        .select(*keys, "s.side", F.posexplode(_tail(F.split("s.f", r"\|"))).alias("place", "section"))
        .select(
            *keys, "side", "place",
            F.substring_index("section", ":", 1).alias("digest"),
            F.split(F.substring_index("section", ":", -1), ",").alias("paragraphs"),
        )
    )
    earlier = Window.partitionBy(*keys, "side").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.size("paragraphs")).over(earlier), F.lit(0))
    differing = _unmatched(sections.withColumn("first", first), keys)
    paragraphs = differing.select(*keys, "side", "first", F.posexplode("paragraphs").alias("i", "p")).select(
        *keys, "side", (F.col("first") + F.col("i")).cast("int").alias("place"),
        F.substring_index("p", ".", 1).alias("digest"),
    )
    return _unmatched(paragraphs, keys).select(*keys, F.col("side").alias("edit"), "place")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with the text of the next one in ascending order of id.

    Returns doc_id, text, next_text; the last document gets the first one's
    text, a single document its own. Null texts count as empty. Null ids come
    last, equal ids are ordered by text.

    The documents are shuffled once, into ranges of ids with about equal numbers
    of documents; the first document of a range is also sent to the range
    before. The driver sees bounds and first ids of the ranges only.
    """
    spark = docs.sparkSession
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [i / ranges for i in range(1, ranges)]
    bounds = named.agg(F.percentile_approx("doc_id", parts, 100 * ranges)).first()[0] if parts else None
    bounds = sorted(set(bounds or []))
    # Two steps of about the root of the number of bounds each.
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    below = lambda listed: F.size(F.filter(listed, lambda b: b <= F.col("doc_id")))
    long_array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<long>")
    group = F.greatest(below(long_array([g[0] for g in groups if g])), F.lit(1))
    inside = F.get(F.array(*[long_array(g) for g in groups]), group - 1)
    place = ((group - 1) * step + below(inside)).cast("int")
    ranged = named.withColumn("range", F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(place))
    firsts = ranged.groupBy("range").agg(F.min("doc_id")).collect()  # one row per range
    firsts = sorted((r[0], r[1]) for r in firsts)
    ids, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, (at, first) in enumerate(firsts):
        ids[at], before[at] = first, firsts[i - 1][0]
    first_id = F.get(long_array(ids), F.col("range"))
    earlier = F.get(F.array(*[F.lit(b) for b in before]), F.col("range"))
    copy = F.struct(earlier.alias("range"), F.lit(True).alias("guest"))
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    places = F.when(F.col("doc_id").eqNullSafe(first_id), F.array(own, copy)).otherwise(F.array(own))
    order = Window.partitionBy("at.range").orderBy(
        "at.guest", F.col("doc_id").asc_nulls_last(), "text"
    )
    return (
        ranged.withColumn("at", F.explode(places))
        .select("doc_id", "text", "at.guest", "at", F.lead("text").over(order).alias("next_text"))
        .where("not guest")
        .select("doc_id", "text", "next_text")
    )


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as
    many (or all) of the next text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next. One row per row of ``docs``; nulls and ties as in
    ``with_next``. No rows give no rows.
    """
    rows = with_next(docs, id_col, text_col).withColumn(
        "edited_text", edited(F.col("text"), F.col("next_text"))
    )
    rows = with_fingerprint(rows, F.col("text"), "fingerprint")
    rows = with_fingerprint(rows, F.col("edited_text"), "edited_fingerprint")
    rows = with_fingerprint(rows, F.col("next_text"), "next_fingerprint")

    def near(name: str) -> Column:
        # Equal roots need no look at the leaves.
        leaves = leaf_likeness(F.col("fingerprint_leaves"), F.col(f"{name}_leaves"))
        return F.when(F.col("fingerprint") == F.col(name), 1.0).otherwise(leaves)

    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "edited_text",
        "fingerprint",
        "edited_fingerprint",
        near("edited_fingerprint").alias("near_edited"),
        near("next_fingerprint").alias("near_next"),
    )
