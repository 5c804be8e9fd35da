"""Near-duplicate texts by the Jaccard similarity of their word shingles.

Candidates come from SetSketch registers: for each of REGISTERS hash functions
the least exponentially distributed value over a set, truncated to a whole power
of BASE. Registers of a union are the greater ones of both, and equal registers
get likelier with similarity, so bands of registers serve as keys of a
locality-sensitive hash. Texts that share a key are compared by all registers
together: the numbers of greater, smaller and equal ones, with the known sizes
of both sets, give the similarity of greatest likelihood. What may be similar
enough forms families; inside them the links are confirmed on the full sets.

No list of pairs is made. Sets that are equal are one class from the beginning.
A crowd of equal keys is compared in one task only up to CROWD sets; a larger
one becomes one family without estimates. A family is confirmed in blocks: each
against itself and the first; then whatever is not in the family's largest
component yet, against all blocks. Tasks report spanning forests of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubhouse.llm.groups import bit_map, by_group, components, forest, in_bit_map
from clubhouse.llm.words import Words, mix, sequence_hash, shingle_hashes, slices
from clubhouse.session import written

WORDS = 5
#: Links have 100 * shared >= PERCENT * union.
PERCENT = 75
REGISTERS = 128
BAND = 4
#: Close to 1, so that registers of unlike sets are seldom equal by chance.
BASE = 1.001
RATE = 20.0
#: A pair is kept for confirmation at this estimate: over six standard
#: deviations below the threshold. A pair at the threshold shares no band with a
#: probability under one in two hundred thousand.
ESTIMATE = 0.5
CROWD = 512
BLOCK = 128
#: Bits of the map of texts to be confirmed.
MAP_BITS = 1 << 24

#: What tells sets apart.
DIGEST = ["n_shingles", "d1", "d2"]

_rng = np.random.default_rng(3)
_FACTORS = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sets of distinct shingles of some texts, one after another, and their
    sizes. A text of fewer than k words has its word sequence as only shingle, a
    text without words the empty set."""
    words = Words(texts, lower=True)
    every = shingle_hashes(words.hash, k)
    sets = []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
        if b - a >= k:
            sets.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            sets.append(np.array([sequence_hash(words.hash[a:b])], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), sizes


def registers(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SetSketch registers of some sets, a row each; 0 for empty sets."""
    result = np.zeros((len(sizes), REGISTERS), np.uint16)
    some = np.flatnonzero(sizes)
    if not len(some):
        return result
    starts = (np.cumsum(sizes) - sizes)[some]
    least = np.empty((REGISTERS, len(some)), np.uint64)
    hashed = np.empty_like(values)
    for i, factor in enumerate(_FACTORS):
        np.multiply(values, factor, out=hashed)
        np.minimum.reduceat(hashed, starts, out=least[i])
    # The least of uniform values gives the least of exponential ones.
    uniform = (least.T.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    result[some] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65_535)
    return result


def _share(x: np.ndarray) -> np.ndarray:
    """Chance of a greater register, for a share x of the union."""
    return -np.log1p(-np.clip(x, 1e-12, 1 - 1e-12) * (BASE - 1) / BASE) / np.log(BASE)


def likeliest(greater: np.ndarray, smaller: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood for pairs of sets of sizes ``one``
    and ``other`` with that many greater and smaller registers."""
    u = one / (one + other)
    most = np.minimum(u, 1 - u) / np.maximum(u, 1 - u)
    j = most[:, None] * np.linspace(0, 1, 101)
    up, down = _share(u[:, None] - (1 - u)[:, None] * j), _share((1 - u)[:, None] - u[:, None] * j)
    equal = REGISTERS - greater - smaller
    chance = (
        greater[:, None] * np.log(up) + smaller[:, None] * np.log(down)
        + equal[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    )
    return np.take_along_axis(j, chance.argmax(axis=1)[:, None], 1)[:, 0]


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as doc_id, a hash of the text, n_shingles, a digest of the
    set (two numbers), and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                values, sizes = shingle_sets(texts)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sketch = registers(values, sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)),
                        pa.array(sizes), *_digests(values, ends),
                        pa.array([row.tobytes() for row in sketch], pa.binary()),
                    ],
                    ["doc_id", "text_hash", *DIGEST, "registers"],
                )
                at += len(texts)

    schema = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, registers binary"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def _digests(values: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Two numbers for every set, whatever the order of its members."""
    digests = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)))])
        digests.append(pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64)))
    return digests


def _likely(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Forest of the likely links among the sets of one key."""
    reps, place = np.unique(table["rep"].to_numpy(), return_index=True)
    if len(reps) < 2:
        return
    sketch = np.frombuffer(b"".join(table["registers"].take(place).to_pylist()), np.uint16).reshape(len(reps), -1)
    sizes = table["n_shingles"].to_numpy()[place]
    linked = []
    for i in range(len(reps) - 1):
        mine, rest = sketch[i], sketch[i + 1 :]
        n = sizes[i + 1 :]
        # Sizes alone can rule a link out, and so can very few equal registers.
        close = 100 * np.minimum(n, sizes[i]) >= PERCENT * np.maximum(n, sizes[i])
        close &= (rest == mine).sum(axis=1) >= REGISTERS * 0.4
        j = np.flatnonzero(close)
        if len(j):
            up, down = (mine > rest[j]).sum(axis=1), (mine < rest[j]).sum(axis=1)
            j = j[likeliest(up, down, np.full(len(j), sizes[i]), n[j]) >= ESTIMATE]
            linked.append((np.full(len(j), i), j + i + 1))
    yield from _forest_rows(reps, linked)


def _forest_rows(ids: np.ndarray, linked: list) -> Iterator[pa.RecordBatch]:
    label = forest(linked, len(ids))
    joined = np.flatnonzero(label != np.arange(len(ids)))
    if len(joined):
        yield pa.RecordBatch.from_arrays([pa.array(ids[joined]), pa.array(ids[label[joined]])], ["a", "b"])


def families(classes: DataFrame) -> DataFrame:
    """Sets that may be similar enough to some other: id, component."""
    bands = REGISTERS // BAND
    key = lambda b: F.xxhash64(F.substring("registers", 2 * b * BAND + 1, 2 * BAND), F.lit(b))
    keyed = classes.select("rep", F.explode(F.array(*[key(b) for b in range(bands)])).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"), F.min("rep").alias("hub"))
    together = written(keyed.join(shared.where("crowd > 1"), "key"))
    crowds = together.where(F.col("crowd") > CROWD)
    crowded = crowds.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    few = together.where(F.col("crowd") <= CROWD).select("key", "rep")
    few = few.join(classes.select("rep", "n_shingles", "registers"), "rep")
    likely = by_group(few, ["key"], _likely, "a long, b long")
    return components(likely.unionByName(crowded))


def _confirmed(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Forest of the links among some sets, by their full contents."""
    ids, place = np.unique(table["rep"].to_numpy(), return_inverse=True)
    if len(place) < 2:
        return
    sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Only shingles of several sets can be shared.
    several = times > 1
    column = np.cumsum(several) - 1
    width = -(-int(several.sum()) // 64)
    chosen = several[value]
    bits = np.zeros((len(sets), width * 64), bool)
    bits[owner[chosen], column[value[chosen]]] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    linked = []
    for i in range(len(sets) - 1):
        shared = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int64)
        union = sizes[i] + sizes[i + 1 :] - shared
        j = np.flatnonzero(100 * shared >= PERCENT * union) + i + 1
        linked.append((np.full(len(j), place[i]), place[j]))
    yield from _forest_rows(ids, linked)


def _with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full sets of the wanted classes: family, rep, shingles.

    The text of a class is one with its ``first`` id and its digest. A bit map of
    fixed size leaves most other texts out before anything moves; a fuller map
    lets more through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(wanted.select(F.xxhash64("first").alias("m")), MAP_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            hashed = whole.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            batch = whole.filter(pa.array(in_bit_map(shared.value, hashed)))
            at = 0
            for texts in slices(batch.column(1)):
                values, sizes = shingle_sets(texts)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                rows = [values[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), pa.array(sizes), *_digests(values, ends),
                        pa.array(rows, pa.binary()),
                    ],
                    ["first", *DIGEST, "shingles"],
                )
                at += len(texts)

    named = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = named.mapInArrow(run, "first long, n_shingles long, d1 long, d2 long, shingles binary")
    return sets.join(wanted, ["first", *DIGEST]).select("family", "rep", "shingles")


def confirmed_links(docs: DataFrame, classes: DataFrame, likely: DataFrame) -> DataFrame:
    """Links (a, b) that join the truly linked sets of each family."""
    members = likely.select(F.col("id").alias("rep"), F.col("component").alias("family"))
    wanted = written(classes.select("rep", "first", *DIGEST).join(members, "rep"))
    sets = written(_with_sets(docs, wanted))
    blocks = sets.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    spread = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = sets.join(blocks, "family").withColumn("block", spread)
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = placed.withColumn(
        "part", F.explode(F.when(F.col("block") == 0, everywhere).otherwise(F.array("block")))
    )
    schema = "a long, b long"
    links = written(by_group(first.select("family", "part", "rep", "shingles"), ["family", "part"], _confirmed, schema))
    wide = placed.where("blocks > 1")
    if not wide.head(1):
        return links
    joined = components(links)
    state = written(
        wide.select("family", "rep", "blocks").distinct()
        .join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    sizes = state.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("family").agg(F.max(F.struct("n", "component"))["component"].alias("largest"))
    left = state.join(largest, "family").where("component <> largest")
    rests = left.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rests"))
    if not rests.head(1):
        return links
    rest_block = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rests")).cast("int")
    both = wide.join(rests, "family")
    others = both.select(
        "family", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), F.col("block").alias("j"),
        "rep", "shingles",
    )
    rest = both.join(left.select("rep"), "rep").select(
        "family", rest_block.alias("i"), F.explode(everywhere).alias("j"), "rep", "shingles"
    )
    more = by_group(others.unionByName(rest), ["family", "i", "j"], _confirmed, schema)
    return written(links.unionByName(more))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _in_components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and for every set with a named text its component:
    digest, rep, first (least id of the set), component_id (least one of the component).

    Sets go by numbers of their own: several may have the same least id.
    """
    sketches = written(signed(rows))
    classes = written(
        sketches.where(_NAMED)
        .groupBy(*DIGEST, "registers")
        .agg(F.min("doc_id").alias("first"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    joined = written(components(confirmed_links(rows, classes, written(families(classes)))))
    numbers = classes.select("rep", "first", *DIGEST)
    firsts = joined.join(numbers.select(F.col("rep").alias("id"), "first"), "id")
    least = firsts.groupBy("component").agg(F.min("first").alias("least"))
    joined = joined.join(least, "component").select(F.col("id").alias("rep"), "component", "least")
    return sketches, numbers.join(joined, "rep", "left").select(
        *DIGEST, "rep", "first", F.coalesce("component", "rep").alias("component"),
        F.coalesce("least", "first").alias("component_id"),
    )


_NAMED = "doc_id is not null and n_shingles > 0"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate texts.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the
    least id reachable by links, its own included) and kept (doc_id =
    component_id). Null texts and texts without words have no shingles, link
    with nothing and are kept. Rows with equal ids are texts of their own, which
    link if they are alike. A row with a null id links with nothing, has a
    null component and is kept. Other columns are not looked at.
    """
    sketches, known = _in_components(_rows(docs, id_col, text_col))
    linked = sketches.where(_NAMED).join(known, DIGEST).select("doc_id", "n_shingles", "component_id")
    alone = sketches.where(f"not ({_NAMED})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for every group of near-duplicates, all columns kept.

    It is the one with the least id; of several texts with that id one stays, and
    of rows that repeat it one. A row goes only if a near copy of its text
    stays: texts that are not alike stay under one id, and so do rows without an id or
    without words.
    """
    sketches, known = _in_components(_rows(docs, id_col, text_col))
    chosen = (
        known.where("first = component_id").groupBy("component").agg(F.min("rep").alias("rep"))
        .join(known.select("rep", "first", *DIGEST), "rep")
        .select(F.col("first").alias("doc_id"), *DIGEST)
    )
    # Equal ids and equal sets may still be different texts.
    texts = sketches.where(_NAMED).join(chosen, ["doc_id", *DIGEST]).groupBy("doc_id", *DIGEST)
    kept = texts.agg(F.min("text_hash").alias("__hash")).select(F.col("doc_id").alias("__id"), "__hash")
    text = F.col(f"`{text_col}`").cast("string")
    told = docs.withColumns({"__id": F.col(f"`{id_col}`").cast("long"), "__hash": F.xxhash64(text)})
    named = told.join(kept, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    # Without an id or without words nothing is a copy of anything.
    apart = told.where(F.col("__id").isNull() | ~F.coalesce(F.regexp_like(text, F.lit(_WORD)), F.lit(False)))
    return named.unionByName(apart).select(*docs.columns)


_WORD = r"[^\x20\x09-\x0D]"
