"""Near-duplicate vectors by cosine similarity.

Equal vectors are put together first. Spherical k-means then divides the
directions into cells; the centres are fitted to a bounded sample. A vector's
home is the cell of the centre nearest to it. For vectors x at home in cell a
and y within a distance d of x, y.(c - c_a) <= d |c - c_a| holds for every
centre c, so y is also sent as a guest to every cell where that holds for the
centre of its own home and some others. Each of x and y would so be a guest of the
other; as one meeting is enough, guests go only to cells of a higher number than
their home. Each cell then holds all partners, at home there or in cells before it,
of the vectors at home there, and no pair is lost or met twice. Vectors travel in
packs, as the numbers of many in one row. Cells are compared in blocks of
bounded size by matrix products in double precision; a block reports numbers of
partners and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubhouse.llm.groups import by_group, components, forest
from clubhouse.session import written

THRESHOLD = 0.95
#: Vectors the centres are fitted to, and of a cell and of a block, about.
SAMPLE = 20_000
CELL = 2_000
BLOCK = 2_048
#: Vectors of a pack at most, and rows of a block that are compared at once.
PACK = 256
_PACKS = 64  # that a task hands over together
_STEP = 512
_ITERATIONS = 8
_PACK = pa.schema(
    [
        ("cell", pa.int32()), ("home", pa.bool_()), ("n", pa.int32()),
        ("v", pa.binary()), ("rep", pa.binary()), ("copies", pa.binary()),
    ]
)
#: Widens the guests' bound so that rounding loses nothing.
_SLACK = 1e-6


def usable(vector: Column) -> Column:
    """If a vector can have a cosine: no nulls, finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    nonzero = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.forall(vector, finite) & nonzero, F.lit(False))


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1 in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return _of_length_one(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _of_length_one(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no over- or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Centres of length 1; empty cells are dropped."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(_ITERATIONS):
        home = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(x, -(-len(x) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        sizes = np.sqrt((sums**2).sum(axis=1))
        centres = sums[sizes > 1e-9] / sizes[sizes > 1e-9, None]
    return np.unique(centres, axis=0)


def cells_of(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) for all cells where a vector must be present: its home, and
    cells of higher numbers that may have partners of it at home."""
    distance = np.sqrt(max(2 - 2 * threshold, 0)) + _SLACK
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    near = x @ centres.T
    home = near.argmax(axis=1)
    within = np.ones(near.shape, bool)
    # The bound for the nearest centres; each alone would do.
    for c in np.argsort(-near, axis=1)[:, :8].T:
        ahead = np.take_along_axis(near, c[:, None], 1) - near
        within &= ahead <= distance * apart[c] + _SLACK
    within &= np.arange(len(centres)) > home[:, None]
    within[np.arange(len(x)), home] = True
    row, cell = np.nonzero(within)
    return row, cell, home[row] == cell


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """Links, components and representatives of all vectors.

    Returns one row per row of ``vectors``: vec_id, n_links (other vectors with
    a cosine of at least ``threshold``), component_id (the least id reachable by
    links, its own included) and kept (vec_id = component_id). Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing,
    and vectors of different lengths do not link. Rows with equal ids are
    vectors of their own. A row with a null id does not link and is kept.
    Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("usable", usable(F.col("v")) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    # Distinct vectors go by numbers of their own: several may have the same least id.
    classes = written(
        rows.where("usable")
        .groupBy("v")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().collect()}  # by length of vector
    counts, links = [], []
    for length, n in sorted(sizes.items()):
        found = written(_compare(classes.where(F.size("v") == length), n, threshold))
        counts.append(found.where("other is null").groupBy("rep").agg(F.sum("partners").alias("partners")))
        links.append(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    empty = spark.createDataFrame([], "rep long, partners long")
    partners = _union(counts, empty)
    joined = written(components(_union(links, spark.createDataFrame([], "a long, b long"))))
    firsts = joined.join(classes.select(F.col("rep").alias("id"), "first"), "id")
    least = firsts.groupBy("component").agg(F.min("first").alias("least"))
    joined = joined.join(least, "component").select(F.col("id").alias("rep"), "least")
    known = (
        classes.join(partners, "rep", "left")
        .join(joined, "rep", "left")
        .select(
            "v",
            (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
            F.coalesce("least", "first").alias("component_id"),
        )
    )
    linked = rows.where("usable").join(known, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    for frame in frames:
        empty = empty.unionByName(frame)
    return empty


def _compare(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """Partners and forest links of n distinct vectors of one length.

    Rows (rep, partners, null) add up to the numbers of partners; rows
    (rep, null, other) are links of a spanning forest.
    """
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow()
    centres = spherical_kmeans(unit(sample["v"]), max(1, min(n // CELL, SAMPLE // 8)))
    length = centres.shape[1]
    shared = spark.sparkContext.broadcast(centres)  # SAMPLE / 8 rows at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                row, cell, home = cells_of(unit(batch.column(0)), shared.value, threshold)
                plain = _plain(batch.column(0))
                numbers = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
                order = np.lexsort((row, ~home, cell))
                row, cell, home = row[order], cell[order], home[order]
                cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (home[1:] != home[:-1])) + 1
                packs: list[tuple] = []
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)]):
                    for i in range(a, b, PACK):
                        part = row[i : min(i + PACK, b)]
                        data = (x[part].tobytes() for x in (plain, *numbers))
                        packs.append((int(cell[a]), bool(home[a]), len(part), *data))
                        if len(packs) == _PACKS:
                            yield _packed(packs)
                            packs = []
                yield _packed(packs)

    placed = written(
        classes.select("v", "rep", "copies").mapInArrow(
            place, "cell int, home boolean, n int, v binary, rep binary, copies binary"
        )
    )
    at_home, all_here = F.sum(F.when(F.col("home"), F.col("n"))), F.sum("n")
    blocks = placed.groupBy("cell").agg(
        F.ceil(at_home / BLOCK).cast("int").alias("rows"), F.ceil(all_here / BLOCK).cast("int").alias("cols")
    )
    # One row per cell, SAMPLE / 8 at most.
    blocks = blocks.where("rows > 0")
    # A pack is known by its vectors: no two at home in a cell, or guests there, share one.
    spread = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    both = placed.join(F.broadcast(blocks), "cell")
    packs = ["home", "n", "v", "rep", "copies"]
    homes = both.where("home").select(
        "cell", spread(F.col("rows")).alias("i"), F.explode(numbers("cols")).alias("j"), F.lit(True).alias("is_row"), *packs
    )
    others = both.select(
        "cell", F.explode(numbers("rows")).alias("i"), spread(F.col("cols")).alias("j"), F.lit(False).alias("is_row"), *packs
    )

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        is_row = table["is_row"].to_numpy()
        if is_row.all() or not is_row.any():
            return
        rows, cols = (_unpacked(table.filter(pa.array(side)), length) for side in (is_row, ~is_row))
        ids, node = np.unique(np.concatenate([rows.rep, cols.rep]), return_inverse=True)
        of_row, of_col = node[: len(rows.rep)], node[len(rows.rep) :]
        # Pairs of which both are at home meet from either side, a guest meets its partner once.
        partners = np.zeros(len(ids), np.int64)
        links = []
        for at in range(0, len(rows.rep), _STEP):
            here = slice(at, at + _STEP)
            linked = rows.v[here] @ cols.v.T >= threshold
            r, c = np.nonzero(linked)
            r += at
            apart = of_row[r] != of_col[c]
            r, c = r[apart], c[apart]
            np.add.at(partners, of_row[r], cols.copies[c])
            guest = ~cols.home[c]
            np.add.at(partners, of_col[c[guest]], rows.copies[r[guest]])
            label = forest([(of_row[r], of_col[c])], len(ids))
            joined = np.flatnonzero(label != np.arange(len(ids)))
            links.append((joined, label[joined]))
        some = np.flatnonzero(partners)
        if not len(some):
            return
        label = forest(links, len(ids))
        joined = np.flatnonzero(label != np.arange(len(ids)))
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[some], ids[joined]])),
                pa.concat_arrays([pa.array(partners[some]), none(len(joined))]),
                pa.concat_arrays([none(len(some)), pa.array(ids[label[joined]])]),
            ],
            ["rep", "partners", "other"],
        )

    return by_group(
        homes.unionByName(others), ["cell", "i", "j"], compare, "rep long, partners long, other long"
    )


def _packed(packs: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*packs)) if packs else [()] * len(_PACK)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACK)], schema=_PACK)


def _plain(column: pa.Array) -> np.ndarray:
    """Vectors of one length as they are, in single precision where that holds them exactly."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return short if (short == x).all() else x


@dataclass
class _Unpacked:
    v: np.ndarray
    rep: np.ndarray
    copies: np.ndarray
    home: np.ndarray


def _unpacked(packs: pa.Table, length: int) -> _Unpacked:
    """The vectors of some packs, with length 1, and what belongs to them."""
    sizes = packs["n"].to_numpy()
    parts = []
    for data, n in zip(packs["v"].to_pylist(), sizes.tolist()):
        kind = np.float32 if len(data) == 4 * n * length else np.float64
        parts.append(np.frombuffer(data, kind).astype(np.float64).reshape(n, length))
    rep, copies = (np.frombuffer(b"".join(packs[c].to_pylist()), np.int64) for c in ("rep", "copies"))
    return _Unpacked(_of_length_one(np.concatenate(parts)), rep, copies, np.repeat(packs["home"].to_numpy(), sizes))
