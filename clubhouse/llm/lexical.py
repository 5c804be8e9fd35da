"""Ranked lexical search: an inverted index in segments, and Block-Max MaxScore.

Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z
lowered. ``index`` writes one row per segment and term: its documents and
counts in blocks, and for every block the highest weight-free score in it.
A segment is some documents of one task, with about SEGMENT_BYTES of text, so building
it moves nothing between tasks.

``search`` looks every item up in every segment. The lists of an item are taken
by falling bound (weight times highest score). As long as the bounds of the lists
not yet taken add up to at least the score of the k-th best document, the next
lists are essential: all their documents become candidates. Then the remaining lists
are only asked about candidates, and a candidate whose score so far, its block's
bound and the bounds of the lists after it stay below that score is given up before
the block is decompressed. Every task keeps a heap for each item over all
its segments, and the heaps of all tasks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clubhouse.llm.words import buffer_of, slices
from clubhouse.session import written

#: Text of a segment and postings of a block.
SEGMENT_BYTES = 12 << 20
BLOCK = 64
#: Distinct (item, term) pairs that one search holds in every task: about 16 MB.
ROUND_TERMS = 400_000
#: Tasks of a search at most; each takes several segments if there are more.
_MOST_TASKS = 20_000

_TERM_BYTE = np.zeros(256, np.uint8)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM_BYTE[_first : _last + 1] = np.arange(_first, _last + 1)
_TERM_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)  # A-Z
_TERM_BYTE[_TERM_BYTE == 0] = 0x20

#: In the row of a segment's documents ``term`` is null, ``data`` has their ids,
#: ``block_top`` tells null ids and ``block_last`` has their length factors.
INDEX = (
    "segment string, term string, postings long, top long, block_last binary, block_top binary,"
    " block_end binary, data binary"
)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms of some texts: for every occurrence the number of its text and
    the number of its term, and the terms in the order of their numbers."""
    data, bounds = buffer_of(texts)
    plain = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(_TERM_BYTE[data])
    )
    cut = pc.ascii_split_whitespace(plain)
    coded = cut.flatten().dictionary_encode()
    term = coded.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), cut.value_lengths().to_numpy(zero_copy_only=False))
    empty = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:
        held = term != empty
        text, term = text[held], term[held]
    return text, term, coded.dictionary


def statistics(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = total = 0
        is_gap = _TERM_BYTE == 0x20
        for batch in batches:
            for texts in slices(batch.column(0)):
                data, bounds = buffer_of(texts)
                inside = ~is_gap[data]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                heads = bounds[:-1][bounds[:-1] < bounds[1:]]
                begins[heads] = inside[heads]
                counts = np.diff(np.concatenate([[0], np.cumsum(begins)])[bounds])
                documents += int((counts > 0).sum())
                total += int(counts.sum())
        yield pa.RecordBatch.from_pydict({"n": [documents], "l": [total]})

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l"))
    n, total = found.first()
    return n or 0, total or 0


def _packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in 7-bit groups, low ones first, and the bytes each one takes."""
    numbers = numbers.astype(np.uint64)
    sizes = np.ones(len(numbers), np.int64)
    for bits in range(7, 63, 7):
        more = numbers >= np.uint64(1) << np.uint64(bits)
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(sizes.max(initial=0))):
        has = sizes > i
        group = (numbers[has] >> np.uint64(7 * i)) & np.uint64(127)
        out[ends[has] - sizes[has] + i] = group.astype(np.uint8) | np.where(sizes[has] > i + 1, 128, 0).astype(np.uint8)
    return out, sizes


def _unpacked(data: np.ndarray) -> np.ndarray:
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def _scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count gives in a document of length factor m, before weighing."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_factor(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 25 + 25 n N / L, rounded down, of documents with n terms."""
    scaled = [(25 * x * n) // max(total, 1) for x in lengths.tolist()]  # beyond 64 bits if need be
    return np.array(scaled, np.int64) + 75


def _segment(name: str, doc_ids: pa.Array, texts: list[pa.Array], n: int, total: int) -> pa.RecordBatch:
    """The rows of a segment, its documents in ascending order of id."""
    order = pc.sort_indices(doc_ids, null_placement="at_end").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    text, term, words = terms_of(pa.concat_arrays(texts))
    lengths = np.bincount(rank[text], minlength=len(order))
    m = length_factor(lengths, n, total)

    key = term.astype(np.int64) * len(order) + rank[text]
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // len(order), key % len(order)
    firsts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([firsts, [len(term)]]))
    inside = np.arange(len(term)) - np.repeat(firsts, sizes)
    gaps = np.where(inside == 0, doc, doc - np.concatenate([[0], doc[:-1]]))
    score = _scores(tf, m[doc])

    data, taken = _packed(np.stack([gaps, tf], 1).ravel())
    after = np.cumsum(taken)[1::2]  # bytes after each posting
    blocks = np.flatnonzero(inside % BLOCK == 0)
    tails = np.concatenate([blocks[1:], [len(term)]]) - 1 if len(blocks) else blocks
    block_top = np.maximum.reduceat(score, blocks) if len(blocks) else score
    of_term = np.concatenate([[0], np.cumsum(-(-sizes // BLOCK))])
    begins = np.concatenate([[0], after[firsts[1:] - 1], after[-1:]]) if len(firsts) else np.zeros(1, np.int64)
    block_end = after[tails] - np.repeat(begins[:-1], np.diff(of_term)) if len(blocks) else tails

    def sliced(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values.tobytes())]
        ).cast(pa.binary())

    tops = np.maximum.reduceat(score, firsts) if len(firsts) else score
    ids = doc_ids.take(pa.array(order))
    rows = {
        "term": pa.concat_arrays([pa.nulls(1, pa.string()), words.cast(pa.string()).take(pa.array(term[firsts]))]),
        "postings": pa.array(np.concatenate([[len(order)], sizes])),
        "top": pa.array(np.concatenate([[0], tops])),
        "block_last": pa.concat_arrays([_binary(m.astype("<i8")), sliced(doc[tails].astype("<i4"), 4 * of_term)]),
        "block_top": pa.concat_arrays(
            [_binary(np.asarray(ids.is_null()).astype("u1")), sliced(block_top.astype("<i4"), 4 * of_term)]
        ),
        "block_end": pa.concat_arrays([_binary(np.zeros(0)), sliced(block_end.astype("<i4"), 4 * of_term)]),
        "data": pa.concat_arrays([_binary(np.asarray(pc.fill_null(ids, 0)).astype("<i8")), sliced(data, begins)]),
    }
    return pa.RecordBatch.from_pydict({"segment": pa.array([name] * len(rows["term"])), **rows})


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def index(docs: DataFrame, n: int, total: int, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the index of (doc_id, text); see INDEX. ``n`` and ``total`` are its statistics.

    All texts are indexed whole, null ones as empty; rows with one id are
    documents of their own. A text longer than a segment is a segment of its own.
    Other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        texts: list[pa.Array] = []
        size = 0
        for batch in batches:
            at = 0
            for piece in slices(batch.column(1)):
                if size and size + piece.nbytes > segment_bytes:
                    yield _segment(f"{part}-{number}", pa.concat_arrays(ids), texts, n, total)
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(batch.column(0).slice(at, len(piece)))
                texts.append(piece)
                at, size = at + len(piece), size + piece.nbytes
        if ids:
            yield _segment(f"{part}-{number}", pa.concat_arrays(ids), texts, n, total)

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(given.mapInArrow(run, INDEX))


class Postings:
    """The list of a term in a segment; blocks are decompressed when asked for."""

    def __init__(self, row: dict, m: np.ndarray):
        self.top, self.size = row["top"], row["postings"]
        self._m, self._row = m, row
        self._docs: np.ndarray | None = None

    def _open(self) -> None:
        if not hasattr(self, "last"):
            self.last = np.frombuffer(self._row["block_last"], "<i4")
            self.block_top = np.frombuffer(self._row["block_top"], "<i4")
            self._end = np.frombuffer(self._row["block_end"], "<i4")
            self._data = np.frombuffer(self._row["data"], np.uint8)
            self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _decoded(self, data: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        pairs = _unpacked(data)
        docs = np.cumsum(pairs[::2]) + before
        return docs, _scores(pairs[1::2], self._m[docs])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """All documents, ascending, with their scores before weighing."""
        if self._docs is None:
            self._open()
            self._docs, self._values = self._decoded(self._data, 0)
        return self._docs, self._values

    def blocks_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending documents: the block that could hold each, and its bound
        (0 beyond the last block)."""
        self._open()
        block = np.searchsorted(self.last, docs)
        return block, np.where(block < len(self.last), self.block_top[np.minimum(block, len(self.last) - 1)], 0)

    def scores_of(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Scores of documents in their blocks, 0 where the term is absent."""
        out = np.zeros(len(docs), np.int64)
        needed = np.unique(block[block < len(self.last)])
        if self._docs is None and 2 * len(needed) < len(self.last):
            self.decompressed = getattr(self, "decompressed", 0)
            for b in needed.tolist():
                if b not in self._blocks:
                    begin = int(self._end[b - 1]) if b else 0
                    before = int(self.last[b - 1]) if b else 0
                    self._blocks[b] = self._decoded(self._data[begin : int(self._end[b])], before)
                    self.decompressed += 1
                have, values = self._blocks[b]
                a, z = np.searchsorted(block, [b, b + 1])
                out[a:z] = _picked(have, values, docs[a:z])
            return out
        return _picked(*self.whole(), docs)


def _picked(have: np.ndarray, values: np.ndarray, docs: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(have, docs), len(have) - 1)
    return np.where(have[place] == docs, values[place], 0)


def best_of(lists: list[tuple[int, Postings]], size: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a segment that can be among the k best, with their scores.

    ``lists`` are (weight, postings), ``size`` the documents of the segment and
    ``least`` a score that k documents elsewhere reach. Documents below the
    k-th score are left out; all that reach it are there.
    """
    lists = sorted(((w, p, w * p.top) for w, p in lists if w > 0 and p.top > 0), key=lambda x: -x[2])
    after = np.concatenate([np.cumsum([b for *_, b in lists][::-1])[::-1], [0]]).astype(np.int64)
    seen = np.zeros(size, bool)
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bar = max(least, 1)
    at = 0
    # A document that is in the lists from `at` on only scores after[at] at most.
    while at < len(lists) and after[at] >= bar:
        # Essential lists, some at a time: as many as bring some new candidates.
        partial = np.zeros(size, np.int64)
        fresh = ~seen
        first, gathered = at, 0
        while at < len(lists) and after[at] >= bar and (at == first or gathered < 2 * k):
            weight, postings, _ = lists[at]
            have, values = postings.whole()
            partial[have] += weight * values
            gathered += len(have)
            at += 1
        new = np.flatnonzero(fresh & (partial > 0))
        seen[new] = True
        value = partial[new]
        for i in range(at, len(lists)):
            if not len(new):
                break
            weight, postings, _ = lists[i]
            block, bound = postings.blocks_of(new)
            hopeful = value + weight * bound + after[i + 1] >= bar
            if not hopeful.all():
                new, value, block = new[hopeful], value[hopeful], block[hopeful]
            value = value + weight * postings.scores_of(new, block)
        docs, scores = np.concatenate([docs, new]), np.concatenate([scores, value])
        if len(scores) >= k:
            bar = max(bar, int(np.partition(scores, -k)[-k]))
        keep = scores >= bar
        docs, scores = docs[keep], scores[keep]
    return docs, scores


class Heap:
    """The k best documents of an item so far; equal scores by id, null ids last."""

    def __init__(self, k: int):
        self._k, self.rows = k, []

    @property
    def least(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self._k else 0

    def add(self, found: list[tuple[int, int | None]]) -> None:
        self.rows += found
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        del self.rows[self._k :]


def _queries(items: DataFrame, rounds: int, number: int) -> tuple[list, dict[str, list[tuple[int, int]]]]:
    """One round's items, and for every term its items (by place) and repeats."""
    listed = items.where(F.col("round") == number).drop("round").toArrow()
    ids, terms = [], {}
    place: dict = {}
    for item, term, times in zip(*(listed[c].to_pylist() for c in ("item_id", "term", "times"))):
        if item not in place:
            place[item] = len(ids)
            ids.append(item)
        terms.setdefault(term, []).append((place[item], times))
    return ids, terms


def item_terms(items: DataFrame) -> DataFrame:
    """The terms of (item_id, text): item_id, term, times. Repeated rows count once;
    different texts of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                text, term, words = terms_of(texts)
                key, times = np.unique(text * max(len(words), 1) + term, return_counts=True)
                owner = batch.column(0).take(pa.array(at + key // max(len(words), 1)))
                word = words.cast(pa.string()).take(pa.array(key % max(len(words), 1)))
                yield pa.RecordBatch.from_pydict({"item_id": owner, "term": word, "times": pa.array(times)})
                at += len(texts)

    given = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    rows = given.mapInArrow(run, "item_id long, term string, times long")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def search(index: DataFrame, items: DataFrame, n: int, k: int = 20) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score.

    ``n`` is the number of documents with a term. Documents of score 0 are not
    there; equal scores go by ascending doc_id, null ids last. An item without
    text or terms has no row; a null item_id is an item too. Items are searched in
    rounds, so that a round's terms fit every task.
    """
    terms = written(item_terms(items))
    rounds = 1 + terms.count() // ROUND_TERMS
    terms = terms.withColumn("round", F.pmod(F.xxhash64("item_id"), F.lit(rounds)))
    found = [_search_round(index, terms, rounds, i, n, k) for i in range(rounds)]
    merged = found[0]
    for other in found[1:]:
        merged = merged.unionByName(other)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_round(index: DataFrame, terms: DataFrame, rounds: int, number: int, n: int, k: int) -> DataFrame:
    ids, asked = _queries(terms, rounds, number)
    names = F.broadcast(terms.where(F.col("round") == number).select("term").distinct())
    lists = index.where("term IS NOT NULL").join(names, "term", "left_semi")
    # One row per term of the round.
    weights = (
        lists.groupBy("term")
        .agg(F.sum("postings").alias("df"))
        .select("term", F.floor(1000 * F.log((F.lit(2.0 * n + 2)) / (2 * F.col("df") + 1))).alias("weight"))
        .toArrow()
    )
    weight = dict(zip(weights["term"].to_pylist(), weights["weight"].to_pylist()))
    # Item by item: (term, weight with repeats).
    wanted: list[list[tuple[str, int]]] = [[] for _ in ids]
    for term, users in asked.items():
        for place, times in users:
            if weight.get(term, 0) > 0:
                wanted[place].append((term, weight[term] * times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in ids]
        rows: list[dict] = []
        segment = None

        def done() -> None:
            head = next(r for r in rows if r["term"] is None)
            m = np.frombuffer(head["block_last"], "<i8")
            named = np.frombuffer(head["block_top"], "u1") == 0
            doc_ids = np.frombuffer(head["data"], "<i8")
            lists = {r["term"]: Postings(r, m) for r in rows if r["term"] is not None}
            for heap, parts in zip(heaps, wanted):
                mine = [(w, lists[t]) for t, w in parts if t in lists]
                if not mine:
                    continue
                docs, scores = best_of(mine, len(doc_ids), k, heap.least)
                named_ids = [i if is_id else None for i, is_id in zip(doc_ids[docs].tolist(), named[docs].tolist())]
                heap.add(list(zip(scores.tolist(), named_ids)))

        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] != segment and rows:
                    done()
                    rows = []
                segment = row["segment"]
                rows.append(row)
        if rows:
            done()
        out = [(ids[i], d, s) for i, heap in enumerate(heaps) for s, d in heap.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"]
        )

    documents = index.where("term IS NULL")
    parts = max(1, min(documents.count(), _MOST_TASKS))
    grouped = lists.unionByName(documents).repartition(parts, "segment").sortWithinPartitions("segment")
    return written(grouped.mapInArrow(run, "item_id long, doc_id long, score long"))
