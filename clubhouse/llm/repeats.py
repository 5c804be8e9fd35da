"""Removing word sequences that have occurred before, anywhere in the corpus.

A window is WINDOW words in a row; it goes if the same words stand earlier: in a
document with a smaller id, or earlier in the same one. Each window has a
representative, the GRAM words in it with the least hash (the leftmost of
equals). Neighbouring windows mostly share theirs, so a text is a list of short
segments, each with all windows of one representative; equal windows always have
equal representatives. Only segments whose representative occurs more than once
matter. They are found with a bit map of fixed size and sent to their
representative: that is the shard whose texts can match them.

Equal segments are put together first; all but the earliest go as a whole. A
shard reads its distinct segments in order of first occurrence. It streams each
through the suffix automaton of those before it; the matching statistics say
which windows end in a match of at least WINDOW words. Then the segment joins
the automaton. A shard of more than SHARD segments is not read by one task: its
windows are sent out once more, by their words, and the earliest is an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubhouse.llm.groups import bit_map, by_group, in_bit_map
from clubhouse.llm.words import Words, shingle_hashes, slices
from clubhouse.session import written

WINDOW = 20
GRAM = 10
#: Distinct segments that one automaton holds at most.
SHARD = 500
#: Size of the bit map of repeated representatives. A fuller map lets more
#: segments through, and changes no result.
MAP_BITS = 1 << 27
#: Representatives that a task gathers before it sends them.
GATHERED = 4_000_000


class SuffixAutomaton:
    """The suffix automaton of some word sequences, which can grow."""

    def __init__(self) -> None:
        self._next: list[dict] = [{}]
        self._link = [-1]
        self._length = [0]

    def statistics(self, words: list) -> list[int]:
        """For every place, the length of the longest match that ends there."""
        following, link, length = self._next, self._link, self._length
        state = matched = 0
        result = []
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            else:
                matched = 0
            result.append(matched)
        return result

    def _copy(self, state: int, target: int, word) -> int:
        """A shorter twin of ``target``, for the ways that lead there from ``state`` up."""
        twin = len(self._length)
        self._length.append(self._length[state] + 1)
        self._next.append(dict(self._next[target]))
        self._link.append(self._link[target])
        self._link[target] = twin
        while state >= 0 and self._next[state].get(word) == target:
            self._next[state][word] = twin
            state = self._link[state]
        return twin

    def add(self, words: list) -> None:
        """Let the automaton also know all parts of a sequence."""
        last = 0
        for word in words:
            target = self._next[last].get(word)
            if target is not None:  # known from another sequence
                if self._length[target] != self._length[last] + 1:
                    target = self._copy(last, target, word)
                last = target
                continue
            new = len(self._length)
            self._length.append(self._length[last] + 1)
            self._next.append({})
            self._link.append(0)
            state = last
            while state >= 0 and word not in self._next[state]:
                self._next[state][word] = new
                state = self._link[state]
            if state >= 0:
                target = self._next[state][word]
                if self._length[target] != self._length[state] + 1:
                    target = self._copy(state, target, word)
                self._link[new] = target
            last = new


def segments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all texts: representative, text, first window (in words from
    the text's beginning) and number of windows."""
    gram = shingle_hashes(words.hash, GRAM)
    n = len(words.hash) - WINDOW + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty.astype(np.uint64), empty, empty, empty
    least, at = gram[:n].copy(), np.arange(n)
    for offset in range(1, WINDOW - GRAM + 1):
        other = gram[offset : offset + n]
        less = other < least
        least[less] = other[less]
        at[less] = np.flatnonzero(less) + offset
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())[:n]
    inside = words.first[text + 1] - np.arange(n) >= WINDOW
    begins = np.ones(n, bool)
    begins[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    begins &= inside
    start = np.flatnonzero(begins)
    # A segment ends where the next begins or where its text has no more windows.
    last_window = words.first[text[start] + 1] - WINDOW
    end = np.minimum(np.append(start[1:], n), last_window + 1)
    return least[start], text[start], start - words.first[text[start]], end - start


def _repeated(docs: DataFrame, buckets: int) -> DataFrame:
    """Representatives (m) of more than one segment."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            found, times = np.unique(np.concatenate(waiting), return_counts=True)
            bucket = (found % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                some = order[cuts[b] : cuts[b + 1]]
                if len(some):
                    again = found[some][times[some] > 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([found[some].tobytes() + again.tobytes()], pa.binary())],
                        ["bucket", "found"],
                    )

        for batch in batches:
            for texts in slices(batch.column(0)):
                waiting.append(segments(Words(texts))[0])
                held += len(waiting[-1])
                if held >= GATHERED:
                    yield from send()
                    waiting, held = [], 0
        if held:
            yield from send()

    def count(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = np.concatenate([np.frombuffer(x, np.uint64) for x in table["found"].to_pylist()])
        found, times = np.unique(found, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found[times > 1].view(np.int64))], ["m"])

    gathered = docs.select("text").mapInArrow(gather, "bucket int, found binary")
    return by_group(gathered, ["bucket"], count, "m long")


def _occurrences(docs: DataFrame, shared) -> DataFrame:
    """Segments whose representative may be repeated, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = 0
            for texts in slices(batch.column(2)):
                words = Words(texts)
                m, text, start, n = segments(words)
                some = np.flatnonzero(in_bit_map(bits, m))
                first = words.first[text[some]] + start[some]
                begin, end = words.starts[first], words.ends[first + n[some] + WINDOW - 2]
                data = words.data.tobytes()
                cut = [b" ".join(data[a:b].split()) for a, b in zip(begin.tolist(), end.tolist())]
                row = pa.array(at + text[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(m[some].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row),
                        pa.array(start[some].astype(np.int32)), pa.array(n[some].astype(np.int32)),
                        pa.array(cut, pa.binary()).cast(pa.string()),
                    ],
                    ["m", "doc_id", "text_hash", "start", "n", "words"],
                )
                at += len(texts)

    schema = "m long, doc_id long, text_hash int, start int, n int, words string"
    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, schema)


def _matched(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Windows of a shard's segments that occur in segments before them."""
    automaton, masks = SuffixAutomaton(), []
    for text in table["words"].to_pylist():
        words = text.split(" ")
        mask = 0
        for end, length in enumerate(automaton.statistics(words)):
            if length >= WINDOW:
                mask |= 1 << (end - WINDOW + 1)
        masks.append(mask)
        automaton.add(words)
    rows = pa.RecordBatch.from_arrays(
        [table[c].combine_chunks() for c in ("m", "s")] + [pa.array(masks, pa.int32())], ["m", "s", "mask"]
    )
    yield rows.filter(pa.array(np.array(masks) > 0))


def _windows(distinct: DataFrame) -> DataFrame:
    """The same for the segments of large shards, window by window."""
    words = F.split("words", " ")
    listed = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.array_join(F.slice(words, i + 1, WINDOW), " ")
    )
    windows = distinct.select("m", "s", "first", F.posexplode(listed).alias("i", "window")).select(
        "m", "s", "i", (F.col("first") + F.col("i")).cast("decimal(38,0)").alias("at"),
        F.xxhash64("window").alias("h1"), F.xxhash64(F.lit(1), "window").alias("h2"),
    )
    windows = written(windows)
    earliest = windows.groupBy("h1", "h2").agg(F.min("at").alias("earliest"))
    later = windows.join(earliest, ["h1", "h2"]).where("at > earliest")
    return later.groupBy("m", "s").agg(F.expr("bit_or(shiftleft(1, i))").alias("mask"))


def removed_windows(docs: DataFrame) -> DataFrame:
    """For (doc_id, text_hash, text): the windows that go, as rows doc_id,
    text_hash, start, n, mask: bit i stands for the window at start + i."""
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = bit_map(_repeated(docs, buckets), MAP_BITS)
    found = _occurrences(docs, spark.sparkContext.broadcast(bits))  # MAP_BITS, 16 MB
    found = written(found.withColumn("s", F.xxhash64("words")))
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)") + F.col("start")
    at = place.cast("decimal(38,0)")
    distinct = found.groupBy("m", "s", "words").agg(
        F.min(at).alias("first"), F.count(F.lit(1)).alias("times")
    )
    distinct = written(distinct)
    shards = distinct.groupBy("m").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    several = written(distinct.join(shards, "m"))
    small = several.where(F.col("texts") <= SHARD).select("m", "s", "first", "words")
    masks = by_group(small, ["m"], _matched, "m long, s long, mask int", order=["first"])
    large = several.where(F.col("texts") > SHARD)
    masks = masks.unionByName(_windows(large))
    verdicts = (
        distinct.select("m", "s", "first", "times").join(masks, ["m", "s"], "left")
        .where("times > 1 or mask is not null").select("m", "s", "first", "mask")
    )
    all_windows = F.expr("shiftleft(1, n) - 1")
    mask = F.when(at > F.col("first"), all_windows).otherwise(F.coalesce("mask", F.lit(0)))
    told = found.select("m", "s", "doc_id", "text_hash", "start", "n").join(verdicts, ["m", "s"])
    return told.select("doc_id", "text_hash", "start", "n", mask.alias("mask")).where("mask <> 0")


def _cut(texts: pa.Array, windows: list) -> tuple[np.ndarray, np.ndarray, list[bytes], list]:
    """Words, removed words, remaining text and removed byte spans of each text."""
    words = Words(texts, hashes=False)
    counts = words.counts()
    data, removed, kept, spans = words.data.tobytes(), np.zeros(len(texts), np.int64), [], []
    for i, given in enumerate(windows):
        a, b = int(words.bounds[i]), int(words.bounds[i + 1])
        if not given:
            kept.append(data[a:b])
            spans.append([])
            continue
        change = np.zeros(counts[i] + 1, np.int64)
        for w in given:
            for bit in range(w["n"]):
                if w["mask"] >> bit & 1:
                    change[w["start"] + bit] += 1
                    change[w["start"] + bit + WINDOW] -= 1
        gone = np.cumsum(change[:-1]) > 0
        removed[i] = gone.sum()
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        starts = np.append(words.starts[words.first[i] : words.first[i + 1]], b)
        cuts = [(int(starts[x]), int(starts[y])) for x, y in zip(edges[::2], edges[1::2])]
        parts, at = [], a
        for x, y in cuts:
            parts.append(data[at:x])
            at = y
        kept.append(b"".join([*parts, data[at:b]]))
        spans.append([{"begin": x - a, "end": y - a} for x, y in cuts])
    return counts, removed, kept, spans


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """Every text without the words of windows that have occurred earlier.

    Returns one row per row of ``docs``: doc_id, n_words, n_removed, kept_text
    (the text without the removed words and the white space after each run of
    them) and spans (what was cut: begin and end in bytes of the UTF-8 text). A
    null text has no words and gives an empty text. A null id counts as greater
    than all others. Rows with equal ids count as one document: a window at the
    same place of both is not earlier than itself. Windows are judged on the
    input, not on what is left. Other columns are not looked at; ``carry`` hands
    the whole row through as a struct, ``row``.
    """
    greatest = F.lit(2**63 - 1)
    carried = [F.col(f"`{c}`") for c in docs.columns if carry and c != text_col]
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), greatest).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.struct(*carried, F.lit(True).alias("__")).alias("row"),
    ).withColumn("text_hash", F.hash("text"))
    listed = (
        removed_windows(rows).groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("start", "n", "mask")).alias("windows"))  # of one document
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                windows = batch.column(2).slice(at, len(texts)).to_pylist()
                n, removed, kept, spans = _cut(texts, windows)
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), pa.array(n), pa.array(removed),
                        pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind),
                        batch.column(3).slice(at, len(texts)),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_text", "spans", "row"],
                )
                at += len(texts)

    kind = rows.schema["row"].dataType.simpleString()
    schema = f"""doc_id long, n_words long, n_removed long, kept_text string,
    spans array<struct<begin: long, end: long>>, row {kind}"""
    joined = rows.join(listed, ["doc_id", "text_hash"], "left")
    result = joined.select("id", "text", "windows", "row").mapInArrow(run, schema)
    return result if carry else result.drop("row")
