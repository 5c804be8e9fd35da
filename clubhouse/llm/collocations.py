"""Phrases that occur together more often than their parts suggest.

A text is cut into pieces at punctuation and line ends, a piece into words. All
counts are per language. A phrase of 2 to 5 words scores as low as its weakest
cut into a first part and a rest:

    score = min over cuts of floor(1000 f(phrase) n / (f(first) f(rest)))

No phrase scores above floor(1000 n / f(w)) for its first word w: the cut after
w gives 1000 f(phrase) n / (f(w) f(rest)), and the rest occurs at least as often
as the phrase. So a word's count bounds the whole tree of phrases that begin
with it, and the trees are grown best first: rare words, with high bounds, in the
first wave, and in the second one only words whose bound still reaches the score of
the last phrase that survived. What is left cannot come up to it.

A wave grows its trees word by word. A pass over the texts counts the next word
after every phrase of the frontier; a phrase goes on only if it is frequent. One
more pass counts what the phrases are compared with: their rests, and the words
before them. A phrase is dropped if a longer one that holds it is as frequent;
then a phrase with one word more, before or after, is too, so those two
counts settle it.

Words and phrases are 64-bit numbers in the passes, a language and a word
making one. A map of fixed size tells a task which phrases to look at; what it
lets through by chance goes in the joins that follow. With a billion different
words the odds that one of a million frequent ones shares its number are 1 in 10,000.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clubhouse.llm.groups import bit_map, in_bit_map
from clubhouse.llm.words import _BYTE, _PLACE, _power_tables, buffer_of, mix, shingle_hashes, slices
from clubhouse.session import written

LONGEST = 5
LEAST = 100
KEPT = 2000
#: Share of a language's words that the trees of the first wave begin with.
FIRST_SHARE = 0.1
#: Bits of the maps that tell frequent words and the phrases to look at: 4 MB each.
MAP_BITS = 1 << 25
#: Different counted keys that a task holds before it hands them on.
HELD = 1 << 21

_WORD, _GAP, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[_KIND != _WORD] = 0x20
_VALUE = _BYTE[_PLAIN]
_VALUE[_KIND != _WORD] = 0


def _hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at some places; what is between them counts nothing."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverse = _power_tables(len(data))
    return mix(np.add.reduceat(_VALUE[data] * powers, starts) * inverse[starts])


def _languages(langs: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of every text's language (null: ``und``), and the languages."""
    coded = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _salts(langs: pa.Array) -> np.ndarray:
    """A number for every language, the same in all tasks."""
    return np.array([xxhash.xxh64_intdigest(name) for name in langs.to_pylist()], np.uint64)


def _word_ids(hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return mix(hashes ^ (salt * np.uint64(0x9E3779B97F4A7C15)))


class Sequence:
    """The words of some texts as numbers, and the piece that each one is in."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, bounds = buffer_of(texts)
        kind = _KIND[data]
        inside = kind == _WORD
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[heads] = inside[heads]
        starts = np.flatnonzero(begins)
        cuts = kind == _BREAK
        # A break may stand where a text begins; either way a new piece does.
        cuts[heads] = True
        lang, names = _languages(langs)
        text = np.searchsorted(bounds, starts, "right") - 1
        self.piece = np.cumsum(cuts)[starts]
        self.words = _word_ids(_hashes(data, starts), _salts(names)[lang[text]])

    def phrases(self, k: int) -> np.ndarray:
        """The phrase of k words that begins at each word, whatever pieces they are in."""
        return shingle_hashes(self.words, k)

    def together(self, k: int) -> np.ndarray:
        """True where k words from here are in one piece."""
        n = max(0, len(self.words) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]


def count_words(docs: DataFrame) -> DataFrame:
    """All words: lang, word, id, f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(0)):
                lang, names = _languages(batch.column(1).slice(at, len(texts)))
                at += len(texts)
                data, bounds = buffer_of(texts)
                plain = pa.LargeStringArray.from_buffers(
                    len(texts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(_PLAIN[data])
                )
                cut = pc.ascii_split_whitespace(plain)
                coded = cut.flatten().dictionary_encode()
                word, listed = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
                lang = np.repeat(lang, cut.value_lengths().to_numpy(zero_copy_only=False))
                key, f = np.unique(word.astype(np.int64) * len(names) + lang, return_counts=True)
                word, lang = key // max(len(names), 1), key % max(len(names), 1)
                filled = np.asarray(pc.not_equal(listed, pa.scalar("", pa.large_string())))[word]
                word, lang, f = word[filled], lang[filled], f[filled]
                letters, ends = buffer_of(listed)
                hashes = _each_hash(letters, ends[:-1], np.diff(ends))
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": names.take(pa.array(lang)),
                        "word": listed.cast(pa.string()).take(pa.array(word)),
                        "id": pa.array(_word_ids(hashes[word], _salts(names)[lang]).view(np.int64)),
                        "f": pa.array(f),
                    }
                )

    rows = docs.select("text", "lang").mapInArrow(run, "lang string, word string, id long, f long")
    return rows.groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def _each_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of words that stand next to each other; 0 for one without bytes."""
    out = np.zeros(len(starts), np.uint64)
    out[lengths > 0] = _hashes(data, starts[lengths > 0])
    return out


class _Tally:
    """Counts rows of numbers and hands them on when there are many."""

    def __init__(self, names: list[str]):
        self._names, self._parts, self._held = names, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows whose first column tells them apart."""
        key, first, f = np.unique(columns[0], return_index=True, return_counts=True)
        self._parts.append([key, *[c[first] for c in columns[1:]], f])
        self._held += len(key)
        if self._held > HELD:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self._held:
            *columns, f = [np.concatenate(c) for c in zip(*self._parts)]
            key, first, back = np.unique(columns[0], return_index=True, return_inverse=True)
            f = np.bincount(back, f, len(key)).astype(np.int64)
            arrays = [key, *[c[first] for c in columns[1:]], f]
            self._parts, self._held = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)) for a in arrays], names=[*self._names, "f"]
            )


def _passed(docs: DataFrame, names: list[str], rows_of: Callable[[Sequence], Iterator[tuple]]) -> DataFrame:
    """Count rows that ``rows_of`` gives for the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(names)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(0)):
                sequence = Sequence(texts, batch.column(1).slice(at, len(texts)))
                at += len(texts)
                for columns in rows_of(sequence):
                    yield from tally.add(*columns)
        yield from tally.rest()

    schema = ", ".join(f"{c} long" for c in [*names, "f"])
    rows = docs.select("text", "lang").mapInArrow(run, schema)
    return rows.groupBy(*names).agg(F.sum("f").alias("f"))


def _extended(docs: DataFrame, k: int, prefixes: np.ndarray, frequent: np.ndarray, least: int) -> DataFrame:
    """Frequent phrases of a known prefix of k words and one word: h, p, x, f."""

    def rows_of(s: Sequence) -> Iterator[tuple]:
        at = np.flatnonzero(s.together(k + 1))
        at = at[in_bit_map(frequent, s.words[at + k])]
        prefix = s.phrases(k)[at]
        known = in_bit_map(prefixes, prefix)
        at, prefix = at[known], prefix[known]
        if len(at):
            yield s.phrases(k + 1)[at], prefix, s.words[at + k]

    return _passed(docs, ["h", "p", "x"], rows_of).where(F.col("f") >= least)


def _context(docs: DataFrame, rests: np.ndarray, phrases: np.ndarray, longest: int) -> DataFrame:
    """Counts of wanted phrases (p null), and of phrases with the word before them (p)."""

    def rows_of(s: Sequence) -> Iterator[tuple]:
        for k in range(2, longest):
            here = s.phrases(k)
            whole = s.together(k)
            wanted = here[whole & in_bit_map(rests, here)]
            if len(wanted):
                yield wanted, np.zeros(len(wanted), np.uint64), np.zeros(len(wanted), np.int64)
            before = np.flatnonzero(s.together(k + 1))
            before = before[in_bit_map(phrases, here[before + 1])]
            if len(before):
                longer = s.phrases(k + 1)[before]
                # The longer phrase as such may be wanted as well: tell the two apart.
                yield mix(longer ^ np.uint64(1)), here[before + 1], np.ones(len(before), np.int64)

    return _passed(docs, ["h", "p", "before"], rows_of)


def _with_rests(phrases: DataFrame) -> DataFrame:
    """For every phrase and cut k with a rest of two words or more: h, k, l, s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, words, pre = batch.columns
            sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            for m in np.unique(sizes).tolist():
                mine = pa.array(np.flatnonzero(sizes == m))
                ids = pc.list_flatten(words.take(mine)).to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, m)
                first = pc.list_flatten(pre.take(mine)).to_numpy(zero_copy_only=False).reshape(-1, m - 1)
                for k in range(1, m - 1):
                    total = np.zeros(len(ids), np.uint64)
                    for i in range(m - k):
                        total += ids[:, k + i] * _PLACE[i]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "h": h.take(mine),
                            "k": pa.array(np.full(len(ids), k, np.int32)),
                            "l": pa.array(first[:, k - 1]),
                            "s": pa.array(mix(total).view(np.int64)),
                        }
                    )

    return phrases.select("h", "words", "pre").mapInArrow(run, "h long, k int, l long, s long")


def _roots(words: DataFrame) -> DataFrame:
    """Single words as phrases: their number as a phrase, counts, language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(ids * _PLACE[0]).view(np.int64)), *batch.columns], names=["h", "id", "f", "lang", "n"]
            )

    rows = words.select("id", "f", "lang", "n").mapInArrow(run, "h long, id long, f long, lang string, n long")
    none = F.array().cast("array<long>")
    return rows.select("h", "f", "lang", "n", F.array("id").alias("words"), none.alias("pre"))


def _grown(docs: DataFrame, roots: DataFrame, frequent: np.ndarray, least: int, longest: int, bits: int) -> DataFrame:
    """All frequent phrases of 2 words or more that begin with the roots:
    h, f, lang, n, words, pre (counts of the first words), p (the phrase without its last word)."""
    levels, frontier = [], roots
    for k in range(1, longest):
        prefixes = bit_map(frontier.select(F.col("h").alias("m")), bits)
        if not prefixes.any():
            break
        counted = _extended(docs, k, prefixes, frequent, least)
        parents = frontier.select(F.col("h").alias("p"), F.col("f").alias("fp"), "lang", "n", "words", "pre")
        frontier = written(
            counted.join(parents, "p").select(
                "h", "f", "lang", "n",
                F.concat("words", F.array("x")).alias("words"),
                F.concat("pre", F.array("fp")).alias("pre"),
                "p",
            )
        )
        levels.append(frontier)
    if not levels:
        return roots.withColumn("p", F.lit(None).cast("long")).limit(0)
    return reduce(DataFrame.unionByName, levels)


def _score() -> Column:
    """floor(1000 f n / (l r)), exactly."""
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("f", "n", "l", "r")}
    above = (F.lit(1000).cast("decimal(38,0)") * wide["f"]).cast("decimal(38,0)") * wide["n"]
    below = wide["l"] * wide["r"]
    return F.call_function("div", above.cast("decimal(38,0)"), below.cast("decimal(38,0)"))


def _survivors(docs: DataFrame, grown: DataFrame, words: DataFrame, longest: int, bits: int) -> DataFrame:
    """The phrases that no longer one stands for, with their weakest cut:
    h, lang, n, f, words, l, r, score."""
    rests = written(_with_rests(grown))
    shorter = grown.where(F.size("words") < longest)
    maps = [bit_map(x.select(F.col(c).alias("m")), bits) for x, c in ((rests, "s"), (shorter, "h"))]
    context = written(_context(docs, *maps, longest))
    known = context.where("before = 0").select(F.col("h").alias("s"), F.col("f").alias("r"))
    last = F.element_at("words", -1).alias("id")
    cuts = rests.join(known, "s").select("h", "k", "l", "r")
    ends = grown.select("h", (F.size("words") - 1).alias("k"), F.element_at("pre", -1).alias("l"), last)
    ends = ends.join(words.select("id", F.col("f").alias("r")), "id").select("h", "k", "l", "r")
    cut = F.struct(F.col("k"), F.col("l"), F.col("r"))
    listed = cuts.unionByName(ends).groupBy("h").agg(F.collect_list(cut).alias("cuts"))  # four at most
    # The most frequent phrase that is longer by a word, after or before.
    after = grown.groupBy(F.col("p").alias("h")).agg(F.max("f").alias("longer"))
    before = context.where("before = 1").groupBy(F.col("p").alias("h")).agg(F.max("f").alias("longer"))
    longer = after.unionByName(before).groupBy("h").agg(F.max("longer").alias("longer"))
    alone = (
        grown.join(longer, "h", "left")
        .where((F.size("words") == longest) | F.col("longer").isNull() | (F.col("longer") < F.col("f")))
        .join(listed, "h")
        .select("h", "lang", "n", "f", "words", F.explode("cuts").alias("cut"))
        .select("h", "lang", "n", "f", "words", "cut.*")
    )
    weakest = alone.withColumn("score", _score()).groupBy("h").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("least"),
        *[F.any_value(c).alias(c) for c in ("lang", "n", "f", "words")],
    )
    return written(weakest.select("h", "lang", "n", "f", "words", "least.l", "least.r", "least.score"))


def _bounded(words: DataFrame) -> DataFrame:
    """Words with the highest score that a phrase beginning with them can have."""
    bound = F.call_function("div", F.lit(1000).cast("decimal(38,0)") * F.col("n"), F.col("f").cast("decimal(38,0)"))
    return words.withColumn("bound", bound)


def _first_wave(words: DataFrame, share: float) -> DataFrame:
    """The count up to which words are in the first wave: lang, most.

    The rarest words, until they make up a share of all words of the language.
    """
    counts = words.groupBy("lang", "n", "f").agg((F.count(F.lit(1)) * F.col("f")).alias("mass"))
    rarer = Window.partitionBy("lang").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("below", F.coalesce(F.sum("mass").over(rarer), F.lit(0)))
    return below.where(F.col("below") <= share * F.col("n")).groupBy("lang").agg(F.max("f").alias("most"))


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    kept: int = KEPT,
    longest: int = LONGEST,
    share: float = FIRST_SHARE,
    bits: int = MAP_BITS,
) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    A candidate has 2 to ``longest`` words and occurs ``least`` times or more; a is
    how often, l and r are the counts of the two parts of its weakest cut, of
    equal cuts the first. Ranks go by score and a, falling, then by phrase in byte order.
    Needs the columns text and lang; a null text is empty, a null lang is ``und``;
    repeated rows count as often as they occur, other columns do not matter, and an
    empty table gives no rows.
    """
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    every = written(count_words(docs))
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = written(every.where(F.col("f") >= least).join(totals, "lang"))
    frequent = bit_map(words.select(F.col("id").alias("m")), bits)
    words = _bounded(words)
    waved = written(words.join(_first_wave(words, share), "lang").withColumn("early", F.col("f") <= F.col("most")))

    def survivors(roots: DataFrame) -> DataFrame:
        grown = _grown(docs, _roots(roots), frequent, least, longest, bits)
        return _survivors(docs, grown, words, longest, bits)

    early = survivors(waved.where("early"))
    # The score to reach: that of the last phrase kept so far, if there are so many.
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "h")
    bar = early.withColumn("place", F.row_number().over(best)).where(F.col("place") <= kept)
    bar = bar.where(F.col("place") == kept).select("lang", F.col("score").alias("bar"))
    late = waved.where("NOT early").join(bar, "lang", "left")
    late = written(late.where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar"))).drop("bar"))
    found = early.unionByName(survivors(late))

    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"))
    top = found.withColumn("place", F.rank().over(first)).where(F.col("place") <= kept)
    placed = top.select("h", "lang", "n", "f", "l", "r", "score", F.posexplode("words").alias("i", "id"))
    spelled = placed.join(words.select("id", "word"), "id").groupBy("h", "lang", "n", "f", "l", "r", "score").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("i", "word"))).getField("word"), " ").alias("phrase")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= kept)
    return ranked.select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
