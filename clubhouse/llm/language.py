"""Language identification with error-correcting output codes.

Every language has a codeword of bits. One binary classifier per bit scores the
byte n-grams of a text: the log odds of an n-gram among the languages whose bit
is 1 against the others, learnt from the counts of all labelled texts. Decoding
adds up, for every codeword, the logistic losses of the classifiers' margins on
its bits, and takes the language with the least loss; when two are close, the
text is flagged as ambiguous.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubhouse.llm.words import SLICE_BYTES, buffer_of, slices

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
#: Counts of this many n-grams travel in one row.
_BLOCK = 1 << 12
#: Two languages whose losses differ by less are too close to tell.
CLOSE = 2.0
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def held_out(id_col: str, parts: int, part: int) -> Column:
    """If a row is kept from learning. A null id counts as empty text."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % parts == part


def ngrams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the buckets of all n-grams, by place; BUCKETS where an
    n-gram would reach into the next text. And the bounds of the texts."""
    data, bounds = buffer_of(texts)
    folded = _FOLD[data].astype(np.uint32)
    found, code = [], folded.copy()
    for order in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint32(257) + folded[order - 1 :] if len(code) > 1 else code[:0]
        if order in ORDERS:
            mixed = (code ^ (code >> np.uint32(13))) * np.uint32(0x9E3779B1)
            bucket = np.full(len(folded), BUCKETS, np.int32)
            bucket[: len(code)] = mixed >> np.uint32(32 - 15)
            for back in range(1, order):
                ends = bounds[1:] - back
                bucket[ends[ends >= bounds[:-1]]] = BUCKETS
            found.append(bucket)
    return found, bounds


def count_ngrams(labelled: DataFrame) -> dict[str, np.ndarray]:
    """n-gram counts of every language over all rows of (text, lang)."""
    schema = "lang string, block int, counts binary"

    def rows(lang: str, counts: np.ndarray) -> dict:
        blocks = counts.reshape(-1, _BLOCK)
        return {
            "lang": pa.array([lang] * len(blocks), pa.string()),
            "block": pa.array(range(len(blocks)), pa.int32()),
            "counts": pa.array([b.tobytes() for b in blocks], pa.binary()),
        }

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = defaultdict(lambda: np.zeros(len(ORDERS) * BUCKETS, np.int64))
        for batch in batches:
            langs = batch.column(1)
            for lang in langs.unique().to_pylist():
                chosen = batch.column(0).filter(pc.equal(langs, lang))
                for texts in slices(chosen):
                    for i, bucket in enumerate(ngrams(texts)[0]):
                        part = np.bincount(bucket, minlength=BUCKETS + 1)[:BUCKETS]
                        sums[lang][i * BUCKETS : (i + 1) * BUCKETS] += part
        for lang, counts in sums.items():
            yield pa.RecordBatch.from_pydict(rows(lang, counts))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for lang, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(data, np.int64)
                sums[lang, block] = sums[lang, block] + counts if (lang, block) in sums else counts
        for (lang, block), counts in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang], "block": pa.array([block], pa.int32()), "counts": [counts.tobytes()]}
            )

    added = labelled.mapInArrow(count, schema).repartition("lang", "block").mapInArrow(add, schema)
    result: dict = defaultdict(lambda: np.zeros(len(ORDERS) * BUCKETS, np.int64))
    for row in added.toLocalIterator():  # a fixed number of rows for every language
        result[row[0]][row[1] * _BLOCK : (row[1] + 1) * _BLOCK] = np.frombuffer(row[2], np.int64)
    return dict(result)


def codewords(n: int) -> np.ndarray:
    """n different codewords of bits -1 and 1, a row each, far from each other.

    All ways to split up to seven languages in two; for more, the best of some
    seeded draws of about ten bits for every doubling.
    """
    if n <= 7:
        splits = range(1, 1 << max(n - 1, 0))
        rows = [[1 if k == 0 else (1 if s >> (k - 1) & 1 == 0 else -1) for s in splits] for k in range(n)]
        return np.array(rows, np.float64).reshape(n, len(splits))
    bits = int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for seed in range(64):
        rng = np.random.default_rng(seed)
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        near = code @ code.T - 2 * bits * np.eye(n)
        if (gap := bits - near.max()) > apart:
            best, apart = code, gap
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # orders x (BUCKETS + 1) x bits


def learn(labelled: DataFrame) -> Model:
    """Fit the classifiers to all rows of (text, lang) with neither of them null.

    Each language weighs the same, however many texts it has.
    """
    known = labelled.where("text is not null and lang is not null")
    counts = count_ngrams(known.select(F.col("text").cast("string"), F.col("lang").cast("string")))
    languages = sorted(k for k, v in counts.items() if v.sum())
    code = codewords(len(languages))
    weights = np.zeros((len(ORDERS), BUCKETS + 1, code.shape[1] if code.size else 0), np.float32)
    if code.size:
        shares = np.stack([counts[k].reshape(len(ORDERS), BUCKETS) for k in languages]) + 0.5
        shares = shares / shares.sum(axis=2, keepdims=True)
        for bit in range(code.shape[1]):
            ones, zeros = shares[code[:, bit] > 0], shares[code[:, bit] < 0]
            weights[:, :BUCKETS, bit] = np.log(ones.mean(axis=0)) - np.log(zeros.mean(axis=0))
    return Model(languages, code, weights / len(ORDERS))


def margins(model: Model, texts: pa.Array) -> np.ndarray:
    """The classifiers' margins for every text."""
    found, bounds = ngrams(texts)
    result = np.zeros((len(texts), model.weights.shape[2]))
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    step = SLICE_BYTES >> 2
    for i, bucket in enumerate(found):
        for at in range(0, len(bucket), step):  # a long text's parts add up
            to = min(at + step, len(bucket))
            inside = some[(bounds[some + 1] > at) & (bounds[some] < to)]
            starts = np.maximum(bounds[inside] - at, 0)
            result[inside] += np.add.reduceat(model.weights[i][bucket[at:to]], starts, axis=0)
    return result


def has_letter(texts: pa.Array) -> np.ndarray:
    """If a text has a letter of any script."""
    data, bounds = buffer_of(texts)
    ascii_before = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = ascii_before[bounds[1:]] > ascii_before[bounds[:-1]]
    for i in np.flatnonzero(~found & (bounds[1:] > bounds[:-1])):
        found[i] = any(c.isalpha() for c in texts[i].as_py())
    return found


def decide(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of every text."""
    n = len(texts)
    if not model.languages:
        return [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool)
    losses = np.zeros((n, len(model.languages)))
    if model.code.shape[1]:
        m = margins(model, texts)
        for k, word in enumerate(model.code):
            losses[:, k] = np.logaddexp(0, -m * word).sum(axis=1)
    best = losses.argmin(axis=1)
    least = losses[np.arange(n), best]
    score = 1 / np.exp(least[:, None] - losses).sum(axis=1)
    ordered = np.sort(losses, axis=1)
    close = ordered[:, 1] - ordered[:, 0] < CLOSE if losses.shape[1] > 1 else np.zeros(n, bool)
    letters = has_letter(texts)
    langs = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
    return langs, np.where(letters, score, 0.0), close | ~letters


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every text, from the text alone.

    Returns doc_id, lang_pred, score (0 to 1) and ambiguous, a row for each row
    of ``docs``. A null text, one without a letter, or a model that learnt no
    language gives ``und`` with score 0. Equal texts get equal languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # orders x buckets x bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                langs, score, close = decide(shared.value, texts)
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array(langs, pa.string()), pa.array(score), pa.array(close),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "ambiguous"])
                at += len(texts)

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
