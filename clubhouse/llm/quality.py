"""A quality classifier by co-training.

Two views of a document are judged by classifiers of their own: its content
(byte n-grams of the text) and its page metadata (source, language, size and
layout). Both learn from the labelled documents. Then, over some rounds, each
says which unlabelled documents it is most sure of, and the other learns from
these as well. At the end each view is calibrated on labelled documents that no
classifier has seen, and the calibrated views are combined.

The classifiers are fitted on the driver to at most LABELLED labelled documents,
chosen by a hash of the id, and to what is handed over. In every round tasks score all
unlabelled documents and report those they are most sure of; only the best few of these, and only as
features of fixed size, reach the driver. At the end every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clubhouse.llm.words import SLICE_BYTES, Words, slices
from clubhouse.session import written

#: Labelled documents for fitting, and rounds of exchange.
LABELLED = 4000
ROUNDS = 3
#: A view hands over the documents that it is most sure of among all unlabelled
#: ones: so many of each class in a round, if it is as sure as this.
HANDED = 150
SURE = 0.95
#: Documents whose features reach the driver together, some 5 MB.
PIECE = 512
#: Rows of labels that may be broadcast: ids alone, 8 bytes each.
KNOWN_ROWS = 1_000_000
GRAMS = 1 << 11
_SHAPE = 9
CONTENT = _SHAPE + 256 + GRAMS
CATEGORIES = 64
_NUMBERS = 6
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def content_features(texts: pa.Array) -> np.ndarray:
    """What whole texts are made of: shares of repeated words, capitals, digits
    and other signs; square roots of the shares of bytes and of hashed byte pairs
    and triples. An empty text has none."""
    rows = []
    for part in slices(texts):
        words = Words(part, lower=True)
        again = np.zeros(len(words.hash), bool)
        again[1:] = words.hash[1:] == words.hash[:-1]
        lone = (words.ends - words.starts == 1) & ~_LETTER[words.data[words.starts]]
        for i, (a, b) in enumerate(zip(words.bounds, words.bounds[1:])):
            data, own = words.data[a:b], slice(words.first[i], words.first[i + 1])
            single = np.bincount(data, minlength=256)
            grams = np.zeros(GRAMS, np.int64)
            for at in range(0, len(data), SLICE_BYTES):  # a very long text in parts, two bytes shared
                for code in _gram_codes(data[at : at + SLICE_BYTES + 2].astype(np.uint32)):
                    grams += np.bincount(code, minlength=GRAMS)
            n, size = max(own.stop - own.start, 1), max(len(data), 1)
            shape = [
                again[own.start + 1 : own.stop].sum() / n,
                len(np.unique(words.hash[own])) / n,
                size / n / 10 if len(data) else 0,
                single[65:91].sum() / size,
                single[48:58].sum() / size,
                (single[33:48].sum() + single[58:65].sum() + single[91:97].sum() + single[123:127].sum()) / size,
                single[10] / size,
                (single[46] + single[44]) / size,
                lone[own].sum() / n,
            ]
            rows.append(np.concatenate([shape, np.sqrt(single / size), np.sqrt(grams / max(grams.sum(), 1))]))
    return np.array(rows, np.float32).reshape(-1, CONTENT)


def _gram_codes(data: np.ndarray) -> Iterator[np.ndarray]:
    code = data
    for order in (1, 2):
        if len(code) < 2:
            return
        code = code[:-1] * np.uint32(257) + data[order:]
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        yield mixed >> np.uint32(32 - 11)


def metadata_features(texts: pa.Array, langs: list, sources: list) -> np.ndarray:
    """Hashed source and language, sizes, and layout of the lines."""
    rows = np.zeros((len(langs), 2 * CATEGORIES + _NUMBERS), np.float32)
    for i, (text, lang, source) in enumerate(zip(texts.to_pylist(), langs, sources)):
        rows[i, crc32(f"l{lang}".encode()) % CATEGORIES] = 1
        rows[i, CATEGORIES + crc32(f"s{source}".encode()) % CATEGORIES] = 1
        lines = (text or "").split("\n")
        sizes = [len(line) for line in lines]
        rows[i, 2 * CATEGORIES :] = [
            np.log1p(sum(sizes)) / 10,
            np.log1p(len(lines)) / 5,
            np.log1p(max(sizes)) / 10,
            np.log1p(sum(sizes) / len(sizes)) / 10,
            np.std(sizes) / (1 + sum(sizes) / len(sizes)),
            len(set(lines)) / len(lines),
        ]
    return rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Linear:
    """Logistic regression on scaled features."""

    weights: np.ndarray
    bias: float
    scale: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ (self.weights * self.scale) + self.bias


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 200) -> Linear:
    """Fit by accelerated gradient steps; both classes weigh the same. The many
    hashed features count for less than the few others."""
    # Some columns at a time: a copy of all features is made once, as z.
    spread = np.concatenate([x[:, at : at + 128].std(axis=0) for at in range(0, x.shape[1], 128)])
    scale = (1 / np.maximum(spread, 1e-2)).astype(np.float32)
    if x.shape[1] == CONTENT:
        scale[_SHAPE : _SHAPE + 256] *= 0.3
        scale[_SHAPE + 256 :] *= 0.05
    z = x.astype(np.float32, copy=False) * scale
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    # Single precision throughout: a mixed product would copy all features.
    w, b = np.zeros(z.shape[1], np.float32), 0.0
    ahead, ahead_b = w, b
    rate = 4 / (float((weight * np.einsum("ij,ij->i", z, z)).sum()) + 1 + ridge)
    for t in range(1, steps + 1):
        error = ((_sigmoid(z @ ahead + ahead_b) - y) * weight).astype(np.float32)
        new, new_b = ahead - rate * (error @ z + ridge * ahead), ahead_b - rate * float(error.sum())
        push = t / (t + 3)
        ahead, ahead_b = new + push * (new - w), new_b + push * (new_b - b)
        w, b = new, new_b
    return Linear(w.astype(np.float32), float(b), scale)


@dataclass
class Model:
    content: Linear
    metadata: Linear
    #: Slope and intercept that calibrate each view, and weights that combine both.
    calibration: np.ndarray
    combination: np.ndarray

    def scores(self, texts: pa.Array, langs: list, sources: list) -> np.ndarray:
        """Probabilities of good quality: both views together, content, metadata."""
        views = np.stack(
            [
                self.content.logit(content_features(texts)),
                self.metadata.logit(metadata_features(texts, langs, sources)),
            ],
            axis=1,
        ).reshape(-1, 2)
        calibrated = views * self.calibration[:, 0] + self.calibration[:, 1]
        both = calibrated @ self.combination[:2] + self.combination[2]
        return _sigmoid(np.column_stack([both, calibrated]))


def _platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope(s) and intercept of a logistic curve, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    # Targets a little inside 0 and 1, so that separable data stay finite.
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = _sigmoid(a @ w)
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - t) + 1e-3 * w)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    return w


def _calibrated(models: list[Linear], views: tuple, truth: np.ndarray) -> Model:
    """Both views with their calibration and combination, from documents apart."""
    logits = [m.logit(view) for m, view in zip(models, views)]
    calibration = np.stack([_platt(v, truth) for v in logits])
    calibrated = np.column_stack([v * s + o for v, (s, o) in zip(logits, calibration)])
    combination = _platt(calibrated, truth)
    for view in np.flatnonzero(combination[:2] < 0):  # a view never counts against itself
        other = _platt(calibrated[:, [1 - view]], truth)
        combination = np.zeros(3)
        combination[[1 - view, 2]] = other
    return Model(*models, calibration, combination)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")],
    )


def _features(rows: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, content features and metadata features of a bounded number of rows.

    The features are made in tasks: texts of any size never reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                langs, sources = (batch.column(i).slice(at, len(texts)).to_pylist() for i in (2, 3))
                made = content_features(texts), metadata_features(texts, langs, sources)
                columns = [pa.array([row.tobytes() for row in view], pa.binary()) for view in made]
                names = ["doc_id", "content", "metadata"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names)
                at += len(texts)

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, content binary, metadata binary")
    made = written(made.dropDuplicates(["doc_id"]))
    ids = made.select("doc_id").orderBy("doc_id").toArrow()["doc_id"].to_pylist()
    width = {"content": CONTENT, "metadata": 2 * CATEGORIES + _NUMBERS}
    views = [np.empty((len(ids), n), np.float32) for n in width.values()]
    for at in range(0, len(ids), PIECE):
        part = ids[at : at + PIECE]
        piece = made.where(F.col("doc_id").between(part[0], part[-1])).orderBy("doc_id").toArrow()
        for view, c in zip(views, width):
            view[at : at + len(part)] = np.frombuffer(b"".join(piece[c].to_pylist()), np.float32).reshape(len(part), -1)
    return ids, *views


def _surest(rows: DataFrame, models: list[Linear], handed: set) -> list[tuple]:
    """What each view is most sure of among all given documents but those handed
    over already: (view, class, doc_id). A task reports its HANDED best at most."""
    shared = rows.sparkSession.sparkContext.broadcast((models, handed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, gone = shared.value
        best: dict[tuple[int, int], list[tuple]] = {(v, c): [] for v in (0, 1) for c in (0, 1)}
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                langs, sources = (batch.column(i).slice(at, len(texts)).to_pylist() for i in (2, 3))
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                views = content_features(texts), metadata_features(texts, langs, sources)
                for v, (model, view) in enumerate(zip(models, views)):
                    p = _sigmoid(model.logit(view).astype(np.float64))
                    for c, sure in ((0, 1 - p), (1, p)):
                        found = [(float(sure[i]), ids[i]) for i in np.flatnonzero(sure >= SURE) if ids[i] not in gone]
                        best[v, c] = sorted({*best[v, c], *found}, key=lambda x: (-x[0], x[1]))[:HANDED]
        out = [(v, c, *x) for (v, c), listed in best.items() for x in listed]
        yield pa.RecordBatch.from_pylist([dict(zip(("view", "class", "sure", "doc_id"), x)) for x in out], schema=kinds)

    kind = rows.schema["doc_id"].dataType
    kinds = pa.schema([("view", pa.int32()), ("class", pa.int32()), ("sure", pa.float64()), ("doc_id", to_arrow_type(kind))])
    reported = written(rows.mapInArrow(run, f"view int, class int, sure double, doc_id {kind.simpleString()}"))
    chosen = []
    for v in (0, 1):
        for c in (0, 1):
            mine = reported.where((F.col("view") == v) & (F.col("class") == c))
            top = mine.groupBy("doc_id").agg(F.max("sure").alias("sure")).orderBy(F.desc("sure"), "doc_id").limit(HANDED)
            chosen += [(v, c, r.doc_id) for r in top.select("doc_id").collect()]
    return chosen


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit to documents (doc_id, text, lang, source) and labels (doc_id, quality).

    Several labels of a document count as the lowest; null labels and labels of
    unknown documents are left out, and of rows with equal ids one counts. None if the labels
    do not hold both classes at least five times.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    stated = written(
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    )
    chosen = stated.orderBy(order, "doc_id").limit(LABELLED)
    truth = dict(chosen.collect())
    texts = _texts(docs).where("doc_id is not null")
    ids, *views = _features(texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    y = np.array([float(truth[i] > 0) for i in ids])
    if min((y > 0).sum(), (y <= 0).sum()) < 5:
        return None
    apart = np.zeros(len(y), bool)
    for c in (0, 1):  # every fourth of each class is for calibration
        apart[np.flatnonzero(y == c)[::4]] = True
    taught = [(view[~apart], y[~apart]) for view in views]
    checked = [view[apart] for view in views]
    del views
    known = stated.select("doc_id")
    free = texts.join(F.broadcast(known) if known.count() <= KNOWN_ROWS else known, "doc_id", "left_anti")
    models = [fit(*t) for t in taught]
    handed: set = set()
    for _ in range(ROUNDS):
        surest = _surest(free, models, handed)
        if not surest:
            break
        new = docs.sparkSession.createDataFrame([(i,) for i in {i for *_, i in surest}], docs.select("doc_id").schema)
        ids, *views = _features(texts.join(F.broadcast(new), "doc_id", "left_semi"))
        place = {i: n for n, i in enumerate(ids)}
        for teacher in (0, 1):
            learner = 1 - teacher
            rows = [(place[i], c) for v, c, i in surest if v == teacher]
            x, classes = taught[learner]
            more = views[learner][[r for r, _ in rows]]
            taught[learner] = np.concatenate([x, more]), np.append(classes, [float(c) for _, c in rows])
        handed |= set(ids)
        models = [fit(*t) for t in taught]
    return _calibrated(models, checked, y[apart])


def _by_slice(model: Model | None, batch: pa.RecordBatch, at: tuple[int, int, int]) -> Iterator[tuple]:
    """Runs of a batch with their scores; a missing model finds all good."""
    text, lang, source = (batch.column(i) for i in at)
    begin = 0
    for texts in slices(text):
        n = len(texts)
        if model is None:
            scores = np.ones((n, 3))
        else:
            scores = model.scores(texts, lang.slice(begin, n).to_pylist(), source.slice(begin, n).to_pylist())
        yield batch.slice(begin, n), scores
        begin += n


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Score every document: doc_id, score (both views), content_score,
    metadata_score (probabilities of good quality) and accepted (score >= 0.5).

    One row per row of ``docs``, also for equal and null ids. A null text counts
    as empty, a null source or language as a value of its own.
    """
    chosen = _texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "score", "content_score", "metadata_score", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, s in _by_slice(shared.value, batch, (1, 2, 3)):
                columns = [rows.column(0), *(pa.array(s[:, i]) for i in range(3)), pa.array(s[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, content_score double, metadata_score double, accepted boolean"
    return chosen.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose documents ``score`` accepts, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = tuple(docs.columns.index(c) for c in ("text", "lang", "source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, s in _by_slice(shared.value, batch, at):
                yield rows.filter(pa.array(s[:, 0] >= 0.5))

    return docs.mapInArrow(run, docs.schema)
