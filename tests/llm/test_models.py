"""Trained operators: language, quality, scoring."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from clubhouse.llm import attention, language, quality, scoring
from pyspark.sql import functions as F
from test_texts import frame

SF_DIR = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# -- language ---------------------------------------------------------------------


def test_codewords_are_far_apart():
    for n in (1, 2, 3, 4, 7, 8, 30):
        code = language.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert not apart or min(apart) >= max(1, code.shape[1] // 4)


def test_language_is_found_on_texts_not_learnt(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    apart = language.held_out("doc_id", 4, 2)
    model = language.learn(docs.where(~apart))
    assert model.languages == ["de", "en", "es", "fr"] and model.code.shape == (4, 7)
    found = language.identify(docs.where(apart), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.95 * len(found)
    odd = frame(spark, [None, "", "12 34 !!", "the the and of the", "日本語", None])
    rows = language.identify(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and [r.score for r in rows[:3]] == [0.0] * 3
    assert rows[3].lang_pred == "en" and rows[4].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_when_few_are_learnt(spark):
    docs = frame(spark, ["some words", None])
    none = language.learn(docs.where("doc_id < 0"))
    assert [r.lang_pred for r in language.identify(docs, none).collect()] == ["und", "und"]
    one = language.learn(docs)
    assert one.languages == ["en"]
    assert sorted(r.lang_pred for r in language.identify(docs, one).collect()) == ["en", "und"]
    assert language.identify(frame(spark, []), one).count() == 0


def test_margins_of_a_long_text_add_up():
    rng = random.Random(0)
    texts = pa.array(["ab cd", "", "".join(rng.choice("abcdé ") for _ in range(700_000)), "x"], pa.large_string())
    weights = np.random.default_rng(0).standard_normal((3, language.BUCKETS + 1, 2)).astype(np.float32)
    weights[:, language.BUCKETS] = 0
    model = language.Model(["a", "b"], np.ones((2, 2)), weights)
    together = language.margins(model, texts)
    for i, text in enumerate(texts.to_pylist()):
        alone = language.margins(model, pa.array([text], pa.large_string()))
        assert np.allclose(together[i], alone[0], rtol=1e-3, atol=1e-2)
    assert (together[1] == 0).all()


# -- quality ------------------------------------------------------------------------


def test_quality_of_documents_without_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learnt = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 0)
    model = quality.learn(docs, learnt)
    unseen = labels.join(learnt, "doc_id", "left_anti")
    found = quality.score(docs, model).join(unseen, "doc_id").collect()
    good, bad = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert len(bad) > 5 and sum(r.accepted for r in good) >= 0.97 * len(good)
    assert sum(not r.accepted for r in bad) >= 0.75 * len(bad)  # of some 300 labels
    kept = quality.accepted(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == quality.score(docs, model).where("accepted").count()


def test_quality_of_odd_rows(spark):
    docs = frame(spark, [None, "", "some text", "some text"])
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.learn(docs, no_labels)
    assert model is None and quality.score(docs, model).where("accepted").count() == 4
    rng = np.random.default_rng(0)
    view = lambda y, n: y[:, None] * 2.0 + rng.standard_normal((len(y), n))
    y = (np.arange(80) % 2).astype(float)
    views = view(y, quality.CONTENT), view(y, 2 * quality.CATEGORIES + 6)
    model = quality._calibrated([quality.fit(v, y) for v in views], views, y)
    strange = spark.createDataFrame(
        [(None, None, None, None), (1, "x", None, "s")], "doc_id long, text string, lang string, source string"
    )
    assert quality.score(strange, model).count() == 2
    assert quality.accepted(frame(spark, []), model).count() == 0


def test_features_reach_the_driver_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 4)
    sizes = []
    kind = type(spark.range(1))
    plain = kind.toArrow

    def counted(df):
        table = plain(df)
        sizes.append((table.num_rows, table.num_columns))
        return table

    monkeypatch.setattr(kind, "toArrow", counted)
    texts = [f"text {i} of some " + "words " * i for i in range(11)]
    docs = frame(spark, texts).repartition(3)
    ids, content, metadata = quality._features(quality._texts(docs.unionByName(docs)))
    assert ids == [10 * i for i in range(11)]
    every = pa.array(texts, pa.large_string())
    assert (content == quality.content_features(every)).all()
    assert (metadata == quality.metadata_features(every, ["en"] * 11, ["s"] * 11)).all()
    assert max(n for n, columns in sizes if columns > 1) == 4  # before, all at once
    none = quality._features(quality._texts(docs.limit(0)))
    assert none[0] == [] and none[1].shape == (0, quality.CONTENT)


def test_scales_of_some_columns_at_a_time_are_those_of_all():
    x = np.random.default_rng(1).random((300, quality.CONTENT)).astype(np.float32)
    y = (np.arange(300) % 2).astype(float)
    scale = (1 / np.maximum(x.std(axis=0), 1e-2)).astype(np.float32)
    scale[quality._SHAPE : quality._SHAPE + 256] *= 0.3
    scale[quality._SHAPE + 256 :] *= 0.05
    assert (quality.fit(x, y, steps=1).scale == scale).all()


# -- scoring --------------------------------------------------------------------------


def _model(seed: int = 0) -> attention.Model:
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, 301)
    ids = np.arange(0, 300, 2)
    classes = attention.class_map(counts, ids, rng.integers(0, 9, (len(ids), 2 * attention.NEIGHBOURS)))
    after = rng.integers(0, 4, (attention.CLASSES, 301)).astype(float)
    weights = attention.new_weights()
    weights["top"] = rng.standard_normal(weights["top"].shape).astype(np.float32) * 0.3
    return attention.Model(
        classes, attention.share_table(counts, classes, after),
        attention.pair_table(counts, classes, after), weights,
    )


def test_gradients():
    model = _model()
    model.weights = {n: w.astype(np.float64) for n, w in model.weights.items()}
    rng = np.random.default_rng(1)
    windows = rng.integers(0, attention.CLASSES, (3, attention.WINDOW + 1))
    windows[0, 10:] = -1
    _, gradients = attention.step(model, windows)
    for name, w in model.weights.items():
        at = (windows[1, 4], 3) if name == "embed" else tuple(rng.integers(0, n) for n in w.shape)
        w[at] += 1e-5
        up = attention.step(model, windows)[0]
        w[at] -= 2e-5
        down = attention.step(model, windows)[0]
        w[at] += 1e-5
        assert gradients[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


def test_scores_equal_one_place_at_a_time():
    model = _model()
    scorer = attention.Scorer(model)
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 23, 24, 100])
    ids = rng.integers(0, 300, counts.sum())
    found = scorer(ids, counts)
    w, context = model.weights, attention.WINDOW - attention.STRIDE
    at = 0
    for n, value in zip(counts, found):
        line = np.concatenate([[model.end], ids[at : at + n], [model.end]])
        at += n
        c, total = model.classes[line], 0.0
        for i in range(n + 1):  # line[i + 1] from line[.. i]
            run = i // attention.STRIDE * attention.STRIDE
            first = max(0, run - context)
            x = w["embed"][c[first : i + 1]] + w["place"][first - run + context : i + 1 - run + context]
            a = np.exp((x[-1] @ w["query"]) @ (x @ w["key"]).T / np.sqrt(attention.WIDTH))
            h = x[-1] + (a / a.sum()) @ (x @ w["value"]) @ w["out"]
            logits = h @ w["top"] + w["bias"] + model.pairs[c[i]]
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            # All ids together have probability one.
            everything = chance[model.classes] * 10.0 ** model.shares[c[i]]
            assert everything.sum() == pytest.approx(1, abs=1e-3)
            total += math.log10(chance[c[i + 1]]) + model.shares[c[i], line[i + 1]]
        assert value == pytest.approx(total, rel=1e-3)


def test_base_scores_equal_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_WORDS", 500)
    monkeypatch.setattr(scoring, "START_WINDOWS", 128)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (9004, "The THE the")], docs.schema)
    docs = docs.limit(60).union(odd)
    learnt = ~language.held_out("doc_id", 10, 0)
    found = scoring.score(docs, learnt, RANKS, public_tokenizers.PATTERN).collect()
    given = {r.doc_id: (r.text, r.use) for r in docs.withColumn("use", learnt).collect()}
    words = {i: [*(t or "").encode().lower().split(), None] for i, (t, _) in given.items()}
    counts = collections.Counter(w for i, ws in words.items() if given[i][1] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    assert len(found) == len(given)
    for r in found:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words[r.doc_id])
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.train_tokens) == (len(words[r.doc_id]), total)
        assert r.n_known == sum(counts[w] > 0 for w in words[r.doc_id])
        assert r.held_out == (not given[r.doc_id][1]) and r.score < 0


def test_scores_when_nothing_is_learnt(spark):
    docs = frame(spark, ["a b", None])
    found = scoring.score(docs, F.lit(False), RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.base_score) for r in found] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert scoring.score(docs.limit(0), F.lit(True), RANKS, public_tokenizers.PATTERN).count() == 0


def test_all_of_every_text_is_learnt_from(spark, monkeypatch):
    learnt_from = []
    averaged = scoring._averaged
    monkeypatch.setattr(
        scoring, "_averaged", lambda windows, *a: learnt_from.append(windows.collect()) or averaged(windows, *a)
    )
    rng = random.Random(3)
    texts = ["", "one", " ".join(rng.choices("the quick brown fox jumps over a lazy dog again".split(), k=3000))]
    encoder = lambda: scoring.rank_encoder(RANKS, public_tokenizers.PATTERN)
    model = scoring.learn(spark.createDataFrame(list(zip(texts, [1, 2, 3])), "text string, seed long"), encoder)
    encode, size = encoder()
    after, counts, wanted = np.zeros((attention.CLASSES, size + 1)), np.zeros(size + 1), collections.Counter()
    for text in texts:
        ids, _ = encode.of_chunks([text.encode().split()])
        line = np.concatenate([[size], ids, [size]])
        counts += np.bincount(line[1:], minlength=size + 1)
        np.add.at(after, (model.classes[line[:-1]], line[1:]), 1)
        wanted.update(zip(line[:-1].tolist(), line[1:].tolist()))
    assert np.allclose(model.pairs, attention.pair_table(counts, model.classes, after))
    assert np.allclose(model.shares, attention.share_table(counts, model.classes, after))
    for rows in learnt_from:
        found = collections.Counter()
        for row in rows:
            for w in np.frombuffer(row.data, np.int32).reshape(-1, attention.WINDOW + 1):
                found.update((a, b) for a, b in zip(w[:-1].tolist(), w[1:].tolist()) if b >= 0)
        assert found == wanted
    assert learnt_from


def test_weights_are_averaged_more_than_once(spark, monkeypatch):
    averaged, rounds = scoring._averaged, []
    monkeypatch.setattr(scoring, "_averaged", lambda *a: rounds.append(1) or averaged(*a))
    encoder = lambda: scoring.rank_encoder(RANKS, public_tokenizers.PATTERN)
    scoring.learn(spark.createDataFrame([("a b c", 1)], "text string, seed long"), encoder)
    assert len(rounds) >= 2
