"""Near-duplicates and repeats against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from clubhouse.llm import groups, nearcopies, repeats, vectors
from test_texts import frame


def _least(n: int, linked) -> list[int]:
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


# -- components ------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40, 70)]  # a chain
    links += [(100, i) for i in range(101, 160)]  # a star
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    found = dict(
        tuple(r) for r in groups.components(spark.createDataFrame(links, "a long, b long")).collect()
    )
    label = _least(400, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: label[x] for x in touched}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- vectors -----------------------------------------------------------------------


@pytest.mark.parametrize("block, cell", [(1024, 2000), (16, 30)])
def test_vectors_equal_brute_force(spark, monkeypatch, block, cell):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CELL", cell)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    x = [b + rng.standard_normal(16) * 0.2 * rng.random() for b in base for _ in range(5)]
    x += [base[0] * 3.0] * 40  # a hot group of copies
    x = [list(map(float, v.astype(np.float32))) for v in map(np.asarray, x)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16]
    rows = [(i, v, 1) for i, v in enumerate(x)] + [(1000 + i, v, 1) for i, v in enumerate(bad)]
    rows += [(None, x[0], 1), (2000, [1.0, 2.0], 1), (2001, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    found = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert len(found) == len(rows)
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    label = _least(len(x), list(zip(*np.nonzero(linked))))
    for i in range(len(x)):
        r = found[i]
        assert (r.n_links, r.component_id, r.kept) == (linked[i].sum() - 1, label[i], label[i] == i)
    for i in range(len(bad)):
        assert tuple(found[1000 + i]) == (1000 + i, 0, 1000 + i, True)
    assert tuple(found[None]) == (None, 0, None, True)
    assert found[2001].component_id == 2000 and found[2000].n_links == 1
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_meet_once_and_travel_in_packs(spark, monkeypatch):
    """A vector is at home in one cell and a guest in later ones only, and rows hold many vectors."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = vectors.spherical_kmeans(x, 12)
    row, cell, at_home = vectors.cells_of(x, centres, 0.9)
    home = np.empty(len(x), int)
    home[row[at_home]] = cell[at_home]
    assert at_home.sum() == len(x) and (cell[~at_home] > home[row[~at_home]]).all()
    placed = set(zip(row.tolist(), cell.tolist()))
    for i, j in np.argwhere(x @ x.T >= 0.9):
        late, early = (i, j) if home[i] >= home[j] else (j, i)
        assert (early, home[late]) in placed
    for name, n in (("CELL", 25), ("BLOCK", 20), ("PACK", 7), ("_PACKS", 3), ("_STEP", 6)):
        monkeypatch.setattr(vectors, name, n)
    sent = []
    monkeypatch.setattr(vectors, "by_group", lambda rows, *rest: (sent.append(rows), groups.by_group(rows, *rest))[1])
    # Vectors that need double precision, and copies of some.
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[i].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, threshold=0.9).collect()}
    u = np.concatenate([x, x[:30]])
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert [found[i] for i, _ in rows] == want.tolist()
    # Before, a row was a vector.
    assert sent[0].count() < 0.5 * sent[0].agg({"n": "sum"}).first()[0]


# -- near copies -------------------------------------------------------------------------


def _family(rng, n_copies: int, length: int, changes: int) -> list[str]:
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    texts = []
    for _ in range(n_copies):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(length)] = f"x{rng.randrange(5000)}"
        texts.append(" ".join(words).upper() if rng.random() < 0.2 else "  ".join(words))
    return texts


def _shingles(text) -> set:
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


@pytest.mark.parametrize("crowd, block", [(512, 128), (4, 5)])
def test_near_copies_equal_brute_force(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(nearcopies, "CROWD", crowd)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rng = random.Random(9)
    texts = [t for _ in range(12) for t in _family(rng, 4, rng.choice([30, 80]), 3)]
    texts += _family(rng, 40, 120, 8) + ["same text for all of these rows here"] * 20
    texts += [None, "", " \n", "one two", "ONE two", "one two three four", "one two three"]
    sets = [_shingles(t) for t in texts]
    linked = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    label = _least(len(texts), linked)
    docs = frame(spark, texts)
    found = {r.doc_id: r for r in nearcopies.near_duplicates(docs).collect()}
    assert len(found) == len(texts)
    for i, s in enumerate(sets):
        r = found[10 * i]
        assert (r.n_shingles, r.component_id, r.kept) == (len(s), 10 * label[i], label[i] == i)
    kept = nearcopies.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [10 * i for i in range(len(texts)) if label[i] == i]


def test_near_copies_of_odd_rows(spark):
    assert nearcopies.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in nearcopies.near_duplicates(docs).where("doc_id is not null").collect())
    assert found == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    kept = nearcopies.representatives(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1]


def test_unlike_texts_under_one_id_all_stay(spark):
    rng = random.Random(4)
    first, second, third = (" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(3))
    near = second + " more"
    rows = [(1, first, "a"), (1, second, "b"), (2, near, "c"), (1, near, "d"), (3, third, "e"), (3, third, "f"), (4, "", "g"), (4, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    found = nearcopies.near_duplicates(docs)
    assert sorted(tuple(r) for r in found.select("doc_id", "component_id").collect()) == [
        (1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4), (4, 4),
    ]
    kept = sorted((r.doc_id, r.text or "", r.tag) for r in nearcopies.representatives(docs).collect())
    tags = [t for *_, t in kept]
    # One of the near copies b, c and d, one of the equal rows e and f, and all that is like nothing.
    assert len(kept) == 5 and {"a", "g", "h"} <= set(tags)
    assert len(set(tags) & set("bd")) == 1 and len(set(tags) & set("ef")) == 1


def test_unlike_vectors_under_one_id_link(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.01, 1.0]), (2, [1.0, 0.01]), (3, [-1.0, 0.0])]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(tuple(r)[:3] for r in found.collect()) == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(2)
    for j in (0.2, 0.5, 0.75, 0.95):
        one, other = 700, 500
        shared = int(j * (one + other) / (1 + j))
        if shared > other:
            one = other = 600
            shared = int(j * (one + other) / (1 + j))
        estimates = []
        for _ in range(20):
            values = rng.integers(0, 2**63, one + other - shared, dtype=np.uint64)
            sets = np.concatenate([values[:one], values[one - shared :]])
            a, b = nearcopies.registers(sets, np.array([one, other]))
            estimates += list(
                nearcopies.likeliest(*(np.array([x]) for x in ((a > b).sum(), (a < b).sum(), one, other)))
            )
        assert abs(np.mean(estimates) - j) < 0.03
    # Registers of a union are the greater ones.
    parts = nearcopies.registers(values, np.array([100, len(values) - 100]))
    whole = nearcopies.registers(values, np.array([len(values)]))
    assert (parts.max(axis=0) == whole[0]).all()


# -- repeats ----------------------------------------------------------------------------------


def _brute(texts: list, ids: list) -> dict:
    seen, result = set(), {}
    for i in sorted(range(len(texts)), key=lambda i: ids[i]):
        words = (texts[i] or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - 19):
            window = tuple(words[a : a + 20])
            if window in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(window)
        result[ids[i]] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g))
    return result


@pytest.mark.parametrize("shard, alphabet", [(500, 4000), (500, 3), (1, 4000), (1, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, shard, alphabet):
    monkeypatch.setattr(repeats, "SHARD", shard)
    rng = random.Random(alphabet)
    draw = lambda n: [f"w{rng.randrange(alphabet)}" for _ in range(n)]
    shared = [draw(n) for n in (20, 21, 35, 60)]
    texts = [None, "", "a b", " ".join(["x", "y"] * 60), " ".join(["x"] * 19), " ".join(["x"] * 50)]
    for _ in range(40):
        words = draw(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(shared) + draw(rng.randint(0, 10))
        texts.append(rng.choice([" ", "\n", " \t "]).join(words) + rng.choice(["", "\n"]))
    texts += texts[8:12]
    docs = frame(spark, texts)
    order = list(range(len(texts)))
    found = {r.doc_id: r for r in repeats.without_repeats(docs.repartition(3)).collect()}
    assert len(found) == len(texts)
    for doc_id, (n, gone, kept) in _brute(texts, [10 * i for i in order]).items():
        row = found[doc_id]
        assert (row.n_words, row.n_removed) == (n, gone)
        assert b" ".join(row.kept_text.encode().split()) == kept
        raw = (texts[doc_id // 10] or "").encode()
        left, at = b"", 0
        for span in row.spans:
            left, at = left + raw[at : span.begin], span.end
        assert left + raw[at:] == row.kept_text.encode()


def test_repeats_of_odd_rows(spark):
    assert repeats.without_repeats(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "r"), (5, text, "r"), (5, text, "r"), (7, text, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    found = sorted((r.doc_id or 0, r.n_removed) for r in repeats.without_repeats(docs).collect())
    assert found == [(0, 30), (5, 0), (5, 0), (7, 30)]
    carried = repeats.without_repeats(docs, carry=True)
    assert {r.row.row for r in carried.collect()} == {"r"}


def test_matching_statistics():
    rng = random.Random(0)
    for _ in range(60):
        automaton, texts = repeats.SuffixAutomaton(), []
        for _ in range(5):
            text = [rng.choice("ab") for _ in range(rng.randint(0, 12))]
            wanted = [
                max(
                    n for n in range(i + 2)
                    if n == 0 or any(t[k : k + n] == text[i + 1 - n : i + 1] for t in texts for k in range(len(t) - n + 1))
                )
                for i in range(len(text))
            ]
            assert automaton.statistics(text) == wanted
            automaton.add(text)
            texts.append(text)


def test_segments_hold_every_window_once():
    from clubhouse.llm.words import Words

    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(30)]
    words = Words(pa.array(texts, pa.large_string()))
    _, text, start, n = repeats.segments(words)
    windows = [(t, s + i) for t, s, k in zip(text.tolist(), start.tolist(), n.tolist()) for i in range(k)]
    assert windows == [(t, i) for t, x in enumerate(texts) for i in range(len(x.split()) - 19)]
    assert n.max() <= repeats.WINDOW - repeats.GRAM + 1
