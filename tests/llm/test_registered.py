"""The registered queries and the pipeline over the driver's tables."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import pytest
import sentencepiece
from checks.compare import database, difference
from clubhouse.llm import mixing
from clubhouse.llm.queries import QUERIES, SQL
from test_pairs import _brute, _family, _least, _shingles
from test_texts import PIECES

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), database(SF_DIR), SQL[name]) == ""


def test_every_operator_is_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in found if k.startswith("op")}
    assert "pipeline" in found and len(corpus_pipeline.STAGES) == 5


def test_digests_of_pieces(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op2_pieces"](spark, SF_DIR).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_stages_do_what_they_say(spark, tmp_path):
    """Each stage against brute force on its own input."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(5, 60))) for _ in range(60)]
    texts += _family(rng, 6, 80, 3)
    passage = " ".join(f"p{i}" for i in range(55))
    texts += [f"{texts[i]}\n{passage}\n{texts[i + 1]}" for i in range(8)] + [None, ""]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    good, near, cut, mix, coded = (f for _, f in corpus_pipeline.STAGES)

    labels = f"{tmp_path}/labels.parquet"
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(labels)
    assert good(spark, docs, str(tmp_path)).count() == len(texts)  # too few labels: all stay

    sets = [_shingles(t) for t in texts]
    linked = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    label = _least(len(texts), linked)
    kept = near(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, x in enumerate(label) if x == i]

    shorter = cut(spark, kept, SF_DIR)
    assert shorter.columns == docs.columns
    given = {r.doc_id: r.text for r in kept.collect()}
    wanted = _brute(list(given.values()), list(given))
    for r in shorter.collect():
        assert b" ".join(r.text.encode().split()) == wanted[r.doc_id][2] and r.n_chars == len(r.text)

    taken = mix(spark, shorter, SF_DIR)
    assert taken.columns == docs.columns
    planned = {r.doc_id: r.taken for r in mixing.mixed(shorter).collect()}
    words: dict = {}
    for r in taken.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in planned.items() if n}

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert sorted((r.doc_id, r.ids) for r in coded(spark, taken, SF_DIR).collect()) == sorted(
        (r.doc_id, library.encode(r.text)) for r in taken.collect()
    )


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.count() > 50 and rows.columns == ["doc_id", "ids", "begins", "ends", "decoded"]
