"""Row-wise operators on texts: pieces, token files, fingerprints, mixing."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from clubhouse.llm import merkle, mixing, pieces, tokenfiles
from clubhouse.llm.words import Words, slices
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "a \nb", "日本語 テスト", "x▁ y", "▁",
    "<s> </s> <unk>", "<|endoftext|> x", "\x00 a", "a\tb", "😀 😀😀", "it's he'll 's", "\x1c a", "a  b",
    "x" * 3000, "one two three four five six seven " * 40,
]
DOCS = "doc_id long, text string, lang string, source string, words string, size int, tag long"


def frame(spark, texts, sources=None):
    """Documents with ids 10, 20, … and columns whose names the operators use too."""
    rows = [
        (10 * i, t, "en", sources[i] if sources else "s", "clash", 1, 2) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


# -- words -------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nabAB\x0bé", max_size=30), min_size=1, max_size=8))
def test_words_are_those_of_bytes_split(texts):
    words = Words(pa.array(texts, pa.large_string()), lower=True)
    listed = [t.encode().lower().split() for t in texts]
    assert words.counts().tolist() == [len(w) for w in listed]
    flat = [w for ws in listed for w in ws]
    cut = [words.data[a:b].tobytes().lower() for a, b in zip(words.starts, words.ends)]
    assert cut == flat
    assert len(set(zip(flat, words.hash.tolist()))) == len(set(flat)) == len(set(words.hash.tolist()))


def test_slices_never_cut_a_text():
    texts = ["a" * 700_000, None, "b" * 2_000_000, "c", "d" * 700_000]
    parts = list(slices(pa.array(texts)))
    assert [t for p in parts for t in p.to_pylist()] == [t or "" for t in texts]
    assert len(parts) == 3


# -- pieces --------------------------------------------------------------------


def test_pieces_equal_the_library_and_cover_the_text(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(" ab\n▁é日1.<s>") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = pieces.encode(frame(spark, texts), PIECES).orderBy("doc_id").collect()
    assert len(found) == len(texts)
    for row, text in zip(found, texts):
        text = text or ""
        assert row.ids == library.encode(text) and row.decoded == library.decode(row.ids)
        raw = text.encode()
        if row.ids:
            assert row.begins[0] == 0 and row.ends[-1] == len(raw) and row.begins[1:] == row.ends[:-1]
        for i, a, b in zip(row.ids, row.begins, row.ends):
            if not library.is_byte(i) and "▁" not in text:
                piece = library.id_to_piece(i).replace("▁", " ")
                assert raw[a:b].decode() == (piece if a or raw[:1] == b" " and piece != " " else piece[1:]) or a == 0


def test_normaliser_follows_a_compiled_map():
    """A map of two entries, built here: "ab" -> "x" and "a" -> "yy"."""
    import struct

    class Spec:
        add_dummy_prefix, remove_extra_whitespaces = True, False

    units = [0] * 1024

    def offset(to):  # the lowest bits name the label, the upper ones the way on
        return to << 10

    root, node_a, node_ab = 256, 512, 768
    units[0] = offset(root)
    at_a = root ^ ord("a")
    units[at_a] = ord("a") | 1 << 8 | offset(at_a ^ node_a)
    units[node_a] = 1 << 31 | 2  # text at 2: "yy"
    at_ab = node_a ^ ord("b")
    units[at_ab] = ord("b") | 1 << 8 | offset(at_ab ^ node_ab)
    units[node_ab] = 1 << 31 | 0  # text at 0: "x"
    Spec.precompiled_charsmap = struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"x\0yy\0"
    normal, places = pieces.Normalizer(Spec)("ab a")
    assert normal == "▁x▁yy".encode()
    assert places.tolist() == [0, 0, 0, 0, 2, 2, 2, 3, 3, 4]


def test_pieces_of_nothing(spark):
    assert pieces.encode(frame(spark, []), PIECES).count() == 0


# -- token files -----------------------------------------------------------------


def test_byte_level_ids_equal_the_library():
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    rng = random.Random(2)
    texts = [t or "" for t in ODD]
    texts += ["".join(rng.choice(" ab\n\t'sé日1.   ") for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    ids, counts = tokenfiles.byte_level_encoder(BYTES)(texts)
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts, ends):
        assert ids[end - n : end].tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_met_before_are_not_encoded_again(monkeypatch):
    from clubhouse.llm import chunks

    monkeypatch.setattr(chunks, "CACHE_CHUNKS", 8)
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    tokenfiles.byte_level_encoder.cache_clear()
    encode = tokenfiles.byte_level_encoder(BYTES)
    asked, plain = [], encode._encode
    encode._encode = lambda text: asked.append(text) or plain(text)
    texts = [f"the cat and the {i}th dog <|endoftext|> x\n{i} the cat" for i in range(20)]  # with ever new chunks
    for text in texts:
        ids, counts = encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    assert sum(" cat" in a for a in asked) == 1 and asked.count("the") == 1  # before: again after every full cache
    tokenfiles.byte_level_encoder.cache_clear()


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FRAME_IDS", 40)
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    docs = frame(spark, ODD).select(F.col("doc_id").alias("doc_id"), "text").repartition(3)
    folder = f"file://{tmp_path}/files"
    manifest = tokenfiles.write(docs, folder, lambda: tokenfiles.byte_level_encoder(BYTES), 2, end_id=2)
    rows = tokenfiles.read(manifest, folder).orderBy("doc_id").collect()
    start = 0
    for i, (row, text) in enumerate(zip(rows, ODD)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens) == (10 * i, start, len(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        start += len(ids)
    assert len(rows) == len(ODD)
    assert [r.doc_id for r in tokenfiles.read(manifest, folder, [30, 110]).collect()] == [30, 110]

    # Only the frames of the documents asked for are read; damage is noticed.
    from pyarrow import fs

    path = manifest.orderBy("part").first().path
    source = fs.LocalFileSystem().open_input_file(path)
    reader = tokenfiles.Reader(source, 2)
    wanted = int(reader.documents["id"][0])
    assert len(list(reader.rows([wanted]))) == reader.frames_read == 1
    with open(path, "r+b") as file:
        file.seek(6)
        byte = file.read(1)
        file.seek(6)
        file.write(bytes([byte[0] ^ 255]))
    with pytest.raises(Exception):
        list(tokenfiles.Reader(fs.LocalFileSystem().open_input_file(path), 2).rows())


def test_token_files_of_null_and_equal_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (5, "x"), (5, "x"), (5, None)], "doc_id long, text string")
    folder = f"file://{tmp_path}/files"
    manifest = tokenfiles.write(docs, folder, lambda: tokenfiles.byte_level_encoder(BYTES), 2, 2)
    rows = sorted(tokenfiles.read(manifest, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, 2), (5, 1), (5, 2), (5, 2)]
    none = tokenfiles.write(docs.limit(0), folder, lambda: tokenfiles.byte_level_encoder(BYTES), 2, 2)
    assert tokenfiles.read(none, folder).count() == 0


# -- fingerprints ------------------------------------------------------------------


def test_fingerprints_of_edited_texts(spark):
    texts = ["First line here.\nSecond one, longer.\n" * 20, "Other words entirely; yes.", "", None, "é😀 x", "z"]
    texts.append(texts[0])
    found = merkle.compared_with_next(frame(spark, texts)).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    for i, row in enumerate(found):
        text, after = plain[i], plain[(i + 1) % len(plain)]
        half = len(text) // 2
        assert row.n_chars == len(text) and row.edited_text == text[: len(text) - half] + after[:half]
        assert (row.fingerprint == row.edited_fingerprint) == (text == row.edited_text)
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        assert (row.near_next == 1) == (set(text.split()) == set(after.split()) and text == after)
    assert found[0].fingerprint == found[-1].fingerprint and found[-1].near_next == 1
    assert found[0].near_edited > found[0].near_next
    assert len({r.fingerprint for r in found}) == len(set(plain))
    one = spark.createDataFrame([(found[0].fingerprint, found[0].edited_fingerprint)], "a string, b string")
    near, same = one.select(
        merkle.likeness(F.col("a"), F.col("b")), merkle.likeness(F.col("a"), F.col("a"))
    ).first()
    assert near == pytest.approx(found[0].near_edited) and same == 1


def test_edits_are_located(spark):
    rng = random.Random(6)
    pairs = []
    for n in (1, 2, 40, 1000):  # one line before, between or after n others
        lines = [f"line {rng.randrange(n // 3 + 5)} of some" for _ in range(n)]
        for at in {0, n // 2, n}:
            pairs.append(("\n".join(lines), "\n".join([*lines[:at], "a new line", *lines[at:]])))
            pairs.append(("\n".join([*lines[:at], "an old line", *lines[at:]]), "\n".join(lines)))
    for _ in range(12):
        lines = [rng.choice(["", "same", f"l{rng.randrange(60)}"]) for _ in range(rng.randint(0, 200))]
        other = [x for x in lines if rng.random() < 0.95]
        for _ in range(rng.randint(0, 4)):
            other.insert(rng.randint(0, len(other)), rng.choice(["", "same", "new"]))
        pairs.append(("\n".join(lines), "\n".join(other)))
    pairs += [("", ""), ("a", ""), (pairs[0][0], pairs[0][0])]
    rows = spark.createDataFrame([(i, 7, *p) for i, p in enumerate(pairs)], "id int, place int, one string, other string")
    for c in ("one", "other"):
        rows = merkle.with_fingerprint(rows, F.col(c), f"{c}_f").withColumnRenamed(f"{c}_f_leaves", f"{c}_l")
    found: dict = {}
    for i, edit, place in merkle.edits(rows, ["id"], "one_f", "other_f").collect():
        found.setdefault(i, []).append((edit, place))
    for i, (one, other) in enumerate(pairs):
        a, b = one.split("\n"), other.split("\n")
        mine = found.get(i, [])
        assert Counter(a[p] for e, p in mine if e == "deleted") == Counter(a) - Counter(b)
        assert Counter(b[p] for e, p in mine if e == "inserted") == Counter(b) - Counter(a)
        assert len(set(mine)) == len(mine)
    assert all(len(found[i]) == 1 for i in range(22))


def test_the_tree_is_that_of_its_paragraphs(spark):
    """Sections end after a paragraph whose hash is a multiple of SECTION; nodes hash children."""
    text = "\n".join(f"line {i % 50}, with clauses; and ends." for i in range(400))
    df = spark.createDataFrame([(text,)], "t string")
    hashes = df.select(merkle.leaf_hashes(F.col("t")).alias("h")).first().h
    paragraphs = [r[0] for r in spark.createDataFrame([(h,) for h in hashes], "h array<bigint>").select(F.xxhash64("h")).collect()]
    sections, now = [], []
    for h in paragraphs:
        now.append(h)
        if h % merkle.SECTION == 0:
            sections, now = [*sections, now], []
    sections += [now] if now else []
    digests = spark.createDataFrame([(s,) for s in sections], "h array<bigint>").select(F.hex(F.xxhash64("h"))).collect()
    fingerprint = merkle.with_fingerprint(df, F.col("t"), "f").first().f
    root, *rest = fingerprint.split("|")
    assert [s.split(":")[0] for s in rest] == [d[0] for d in digests] and len(sections) > 5
    assert root == hashlib.md5("|".join(rest).encode()).hexdigest()
    named = [p.split(".")[0] for s in rest for p in s.split(":")[1].split(",")]
    assert named == [f"{h % 2**64:X}" for h in paragraphs]


def test_next_document_over_many_ranges(spark):
    docs = spark.range(500).select((F.col("id") * 3).alias("doc_id"), F.col("id").cast("string").alias("text"))
    found = merkle.with_next(docs.repartition(7))
    assert found.where("cast(next_text as int) <> (cast(text as int) + 1) % 500").count() == 0
    assert found.count() == 500
    (alone,) = merkle.with_next(docs.limit(1)).collect()
    assert alone.text == alone.next_text
    assert merkle.compared_with_next(docs.limit(0)).count() == 0
    tied = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "doc_id long, text string")
    assert sorted(tuple(r)[1:] for r in merkle.with_next(tied).collect()) == [("a", "b"), ("b", "c"), ("c", "a")]


# -- mixing --------------------------------------------------------------------------


def _filled(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    targets, free, left = {}, set(order), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return targets | {s: level * weight[s] for s in free}
        targets |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return targets


def test_mix_meets_the_targets(spark):
    rng = random.Random(1)
    sources = rng.choices(["a", "B", None, "ä", "z", "tiny"], [60, 5, 5, 20, 9, 1], k=400)
    texts = ["w " * rng.choice([0, 1, 5, 50, 300]) for _ in sources]
    docs = frame(spark, texts, sources)
    found = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    again = {r.doc_id: r.taken for r in mixing.mixed(docs.repartition(5)).collect()}
    assert again == {i: r.taken for i, r in found.items()} and len(found) == 400
    sizes: dict = {}
    for s, t in zip(sources, texts):
        sizes[s] = sizes.get(s, 0) + len(t.split())
    targets = _filled(sizes)
    for s in sizes:
        own = [found[10 * i] for i, x in enumerate(sources) if x == s]
        assert {round(r.target, 6) for r in own} == {round(targets[s], 6)}
        assert abs(sum(r.taken for r in own) - targets[s]) <= 0.5
        assert all(r.taken <= 3 * r.size and r.source_size == sizes[s] for r in own)
    copies = mixing.materialized(docs)
    assert copies.columns == docs.columns
    words = copies.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in found.values())


def test_mix_of_nothing_and_of_repeated_rows(spark):
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mixed(frame(spark, ["", None])).collect()] == [0, 0]
    twice = frame(spark, ["a b c"]).union(frame(spark, ["a b c"]))
    assert sum(r.taken for r in mixing.mixed(twice).collect()) == 6
    assert mixing.materialized(twice).count() == 2




def test_rows_that_differ_in_which_column_is_null_are_all_taken(spark):
    rows = [(1, "a b c", None, "x"), (1, "a b c", "x", None), (1, "a b c", "x", None), (2, "d e", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = mixing.materialized(docs, weights=(1,), max_epochs=1)
    assert sorted(map(str, taken.collect())) == sorted(map(str, docs.collect()))


def test_every_file_is_read_by_a_task_of_its_own(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    settings = {"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, setting in settings.items():
        spark.conf.set(name, setting)
    try:
        manifest = tokenfiles.write(docs, str(tmp_path), lambda: tokenfiles.byte_level_encoder(BYTES), 2, 2)
        read = tokenfiles.read(manifest, str(tmp_path))
        assert read.rdd.getNumPartitions() == manifest.count() > 1 and read.count() == 40
    finally:
        for name, setting in before.items():
            spark.conf.set(name, setting)


def test_ids_that_do_not_fit_are_refused():
    writer = tokenfiles.Writer(pa.BufferOutputStream(), 2)
    writer.add([1], np.array([70_000]), np.array([1]))
    with pytest.raises(ValueError, match="does not fit 2 bytes"):
        writer.close()
