"""Encoding to pieces with their places in the original bytes, and decoding.

A model file of the sentencepiece library says how text is normalised: a
compiled character map (a double-array trie) rewrites the longest prefix it
knows at each place, white space may be trimmed, a space put in front. The
normaliser here follows that map and notes for every normalised byte the
original byte it comes from. The library cuts the text into pieces; their
lengths in the normalised text then give each piece's original byte span.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubhouse.llm.chunks import ChunkEncoder
from clubhouse.llm.words import buffer_of, slices

MARK = "▁"  # stands for a space in pieces


class Normalizer:
    """Longest-prefix normalisation with alignment to the original bytes."""

    def __init__(self, spec):
        self.add_prefix = spec.add_dummy_prefix
        self.trim = spec.remove_extra_whitespaces
        blob = spec.precompiled_charsmap
        self._units: tuple[int, ...] = ()
        self._texts = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self._units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self._texts = blob[4 + size :]

    @property
    def is_identity(self) -> bool:
        return not self._units and not self.trim

    def _replacement(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the longest known prefix at a place, and its length.
        An unknown character stands for itself."""
        units, best, length = self._units, -1, 0
        if units:
            node = units[0]
            base = (node >> 10) << ((node & 0x200) >> 6)
            for i in range(at, len(data)):
                place = base ^ data[i]
                if place >= len(units) or units[place] & 0x800000FF != data[i]:
                    break
                node = units[place]
                base = place ^ ((node >> 10) << ((node & 0x200) >> 6))
                if node >> 8 & 1:
                    best, length = units[base] & 0x7FFFFFFF, i - at + 1
        if length:
            return self._texts[best : self._texts.index(b"\0", best)], length
        first = data[at]
        length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return data[at : at + length], length

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, spaces as marks, and for each of them and for
        the end the original byte place."""
        data = text.encode()
        out, places = bytearray(), []
        at, after_space = 0, self.trim
        mark = MARK.encode()
        units = []
        while at < len(data):
            new, length = self._replacement(data, at)
            units.append((new, at))
            at += length
        flat = [(bytes([b]), p) for new, p in units for b in new]
        if self.trim:
            kept = []
            for byte, place in flat:
                if byte == b" " and after_space:
                    continue
                after_space = byte == b" "
                kept.append((byte, place))
            while kept and kept[-1][0] == b" ":
                kept.pop()
            flat = kept
        if flat and self.add_prefix:
            flat.insert(0, (b" ", flat[0][1] if self.trim else 0))
        for byte, place in flat:
            byte = mark if byte == b" " else byte
            out += byte
            places += [place] * len(byte)
        return bytes(out), np.array([*places, len(data)], np.int64)


class PieceModel:
    """A model file, with the tables that spans need."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.normalizer = Normalizer(proto.normalizer_spec)
        names = [p.piece for p in proto.pieces]
        is_byte = np.array([p.type == p.BYTE for p in proto.pieces])
        #: Bytes of a piece in the normalised text, and with marks as one byte.
        self.normalized_size = np.where(is_byte, 1, [len(n.encode()) for n in names])
        self.size = np.where(is_byte, 1, [len(n.replace(MARK, " ").encode()) for n in names])
        self.unknown = proto.trainer_spec.unk_id
        opens = np.array([n.startswith(MARK) for n in names])
        crossing = any(MARK in n.lstrip(MARK) for n in names)
        # Only if no piece crosses a space are chunks independent.
        self.by_chunk = (
            self.normalizer.is_identity and self.normalizer.add_prefix and not crossing
            and proto.trainer_spec.byte_fallback
        )
        irregular = re.compile(f"^ | (?: |$)|{MARK}").search if self.by_chunk else lambda _: True
        self.encode = ChunkEncoder(self.library.encode, opens, irregular, bare_start=True)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans of the pieces of one text, by the normaliser."""
        normal, places = self.normalizer(text)
        sizes = self.normalized_size[ids].copy()
        if (unknown := np.flatnonzero(ids == self.unknown)).size:
            named = self.library.encode(text, out_type=str)
            for i in unknown:
                sizes[i] = len(named[i].encode())
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return places[ends - sizes], np.maximum(places[ends], places[ends - sizes])


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def encoded_slice(model: PieceModel, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Ids of the texts in a row, ids per text, and the pieces' byte spans."""
    plain = texts.to_pylist()
    ids, counts = model.encode(plain)
    sizes = model.size[ids]
    first = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    before = np.repeat((np.concatenate([[0], ends]))[first] + 1, counts)  # 1: the space in front
    begins = np.maximum(ends - sizes - before, 0)
    ends = ends - before
    lengths = np.diff(buffer_of(texts)[1])
    for i, text in enumerate(plain):
        if not model.by_chunk or MARK in text:
            own = slice(first[i], first[i] + counts[i])
            begins[own], ends[own] = model.spans(text, ids[own])
        elif counts[i] and ends[first[i] + counts[i] - 1] != lengths[i]:
            raise ValueError("pieces do not cover the text")
    return ids, counts, begins, ends


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text.

    Returns doc_id, ids (int list, as the library gives them, without begin or
    end ids), begins and ends (int lists: the original bytes of each piece in
    UTF-8; a piece that stands for nothing in the text has an empty span), and
    decoded (the library's decoding of the ids). One row per row of ``docs``,
    also for equal ids and null ids; a null text counts as empty and has no
    ids. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                ids, counts, begins, ends = encoded_slice(model, texts)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                lists = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
                decoded = model.library.decode(lists, num_threads=1)
                listed = lambda x: pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(x, pa.int32())
                )
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    listed(ids), listed(begins), listed(ends),
                    pa.array(decoded, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "begins", "ends", "decoded"])
                at += len(texts)

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string"
    return chosen.mapInArrow(run, schema)
