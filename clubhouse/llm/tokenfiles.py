"""Token ids in binary files of independent compressed frames.

A file holds documents in ascending order of id:

    frame, frame, ...      zstandard frames, each with its own content checksum;
                           the ids of some whole documents, one after another,
                           little-endian, 2 or 4 bytes each
    documents              a skippable frame: for every document its id (8
                           bytes, signed), its frame (4), the number of ids
                           before it in that frame (4), its number of ids (4)
                           and 1 for an id, 0 for a null id (4)
    seek table             a skippable frame as in the public seekable format:
                           compressed size, size and checksum of every frame

The seek table ends with the number of frames, a flag byte and a magic number,
so a reader starts at the end of the file, finds the documents it is asked for
and decompresses only their frames.

Every task writes one file, under a name of its own, and its row in the manifest
is what makes the file count: files of failed or repeated attempts are in no
manifest. Files go to any folder that Arrow's file systems reach.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clubhouse.llm.chunks import ChunkEncoder
from clubhouse.llm.words import slices
from clubhouse.session import written

FRAME_IDS = 1 << 17
#: Tasks that read files at most; each reads several if there are more.
_MOST_TASKS = 100_000
SKIPPABLE = 0x184D2A5E
DOCUMENTS = 0x184D2A50
SEEKABLE = 0x8F92EAB1
_DOCUMENT = np.dtype([("id", "<i8"), ("frame", "<u4"), ("start", "<u4"), ("count", "<u4"), ("named", "<u4")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
MANIFEST = "part int, path string, documents long, ids long, bytes long, width int"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a folder's address, and the folder's path there."""
    if "://" not in uri:
        uri = "file://" + re.sub("^file:", "", uri)
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file, a run of documents at a time."""

    def __init__(self, sink, width: int, level: int = 1):
        self._sink, self._type = sink, np.dtype("<u2" if width == 2 else "<u4")
        self._pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self._waiting: list[np.ndarray] = []
        self._waiting_ids = 0
        self._documents: list[np.ndarray] = []
        self._frames: list[tuple[int, int, int]] = []
        self.ids = self.documents = self.bytes = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Append documents; a frame is closed when it holds FRAME_IDS ids."""
        ends = np.cumsum(counts)
        at = 0
        while at < len(counts):
            before = int(ends[at - 1]) if at else 0
            room = max(FRAME_IDS - self._waiting_ids, 1)
            to = max(at + 1, int(np.searchsorted(ends, before + room, "right")))
            rows = np.zeros(to - at, _DOCUMENT)
            rows["id"] = [0 if x is None else x for x in doc_ids[at:to]]
            rows["named"] = [x is not None for x in doc_ids[at:to]]
            rows["frame"] = len(self._frames)
            rows["count"] = counts[at:to]
            rows["start"] = self._waiting_ids + (ends[at:to] - counts[at:to]) - before
            self._documents.append(rows)
            self._waiting.append(ids[before : int(ends[to - 1])])
            self._waiting_ids += int(ends[to - 1]) - before
            if self._waiting_ids >= FRAME_IDS:
                self._close_frame()
            at = to
        self.documents += len(counts)
        self.ids += int(ends[-1]) if len(ends) else 0

    def _put(self, data: bytes) -> None:
        self._sink.write(data)
        self.bytes += len(data)

    def _close_frame(self) -> None:
        if not self._waiting:
            return
        ids = np.concatenate(self._waiting)
        if len(ids) and (ids.min() < 0 or ids.max() > np.iinfo(self._type).max):
            raise ValueError(f"an id does not fit {self._type.itemsize} bytes")
        data = ids.astype(self._type).tobytes()
        packed = self._pack.compress(data)
        self._put(packed)
        self._frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self._waiting, self._waiting_ids = [], 0

    def close(self) -> None:
        self._close_frame()
        listed = np.concatenate([np.zeros(0, _DOCUMENT), *self._documents]).tobytes()
        self._put(struct.pack("<II", DOCUMENTS, len(listed)) + listed)
        table = np.array(self._frames, _SEEK).tobytes()
        self._put(struct.pack("<II", SKIPPABLE, len(table) + 9) + table)
        self._put(struct.pack("<IBI", len(self._frames), 0x80, SEEKABLE))
        self._sink.close()


class Reader:
    """Reads documents of one file (any seekable source)."""

    def __init__(self, source, width: int):
        self._source, self._type = source, np.dtype("<u2" if width == 2 else "<u4")
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table")
        self._table = np.frombuffer(source.read_at(12 * frames, size - 9 - 12 * frames), _SEEK)
        self._starts = np.concatenate([[0], np.cumsum(self._table["packed"], dtype=np.int64)])
        begin = int(self._starts[-1])
        magic, length = struct.unpack("<II", source.read_at(8, begin))
        if magic != DOCUMENTS:
            raise ValueError("no list of documents")
        self.documents = np.frombuffer(source.read_at(length, begin + 8), _DOCUMENT)
        self._unpack = zstandard.ZstdDecompressor()
        self.frames_read = 0

    def frame(self, number: int) -> np.ndarray:
        """The ids of a frame; raises if its checksum differs."""
        row = self._table[number]
        packed = self._source.read_at(int(row["packed"]), int(self._starts[number]))
        data = self._unpack.decompress(packed, max_output_size=int(row["size"]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != row["check"]:
            raise ValueError(f"frame {number} is damaged")
        self.frames_read += 1
        return np.frombuffer(data, self._type)

    def rows(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each frame needed: the rows of its (wanted) documents, and its ids."""
        rows = self.documents
        if wanted is not None:
            rows = rows[np.isin(rows["id"], np.fromiter(wanted, np.int64)) & (rows["named"] == 1)]
        for number in np.unique(rows["frame"]):
            yield rows[rows["frame"] == number], self.frame(int(number))


def write(docs: DataFrame, folder: str, encoder: Callable, width: int, end_id: int) -> DataFrame:
    """Write (doc_id, text) as files in ascending order of id; returns the manifest.

    ``encoder()`` is called in a worker and gives a function from a list of
    texts to (ids in a row, ids per text). ``end_id`` follows every document. A
    null text counts as empty. Null ids come first; rows with equal ids are
    documents of their own, ordered by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = None, None
        part = TaskContext.get().partitionId()
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                if out is None:
                    encode = encoder()
                    system, top = open_folder(folder)
                    system.create_dir(top, recursive=True)
                    path = f"{top}/ids-{part:05d}-{uuid.uuid4().hex}.zst"
                    out = Writer(system.open_output_stream(path, compression=None), width)
                ids, counts = encode(texts.to_pylist())
                ends = np.cumsum(counts)
                out.add(
                    batch.column(0).slice(at, len(texts)).to_pylist(),
                    np.insert(ids, ends, end_id),
                    counts + 1,
                )
                at += len(texts)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "path": [path],
                    "documents": [out.documents],
                    "ids": [out.ids],
                    "bytes": [out.bytes],
                    "width": pa.array([width], pa.int32()),
                }
            )

    ranged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranged = ranged.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(run, MANIFEST))


def read(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """Read the files of a manifest back: doc_id, start (ids of all documents
    before it), n_tokens, ids (binary: little-endian unsigned 32-bit integers).

    ``wanted`` names the documents to read; only their frames are decompressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, width, base in zip(*(batch.column(n).to_pylist() for n in ("path", "width", "base"))):
                system, _ = open_folder(folder)
                with system.open_input_file(path) as source:
                    reader = Reader(source, width)
                    totals = np.cumsum(reader.documents["count"].astype(np.int64))
                    firsts = base + totals - reader.documents["count"]
                    place = {}
                    for number, first in zip(*np.unique(reader.documents["frame"], return_index=True)):
                        place[int(number)] = int(firsts[first])
                    for rows, ids in reader.rows(wanted):
                        yield _read_batch(rows, ids.astype("<u4"), place[int(rows["frame"][0])])

    one_by_one = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(one_by_one), F.lit(0)))
    # A task per file: few rows, but each stands for much work.
    tasks = max(1, min(manifest.count(), _MOST_TASKS))
    spread = based.repartition(tasks).select("path", "width", "base")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _read_batch(rows: np.ndarray, ids: np.ndarray, before: int) -> pa.RecordBatch:
    begins = rows["start"].astype(np.int64)
    counts = rows["count"].astype(np.int64)
    data = ids.tobytes()
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(rows["id"], mask=rows["named"] == 0),
            "start": pa.array(before + begins),
            "n_tokens": pa.array(counts),
            "ids": pa.array([data[4 * a : 4 * (a + n)] for a, n in zip(begins.tolist(), counts.tolist())], pa.binary()),
        }
    )


@lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> Callable:
    """An encoder over a byte-level vocabulary file of the tokenizers library.

    Strings of special tokens in a text are ordinary text.
    """
    import json

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    told = json.loads(library.to_str())
    names = library.get_vocab(with_added_tokens=False)
    opens = np.zeros(library.get_vocab_size(), bool)
    for name, number in names.items():
        opens[number] = name.startswith("Ġ")
    cutter = told["pre_tokenizer"] or {}
    # A piece may reach over a space only between white space, as irregular texts have it.
    by_chunk = (
        told["normalizer"] is None
        and told["model"]["type"] == "BPE"
        and cutter.get("type") == "ByteLevel"
        and cutter.get("use_regex") is True
        and not cutter.get("add_prefix_space")
        and not any(library.decode([n]).strip() for name, n in names.items() if "Ġ" in name[1:])
    )
    irregular = re.compile(r" (?:\s|\Z)").search if by_chunk else lambda _: True
    return ChunkEncoder(
        # The fast form leaves out places in the text, which nobody needs here.
        lambda text: library.encode_batch_fast([text], add_special_tokens=False)[0].ids,
        opens,
        irregular,
        bare_start=False,
    )
