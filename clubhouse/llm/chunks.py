"""Encoding many texts with a subword library, each distinct chunk once.

A chunk is a space with what follows up to the next space. In the vocabularies
used here no piece reaches from one chunk into the next, so the ids of a text
are the ids of its chunks in a row. Chunks that were not met before are joined
and given to the library together; a piece that begins with a space shows where
the next chunk begins. Texts whose spaces are not single ones between words go
to the library whole. The result is what the library gives for the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Chunks a worker remembers, and the longest one in characters.
CACHE_CHUNKS = 400_000
CACHED_LENGTH = 48
#: New chunks that the library encodes together, and so few that they go one by one
#: where that does not work.
LINE_CHUNKS = 256
FEW_CHUNKS = 16


def _text(chunks: list) -> str:
    """Chunks one space apart, as text; they are text or UTF-8, all alike."""
    return b" ".join(chunks).decode() if isinstance(chunks[0], bytes) else " ".join(chunks)


class ChunkEncoder:
    """Encodes lists of texts to 32-bit ids.

    ``encode`` gives the ids of one text as the library does; ``opens[i]`` tells
    if piece i begins with a space; ``irregular`` finds texts that must be
    encoded whole; ``bare_start`` says that the first chunk of a text, which has
    no space before it, is encoded as if it had one.
    """

    def __init__(
        self,
        encode: Callable[[str], list[int]],
        opens: np.ndarray,
        irregular: Callable[[str], object],
        bare_start: bool,
    ):
        self._encode, self._opens = encode, opens
        self._irregular, self._lead = irregular, "" if bare_start else " "
        # Two generations: when the younger is full, it takes the elder's place, and
        # what is met again returns. Frequent chunks are so never encoded anew.
        self._known: dict[str, bytes] = {}
        self._elder: dict[str, bytes] = {}
        self._bare: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._encode(text), np.int32).tobytes()

    def _first(self, chunk: str) -> bytes:
        ids = self._bare.get(chunk)
        if ids is None:
            ids = self._whole(_text([chunk]))
            if len(chunk) <= CACHED_LENGTH:
                self._bare[chunk] = ids
        return ids

    def _learn(self, missing: list[str]) -> None:
        for at in range(0, len(missing), LINE_CHUNKS):
            self._learn_line(missing[at : at + LINE_CHUNKS])

    def _learn_line(self, part: list[str]) -> None:
        ids = np.asarray(self._encode(self._lead + _text(part)), np.int32)
        begins = np.flatnonzero(self._opens[ids])
        if len(begins) == len(part) and not begins[0]:
            data, cuts = ids.tobytes(), [*(begins * 4).tolist(), 4 * len(ids)]
            self._known.update((c, data[a:b]) for c, a, b in zip(part, cuts, cuts[1:]))
        elif len(part) > FEW_CHUNKS:
            half = len(part) // 2
            self._learn_line(part[:half])
            self._learn_line(part[half:])
        else:
            self._known.update((c, self._whole(self._lead + _text([c]))) for c in part)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        whole = [not text or bool(self._irregular(text)) for text in texts]
        return self._all([None if w else t.split(" ") for t, w in zip(texts, whole)], texts)

    def of_chunks(self, chunked: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that are given as their chunks in UTF-8."""
        return self._all(chunked, [""] * len(chunked))

    def _all(self, chunked: list[list | None], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._known) > CACHE_CHUNKS // 2:
            self._known, self._elder = {}, self._known
        if len(self._bare) > CACHE_CHUNKS // 8:
            self._bare.clear()
        known = self._known
        # The first chunk has no space before it and so may have ids of its own.
        inner = [chunks[1:] if chunks and self._lead else chunks or () for chunks in chunked]
        missing = set().union(*inner)
        missing -= known.keys()
        met = missing & self._elder.keys()
        known.update(zip(met, map(self._elder.__getitem__, met)))
        missing -= met
        self._learn(list(missing))
        rows = []
        for text, chunks, rest in zip(texts, chunked, inner):
            if not chunks:
                rows.append(self._whole(text))
                continue
            row = b"".join(map(known.__getitem__, rest))
            rows.append(self._first(chunks[0]) + row if self._lead else row)
        for chunk in missing:
            if len(chunk) > CACHED_LENGTH:
                del known[chunk]
        counts = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        return np.frombuffer(b"".join(rows), np.int32), counts
