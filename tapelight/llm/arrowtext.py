"""Vectorised handling of text columns inside Spark tasks.

Tasks receive Arrow batches.  `slices` cuts a batch so that one slice holds a bounded number of text
bytes (a single longer text is a slice of its own), and the other functions work on the UTF-8 bytes of
a whole slice at once with numpy, instead of row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: New segments that a memo encodes in one call: a library's results take some hundred bytes for each until they are stored.
ENCODED = 4096
#: ASCII white space: 0x09-0x0D and the space.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits, and ASCII punctuation other than the apostrophe (which may begin a contraction).
PLAIN, MARKS = np.zeros(256, bool), np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
MARKS[33:127] = ~PLAIN[33:127]
MARKS[39] = False
#: The other characters with Unicode's White_Space property, as UTF-8 (fixed values).
WIDE_WHITE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of at most `most` text bytes; a longer text stands alone. Null text becomes empty."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        texts = batch.column(k)
        if texts.null_count or not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
            texts = pc.fill_null(texts.cast(pa.string()), "")
            batch = batch.set_column(k, column, texts)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an array without nulls, and the n + 1 places where texts begin and end."""
    wide = pa.types.is_large_string(texts.type)
    kind = np.int64 if wide else np.int32
    _, places, data = texts.buffers()
    at = np.frombuffer(places, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def dictionary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
    """A number for each piece `data[start:end]` (up to the next start by default) and the distinct pieces by number."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    if ends is None:
        places = np.append(starts, len(data))
    else:  # the gaps between pieces are pieces too, left out afterwards
        places = np.stack([starts, ends], 1).ravel()
    kind = pa.large_binary() if places[-1] >= 1 << 31 else pa.binary()
    buffer = pa.py_buffer(np.ascontiguousarray(places.astype(np.int64 if kind == pa.large_binary() else np.int32)))
    pieces = pa.Array.from_buffers(kind, len(places) - 1, [None, buffer, pa.py_buffer(np.ascontiguousarray(data))])
    if ends is not None:
        pieces = pieces.take(pa.array(np.arange(0, len(places) - 1, 2)))
    found = pieces.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space, never over a text's end) and, for each text, its first word's index (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    black = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1] | edge[1:-1]
    last[:-1] &= ~black[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of segments, roughly white space and the word after it, and each text's first segment (n + 1).

    A segment begins wherever ASCII white space follows a character that isn't white space of any kind,
    and where ASCII punctuation other than an apostrophe follows a letter or digit (ASCII, or U+00C0 to
    U+00FF). Every pre-tokenizer here ends a match at such a place and looks no further, so a text's ids
    are those of its segments one after the other.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    white = WHITE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = white[1:] & ~white[:-1]
    odd = np.flatnonzero(cut[:-1])
    odd = odd[data[odd - 1] >= 128]
    for mark in WIDE_WHITE:
        own = odd[odd >= len(mark)]
        same = np.ones(len(own), bool)
        for i, byte in enumerate(reversed(mark)):
            same &= data[own - 1 - i] == byte
        cut[own[same]] = False
    mark = np.flatnonzero(MARKS[data[1:]]) + 1
    before = data[mark - 1]
    letter = PLAIN[before] | (before >= 128) & (data[mark - 2] == 0xC3) & (mark >= 2) & (before != 0x97) & (before != 0xB7)
    cut[mark[letter]] = True
    cut[at] = True
    starts = np.flatnonzero(cut[:-1])
    return starts, np.searchsorted(starts, at)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Memo:
    """Token ids of segments. Each distinct segment is encoded once and then looked up.

    `encode` takes a list of at most ENCODED strings and returns a list of id lists. Beyond `most` segments the memo forgets those that
    one call alone has had (all, if others are more than half), so memory stays bounded whatever the vocabulary of the input.
    `fold` may change bytes for others, one for one, that make no difference to the ids or to where segments begin.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 300_000, fold: Callable[[np.ndarray], np.ndarray] | None = None):
        self.encode, self.most, self.fold = encode, most, fold
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.again = np.zeros(1 << 16, bool)
        self.used = 0

    def thin(self) -> None:
        """Keep the segments that came in more than one call."""
        kept = np.flatnonzero(self.again[: len(self.rows)])
        if 2 * len(kept) > self.most:
            return self.clear()
        keys = list(self.rows)  # in the order of their rows
        lengths = self.lengths[kept]
        self.flat = self.flat[ranges(self.starts[kept], lengths.astype(np.int64))]
        self.starts, self.lengths, self.again = np.cumsum(lengths, dtype=np.int64) - lengths, lengths, np.zeros(len(kept), bool)
        self.rows, self.used = {keys[i]: row for row, i in enumerate(kept.tolist())}, len(self.flat)

    def _store(self, name: str, at: int, new: np.ndarray) -> None:
        old = getattr(self, name)
        if at + len(new) > len(old):
            grown = np.zeros(max(2 * len(old), at + len(new)), old.dtype)
            grown[:at] = old[:at]
            setattr(self, name, grown)
        getattr(self, name)[at : at + len(new)] = new

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts and the n + 1 places where a text's ids begin and end."""
        if len(self.rows) > self.most:
            self.thin()
        if self.fold is not None:
            data = self.fold(data)
        starts, first = segments(data, at)
        codes, distinct = dictionary(data, starts)
        keys = distinct.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes ten times as long
        rows = np.fromiter(map(self.rows.get, keys, repeat(-1)), np.int64, len(keys))
        self.again[rows[rows >= 0]] = True
        missing = np.flatnonzero(rows < 0)
        for a in range(0, len(missing), ENCODED):
            new, known = missing[a : a + ENCODED], len(self.rows)
            fresh = [keys[i] for i in new]
            ids = self.encode([k.decode() for k in fresh])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
            self._store("flat", self.used, flat)
            self._store("starts", known, self.used + np.cumsum(lengths) - lengths)
            self._store("lengths", known, lengths.astype(np.int32))
            self._store("again", known, np.zeros(len(new), bool))
            self.used += len(flat)
            self.rows.update(zip(fresh, range(known, known + len(fresh)), strict=True))
            rows[new] = np.arange(known, known + len(fresh))
        each = rows[codes]
        lengths = self.lengths[each].astype(np.int64)
        bounds = np.append(0, np.cumsum(lengths))
        return self.flat[ranges(self.starts[each], lengths)], bounds[first]
