"""Adaptive context-mixing range coder for token ids, in blocks that stand alone.

Three orders predict an id. Order 0 is a distribution by the counts of ids so far. Orders 1 and 2 remember, for the last id and
for a hash of the last two ids, an id that came next, with a confidence of 0 (none yet) to 3. The distribution that drives
the range coder is the mixture of the three: order 0's shares, and each guess's own share on top of what its id has there.
A guess's odds are learnt for every two confidences, apart where both guess alike.

A block holds BLOCK ids at most and starts from an empty model, so any block can be read alone and a damaged one spoils
only itself. Its ids are cut into lanes of some 256 ids, coded in step with a range coder each; all lanes share the block's
model, which learns after steps 1, 2, 4, 8 and every 8 from then on (order 0 after powers of 2). So one numpy operation
serves thousands of ids, and when coding is not bound to the steps at all but in the range coder's own few operations.

Block: `TLC3`, number of ids, number of words, CRC-32 of the ids (little-endian unsigned 32-bit), CRC-32 of the words
(each little-endian unsigned 16-bit), then the words: how many each lane has, then those of each lane. A lane ends in zeros
that aren't stored. Ids are 0 to 65534.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
#: Lanes of a block at most, ids of a lane (at least, below LANES lanes), and steps between learning.
LANES, LANE, STEPS = 4096, 256, 8
NONE = 0xFFFF
#: What order 0 gives each id, and all ids so far together besides.
LEAST_SHARE, SHARES = 1, (1 << 20) - (1 << 16)
SLOTS = 18  # bits of order 2's hash
CLASSES = 32
#: A guess has so many times order 0's whole at most: the whole stays below 2 ** 29.
MOST_ODDS = 255
#: The range is kept from LEAST to 2 ** 16 times that; a word of 16 bits leaves (or enters) when it is below.
LEAST = 1 << 32
HEAD = struct.Struct("<4sIIII")
MAGIC = b"TLC3"


class _Model:
    """What a block's ids so far say of the next."""

    def __init__(self) -> None:
        self.order1 = np.full(1 << 16, NONE, np.int32)
        self.order2 = np.full(1 << SLOTS, NONE, np.int32)
        self.counts = np.zeros(1 << 16, np.int64)
        self.met, self.right1, self.right2 = (np.zeros(CLASSES, np.int64) for _ in range(3))
        self.weigh()
        self.mix()

    def weigh(self) -> None:
        """Order 0 from the counts."""
        shares = LEAST_SHARE + self.counts * SHARES // max(1, int(self.counts.sum()))
        self.ends = np.cumsum(shares)
        self.starts = self.ends - shares
        self.whole = int(self.ends[-1])
        self.shares = shares

    def mix(self) -> None:
        """The guesses' shares by class, from how often they were right."""
        wrong = 2 * (self.met - self.right1 - self.right2) + 2
        most = MOST_ODDS * self.whole
        self.extra1 = np.minimum(self.whole * (2 * self.right1 + 1) // wrong, most)
        self.extra2 = np.minimum(self.whole * (2 * self.right2 + 1) // wrong, most)
        self.extra1[CLASSES // 2 :] = 0  # alike: order 2 has both shares

    def guesses(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Order 2's slot, both entries, both guesses, and their class; a is the last id, b the one before."""
        slot = (a * 40503 ^ b * -1640531535) >> (32 - SLOTS) & ((1 << SLOTS) - 1)
        entry1, entry2 = self.order1.take(a), self.order2.take(slot)
        guess1, guess2 = entry1 & 0xFFFF, entry2 & 0xFFFF
        return slot, entry1, entry2, guess1, guess2, (entry1 >> 16) + (entry2 >> 16 << 2) + ((guess1 == guess2) << 4)

    def learn(self, x: np.ndarray, a: np.ndarray, found: tuple[np.ndarray, ...]) -> None:
        """Take in ids and what `guesses` gave for them."""
        slot, entry1, entry2, guess1, guess2, kind = found
        hit1, hit2 = x == guess1, x == guess2
        seen = np.bincount(kind + hit1 * np.int32(CLASSES) + hit2 * np.int32(2 * CLASSES), minlength=4 * CLASSES).reshape(4, CLASSES)
        self.met += seen.sum(0)
        self.right1 += seen[1]
        self.right2 += seen[2] + seen[3]
        fresh = x | 1 << 16
        for table, at, entry, hit in ((self.order1, a, entry1, hit1), (self.order2, slot, entry2, hit2)):
            surer = np.minimum(entry + (1 << 16), entry & 0xFFFF | 3 << 16)
            table[at] = np.where(hit, surer, np.where(entry >= 2 << 16, entry - (1 << 16), fresh))


def _segments(steps: int) -> Iterator[tuple[int, int]]:
    """Steps that are coded before the model learns from them."""
    at = 0
    while at < steps:
        to = min(steps, at + (1 if at < 2 else min(at, STEPS)))
        yield at, to
        at = to


class _Coder:
    """The range coders of a block's lanes. Encodes, or decodes `words` (places, lanes)."""

    def __init__(self, lanes: int, steps: int, words: np.ndarray | None = None):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
        self.place = np.zeros(lanes, np.int64)
        self.decoding = words is not None
        if words is None:
            self.words = np.zeros((2 * steps + 2, lanes), np.int32)
        else:
            self.words = words
            for k in range(3):  # while decoding: the code less the low end
                self.low = self.low << 16 | words[k]
            self.place += 3

    def narrow(self, m: int, unit: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """Take the part [start, start + width) of the first m lanes' ranges, in units, and shift words out or in."""
        low, span = self.low[:m], self.range[:m]
        if self.decoding:
            low -= start * unit
        else:
            low += start * unit
        np.multiply(unit, width, out=span)
        short = (span < LEAST).nonzero()[0]
        while len(short):
            at = self.place[short]
            own = low[short]
            if self.decoding:
                low[short] = own << 16 | self.words[at, short]
            else:
                self.words[at, short] = own >> 32
                low[short] = (own & 0xFFFFFFFF) << 16
            self.place[short] = at + 1
            wider = span[short] << 16
            span[short] = wider
            short = short[wider < LEAST]


def _parts(n: int) -> tuple[int, int, int]:
    """Lanes of a block of n ids, their ids, and how many lanes have one more."""
    lanes = min(LANES, max(1, n // LANE))
    return lanes, n // lanes, n % lanes


def _run(n: int, ids: np.ndarray | None, words: np.ndarray | None) -> tuple[np.ndarray, _Coder]:
    """Code a block: its ids given, or decoded from words. The ids, and the coder."""
    lanes, steps, more = _parts(n)
    past = np.zeros((steps + 3, lanes), np.int32)  # two rows of nothing before, one row of the lanes that have one more
    if ids is not None:
        past[2:, :more] = ids[: more * (steps + 1)].reshape(more, steps + 1).T
        past[2 : steps + 2, more:] = ids[more * (steps + 1) :].reshape(lanes - more, steps).T
    model, coder, counted = _Model(), _Coder(lanes, steps + 1, words), 0
    symbols = None
    for at, to in [*_segments(steps), *([(steps, steps + 1)] if more else [])]:
        if at and at & (at - 1) == 0 and at < steps:
            model.counts += np.bincount(past[counted + 2 : at + 2].ravel(), minlength=1 << 16)
            counted, symbols = at, None
            model.weigh()
            model.mix()
        m = more if at == steps else lanes
        if words is None:
            x = past[at + 2 : to + 2, :m]
            found = model.guesses(past[at + 1 : to + 1, :m], past[at:to, :m])
            guess1, guess2, kind = found[3:]
            extra1, extra2 = model.extra1.take(kind), model.extra2.take(kind)
            whole = extra1 + extra2 + model.whole
            start = model.starts.take(x) + (guess1 < x) * extra1 + (guess2 < x) * extra2
            width = model.shares.take(x) + (guess1 == x) * extra1 + (guess2 == x) * extra2
            for k in range(to - at):
                coder.narrow(m, coder.range[:m] // whole[k], start[k], width[k])
        else:
            if symbols is None:
                symbols = np.repeat(np.arange(1 << 16, dtype=np.uint16), model.shares)
            each = []
            for t in range(at, to):
                each.append(model.guesses(past[t + 1, :m], past[t, :m]))
                guess1, guess2, kind = each[-1][3:]
                extra1, extra2 = model.extra1.take(kind), model.extra2.take(kind)
                whole = extra1 + extra2 + model.whole
                unit = coder.range[:m] // whole
                target = np.minimum(coder.low[:m] // unit, whole - 1)
                # what lies in a guess's share moves to the last place of its id, what lies beyond down by the share
                target -= np.clip(target - model.ends.take(guess2) - (guess1 < guess2) * extra1 + 1, 0, extra2)
                target -= np.clip(target - model.ends.take(guess1) + 1, 0, extra1)
                x = symbols.take(target).astype(np.int32)
                start = model.starts.take(x) + (guess1 < x) * extra1 + (guess2 < x) * extra2
                width = model.shares.take(x) + (guess1 == x) * extra1 + (guess2 == x) * extra2
                coder.narrow(m, unit, start, width)
                past[t + 2, :m] = x
            found = tuple(map(np.concatenate, zip(*each, strict=True)))
        if to < steps:
            model.learn(past[at + 2 : to + 2].ravel(), past[at + 1 : to + 1].ravel(), tuple(part.ravel() for part in found))
            model.mix()
    if ids is None:
        ids = np.concatenate([past[2:, :more].T.ravel(), past[2 : steps + 2, more:].T.ravel()])
    return ids, coder


def encode(ids: np.ndarray) -> list[bytes]:
    """The blocks of a sequence of ids."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= NONE):
        raise ValueError("ids must be 0 to 65534")
    out = []
    for at in range(0, len(ids), BLOCK):
        own = np.ascontiguousarray(ids[at : at + BLOCK], np.int32)
        _, coder = _run(len(own), own, None)
        coder.words[coder.place, np.arange(len(coder.low))] = (coder.low + LEAST - 1) >> 32  # zeros after it are in the range
        coder.place += 1
        most = int(coder.place.max())
        for k in range(most - 1, 0, -1):  # carries, from the end
            coder.words[k - 1] += coder.words[k] >> 16
        words = coder.words[:most].T.astype("<u2")
        stored = np.concatenate([coder.place.astype("<u2"), words[np.arange(most) < coder.place[:, None]]])
        body = stored.tobytes()
        out.append(HEAD.pack(MAGIC, len(own), len(stored), zlib.crc32(own.astype("<u4").tobytes()), zlib.crc32(body)) + body)
    return out


def decode(data: bytes) -> np.ndarray:
    """The ids of blocks joined; ValueError where a block is damaged."""
    out, at = [np.zeros(0, np.int32)], 0
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise ValueError("a block is cut off")
        magic, n, count, ids_crc, crc = HEAD.unpack_from(data, at)
        body = data[at + HEAD.size : at + HEAD.size + 2 * count]
        lanes = _parts(n)[0] if n else 0
        if magic != MAGIC or not 0 < n <= BLOCK or len(body) != 2 * count or zlib.crc32(body) != crc or count < lanes:
            raise ValueError(f"the block at byte {at} is damaged")
        stored = np.frombuffer(body, "<u2")
        held = stored[:lanes].astype(np.int64)
        if held.sum() != count - lanes:
            raise ValueError(f"the block at byte {at} is damaged")
        words = np.zeros((lanes, 2 * (n // lanes) + 12), np.int32)
        words[np.arange(words.shape[1]) < held[:, None]] = stored[lanes:]
        ids, _ = _run(n, None, np.ascontiguousarray(words.T))
        if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("the ids of a block don't match their checksum")
        out.append(ids)
        at += HEAD.size + 2 * count
    return np.concatenate(out)
