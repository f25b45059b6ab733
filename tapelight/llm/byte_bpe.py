"""Byte-level BPE with a sentencepiece model made directly from a rank vocabulary.

The model is a serialised protocol buffer: one piece for each token, its bytes mapped one to one to printable
characters, scored by its negative rank, so that the merge with the best score is the merge with the lowest
rank; the normaliser is the identity. Pre-tokens are cut by the vocabulary's pattern, mapped and encoded;
decoding looks up each id's bytes. A pre-token that is itself a token is that token, as in the rank format's
own definition.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import Memo, ranges, slices, utf8


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens by rank of a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [found[i] for i in range(len(found))]


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece numbers are the tokens' ranks; the unknown piece comes last."""
    letters = byte_characters()
    pieces = [_field(1, _field(1, "".join(letters[b] for b in token).encode()) + b"\x15" + struct.pack("<f", -rank)) for rank, token in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    # trainer: model_type BPE, byte_fallback off, unk/bos/eos/pad ids; normaliser: identity, nothing added or removed
    off = (1 << 64) - 1
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(k, off) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.table = dict(enumerate(byte_characters()))
        self.whole = {token: rank for rank, token in enumerate(tokens)}
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.memo = Memo(self.encode)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        missing: list[str] = []
        places: list[tuple[int, int]] = []
        for text in texts:
            ids: list[int] = []
            for word in self.pattern.findall(text):
                raw = word.encode()
                rank = self.whole.get(raw)
                if rank is None:
                    places.append((len(out), len(ids)))
                    missing.append(raw.decode("latin-1").translate(self.table))
                    ids.append(-1)
                else:
                    ids.append(rank)
            out.append(ids)
        found = self.model.encode(missing, num_threads=1) if missing else []
        for (i, j), ids in zip(reversed(places), reversed(found), strict=True):
            out[i][j : j + 1] = ids
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the n + 1 places where an id's bytes begin and end."""
        lengths = self.lengths[ids]
        return self.bytes[ranges(self.starts[ids], lengths)], np.append(0, np.cumsum(lengths))


@functools.lru_cache(2)
def bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder a worker process; its memo lasts from task to task."""
    return ByteBpe(read_ranks(path), pattern)


@functools.lru_cache(2)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes `id,` of every id: all of them, their starts and lengths."""
    each = [b"%d," % i for i in range(n)]
    lengths = np.fromiter(map(len, each), np.int64, n)
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum(lengths) - lengths, lengths


def encode_documents(documents: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array of int; left out on request), ids_sha256, decoded_sha256, text (decoded).

    path: the rank file, there on every executor. Null text counts as empty and gives no ids. Rows keep no order;
    repeated rows give repeated results; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        shown, starts, lengths = decimals(len(coder.tokens))
        for batch in slices(batches):
            flat, at = coder.memo(*utf8(batch.column("text")))
            size = lengths[flat]
            digits, digit_at = shown[ranges(starts[flat], size)], np.append(0, np.cumsum(size))[at]
            raw, raw_at = coder.decode(flat)
            raw_at = raw_at[at]
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(at), pa.int64()),
                pa.array([hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(digit_at[:-1], digit_at[1:], strict=True)]),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(raw_at[:-1], raw_at[1:], strict=True)]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat)), pa.array([raw[a:b].tobytes().decode() for a, b in zip(raw_at[:-1], raw_at[1:], strict=True)], pa.string())]
                names += ["ids", "text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, text string" * ids
    return documents.selectExpr(f"`{id_column}` AS doc_id", f"coalesce(`{text_column}`, '') AS text").mapInArrow(run, schema)
