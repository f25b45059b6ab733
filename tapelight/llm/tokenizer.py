"""Memoised encoders of a tokenizers file, one per worker process."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

import numpy as np

from .arrowtext import WHITE, Memo

#: A normaliser behind which neither the case of letters nor the kind of white space makes a difference.
FOLDING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
FOLDED[WHITE] = 32


@functools.lru_cache(2)
def _tokenizer(path: str):
    """The file's tokenizer, for which the strings of special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def folded(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case and ASCII white space as spaces, but before a byte beyond ASCII: NFC joins some marks to small letters alone."""
    out = FOLDED[data]
    before = np.flatnonzero(data[1:] >= 128)
    out[before] = data[before]
    return out


@functools.lru_cache(2)
def token_memo(path: str, most: int = 300_000) -> Memo:
    """Texts to ids, without special tokens; the strings of special tokens in a text are ordinary text."""
    tokenizer = _tokenizer(path)
    normal = tokenizer.normalizer
    folds = normal is not None and json.loads(normal.__getstate__()) == FOLDING
    return Memo(lambda texts: [found.ids for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], most, folded if folds else None)


@functools.lru_cache(2)
def library_ids(path: str, most: int = 300_000) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Texts to the ids that the library gives with add_special_tokens=False, called like a `Memo`.

    Texts with the literal of an added token (in any case, as a normaliser may lower it) are encoded whole by the library.
    """
    memo, library = token_memo(path, most), _tokenizer(path)
    literals = {token.content.encode().lower() for token in library.get_added_tokens_decoder().values()}

    def encode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, bounds = memo(data, at)
        plain = data.tobytes().lower()
        whole = set()
        for literal in literals:
            place = plain.find(literal)
            while place >= 0:
                text = int(np.searchsorted(at, place, "right")) - 1
                if place + len(literal) <= at[text + 1]:
                    whole.add(text)
                place = plain.find(literal, place + 1)
        if not whole:
            return flat, bounds
        lengths, parts, done = np.diff(bounds), [], 0
        for text in sorted(whole):
            library.encode_special_tokens = False
            try:
                own = library.encode(data[at[text] : at[text + 1]].tobytes().decode(), add_special_tokens=False).ids
            finally:
                library.encode_special_tokens = True  # as the memo needs it
            parts += [flat[bounds[done] : bounds[text]], np.array(own, flat.dtype)]
            lengths[text], done = len(own), text + 1
        return np.concatenate([*parts, flat[bounds[done] :]]), np.append(0, np.cumsum(lengths))

    return encode
