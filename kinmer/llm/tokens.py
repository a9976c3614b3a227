"""Words of whole Arrow columns of texts, found bytewise in numpy: no Python object for a text or a word.

All classes of letters used here are sets of ASCII bytes, so they can be told apart in UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Words:
    """Words in order of the texts: `words[i]`, of row `row[i]`, in the stretch `piece[i]` that no separator cuts."""

    words: pa.BinaryArray
    row: np.ndarray
    piece: np.ndarray


def classes(gaps: str, separators: str = "") -> np.ndarray:
    """For each byte: 0 of a word, 1 of a gap between words, 2 of a separator."""
    kinds = np.zeros(256, np.uint8)
    kinds[[ord(c) for c in gaps]] = 1
    kinds[[ord(c) for c in separators]] = 2
    return kinds


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def row_chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) rows of stretches of about `most` bytes; a longer text is a stretch of its own."""
    ends = _offsets(texts)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
        yield first, max(end, first + 1)
        first = max(end, first + 1)


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def cut_words(texts: pa.Array, kinds: np.ndarray) -> Words:
    """The words of all texts, A-Z in lower case; a null text has none. At most 2 GB of text, as an Arrow column of strings holds."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return Words(pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends = _offsets(texts)
    body = texts.buffers()[2]
    data = _LOWER[np.frombuffer(body, np.uint8)[ends[0] : ends[-1]]] if body is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = kinds[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < len(data)]
    begins[firsts] = inside[firsts]  # a text's first letter begins a word whatever stands before it
    at = np.flatnonzero(begins)
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, ends)))
    piece = row + np.cumsum(kind == 2, dtype=np.int32)[at] if (kinds == 2).any() else row
    # Where the letters of each word lie once all others are left out.
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, inside.sum()).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return Words(words, row, piece)
