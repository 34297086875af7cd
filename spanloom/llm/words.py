"""Word splitting and hashing over whole Arrow text buffers, without a Python loop per document.

Both word classes are decided by single bytes once A-Z are lower-cased: every byte of a
multi-byte UTF-8 character is 0x80 or more and belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; working arrays take about 40 times as much.
CHUNK_BYTES = 1 << 20

def _table(is_word) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[[b for b in range(256) if not is_word(int(out[b]))]] = 0
    return out


#: Lower-cased byte, or 0 for one that separates words.
BETWEEN_SPACES = _table(lambda b: b not in (0x20, *range(0x09, 0x0E)))
ALPHANUMERIC = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A salt for each of a word's first lanes of eight bytes; later ones get theirs by the same rule.
_LANES = mix(np.arange(1, 65, dtype=np.uint64))
#: What is kept of a lane of which so many bytes belong to the word.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Words:
    """The words of a run of documents, in order.

    ``start`` and ``end`` are byte offsets in ``data``; ``doc`` is the row of each word;
    ``first`` has the index of each row's first word and, last, the number of words.
    """

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, values = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its lanes of eight bytes, each mixed with its place, are summed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(len(codes) + 1, "<u8", padded, strides=(1,))
    length = end - start
    lanes = (length + 7) >> 3
    first = np.cumsum(lanes) - lanes
    if len(first) == first[-1] + lanes[-1]:  # no word has a second lane
        value = at_byte[start] & _KEPT[length]
        return mix(mix(value ^ _LANES[0]) + length.astype(np.uint64))
    number = np.arange(first[-1] + lanes[-1]) - np.repeat(first, lanes)
    value = at_byte[np.repeat(start, lanes) + 8 * number] & _KEPT[np.minimum(np.repeat(length, lanes) - 8 * number, 8)]
    salt = _LANES[number] if lanes.max() <= len(_LANES) else mix(number.astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(mix(value ^ salt), first) + length.astype(np.uint64))


def split(texts: pa.Array, table: np.ndarray) -> Words:
    """All words of the column under the word class of ``table``."""
    data, offsets = buffers(texts)
    codes = table[data]
    inside = codes != 0
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, doc, first, _hashes(codes, start, end))


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes that :func:`split` gives to these single, lower-case words."""
    found = split(pa.array(words, pa.large_string()), BETWEEN_SPACES)
    if len(found.start) != len(words):
        raise ValueError("each entry must be one word")
    return found.hash


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text stays near ``most`` bytes; a longer text comes alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths, dtype=np.int64)
        i = 0
        while i < len(lengths):
            base = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(i, j - i)
            i = j
