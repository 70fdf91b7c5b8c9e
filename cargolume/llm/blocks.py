"""Texts of an Arrow batch as flat byte arrays, and their words as 64-bit codes; vectorised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together; one longer text is looked at alone.
BLOCK = 1 << 20
#: Texts of a batch copied together.
ROWS = 1024
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
MIX = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def blocks(texts: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, cuts): text i of the block is bytes[cuts[i]:cuts[i + 1]]; nulls are empty. size: bytes of a block, BLOCK unless given."""
    for begin in range(0, len(texts), ROWS):
        part = pc.fill_null(texts[begin : begin + ROWS], "").cast(pa.large_string())
        buffers = part.buffers()
        cuts = np.frombuffer(buffers[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < len(part):
            end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + (size or BLOCK), "right")) - 1)
            end = min(end, len(part))
            yield data[cuts[at] : cuts[end]], cuts[at : end + 1] - cuts[at]
            at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_starts(solid: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin (maximal runs of `solid` bytes inside one text), and the text of each."""
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = cuts[:-1][cuts[:-1] < cuts[1:]]
    begins[first] = solid[first]
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(cuts, starts, "right") - 1


def word_codes(data: np.ndarray, solid: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word's bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    marks = np.concatenate([[0], starts])
    place = np.arange(len(data)) - np.repeat(marks, np.diff(np.concatenate([marks, [len(data)]])))
    bytes_ = (data.astype(np.uint64) + np.uint64(1)) * MIX[place & 63] + place.astype(np.uint64)
    return mixed(np.add.reduceat(np.where(solid, mixed(bytes_), np.uint64(0)), starts))


def shingles(data: np.ndarray, cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count) of the distinct word shingles of each text, sorted by text and code.

    A text of fewer words than `width` has one shingle, all its words; one without words has none.
    """
    solid = ~BLANK[data]
    starts, owner = word_starts(solid, cuts)
    codes = word_codes(data, solid, starts)
    n = len(codes)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(width, n)):
        out[: n - j] += np.where(owner[j:] == owner[: n - j], mixed(codes[j:] + MIX[j]), np.uint64(0))
    words = np.bincount(owner, minlength=len(cuts) - 1)
    firsts = np.cumsum(words) - words
    kept = np.arange(n) - firsts[owner] <= np.maximum(words - width, 0)[owner]
    codes, owner = mixed(out[kept]), owner[kept]
    by = np.lexsort((codes, owner))
    codes, owner = codes[by], owner[by]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    return owner[heads], codes[heads], np.diff(np.concatenate([heads, [len(codes)]]))
