"""Files of numpy arrays in the shared folder, memory-mapped by the tasks that read them; Elias-Fano sequences."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


def _local(folder: str) -> str | None:
    parts = urlparse(folder)
    return parts.path if parts.scheme in ("", "file") else None


def save_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file; written under another name first, so that a repeated task replaces it whole."""
    head, at, body = {}, 0, []
    for key, values in arrays.items():
        raw = np.ascontiguousarray(values).tobytes()
        head[key] = (values.dtype.str, len(values), at)
        body += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + (-len(raw) % 8)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    data = [len(text).to_bytes(8, "little"), text, *body]
    other = f"{name}.{uuid.uuid4().hex}"
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{other}", "wb") as file:
            file.writelines(data)
        os.replace(f"{path}/{other}", f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{other}") as file:
        for part in data:
            file.write(part)
    store.move(f"{path}/{other}", f"{path}/{name}")


def map_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; from a store that is no file system, from a local copy
    that has no name any more."""
    if (path := _local(folder)) is not None:
        raw = np.memmap(f"{path}/{name}", dtype=np.uint8, mode="r")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(f"{path}/{name}") as file:
            while part := file.read(1 << 24):
                copy.write(part)
            copy.flush()
            raw = np.memmap(copy.name, dtype=np.uint8, mode="r")
    raw = raw.view(np.ndarray)  # still mapped; slices of a memmap are slow
    size = int(raw[:8].view("<u8")[0])
    head = json.loads(raw[8 : 8 + size].tobytes())
    base = 8 + size
    return {k: raw[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in head.items()}


def ef_arrays(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    """Elias-Fano code of a sequence that never decreases: low bits packed, high parts in unary.

    Beside the unary bits stands the number of ones before each 64-bit word.
    """
    n = len(values)
    values = values.astype(np.uint64)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    bits = np.zeros((top >> low) + n + 1, dtype=np.uint8)
    bits[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    bits = np.concatenate([bits, np.zeros(-len(bits) % 64, dtype=np.uint8)])
    upper = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.bitwise_count(upper).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32 if n < 2**32 else np.uint64)
    packed = np.zeros(n * low // 64 + 2, dtype=np.uint64)
    if low:
        part = values & np.uint64((1 << low) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(packed, word, part << shift)
        over = shift + np.uint64(low) > 64
        np.bitwise_or.at(packed, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    return {f"{prefix}_upper": upper, f"{prefix}_before": before, f"{prefix}_low": packed, f"{prefix}_shape": np.array([n, low])}


def _select(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth (from 0) set bit of each word: halves, quarters and so on by counting bits."""
    place = np.zeros(len(words), dtype=np.uint64)
    nth = nth.astype(np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        here = np.bitwise_count((words >> place) & np.uint64((1 << width) - 1)).astype(np.uint64)
        up = nth >= here
        nth = np.where(up, nth - here, nth)
        place = np.where(up, place + np.uint64(width), place)
    return place.astype(np.int64)


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.upper, self.before, self.packed, shape = (arrays[f"{prefix}_{k}"] for k in ("upper", "before", "low", "shape"))
        self.n, self.low = int(shape[0]), int(shape[1])
        self.zeros = np.arange(len(self.upper), dtype=np.int64) * 64 - self.before.astype(np.int64)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), dtype=np.int64)
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.packed[word] >> shift
        more = shift > 0
        value = np.where(more, value | (self.packed[word + 1] << ((np.uint64(64) - shift) & np.uint64(63))), value)
        return (value & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        word = np.searchsorted(self.before, i, "right") - 1
        high = word * 64 + _select(self.upper[word], i - self.before[word].astype(np.int64)) - i
        return (high << self.low) | self.lows(i)

    def _ones_before_zero(self, nth: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most nth (0 for nth = -1)."""
        inside = np.maximum(nth, 0)
        word = np.searchsorted(self.zeros, inside, "right") - 1
        place = word * 64 + _select(~self.upper[word], inside - self.zeros[word])
        return np.where(nth < 0, 0, place - inside)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of the values, -1 where the sequence does not hold them: successor search."""
        out = np.full(len(values), -1, dtype=np.int64)
        if not self.n:
            return out
        high, low = values >> self.low, values & ((1 << self.low) - 1)
        live = np.flatnonzero(high <= (len(self.upper) * 64 - self.n - 1))
        at, end = self._ones_before_zero(high[live] - 1), self._ones_before_zero(high[live])
        low, stop = low[live], end.copy()
        some = np.flatnonzero(at < end)
        while len(some):  # the low parts of one high part rise: halve
            half = (at[some] + end[some]) // 2
            less = self.lows(half) < low[some]
            at[some] = np.where(less, half + 1, at[some])
            end[some] = np.where(less, end[some], half)
            some = some[at[some] < end[some]]
        some = np.flatnonzero(at < stop)
        some = some[self.lows(at[some]) == low[some]]
        out[live[some]] = at[some]
        return out
