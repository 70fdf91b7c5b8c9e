"""BPE encoding by speculation and verification, and decoding.

A word is cut greedily into the longest vocabulary entries. That proposal is the BPE encoding exactly
if each entry encodes to itself and every two neighbours, merged alone, stay apart. Both are table
questions: the neighbour test runs vectorised over all proposals of a batch, and only the words that
fail it are merged pair by pair in rank order.

Cases: null and empty texts give no ids and an empty decoded text; texts of any length are encoded
whole (a failing word of n symbols takes n log n steps); repeated rows give repeated results; empty
tables give empty results; other columns are kept, the result columns replace columns of their name.
"""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIX = "</w>"
#: Words remembered by each Python worker; beyond it the memory is emptied, results do not change.
REMEMBERED = 300_000
#: The pre-tokenizer's pattern and the Unicode White_Space characters.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Bpe:
    """Tables of one tokenizer file; one per Python worker.

    Inside, a symbol is one character: byte b is chr(b), byte b at the end of a word chr(256 + b).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        byte_of = {c: i for i, c in enumerate(letters)}

        def inner(token: str) -> str:
            end = token.endswith(SUFFIX) and len(token) > len(SUFFIX)
            body = [byte_of[c] for c in (token[: -len(SUFFIX)] if end else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * end)

        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        # order: the base symbols first, then each merge's product in rank order
        self.base = 512
        self.id_of_order = np.zeros(self.base + len(merges), dtype=np.uint32)
        self.order: dict[str, int] = {}
        for b, c in enumerate(letters):
            for end in (0, 1):
                self.order[chr(b + 256 * end)] = b + 256 * end
                self.id_of_order[b + 256 * end] = vocab[c + SUFFIX * end]
        self.left = np.arange(len(self.id_of_order))
        self.right = np.arange(len(self.id_of_order))
        self.ranks: dict[int, int] = {}  # left order << 16 | right order -> order of the product
        for n, (a, b) in enumerate(merges, self.base):
            token = inner(a) + inner(b)
            self.order[token] = n
            self.id_of_order[n] = vocab[a + b]
            self.left[n], self.right[n] = self.order[inner(a)], self.order[inner(b)]
            self.ranks[int(self.left[n]) << 16 | int(self.right[n])] = n
        self.none = len(self.id_of_order)  # after every rank
        wide = np.array([*self.ranks], dtype=np.int64)
        by = np.argsort(wide)
        self.pair_keys, self.pair_made = wide[by], np.array([*self.ranks.values()])[by]
        self.ids = self.id_of_order.tolist()
        self.closing = {chr(b): chr(256 + b) for b in range(128)}
        # longest entry that begins with these two symbols
        self.reach: dict[str, int] = {}
        for token in self.order:
            self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 1))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.own: dict[int, bool] = {}
        self.memory: dict[str, bytes] = {}

    def merged(self, word: str) -> list[int]:
        """Exact merging: the neighbours of lowest rank first, leftmost first."""
        items, rank = [*map(ord, word)], self.ranks.get
        if len(items) > 64:
            return self.merged_long(items)
        none = self.none
        pairs = [rank(a << 16 | b, none) for a, b in zip(items, items[1:])]
        while pairs and (made := min(pairs)) < none:
            i = pairs.index(made)
            items[i] = made
            del items[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank(items[i - 1] << 16 | made, none)
            if i < len(pairs):
                pairs[i] = rank(made << 16 | items[i + 1], none)
        return items

    def merged_long(self, items: list[int]) -> list[int]:
        """The same with a heap and links instead of moving lists."""
        after = [*range(1, len(items)), -1]
        before = [-1, *range(len(items) - 1)]
        rank = self.ranks.get
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(items, items[1:])) if (r := rank(a << 16 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if items[i] != a or j < 0 or items[j] != b:
                continue
            items[i], items[j] = made, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := rank(made << 16 | items[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, made, items[after[i]]))
            if before[i] >= 0 and (r := rank(items[before[i]] << 16 | made)) is not None:
                heapq.heappush(heap, (r, before[i], items[before[i]], made))
        return [x for x in items if x >= 0]

    def proposed(self, word: str) -> list[int]:
        """Greedy longest match."""
        out, at, find, n, reach = [], 0, self.order.get, len(word), self.reach.get
        while at < n:
            end = min(n, at + reach(word[at : at + 2], 1))
            while (found := find(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def itself(self, token: int) -> bool:
        """Does the entry, as a text of its own, encode to itself?"""
        if (known := self.own.get(token)) is None:
            parts, stack = [], [token]
            while stack:
                t = stack.pop()
                if t < self.base:
                    parts.append(chr(t))
                else:
                    stack += [int(self.right[t]), int(self.left[t])]
            known = self.own[token] = self.merged("".join(parts)) == [token]
        return known

    def stay_apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: would merging never cross the boundary between them?

        The later of the two entries is taken apart step by step; a merge across the boundary would
        have happened if the two symbols that meet there combine earlier than the entry last undone.
        """
        one, two = one.copy(), two.copy()
        limit = np.full(len(one), np.iinfo(np.int64).max)
        apart = np.ones(len(one), dtype=bool)
        live = np.arange(len(one))
        while len(live):
            a, b, top = one[live], two[live], limit[live]
            at = np.minimum(np.searchsorted(self.pair_keys, a << 16 | b), len(self.pair_keys) - 1)
            made = np.where(self.pair_keys[at] == (a << 16 | b), self.pair_made[at], np.iinfo(np.int64).max)
            crossed = made < top
            apart[live[crossed]] = False
            by_left = (a >= self.base) & ((a > b) | (b < self.base))
            by_right = ~by_left & (b >= self.base)
            limit[live] = np.where(by_left, a, np.where(by_right, b + 1, top))
            one[live] = np.where(by_left, self.right[a], a)
            two[live] = np.where(by_right, self.left[b], b)
            live = live[~crossed & (by_left | by_right)]
        return apart

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks (texts without white space) that are not remembered yet."""
        words: dict[str, list[int]] = {}
        pieces_of = {}
        for chunk in chunks:
            if chunk.isascii():
                found = (chunk,) if chunk.isalpha() else PIECE.findall(chunk)
                pieces = [x[:-1] + self.closing[x[-1]] for x in found]
            else:
                raw = [x.encode("utf-8") for x in PIECE.findall(chunk)]
                pieces = [x[:-1].decode("latin-1") + chr(256 + x[-1]) for x in raw]
            pieces_of[chunk] = pieces
            for word in pieces:
                if word not in words:
                    words[word] = self.proposed(word)
        flat = array("q", (t for found in words.values() for t in found))
        tokens = np.frombuffer(flat, dtype=np.int64) if flat else np.zeros(0, dtype=np.int64)
        sizes = np.fromiter(map(len, words.values()), dtype=np.int64, count=len(words))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        odd = np.zeros(len(sizes), dtype=bool)
        together = owner[1:] == owner[:-1]
        apart = self.stay_apart(tokens[:-1][together], tokens[1:][together])
        odd[owner[1:][together][~apart]] = True
        wrong = [t for t in np.unique(tokens).tolist() if not self.itself(t)]
        if wrong:
            odd[owner[np.isin(tokens, wrong)]] = True
        for word, again in zip(list(words), odd.tolist()):
            if again:
                words[word] = self.merged(word)
        ids = self.ids
        for chunk, pieces in pieces_of.items():
            orders = words[pieces[0]] if len(pieces) == 1 else [t for word in pieces for t in words[word]]
            self.memory[chunk] = array("I", [ids[t] for t in orders]).tobytes()

    def segments(self, text: str) -> list:
        """Chunks of the normalised text, and the ids (int) of control strings in it."""
        out: list = []
        for part in self.cut.split(text) if self.cut and "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            odd = ODD_SPACE.search(part)
            part = part.replace("Σ", "σ").lower()
            out += [x for x in SPACE.split(part) if x] if odd else part.split()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        rows = [self.segments(t) for t in texts]
        if len(self.memory) > REMEMBERED:
            self.memory = {}
        known = self.memory
        new = {c for row in rows for c in row if c not in known and c.__class__ is str}
        if new:
            collecting = gc.isenabled()
            gc.disable()  # no cycles are made here, but many small lists
            try:
                self.learn(list(new))
            finally:
                if collecting:
                    gc.enable()
        return [b"".join([known[c] if c.__class__ is str else c.to_bytes(4, "little") for c in row]) for row in rows]

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file, entries are joined by one space."""
        return " ".join(map(self.text_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def tables(path: str) -> Bpe:
    return Bpe(path)


def encode_udf(path: str):
    """text -> struct(ids binary, n_tokens, decoded); decoded is made from the ids alone."""

    kind = pa.struct([("ids", pa.binary()), ("n_tokens", pa.int64()), ("decoded", pa.string())])

    @F.arrow_udf("struct<ids: binary, n_tokens: bigint, decoded: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tables(path)
        for texts in batches:
            for at in range(0, len(texts), 128):
                ids = bpe.encode([t or "" for t in texts[at : at + 128].to_pylist()])
                yield pa.array([{"ids": i, "n_tokens": len(i) // 4, "decoded": bpe.decode(i)} for i in ids], type=kind)

    return run


def encode_documents(frame: DataFrame, path: str, text: str = "text", decode: bool = True) -> DataFrame:
    """Adds token_ids (packed little-endian uint32), n_tokens and, if asked, decoded_text."""
    kept = [c for c in frame.columns if c not in ("token_ids", "n_tokens", "decoded_text")]
    out = frame.select(*[F.col(f"`{c}`") for c in kept], encode_udf(path)(F.col(f"`{text}`")).alias("__bpe"))
    made = [F.col("__bpe.ids").alias("token_ids"), F.col("__bpe.n_tokens").alias("n_tokens")]
    return out.select(*[F.col(f"`{c}`") for c in kept], *made, *[F.col("__bpe.decoded").alias("decoded_text")] * decode)
