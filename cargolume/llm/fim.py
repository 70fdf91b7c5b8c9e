"""Fill-in-middle transformation by secondary sort.

A text is cut into units, a seeded hash of its id picks two places between them and the form. Map tasks
emit pieces of at most UNITS units and PIECE bytes, keyed by the row's digest and carrying their place in
the output. One exchange by key with a sort by (key, place) inside partitions - the DataFrame form of
repartitionAndSortWithinPartitions, so Spark sorts and spills - streams each output past an incremental
digest. Restoring reads nothing but output and form: the markers met in the stream tell what each piece
was, and a second sort inside the same partitions, without an exchange, puts the text together again.
No task ever holds a whole output.

Cases: a null text is empty, an empty text is plain; a null id counts as no digits; rows that repeat in
id and text share a digest and are told apart by count, those of different map tasks by the task, so a
hot row is spread; texts of any length are read whole, a slice at a time; empty tables give empty
results; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolume.llm.blocks import BLOCK, blocks

#: Units and bytes of one piece at most.
UNITS, PIECE = 2048, 1 << 14
#: Bytes of pieces handed on together.
TOGETHER = 1 << 21
#: Fixed values of the contract: markers, shares in percent of rows transformed and of the second form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RATE, SPM_RATE = 90, 20
#: Order of the segments in the output of each form: marker, and the segment's place in the text.
ORDERS = {"psm": [(PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)], "spm": [(SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)]}
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True

META = "task int, key binary, doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"
PIECES = f"{META}, place bigint, data binary"
#: The trailer of an output carries its digest and how often the row occurs.
PARTS = f"{META}, part int, place bigint, data binary, output_sha256 string, copies int"
RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
LAST = 9


def unit_starts(data: np.ndarray, before: bool = False) -> np.ndarray:
    """Offsets where units begin; `before`: a letter stands before the data. Bytes inside a code point begin none."""
    letter = LETTER[data]
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    if before and len(data):
        starts[0] &= not letter[0]
    return np.flatnonzero(starts)


def code_points(data: np.ndarray) -> int:
    return sum(int(np.count_nonzero((data[at : at + BLOCK] & 0xC0) != 0x80)) for at in range(0, len(data), BLOCK))


class Units:
    """Count and byte offsets of a text's units; of a long text only every UNITS-th offset is kept."""

    def __init__(self, data: np.ndarray):
        self.data, self.every, self.n = data, [], 0
        for at in range(0, len(data), BLOCK):
            found = unit_starts(data[at : at + BLOCK], at > 0 and bool(LETTER[data[at - 1]])) + at
            self.every.append(found[-self.n % UNITS :: UNITS])
            self.n += len(found)
        self.every = np.concatenate(self.every) if self.every else np.zeros(0, dtype=np.int64)

    def offset(self, unit: int) -> int:
        if unit >= self.n:
            return len(self.data)
        begin = int(self.every[unit // UNITS])
        end = int(self.every[unit // UNITS + 1]) if unit // UNITS + 1 < len(self.every) else len(self.data)
        return begin + int(unit_starts(self.data[begin:end])[unit % UNITS])

    def cuts(self, begin: int, end: int) -> np.ndarray:
        """Offsets strictly between where a chunk of units ends."""
        return self.every[np.searchsorted(self.every, begin, "right") : np.searchsorted(self.every, end, "left")]


class ShortUnits(Units):
    """The same from offsets found for a whole block of texts at once."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts, self.every, self.n = data, starts, starts[::UNITS], len(starts)

    def offset(self, unit: int) -> int:
        return int(self.starts[unit]) if unit < self.n else len(self.data)


def units_of(data: np.ndarray, cuts: np.ndarray) -> Iterator[Units]:
    if len(cuts) == 2:
        yield Units(data)
        return
    letter = LETTER[data]
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    heads = cuts[:-1][cuts[:-1] < cuts[1:]]
    starts[heads] = (data[heads] & 0xC0) != 0x80
    found = np.flatnonzero(starts)
    edges = np.searchsorted(found, cuts)
    for i in range(len(cuts) - 1):
        yield ShortUnits(data[cuts[i] : cuts[i + 1]], found[edges[i] : edges[i + 1]] - cuts[i])


def plan_of(doc_id: int | None, units: Units, marked: bool) -> tuple[str, int, int]:
    """(form, begin and end of the middle in bytes) as the id's hash decides."""
    digits = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[k : k + 8], 16) for k in range(0, 32, 8))
    if not units.n or marked or h3 % 100 >= RATE:
        return "plain", 0, 0
    a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    return "spm" if h4 % 100 < SPM_RATE else "psm", units.offset(a), units.offset(b)


def pieces(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The outputs in pieces, unsorted: see PIECES."""

    def cut(units: Units, begin: int, end: int) -> Iterator[bytes]:
        edges = [begin, *units.cuts(begin, end).tolist(), end]
        for lo, hi in zip(edges, edges[1:]):
            for at in range(lo, hi, PIECE):
                yield units.data[at : min(at + PIECE, hi)].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, size = TaskContext.get().partitionId(), [], 0
        kinds = _arrow_schema(PIECES)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            marked = np.zeros(len(ids), dtype=bool)
            for marker in (PREFIX, SUFFIX, MIDDLE):
                marked |= pc.fill_null(pc.match_substring(texts, marker.decode()), False).to_numpy(zero_copy_only=False)
            at = 0
            for data, cuts in blocks(texts):
                for units in units_of(data, cuts):
                    own = ids[at]
                    form, begin, end = plan_of(own, units, bool(marked[at]))
                    at += 1
                    key = blake2b(units.data, digest_size=16, person=b"" if own is None else own.to_bytes(8, "little", signed=True) + b"+").digest()
                    if form == "plain":
                        outs, meta = [b"", *cut(units, 0, len(units.data))], (task, key, own, units.n, form, None, None)
                    else:
                        spans = {0: (0, begin), 1: (begin, end), 2: (end, len(units.data))}
                        chars = [code_points(units.data[lo:hi]) for lo, hi in (spans[0], spans[1])]
                        outs, meta = [], (task, key, own, units.n, form, *chars)
                        for marker, segment in ORDERS[form]:
                            own_pieces = cut(units, *spans[segment])
                            outs += [marker + next(own_pieces, b""), *own_pieces]
                    for place, out in enumerate(outs):
                        rows.append((*meta, place, out))
                        size += len(out) + 100
                        if size >= TOGETHER:
                            yield _batch(rows, kinds)
                            rows, size = [], 0
        if rows:
            yield _batch(rows, kinds)

    return documents.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`")).mapInArrow(run, PIECES)


def outputs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every output, each output in one partition and in order of place."""
    return pieces(documents, doc_id, text).repartition("key", "task").sortWithinPartitions("key", "task", "place")


class Reader:
    """Tells what the bytes of one output were, from its markers: (part of the text, bytes)."""

    def __init__(self, form: str):
        self.left, self.part, self.held = list(ORDERS.get(form, [])), 0, b""

    def feed(self, data: bytes) -> list[tuple[int, bytes]]:
        out, data = [], self.held + data
        while self.left:
            marker, part = self.left[0]
            if (at := data.find(marker)) < 0:
                break
            out.append((self.part, data[:at]))
            data, self.part = data[at + len(marker) :], part
            self.left.pop(0)
        keep = min(len(data), len(PREFIX) - 1) if self.left else 0  # a marker may go on in the next piece
        self.held = data[len(data) - keep :]
        return [x for x in [*out, (self.part, data[: len(data) - keep])] if x[1]]

    def close(self) -> list[tuple[int, bytes]]:
        return [(self.part, self.held)] if self.held else []


def parts(sorted_pieces: DataFrame) -> DataFrame:
    """Output digests, and every output taken apart again by its markers: see PARTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, rows, size = _arrow_schema(PARTS), [], 0
        now = meta = reader = digest = None
        copies = place = seen = 0

        def ended() -> list[tuple]:
            nonlocal place
            own = []
            for part, data in reader.close():
                own.append((*meta, part, place, data, None, None))
                place += 1
            return [*own, (*meta, LAST, place, b"", digest.hexdigest(), copies)]

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for *head, spot, data in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    if (head[1], head[0]) != now:
                        if now is not None:
                            rows += ended()
                        now, meta, reader, digest = (head[1], head[0]), head, Reader(head[4]), sha256()
                        copies = place = 0
                        seen = -1
                    if spot == 0:
                        copies += 1
                    if spot == seen:  # the same piece of a repeated row
                        continue
                    seen = spot
                    digest.update(data)
                    for part, piece in reader.feed(data):
                        rows.append((*meta, part, place, piece, None, None))
                        place += 1
                        size += len(piece) + 100
                    if size >= TOGETHER:
                        yield _batch(rows, kinds)
                        rows, size = [], 0
        if now is not None:
            rows += ended()
        if rows:
            yield _batch(rows, kinds)

    return sorted_pieces.mapInArrow(run, PARTS)


def restored(taken_apart: DataFrame) -> DataFrame:
    """One row per document with the digests of its output and of the text put together from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, kinds = sha256(), _arrow_schema(RESULT)
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 512):
                for _, _, own, n, form, prefix, middle, part, _, data, output, copies in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    if part < LAST:
                        digest.update(data)
                        continue
                    rows += [(own, n, form, prefix, middle, output, digest.hexdigest())] * copies
                    digest = sha256()
            if rows:
                yield _batch(rows, kinds)

    return taken_apart.sortWithinPartitions("key", "task", "part", "place").mapInArrow(run, RESULT)


def fill_in_middle(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with digests of output and restored text; `outputs` has the outputs themselves."""
    return restored(parts(outputs(documents, doc_id, text)))


def output_texts(sorted_pieces: DataFrame) -> DataFrame:
    """(doc_id, form, output): the outputs as text, a row per document, for outputs that fit a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("output", pa.string())])
        now, head, held, copies, seen = None, None, [], 0, -1
        for batch in batches:
            rows = []
            for task, key, own, _, form, _, _, spot, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, task) != now:
                    rows += [(*head, b"".join(held))] * copies if now else []
                    now, head, held, copies, seen = (key, task), (own, form), [], 0, -1
                copies += spot == 0
                if spot != seen:
                    held.append(data)
                    seen = spot
            if rows:
                yield _batch([(i, f, o.decode("utf-8", "replace")) for i, f, o in rows], kinds)
        if now:
            yield _batch([(*head, b"".join(held).decode("utf-8", "replace"))] * copies, kinds)

    return sorted_pieces.mapInArrow(run, "doc_id bigint, form string, output string")


def restored_text(form: Column, output: Column) -> Column:
    """The text an output of this form was made of; DataFrame functions only."""
    p, s, m = (F.lit(x.decode()) for x in (PREFIX, SUFFIX, MIDDLE))

    def between(head: Column, tail: Column | None) -> Column:
        rest = F.substring(output, F.position(head, output) + 3, F.length(output))
        return rest if tail is None else F.substring(rest, F.lit(1), F.position(tail, rest) - 1)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
