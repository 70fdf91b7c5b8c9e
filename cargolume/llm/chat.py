"""Chat formatting at token level.

Every segment of a turn (role, text) is encoded by itself as ordinary text; reserved ids, which no
text can produce, are spliced around the segments. Lengths of the segments give the offset of each by
prefix sums, and the loss mask is the spans of the assistants' texts. Control strings inside a text
are escaped before encoding, so the rendered string is as unambiguous as the ids.

Layout of a turn: [TURN] role [SAYS] text [END]; a conversation: [OPEN] turns [CLOSE].

Cases: null texts and roles are empty; a null turn number comes first; equal turn numbers are ordered
by role, then text, so repeated rows stay repeated and reruns agree; rows with a null conversation id
form one conversation; empty tables give no rows; further columns are ignored. A conversation of any
length is streamed turn by turn through one task, never gathered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template, and strings of other templates that are escaped too.
OPEN, TURN, SAYS, END, CLOSE = "<s>", "[INST]", "[/INST]", "<|end|>", "</s>"
CONTROL = (OPEN, TURN, SAYS, END, CLOSE)
#: The escape sign follows the first character of a control string, and is doubled like it elsewhere.
SIGN = "\\"
_CONTROL = regex.compile("|".join(regex.escape(c[0]) + regex.escape(SIGN) + "*" + regex.escape(c[1:]) for c in CONTROL))
_ESCAPED = regex.compile("|".join(regex.escape(c[0]) + regex.escape(SIGN) + "+" + regex.escape(c[1:]) for c in CONTROL))


def escape(text: str) -> str:
    """`<s>` becomes `<\\s>`, `<\\s>` becomes `<\\\\s>` and so on: one sign more each."""
    return _CONTROL.sub(lambda m: m[0][0] + SIGN + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class Template:
    """The vocabulary with the reserved ids behind it; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.first = max(ranks.values()) + 1
        self.reserved = {c: self.first + n for n, c in enumerate(CONTROL)}
        self.coder = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.coder.encode_ordinary(escape(t)), dtype="<u4").tobytes() for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        return unescape(self.coder.decode_bytes(ids.tolist()).decode("utf-8"))

    def render(self, ids: np.ndarray) -> str:
        """The formatted string: control strings for reserved ids, escaped text between."""
        cuts = np.flatnonzero(ids >= self.first)
        out, at = [], 0
        for cut in cuts.tolist():
            out += [self.coder.decode_bytes(ids[at:cut].tolist()).decode("utf-8"), CONTROL[int(ids[cut]) - self.first]]
            at = cut + 1
        return "".join([*out, self.coder.decode_bytes(ids[at:].tolist()).decode("utf-8")])


@lru_cache(maxsize=2)
def template(path: str, pattern: str) -> Template:
    return Template(path, pattern)


def encoded_segments(frame: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, text -> the same with role_ids and text_ids (packed little-endian uint32)."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mould = template(path, pattern)
        for texts in batches:
            yield pa.array(mould.encode([t or "" for t in texts.to_pylist()]), type=pa.binary())

    return frame.withColumns({"role_ids": run("role"), "text_ids": run("text")})


SPLICED = (
    "conv_id bigint, position bigint, opens boolean, ids binary, mask_from bigint, mask_to bigint, token_offset bigint"
)


def splice(parts: dict, mould: Template, opens: bool, closes: bool, offset: int) -> tuple[np.ndarray, int, int]:
    """One turn's ids and the span of its text within the conversation, from prefix sums of lengths."""
    control = {k: np.array([v], dtype="<u4") for k, v in mould.reserved.items()}
    role, text = (np.frombuffer(parts[k], dtype="<u4") for k in ("role_ids", "text_ids"))
    pieces = [control[OPEN][: int(opens)], control[TURN], role, control[SAYS], text, control[END], control[CLOSE][: int(closes)]]
    ends = offset + np.cumsum([len(p) for p in pieces])
    return np.concatenate(pieces), int(ends[3]), int(ends[4])


def format_conversations(frame: DataFrame, path: str, pattern: str, trained_role: str = "assistant") -> DataFrame:
    """One row per turn, in order: ids of the turn, its token offset in the conversation, and the loss span.

    The spans of a conversation's rows are its loss mask: [mask_from, mask_to) for the trained role's
    texts, empty (mask_from = mask_to) for others. Concatenating `ids` by position gives the input.
    """
    rows = frame.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = encoded_segments(rows, path, pattern)
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions(F.col("conv_id"), F.col("turn"), "role", "text")
    rows = rows.select("conv_id", F.expr(f"role = '{trained_role}'").alias("trained"), "role_ids", "text_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mould, held, place, offset = template(path, pattern), None, 0, 0
        out: dict[str, list] = {k.split()[0]: [] for k in SPLICED.split(", ")}

        def put(row: dict, closes: bool) -> None:
            nonlocal place, offset
            ids, start, end = splice(row, mould, place == 0, closes, offset)
            start = start if row["trained"] else end
            for k, v in zip(out, (row["conv_id"], place, place == 0, ids.tobytes(), start, end, offset)):
                out[k].append(v)
            place, offset = (0, 0) if closes else (place + 1, offset + len(ids))

        def full() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict(out, schema=_schema())
            for v in out.values():
                v.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                if held is not None:
                    put(held, held["conv_id"] != row["conv_id"])
                held = row
            yield full()
        if held is not None:
            put(held, True)
            yield full()

    return rows.mapInArrow(run, SPLICED)


def _schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SPLICED.split(", "))])


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_tokens bigint, loss_tokens bigint"
)


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each conversation, read from the ids and spans alone.

    Needs `format_conversations`' rows as they come: a conversation's turns in order in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mould = template(path, pattern)
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in DIGESTS.split(", "))])
        done: list[tuple] = []
        now = None

        def close() -> None:
            if now:
                done.append((now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"], now["tokens"], now["masked"]))

        for batch in batches:
            for row in batch.to_pylist():
                if row["opens"]:
                    close()
                    now = {"id": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "tokens": 0, "masked": 0}
                ids = np.frombuffer(row["ids"], dtype="<u4")
                marks = {CONTROL[int(ids[i]) - mould.first]: int(i) for i in np.flatnonzero(ids >= mould.first)}
                role = mould.decode(ids[marks[TURN] + 1 : marks[SAYS]])
                text = mould.decode(ids[marks[SAYS] + 1 : marks[END]])
                now["n"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode())
                start, end = row["mask_from"] - row["token_offset"], row["mask_to"] - row["token_offset"]
                learnt = mould.decode(ids[start:end])
                now["loss"].update(learnt.encode())
                now["chars"] += len(learnt)
                now["all"] += len(mould.render(ids))
                now["tokens"] += len(ids)
                now["masked"] += end - start
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*done)))), schema=schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*done)))), schema=schema)

    return formatted.mapInArrow(run, DIGESTS)
