"""Chat formatting by columnar byte assembly (operator 2).

Each turn becomes five segments: `<|`, role, `|>` + newline, text, `</s>` + newline. The lengths of all segments of a batch give the
offset of each by one running sum; the bytes of every column are then scattered to their places in one preallocated
buffer, which becomes the Arrow string column without another copy. In texts and roles the escape character and the two
characters that open a control string are written as a pair, so no text can hold one, and reading back restores it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, END = "<|", "|>\n", "</s>\n"
#: Fixed pairs; the escape character comes first when writing and last when reading.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
_TURN = re.compile(r"<\|([^<]*)\|>\n([^<]*)</s>\n")
BATCH_ROWS = 2_000


def escape(column: pa.Array) -> pa.Array:
    for plain, pair in ESCAPES:
        column = pc.replace_substring(column, plain, pair)
    return column


def unescape(text: str) -> str:
    for plain, pair in (*ESCAPES[1:], ESCAPES[0]):
        text = text.replace(pair, plain)
    return text


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and offsets of an Arrow string array."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def assemble(roles: pa.Array, texts: pa.Array, conversation: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted strings, one for each run of equal conversation numbers; byte start and end of each turn's text in its string)."""
    n = len(roles)
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (OPEN, SHUT, END)]
    parts = {1: _buffer(escape(roles)), 3: _buffer(escape(texts))}
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0::2] = [len(x) for x in fixed]
    for j, (_, offsets) in parts.items():
        lengths[:, j] = np.diff(offsets)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for j, x in zip((0, 2, 4), fixed, strict=True):
        out[(starts[:, j, None] + np.arange(len(x))).ravel()] = np.tile(x, n)
    for j, (data, offsets) in parts.items():
        at = np.repeat(starts[:, j] - offsets[:-1], lengths[:, j]) + np.arange(offsets[0], offsets[-1])
        out[at] = data[offsets[0] : offsets[-1]]
    first = np.flatnonzero(np.r_[True, conversation[1:] != conversation[:-1]]) if n else np.zeros(0, int)
    bounds = np.r_[starts[first, 0], len(out)] if n else np.zeros(1, np.int64)
    strings = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out)])
    base = np.repeat(bounds[:-1], np.diff(np.r_[first, n])) if n else bounds[:0]
    return strings, starts[:, 3] - base, ends[:, 3] - base


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, end>>), one row per conversation.

    Turns are ordered by turn, then role and text; null texts and roles are empty. loss: byte ranges of the learned role's
    texts, as written, in order. Rows with a null conv_id form one conversation; repeated rows are turns of their own; no
    rows give no conversations; other columns are ignored. A conversation is one output row, so it has to fit one string;
    a task holds one batch and the conversation it is in, no more.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"))
    rows = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x")
    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def emit(table: pa.Table):
        table = table.combine_chunks()
        ids = table["c"].chunk(0)
        number = np.cumsum(np.r_[0, _changes(ids)])
        role, text = table["r"].chunk(0), table["x"].chunk(0)
        strings, start, end = assemble(role, text, number)
        learned = pc.equal(role, learn_role).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        spans: list[list[dict]] = [[] for _ in first]
        for i in np.flatnonzero(learned):
            spans[number[i]].append({"start": int(start[i]), "end": int(end[i])})
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), strings.cast(pa.string()), pa.array(spans, loss)], ["conv_id", "formatted", "loss"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                ids = part.column(0).to_pylist()
                last = next((i for i in range(len(ids) - 1, -1, -1) if ids[i] != ids[-1]), -1) + 1
                if held and held[-1].column(0)[-1].as_py() != ids[0]:
                    yield emit(pa.Table.from_batches(held))
                    held = []
                if last:
                    yield emit(pa.Table.from_batches([*held, part.slice(0, last)]))
                    held = []
                held.append(part.slice(last))
        if held:
            yield emit(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


def _changes(ids: pa.Array) -> np.ndarray:
    """Where an id differs from the one before; two nulls are equal."""
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    value = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    return (value[1:] != value[:-1]) | (valid[1:] != valid[:-1])


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all read back from format_chats()'s output."""

    def one(batches):
        for batch in batches:
            out = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns, raw = read_back(text), text.encode()
                learned = [unescape(raw[x["start"] : x["end"]].decode()) for x in loss]
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest())
                out["loss_chars"].append(sum(map(len, learned)))
                out["loss_sha256"].append(hashlib.sha256("".join(learned).encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.string() if n.endswith("256") else pa.int64()) for n, v in out.items()]], ["conv_id", *out])

    return formatted.mapInArrow(one, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
