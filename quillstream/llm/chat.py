"""Chat formatting with a loss mask, and reading it back.

A turn becomes `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts every `<|` is written `<\\|`, and `<n|` is
written `<\\n|`; a run of backslashes there grows by one. So no control string can occur in them, `<n|` is free to stand
for a line feed in a role, and the escape is undone exactly. The loss mask covers the escaped text of assistant turns.

Rows are dealt by conversation and sorted by turn; a task streams them. For each batch the lengths of all segments
(header, role, line feed, text, footer), their offsets by a running sum and the scatter indices are computed in numpy,
and headers, roles and texts are copied into one buffer that becomes the Arrow column. Reading back parses that column
and hashes turn by turn, so a conversation of any length, even a third of all rows, is never held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import blocks, map_batches, partitions, utf8

#: Rows are assembled in parts of about so many bytes of text; the indices of a part take some forty times as much.
PART_BYTES = 1 << 20
#: Longer texts are copied whole, without indices.
LONG = 1 << 14
START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escaped(column):
    """A text in which no `<|` and no `<n|` is left."""
    return F.regexp_replace(column, r"<(\\*)(n?)\|", r"<$1\\$2|")


def unescape(text: bytes) -> bytes:
    return re.sub(rb"<(\\*)\\(n?)\|", rb"<\1\2|", text)


def assemble(parts: list[bytes | pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Rows joined from constants and string columns: (buffer, row offsets)."""
    n = next(len(p) for p in parts if not isinstance(p, bytes))
    columns = [p if isinstance(p, bytes) else utf8(p) for p in parts]
    lengths = np.stack([np.full(n, len(c)) if isinstance(c, bytes) else c[2] - c[1] for c in columns], 1)
    ends = np.cumsum(lengths.ravel())
    begins = (ends - lengths.ravel()).reshape(n, -1)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, c in enumerate(columns):
        if isinstance(c, bytes):
            out[(begins[:, k, None] + np.arange(len(c))).ravel()] = np.tile(np.frombuffer(c, np.uint8), n)
        else:
            data, start, end = c
            for i in np.flatnonzero(lengths[:, k] > LONG):
                out[begins[i, k] : begins[i, k] + lengths[i, k]] = data[start[i] : end[i]]
            size = np.where(lengths[:, k] > LONG, 0, lengths[:, k])
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(begins[:, k], size) + within] = data[np.repeat(start, size) + within]
    return out, np.concatenate([[0], ends.reshape(n, -1)[:, -1]]) if n else np.zeros(1, np.int64)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (_, r0, r1), (_, t0, t1) = utf8(batch.column(2)), utf8(batch.column(3))
        for a, b in blocks(np.zeros(len(batch), np.int64), (r1 - r0) + (t1 - t0) + 40, PART_BYTES):
            part = batch.slice(a, b - a)
            out, offsets = assemble([START, part.column(2), MIDDLE, part.column(3), END])
            size = lambda c: (lambda x: x[2] - x[1])(utf8(c))
            begin = len(START) + size(part.column(2)) + len(MIDDLE)
            length = np.where(np.asarray(part.column(4)), size(part.column(3)), 0)
            text = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text, pa.array(begin.astype(np.int64)), pa.array(length.astype(np.int64))], names=["conv_id", "turn", "formatted", "loss_from", "loss_bytes"])


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, formatted (the turn's part of its conversation), loss_from and loss_bytes (the masked byte range in
    it), with the turns of a conversation one after another in one partition, by turn, role and text.

    Null roles and texts are empty; a null conversation id is a conversation of its own; turns may repeat or be null
    (first); further columns are not read; an empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    safe = F.replace(escaped(role), F.lit("\n"), F.lit("<n|"))
    named = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), safe.alias("role"), escaped(text).alias("text"), (role == "assistant").alias("masked"))
    dealt = named.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(dealt, _assemble, "conv_id long, turn long, formatted string, loss_from long, loss_bytes long")


class _Reader:
    """Digests of one conversation, fed turn by turn."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: bytes, begin: int, length: int) -> None:
        self.chars += len(formatted.decode())
        for role, text in _TURN.findall(formatted):
            self.turns += 1
            self.whole.update(unescape(role.replace(b"<n|", b"\n")) + b"\n" + unescape(text) + b"\n")
        masked = unescape(formatted[begin : begin + length])
        self.loss.update(masked)
        self.loss_chars += len(masked.decode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    pack = lambda done: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
    now = None
    for batch in batches:
        done = []
        conv, formatted = batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
        for c, f, a, n in zip(conv, formatted, batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            if now is None or now.conv != c:
                if now:
                    done.append(now.row())
                now = _Reader(c)
            now.feed(f, a, n)
        if done:
            yield pack(done)
    if now:
        yield pack([now.row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation of format_turns(), in
    the order of its rows, which must be as they came. A null conversation id is one conversation; repeated turns count
    each; empty texts have digests of nothing; an empty table gives no rows."""
    return map_batches(formatted, _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
