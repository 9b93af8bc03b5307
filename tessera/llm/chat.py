r"""Conversations as training text, assembled column-wise.

Each turn becomes ``<|role|>\n``, its text with control strings escaped, and
``</turn>\n``. In role and text a ``\`` is put before every ``\``, ``|`` and ``</turn>``, so headers and ends of turns never occur inside a
text and unescaping gives it back exactly.

A batch is assembled without a loop over its turns: the lengths of all
segments give offsets by a cumulative sum, and each kind of segment is
scattered from its source bytes into one preallocated buffer, which becomes the
values of an Arrow array. Byte masks of the text to train on come from the same
offsets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, HEAD_END, TURN_END = b"<|", b"|>\n", b"</turn>\n"
#: Turns with this role are trained on.
TRAINED = "assistant"


def _escape(text: pa.Array) -> pa.Array:
    """Escaped copies of a string column, by one whole-column replacement."""
    return pc.replace_substring_regex(text, r"(\\|\||</turn>)", r"\\\1")


_ESCAPED = re.compile(r"\\(\\|\||</turn>)")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy string i of (data, offsets) to out[at[i]:]."""
    lengths = np.diff(offsets)
    total = int(lengths.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(at, lengths) + within] = data[offsets[0] : offsets[0] + total]


def _constant(out: np.ndarray, at: np.ndarray, value: bytes) -> None:
    if len(at):
        out[at[:, None] + np.arange(len(value))] = np.frombuffer(value, np.uint8)


def assemble(role: pa.Array, text: pa.Array, starts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Formatted conversations and, for each, the (start, end) byte spans to train on.

    ``role`` and ``text`` hold turns in order; conversation i has the turns from
    ``starts[i]`` to ``starts[i + 1]``.
    """
    roles, texts = _strings(_escape(role)), _strings(_escape(text))
    r, t = np.diff(roles[1]), np.diff(texts[1])
    lengths = len(HEAD) + r + len(HEAD_END) + t + len(TURN_END)
    begin = np.concatenate(([0], np.cumsum(lengths)))
    buffer = np.empty(int(begin[-1]), np.uint8)
    at = begin[:-1]
    text_at = at + len(HEAD) + r + len(HEAD_END)
    _constant(buffer, at, HEAD)
    _scatter(buffer, at + len(HEAD), *roles)
    _constant(buffer, at + len(HEAD) + r, HEAD_END)
    _scatter(buffer, text_at, *texts)
    _constant(buffer, text_at + t, TURN_END)
    edges = begin[starts]
    formatted = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(buffer)]).cast(pa.binary())
    trained = pc.equal(role, TRAINED).to_numpy(zero_copy_only=False).astype(bool)
    conversation = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    base = edges[:-1][conversation]
    spans = np.stack([text_at - base, text_at + t - base], 1)[trained]
    counts = np.bincount(conversation[trained], minlength=len(starts) - 1)
    pairs = pa.FixedSizeListArray.from_arrays(pa.array(spans.ravel().astype(np.int64)), 2).cast(pa.list_(pa.int64()))
    return formatted, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pairs)


_FORMATTED = "conv_id bigint, formatted binary, trained array<array<bigint>>"
#: Bytes of text after which a task assembles the whole conversations it has.
FLUSH_BYTES = 8 << 20


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Assemble sorted turns; the last conversation of a batch waits for the next."""
    waiting: list[pa.Table] = []
    size, first = 0, None

    def flush(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("conv_id").combine_chunks().to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]))
        clean = lambda c: pc.fill_null(table.column(c).cast(pa.large_string()), "").combine_chunks()
        formatted, trained = assemble(clean("role"), clean("text"), starts)
        return pa.RecordBatch.from_arrays([pa.array(ids[starts[:-1]]), formatted, trained], names=["conv_id", "formatted", "trained"])

    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column("conv_id")[0].as_py() if not waiting else first
        waiting.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size >= FLUSH_BYTES and batch.column("conv_id")[batch.num_rows - 1].as_py() != first:
            table = pa.concat_tables(waiting)
            ids = table.column("conv_id").to_numpy()
            cut = int(np.searchsorted(-(ids != ids[-1]).astype(np.int8), 0)) if len(ids) else 0
            if cut:
                yield flush(table.slice(0, cut).combine_chunks())
                waiting = [table.slice(cut)]
                size, first = waiting[0].nbytes, ids[-1]
    if waiting:
        yield flush(pa.concat_tables(waiting).combine_chunks())


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, trained), one row per conversation.

    ``formatted`` is the UTF-8 text, ``trained`` the byte spans of the
    assistant's (escaped) texts in it. Turns are ordered by ``turn``, nulls
    first, then by role and text, so repeated rows stay and have one order. Null
    roles and texts are empty. Rows without ``conv_id`` belong to no
    conversation and are left out; other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text").mapInArrow(_format, _FORMATTED)


# possessive, so that nothing is kept to go back to in a long text
_TURN = re.compile(r"<\|((?:[^\\|]++|\\.)*+)\|>\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted.decode())]


_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations: their turns, and the text under the loss mask, as read from the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, data, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "trained")), strict=True):
                turns = parse(data)
                loss = "".join(unescape(data[a:b].decode()) for a, b in spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv_id, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(data.decode())))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    return formatted.select("conv_id", "formatted", "trained").mapInArrow(run, _READ)
