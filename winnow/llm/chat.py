"""Chat formatting by columnar byte assembly.

Rows are brought together by conversation and sorted by turn; a task streams over them. For each block of rows the
lengths of all segments (header, content, end of turn) give their offsets by one cumulative sum, and numpy scatters
headers and contents into one preallocated buffer. The output's Arrow strings are laid over that buffer: an offset
for each run of one conversation, and no copy. A conversation that a block's end cuts is gathered run by run and
joined once, when it is complete; a digest of it carries hash states and counts instead.

The template: ``<|im_start|>`` role, line feed, content, ``<|im_end|>``, line feed. Inside roles and contents each
backslash is doubled and ``<|`` is written ``<\\|`` (in roles a line feed is written ``\\n`` too), so a control
string never stands in a text and the original is read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import map_batches
from winnow.llm.textscan import blocks, utf8

START, END = b"<|im_start|>", b"<|im_end|>\n"
#: Whose contents are under the loss mask.
LEARNED = "assistant"


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(pc.replace_substring(column.cast(pa.large_string()).fill_null(""), "\\", "\\\\"), "<|", "<\\|")
    return pc.replace_substring(out, "\n", "\\n") if role else out


def unescape(text: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], text, flags=re.DOTALL) if b"\\" in text else text


@dataclass
class Assembled:
    """All turns of a batch in one buffer; turn ``i`` is ``data[at[i]:at[i + 1]]``, its content ``data[low[i]:high[i]]``."""

    data: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    learned: np.ndarray


def assemble(roles: pa.Array, texts: pa.Array) -> Assembled:
    n = len(roles)
    pieces = [utf8(escape(roles, True)), utf8(escape(texts))]
    (role, role_at), (text, text_at) = pieces
    fixed = [np.frombuffer(x, np.uint8) for x in (START, b"\n", END)]
    sizes = np.stack([np.full(n, len(START)), np.diff(role_at), np.ones(n, np.int64), np.diff(text_at), np.full(n, len(END))], axis=1)
    begin = np.concatenate([[0], np.cumsum(sizes.ravel())])
    data = np.empty(int(begin[-1]), np.uint8)
    begin = begin[:-1].reshape(n, 5) if n else np.zeros((0, 5), np.int64)
    for column, segment in zip((0, 2, 4), fixed, strict=True):
        data[begin[:, column][:, None] + np.arange(len(segment))] = segment
    for column, (source, at) in zip((1, 3), pieces, strict=True):
        data[np.arange(len(source)) + np.repeat(begin[:, column] - at[:-1], np.diff(at))] = source
    learned = np.asarray(pc.equal(roles.fill_null(""), LEARNED).to_numpy(zero_copy_only=False), bool)
    low = begin[:, 3]
    return Assembled(data, np.append(begin[:, 0], len(data)), low, low + sizes[:, 3], learned)


def gathered(turns: DataFrame) -> DataFrame:
    """The turns of each conversation in one partition and in order; rows of the same turn lie by role and text.

    A null conv_id is a conversation too. Null roles and texts are empty.
    """
    kept = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Assembled, list[tuple[int | None, int, int]]]]:
    """Each block assembled, with its runs of one conversation: (conv_id, first turn, end)."""
    for batch in batches:
        for part in blocks(batch):
            ids = part.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            yield assemble(part.column(1), part.column(2)), [(ids[a], a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def strings(built: Assembled, runs: list[tuple[int | None, int, int]]) -> pa.LargeStringArray:
    """The formatted text of each run, laid over the block's buffer."""
    at = built.at[[runs[0][1], *(b for _, _, b in runs)]].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(runs), pa.py_buffer(at), pa.py_buffer(built.data))


def masks(built: Assembled, runs: list[tuple[int | None, int, int]]) -> pa.ListArray:
    """The [start, end) byte ranges under the loss mask of each run, from the run's first byte."""
    turn = np.flatnonzero(built.learned)
    cut = np.array([runs[0][1], *(b for _, _, b in runs)])
    of = np.searchsorted(cut, turn, "right") - 1
    from_ = built.at[cut[of]]
    ranges = pa.StructArray.from_arrays([pa.array(built.low[turn] - from_), pa.array(built.high[turn] - from_)], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(turn, cut).astype(np.int32)), ranges)


SCHEMA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.large_string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


@dataclass
class _Open:
    """A conversation that the end of a block has cut: its runs so far."""

    conv_id: int | None
    texts: list[pa.Array] = field(default_factory=list)
    loss: list[pa.Array] = field(default_factory=list)
    size: int = 0

    def add(self, text: pa.Array, loss: pa.Array) -> None:
        self.texts.append(text)
        start, end = (pc.add(x, self.size) for x in loss.flatten().flatten())
        self.loss.append(pa.StructArray.from_arrays([start, end], names=["start", "end"]))
        self.size += pc.binary_length(text)[0].as_py()

    def row(self) -> pa.RecordBatch:
        data = np.empty(self.size, np.uint8)
        at = 0
        for t in self.texts:
            piece = np.frombuffer(t[0].as_buffer(), np.uint8)
            data[at : at + len(piece)] = piece
            at += len(piece)
        whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, at])), pa.py_buffer(data))
        ranges = pa.concat_arrays(self.loss)
        return pa.RecordBatch.from_arrays([pa.array([self.conv_id], pa.int64()), whole, pa.ListArray.from_arrays(pa.array([0, len(ranges)], pa.int32()), ranges)], schema=SCHEMA)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): each conversation's text and the [start, end) byte ranges under the loss mask.

    A null conv_id is a conversation too; null roles and texts are empty; no turns give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Open | None = None
        for built, runs in _parts(batches):
            texts, loss, first = strings(built, runs), masks(built, runs), 0
            if held and held.conv_id == runs[0][0]:
                held.add(texts[:1], loss[:1])
                first = 1
            last = len(runs) - 1  # may go on in the next block
            if last >= first:
                if held:
                    yield held.row()
                if last > first:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in runs[first:last]], pa.int64()), texts[first:last], loss[first:last]], schema=SCHEMA)
                held = _Open(runs[last][0])
                held.add(texts[last:], loss[last:])
        if held:
            yield held.row()

    return map_batches(gathered(turns), run, "conv_id long, formatted string, loss array<struct<start:bigint,end:bigint>>")


_TURN = re.compile(re.escape(START) + rb"([^\n]*)\n(.*?)" + re.escape(END), re.DOTALL)


def _characters(text: bytes) -> int:
    return len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))


@dataclass
class _Digest:
    """What is read back of one conversation's formatted bytes, piece by piece."""

    conv_id: int | None
    n: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)
    loss_chars: int = 0
    chars: int = 0

    def read(self, data: bytes, masked: list[bytes]) -> None:
        """data: whole turns; masked: the bytes under the loss mask, in order."""
        for m in _TURN.finditer(data):
            self.n += 1
            self.turns.update(unescape(m[1]) + b"\n" + unescape(m[2]) + b"\n")
        for piece in masked:
            text = unescape(piece)
            self.loss.update(text)
            self.loss_chars += _characters(text)
        self.chars += _characters(data)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def report(turns: DataFrame) -> DataFrame:
    """One row a conversation, read back from the output's strings and masks; memory follows the block, not the conversation.

    Nulls, repeated rows and empty tables are as in :func:`format_conversations`.
    """
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Digest | None = None
        for built, runs in _parts(batches):
            done = []
            texts, loss = strings(built, runs), masks(built, runs)
            for i, (conv, _, _) in enumerate(runs):
                if held is None or held.conv_id != conv:
                    if held:
                        done.append(held.row())
                    held = _Digest(conv)
                text = texts[i].as_buffer().to_pybytes()
                held.read(text, [text[x["start"] : x["end"]] for x in loss[i].as_py()])
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done])
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, held.row(), strict=True))])

    return map_batches(gathered(turns), run, DIGEST)
