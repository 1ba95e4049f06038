"""Packing token ids into sequences of fixed length with bounded space.

Documents arrive one by one in each partition, which keeps a fixed number of open windows.  Whole
windows are cut off a long document first.  What is left goes into the open window that it fits
best.  When it fits none and no further window may be opened, the fullest one is topped up with the
document's first ids and emitted.  So only full windows leave a partition until its rows
end; then its open windows are merged, and the one that stays open is a leftover.  Leftovers are
packed in the same way, many to a task, round after round until one is left, which is cut into
sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegate.llm.bpe import WordBPE
from tidegate.llm.common import portions, resident, stored

# Ids of a sequence.
WINDOW = 2048
# Windows that a partition keeps open.
OPEN = 64
# Leftovers (less than a window each) that meet in one task.
FAN_IN = 512
# A sequence's number is made of the round, the partition and a count.
_ROUND_BITS, _COUNT_BITS = 56, 28
# Bytes of ids that are handed on at a time.
_OUT_BYTES = 8 << 20

SCHEMA = ("doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary, leftover int")


class _Library(WordBPE):
    """Words are encoded by the tokenizers library: which method finds them does not matter here."""

    def __init__(self, spec: str):
        super().__init__(spec)
        self._model = Tokenizer.from_str(spec).model

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        return {w: [t.id for t in self._model.tokenize(w)] for w in set(words)}


@dataclass
class _Piece:
    doc: object
    start: int
    tokens: int
    ids: memoryview

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        """Its first ``n`` ids and the others."""
        return (_Piece(self.doc, self.start, self.tokens, self.ids[: 4 * n]),
                _Piece(self.doc, self.start + n, self.tokens, self.ids[4 * n:]))

    @property
    def size(self) -> int:
        return len(self.ids) // 4


@dataclass(order=True)
class _Open:
    free: int
    nr: int
    pieces: list[_Piece] = field(compare=False)


class Packer:
    """The open windows of one partition; ``done`` holds the sequences that are complete."""

    def __init__(self, window: int, most: int):
        self.window, self.most, self.nr = window, most, 0
        self.open: list[_Open] = []  # by free space, the fullest first
        self.done: list[list[_Piece]] = []

    def add(self, piece: _Piece) -> None:
        while piece.size >= self.window:
            whole, piece = piece.cut(self.window)
            self.done.append([whole])
        if not piece.size:
            return
        at = bisect_left(self.open, piece.size, key=lambda w: w.free)
        if at == len(self.open) and len(self.open) == self.most:
            fullest = self.open.pop(0)
            first, piece = piece.cut(fullest.free)
            self.done.append([*fullest.pieces, first])
            at = bisect_left(self.open, piece.size, key=lambda w: w.free)
        if at < len(self.open):
            target = self.open.pop(at)
        else:
            target, self.nr = _Open(self.window, self.nr, []), self.nr + 1
        target.pieces.append(piece)
        target.free -= piece.size
        if target.free:
            insort(self.open, target)
        else:
            self.done.append(target.pieces)

    def merge(self) -> list[_Piece]:
        """Fill the open windows from one another; returns what is less than a window."""
        row, room = [], self.window
        for piece in [p for w in self.open for p in w.pieces]:
            while piece.size >= room:
                first, piece = piece.cut(room)
                self.done.append([*row, first])
                row, room = [], self.window
            if piece.size:
                row.append(piece)
                room -= piece.size
        self.open = []
        return row


def _powers(row: list[_Piece]) -> Iterator[list[_Piece]]:
    """Sequences whose lengths are the powers of two that add up to the ids of ``row``."""
    left = sum(p.size for p in row)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            first, rest = row[0].cut(min(room, row[0].size))
            out.append(first)
            room -= first.size
            row = [rest, *row[1:]] if rest.size else row[1:]
        yield out


def _packed(pieces: Iterator[_Piece], kind: pa.DataType, window: int, most: int, rounds: int, last: bool,
            with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA``: complete sequences, and at the end the pieces of the leftover, these always
    with their ids."""
    packer, partition, count = Packer(window, most), TaskContext.get().partitionId(), 0

    def batch(sequences: list[list[_Piece]], leftover: int | None) -> pa.RecordBatch:
        nonlocal count
        columns: list[list] = [[] for _ in range(9)]
        ids = with_ids or leftover is not None
        for row in sequences:
            offset, number = 0, rounds << _ROUND_BITS | partition << _COUNT_BITS | count
            count += 1
            for p in row:
                values = (p.doc, p.start, p.size, zlib.crc32(p.ids), p.tokens, number, offset, p.ids if ids else None, leftover)
                for column, value in zip(columns, values):
                    column.append(value)
                offset += p.size
        types = [kind, *[pa.int64()] * 6, pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "leftover"])

    for piece in pieces:
        packer.add(piece)
        if len(packer.done) * window * 4 >= _OUT_BYTES:
            yield batch(packer.done, None)
            packer.done = []
    rest = packer.merge()
    yield batch(packer.done + (list(_powers(rest)) if last else []), None)
    if rest and not last:
        yield batch([rest], partition)


def pack(docs: DataFrame, spec: str, end_id: int = 1, window: int = WINDOW, open_windows: int = OPEN,
         id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: ``doc_id``, ``start`` (ids of the document before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence and the ``ids`` themselves
    (little-endian unsigned 32-bit integers), if they are asked for.

    A document is the ids of its whole text and ``end_id``; each id lies in one piece.  Every
    sequence holds ``window`` ids, but for a few at the end whose lengths are powers of two (if
    ``window`` is one), so that none needs padding.  Sequences are numbered uniquely, not densely.

    A null or empty text is ``end_id`` alone.  Rows that repeat an id, or have none, are documents
    of their own; which piece belongs to which of them follows from sequence and offset only.  A
    very long text fills windows by itself.  An empty table gives no rows.  Further columns of
    ``docs`` are not read.  Texts are not shuffled: a partition's documents meet in its windows,
    and of each partition less than a window goes on to the next round.
    """
    schema = docs.select(F.col(id_col).alias("doc_id")).schema
    kind = schema["doc_id"].dataType.simpleString()
    shape = SCHEMA.format(kind=kind)
    end = end_id.to_bytes(4, "little")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
        bpe = resident(_Library, spec)
        for batch in portions(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode(batch.column(1).to_pylist())):
                yield _Piece(doc, 0, len(ids) // 4 + 1, memoryview(ids + end))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
        for batch in portions(batches):
            names = ["doc_id", "start", "doc_tokens", "ids"]
            for doc, start, tokens, ids in zip(*(batch[c].to_pylist() for c in names)):
                yield _Piece(doc, start, tokens, memoryview(ids))

    def step(rows: DataFrame, read, rounds: int, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is not None:
                again = (b for part in ([first], batches) for b in part)
                yield from _packed(read(again), first.column(0).type, window, open_windows, rounds, last, with_ids)

        return stored(rows.mapInArrow(run, shape), "packing")

    found = step(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), documents, 0, False)
    whole, rounds = found.where("leftover IS NULL"), 0
    while True:
        rest = found.where("leftover IS NOT NULL")
        # Each leftover is one window of one task.
        parts = -(-rest.select("leftover").distinct().count() // fan_in)
        if not parts:
            break
        rounds += 1
        met = rest.repartition(parts, F.col("leftover") % parts).sortWithinPartitions("leftover", "offset")
        found = step(met, pieces, rounds, parts == 1)
        whole = whole.unionAll(found.where("leftover IS NULL"))
    return whole.drop("leftover") if with_ids else whole.drop("leftover", "ids")
