"""Operator 9, packing: bounded-space online packing into sequences of a fixed number of tokens.

Every partition keeps at most ``open_windows`` open windows.  A document's full stretches of ``capacity`` tokens are
sequences of their own; what is left goes where it leaves the least room (best fit); if it fits nowhere, the fullest
window is closed when all places are taken, and a new one is opened.  Windows still open at a partition's end are
leftovers: their pieces, a bounded number a partition, are dealt to a few tasks and packed again, longest first.
Documents are never shuffled; what is written between the two steps has no tokens in it unless ids are asked for.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut, small_batches
from ._text import task
from ._tokens import Ids

_PIECE = "id long, start long, length long, {payload}, doc_tokens long, sequence_id long, offset long, leftover boolean"
_SECOND = 1 << 62
LEFTOVERS_A_TASK = 200_000


class Packer:
    """Open windows by free room; ``emit(window)`` gets a closed window's number and its [(piece, offset)]."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.room: list[tuple[int, int]] = []  # (free, window), ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def add(self, piece, length: int) -> tuple[int, list] | None:
        """Place a piece of fewer tokens than the capacity; returns a window that had to be closed, or that is full."""
        closed = None
        at = bisect_left(self.room, (length, -1))
        if at == len(self.room):
            if len(self.room) >= self.places:
                _, window = self.room.pop(0)
                closed = window, self.held.pop(window)
            window, free = self.made, self.capacity
            self.made += 1
            self.held[window] = []
        else:
            free, window = self.room.pop(at)
        self.held[window].append((piece, self.capacity - free))
        if free == length:  # no new window, so none was closed
            return window, self.held.pop(window)
        insort(self.room, (free - length, window))
        return closed

    def rest(self) -> Iterator[tuple[int, list]]:
        for window in sorted(self.held):
            yield window, self.held[window]
        self.held, self.room = {}, []


class _Rows:
    """Output rows, handed out in batches."""

    def __init__(self, schema: pa.Schema, most: int):
        self.schema, self.rows, self.most = schema, [], most

    def full(self) -> bool:
        return len(self.rows) >= self.most

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, self.schema, strict=True)], schema=self.schema)


def _schema(ids: bool) -> pa.Schema:
    payload = pa.field("ids", pa.binary()) if ids else pa.field("ids_crc32", pa.int64())
    longs = [pa.field(c, pa.int64()) for c in ("id", "start", "length")]
    return pa.schema([*longs, payload, *(pa.field(c, pa.int64()) for c in ("doc_tokens", "sequence_id", "offset")), pa.field("leftover", pa.bool_())])


def _pack(path: str, capacity: int, places: int, end_id: int | None, ids: bool):
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Ids(path), Packer(capacity, places)
        base, out = TaskContext.get().partitionId() << 33, _Rows(_schema(ids), 500 if ids else 20_000)
        whole = 0

        def put(window: int, pieces: list, leftover: bool) -> None:
            out.rows += [(*piece, base + window * 2, offset, leftover) for piece, offset in pieces]

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                tokens = memoryview(encode(text.as_py() or "") + tail)
                n = len(tokens) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    part = tokens[4 * start : 4 * (start + length)]
                    piece = doc, start, length, bytes(part) if ids else zlib.crc32(part), n
                    if length == capacity:
                        out.rows.append((*piece, base + whole * 2 + 1, 0, False))
                        whole += 1
                    elif closed := packer.add(piece, length):
                        put(*closed, False)
                if out.full():
                    yield out.batch()
        for window, pieces in packer.rest():
            put(window, pieces, True)
        yield out.batch()

    return task(run)


def _repack(capacity: int, places: int, ids: bool):
    names = [f.name for f in _schema(ids)][:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = Packer(capacity, places), _Rows(_schema(ids), 500 if ids else 20_000)
        base = _SECOND + (TaskContext.get().partitionId() << 33)

        def put(window: int, pieces: list) -> None:
            out.rows += [(*piece, base + window, offset, True) for piece, offset in pieces]

        for batch in batches:
            for piece in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if closed := packer.add(piece, piece[2]):
                    put(*closed)
                if out.full():
                    yield out.batch()
        for window, pieces in packer.rest():
            put(window, pieces)
        yield out.batch()

    return task(run)


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    open_windows: int = 128,
    end_id: int | None = 1,
    ids: bool = False,
) -> DataFrame:
    """Pack the tokens of each row (and ``end_id`` after them) into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: ``id_col``, start, length, ids (little-endian unsigned 32-bit bytes) or without
    ``ids`` their ids_crc32, doc_tokens, sequence_id and offset; a sequence's pieces lie without gaps from 0.

    Defined cases: a null or empty text is ``end_id`` alone (nothing without it); a null id stays null; rows that
    share an id, and equal rows, are packed each for itself; an empty table gives an empty result; extra columns are
    ignored.  Sequence ids depend on how the input is split, not on its values.
    """
    small_batches(docs.sparkSession)
    payload = "ids binary" if ids else "ids_crc32 long"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = cut(rows.mapInArrow(_pack(path, capacity, open_windows, end_id, ids), _PIECE.format(payload=payload)), "pieces")
    left = first.where("leftover")
    tasks = max(1, -(-left.count() // LEFTOVERS_A_TASK))
    again = (
        left.repartition(tasks, F.xxhash64("sequence_id"))
        .sortWithinPartitions(F.desc("length"), "id", "start", "sequence_id", "offset")
        .mapInArrow(_repack(capacity, open_windows, ids), _PIECE.format(payload=payload))
    )
    return first.where("not leftover").unionByName(again).drop("leftover").withColumnRenamed("id", id_col)
