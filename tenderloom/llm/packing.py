"""Bounded-space online packing of token ids into sequences.

Each partition of the input is packed as it is read, without a shuffle: a
document's full windows are sequences at once, its rest goes to the open window
that it fills best. A partition keeps `OPEN` windows. When none has room, the
fullest is emitted: a gap of `CUT` ids or more is first filled from the
document, whose rest is placed again. What is open at a partition's end goes to
a merge of some partitions each, where leftovers, largest first, are put one
after the other into full sequences; only a merge's last sequence has padding.

The result hangs on how the files are split, not on timing: a repeated task
packs the same. Nulls and edges: null text is the end id alone; repeated rows
are packed each time; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import tokens

LENGTH, OPEN, CUT, END = 2048, 64, 16, 1
#: Partitions whose leftovers meet in one merge.
MERGED = 16
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
           ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("fill", pa.int64()), ("ids", pa.binary())]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, fill long, ids binary"


class Windows:
    """Open windows of one partition. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int = LENGTH, most: int = OPEN, cut: int = CUT):
        self.length, self.most, self.cut = length, most, cut
        self.room: list[tuple[int, int]] = []  # (free ids, number), in order
        self.pieces: dict[int, list[tuple]] = {}
        self.next = 0

    def add(self, piece: tuple) -> Iterator[tuple[int, list[tuple]]]:
        """Place a piece; yields (number, pieces) of windows that are done."""
        doc_id, start, ids, total = piece
        while len(ids) >= self.length:
            yield self._number(), [(doc_id, start, ids[: self.length], total)]
            start, ids = start + self.length, ids[self.length:]
        while len(ids):
            k = bisect_left(self.room, (len(ids), -1))
            if k < len(self.room):
                free, number = self.room.pop(k)
                self.pieces[number].append((doc_id, start, ids, total))
                if free == len(ids):
                    yield number, self.pieces.pop(number)
                else:
                    insort(self.room, (free - len(ids), number))
                return
            if len(self.room) < self.most:
                number = self._number()
                self.pieces[number] = [(doc_id, start, ids, total)]
                insort(self.room, (self.length - len(ids), number))
                return
            free, number = self.room.pop(0)
            if free >= self.cut:
                self.pieces[number].append((doc_id, start, ids[:free], total))
                start, ids = start + free, ids[free:]
            yield number, self.pieces.pop(number)

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def left(self) -> Iterator[tuple[int, list[tuple]]]:
        yield from self.pieces.items()


def _rows(done: list[tuple[int, list[tuple], bool]], base: int, with_ids: bool) -> pa.RecordBatch:
    out = {name: [] for name, _ in _FIELDS}
    for number, pieces, is_open in done:
        at, fill = 0, sum(len(p[2]) for p in pieces)
        for doc_id, start, ids, total in pieces:
            raw = ids.tobytes()
            for name, x in zip(out, (doc_id, start, len(ids), zlib.crc32(raw), total, base + number, at, is_open, fill, raw if with_ids or is_open else None), strict=True):
                out[name].append(x)
            at += len(ids)
    return pa.record_batch([pa.array(out[n], t) for n, t in _FIELDS], [n for n, _ in _FIELDS])


def _packed(path: str | None, with_ids: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, windows, done = TaskContext.get().partitionId() << 32, Windows(), []
        for batch in batches:
            for rows, ids in tokens.encoded(batch, path):
                for doc_id, x in zip(batch.column("doc_id")[rows].to_pylist(), ids, strict=True):
                    x = np.append(np.frombuffer(x, "<u4"), np.uint32(END)).astype("<u4")
                    done += [(n, p, False) for n, p in windows.add((doc_id, 0, x, len(x)))]
                if len(done) > 1000:
                    yield _rows(done, base, with_ids)
                    done = []
        yield _rows(done + [(n, p, True) for n, p in windows.left()], base, with_ids)
    return emit


def _merged(with_ids: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in c.groups(batches, ["merge"]):
            base, windows = (1 << 62) + (group["merge"][0].as_py() << 32), []
            held, have = [], 0
            # in order of fill, sequence and offset
            for doc_id, start, raw, total in zip(*(group[n].to_pylist() for n in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                ids = np.frombuffer(raw, "<u4")
                while len(ids):
                    take = min(len(ids), LENGTH - have)
                    held.append((doc_id, start, ids[:take], total))
                    start, ids, have = start + take, ids[take:], have + take
                    if have == LENGTH:
                        windows.append(held)
                        held, have = [], 0
            if held:
                windows.append(held)
            yield _rows([(k, p, False) for k, p in enumerate(windows)], base, with_ids)
    return emit


def packed(docs: DataFrame, text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, fill (ids in the sequence), ids (or null)."""
    c.bounded_batches(docs.sparkSession)
    source = docs.select("doc_id", F.col(text).alias("text"))
    first = c.written(source.mapInArrow(c.task(_packed(tokenizer, with_ids)), _SCHEMA), "packing")
    merge = F.floor(F.shiftright("sequence_id", 32) / F.lit(MERGED)).cast("long")
    left = (first.where("open").withColumn("merge", merge).repartition(c.width(docs.sparkSession), "merge")
            .sortWithinPartitions("merge", F.col("fill").desc(), "sequence_id", "offset"))
    return first.where("not open").union(left.mapInArrow(c.task(_merged(with_ids)), _SCHEMA)).drop("open")
