"""Token ids in files of bit planes.

A file holds the ids of a range of documents in ascending order. The id stream
is cut into blocks of `BLOCK`; a block's 32-bit ids are transposed into planes
(32 of one bit, or 4 of one byte), each compressed with zstandard, planes of
zeros left out. Layout, little-endian::

    b"IDPLANE1", uint32 planes, uint32 ids per block
    block data: the planes one after the other, most significant first
    index (zstandard): uint32[blocks][2 + planes] = ids, bytes, bytes of each plane
    documents (zstandard): int64[docs][2] = doc_id (null as the smallest), ids
    uint64 place of the index, uint32 bytes of index, uint32 bytes of documents, uint32 blocks, uint32 docs, b"IDPLANE1"

Any block is read on its own by the index. Documents are range-partitioned and
sorted by id, one file for each range; the first id of each file follows from
the counts of those before. Files take their name when whole.

Nulls and edges: null text is the end id alone, a null doc_id sorts first,
repeated rows and ids are written each time (equal ids by text), extra columns
are ignored, an empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import tokens

MAGIC, BLOCK, END, PLANES = b"IDPLANE1", 1 << 16, 0, 32
_NULL = np.iinfo(np.int64).min


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    raw = np.ascontiguousarray(ids.astype(">u4")).view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [x.tobytes() for x in np.ascontiguousarray(raw.T)]
    out: list[bytes] = []
    for k in range(4):  # one byte column at a time; a column of zeros has zero planes
        column = np.ascontiguousarray(raw[:, k])
        if column.any():
            out += [np.packbits(column & np.uint8(1 << bit)).tobytes() for bit in range(7, -1, -1)]
        else:
            out += [bytes(-(-len(ids) // 8))] * 8
    return out


def from_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if len(planes) == 4:
        for k, p in enumerate(planes):
            if p is not None:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        for k in range(4):
            column = np.zeros(n, np.uint8)
            for bit, p in zip(range(7, -1, -1), planes[8 * k: 8 * k + 8], strict=True):
                if p is not None:
                    column |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << np.uint8(bit)
            raw[:, k] = column
    return raw.view(">u4").ravel().astype("<u4")


class Writer:
    def __init__(self, stream, planes: int = PLANES, block: int = BLOCK):
        self.out, self.planes, self.block, self.at = stream, planes, block, 0
        self.pack, self.held, self.size, self.index, self.docs = zstandard.ZstdCompressor(level=3), [], 0, [], []
        self._put(MAGIC + struct.pack("<II", planes, block))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((_NULL if doc_id is None else doc_id, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            stream = np.concatenate(self.held)
            cut = len(stream) // self.block * self.block
            for s in range(0, cut, self.block):
                self._block(stream[s: s + self.block])
            self.held, self.size = [stream[cut:].copy()], len(stream) - cut

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.pack.compress(p) if p.strip(b"\0") else b"" for p in to_planes(ids, self.planes)]
        self.index.append([len(ids), sum(map(len, packed)), *map(len, packed)])
        for p in packed:
            self._put(p)

    def close(self) -> None:
        if self.size:
            self._block(np.concatenate(self.held))
        place = self.at
        index = self.pack.compress(np.array(self.index, "<u4").tobytes())
        docs = self.pack.compress(np.array(self.docs, "<i8").tobytes())
        self._put(index + docs + struct.pack("<QIIII", place, len(index), len(docs), len(self.index), len(self.docs)) + MAGIC)
        self.out.close()


class Reader:
    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(0)
        head = source.read(16)
        self.planes, self.block = struct.unpack("<II", head[8:])
        source.seek(size - 32)
        tail = source.read(32)
        if head[:8] != MAGIC or tail[24:] != MAGIC:
            raise ValueError("not a file of id planes")
        place, a, b, blocks, docs = struct.unpack("<QIIII", tail[:24])
        source.seek(place)
        unpack = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(unpack.decompress(source.read(a)), "<u4").reshape(blocks, 2 + self.planes)
        self.docs = np.frombuffer(unpack.decompress(source.read(b)), "<i8").reshape(docs, 2)
        self.offsets = 16 + np.append(0, np.cumsum(self.index[:, 1].astype(np.int64)))

    def read_block(self, k: int) -> np.ndarray:
        self.source.seek(int(self.offsets[k]))
        raw, at, planes, unpack = self.source.read(int(self.index[k, 1])), 0, [], zstandard.ZstdDecompressor()
        for size in self.index[k, 2:].tolist():
            planes.append(unpack.decompress(raw[at: at + size]) if size else None)
            at += size
        return from_planes(planes, int(self.index[k, 0]))

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        return np.concatenate([self.read_block(k) for k in range(first, last + 1)])[start - first * self.block: end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids), block after block."""
        held, have, k, start = [np.zeros(0, "<u4")], 0, 0, 0
        for doc_id, n in self.docs.tolist():
            while have < n:
                held.append(self.read_block(k))
                have += len(held[-1])
                k += 1
            stream = np.concatenate(held) if len(held) != 1 else held[0]
            yield None if doc_id == _NULL else doc_id, start, stream[:n]
            held, have, start = [stream[n:]], have - n, start + n


def _written(folder: str, path: str | None, planes: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + c.local_folder(folder))
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for rows, ids in tokens.encoded(batch, path):
                for doc_id, x in zip(batch.column("doc_id")[rows].to_pylist(), ids, strict=True):
                    if writer is None:
                        store.create_dir(base)
                        name = f"{base}/.{part:06d}.{uuid.uuid4().hex}"
                        writer = Writer(store.open_output_stream(name), planes)
                    writer.add(doc_id, np.append(np.frombuffer(x, "<u4"), np.uint32(END)))
        if writer:
            writer.close()
            store.move(name, f"{base}/{part:06d}.ids")
            yield pa.record_batch([pa.array([part]), pa.array([len(writer.docs)]), pa.array([sum(n for _, n in writer.docs)])], ["part", "docs", "ids"])
    return emit


def write(docs: DataFrame, folder: str, text: str = "text", tokenizer: str | None = None, planes: int = PLANES) -> list[tuple[int, int, int, int]]:
    """Write ids of (doc_id, text) in ascending doc_id order; (part, docs, ids, ids in files before) of each file."""
    c.bounded_batches(docs.sparkSession)
    source = docs.select("doc_id", F.col(text).alias("text"))
    ordered = source.repartitionByRange(c.width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    files = sorted(map(tuple, ordered.mapInArrow(c.task(_written(folder, tokenizer, planes)), "part long, docs long, ids long").collect()))  # one row a file
    before, out = 0, []
    for part, n, ids in files:
        out.append((part, n, ids, before))
        before += ids
    return out


def _read(folder: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + c.local_folder(folder))
        for batch in batches:
            for part, before in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{part:06d}.ids") as f:
                    out = []
                    for doc_id, start, ids in Reader(f).documents():
                        out.append((doc_id, before + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(out) == 5000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)
    return emit


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names)


def read(spark, folder: str, files: list[tuple[int, int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    table = spark.createDataFrame([(f[0], f[3]) for f in files], "part long, before long")
    return table.repartition(max(1, len(files))).mapInArrow(c.task(_read(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")
