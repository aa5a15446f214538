"""Shared helpers: written tables, Arrow group streaming, hashing of words and bytes, block pairs, components."""

from __future__ import annotations

import ctypes
import json
import os
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of text handled by one vector step; a longer text is one step of its own.
STEP_BYTES = 1 << 20


# ---------------------------------------------------------------- written tables

def shared_folder(spark: SparkSession) -> str:
    """The run's folder below spark.checkpoint.dir; where that is unset, below the warehouse, which is always set.

    The file system removes it when the session's process ends.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    root = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    folder = f"{root.rstrip('/')}/llm-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_folder(path: str) -> str:
    """The plain path of a mounted shared folder; files that workers map into memory need one."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: a folder mounted on every worker is needed here")
    return path


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle of rows that one session's settings call for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch of texts; a worker holds two or three at a time, and the executor as many for each of its workers.
ARROW_BYTES = 1 << 24


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to ARROW_BYTES: whole texts are long, and rows are counted by default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, for tokenizers and their caches."""
    name = "_llm_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].state = {}
    return sys.modules[name].state


#: A key with more than one in so many rows is heavy; there can be no more heavy keys than that.
HEAVY = 1000


def looked_up(rows: DataFrame, facts: DataFrame, on: list[str], n: str) -> DataFrame:
    """`rows` left joined to `facts`, whose keys are unique and whose column `n` counts the rows of a key.

    Heavy keys, at most `HEAVY` of them by what heavy means, are brought to the
    rows; the others meet in a shuffle where no key holds more than one row in `HEAVY`.
    """
    total = facts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    heavy = F.broadcast(facts.where(F.col(n) * HEAVY > total))
    light = rows.join(heavy.select(*on), on, "left_anti").join(facts.where(F.col(n) * HEAVY <= total), on, "left")
    return rows.join(heavy, on).unionByName(light)


def task(emit: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`emit` as a task of a worker that others use too: what another module's tasks left in the worker's state goes at
    its begin, and free memory goes back to the system at its end, since idle workers live on beside the next stage."""
    module = emit.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        if state.get("module") != module:
            state.clear()
            state["module"] = module
        try:
            yield from emit(batches)
        finally:
            release()

    return run


def release() -> None:
    """Give memory that allocators hold back for reuse to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


# ---------------------------------------------------------------- words in columns

SPACE = r"[ \t-\r]"
WORD = r"[^\x20\x09-\x0D]+"


def or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row."""
    return F.transform(F.array(value), body)[0]


# ---------------------------------------------------------------- Arrow batches

def as_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], raw[ends[0]: ends[-1]] if len(ends) else raw[:0]


def steps(ends: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts make up at most `most` bytes, one row at least."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, last
        first = last


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups from batches that are sorted by `keys`; one group is held at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table[k].combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        same = bool(held) and all(held[-1][k][-1].as_py() == table[k][0].as_py() for k in keys)
        if held and not same:
            yield pa.concat_tables(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if i and held:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


# ---------------------------------------------------------------- hashing

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of `x`."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2^64, n of each at least."""
    state = worker_state()
    have = state.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base, inverse = int(_ODD), pow(int(_ODD), -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        state["powers"] = have = np.cumprod(up), np.cumprod(down)
    return have


def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = the sum of code(byte) * base^position over data[i:j]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes()[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal byte strings wherever they lie; mixed with the length."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the joined texts, and the row it belongs to."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_IS_SPACE[data]
    # a word also ends where its text ends
    starts = inside[1:] & ~inside[:-1]
    cut = ends[1:-1]
    cut = cut[cut < n]
    starts[cut] |= inside[cut + 1]
    at = np.flatnonzero(starts[:n])
    space = np.append(np.flatnonzero(~inside[1:-1]), n)
    to = space[np.searchsorted(space, at)]
    row = np.searchsorted(ends, at, "right") - 1
    return at, np.minimum(to, ends[row + 1]), row


# ---------------------------------------------------------------- sorted arrays in files

def sorted_files(df: DataFrame, key: str, values: list[str], label: str) -> str:
    """Write `df` (whole numbers) as arrays sorted by `key` into files of the shared folder; returns the folder.

    Range partitions give files whose keys do not overlap; equal keys share a
    file. A file takes its name only when whole, and a second attempt of a task
    writes the same content. Workers map the files into memory (`Sorted`). A
    manifest names every file and its rows, so that a reader on a machine that
    does not see the folder, or lacks a file, raises instead of finding nothing.
    """
    spark = df.sparkSession
    folder = new_path(spark, label)
    path, dtypes = local_folder(folder), {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            table, part = pa.Table.from_batches(held), TaskContext.get().partitionId()
            for c in [*values, key]:  # the keys' file comes last: where it stands, the others do
                os.makedirs(path, exist_ok=True)
                kind = np.int32 if dtypes[c] == "int" else np.int64
                with open(f"{path}/.{part}.{c}.{uuid.uuid4().hex}", "wb") as f:
                    np.save(f, table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(kind))
                os.replace(f.name, f"{path}/{part:06d}.{c}.npy")
            yield pa.record_batch([pa.array([f"{part:06d}"]), pa.array([table.num_rows], pa.int64())], ["name", "n"])

    ordered = df.select(key, *values).repartitionByRange(width(spark), key).sortWithinPartitions(key, *values)
    write_manifest(path, dict(map(tuple, ordered.mapInArrow(task(save), "name string, n long").collect())))  # one row a file
    return folder


MANIFEST = "manifest.json"


def write_manifest(path: str, files: dict[str, int]) -> None:
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.{MANIFEST}.{uuid.uuid4().hex}", "w") as f:
        json.dump(files, f)
    os.replace(f.name, f"{path}/{MANIFEST}")


def read_manifest(path: str) -> dict[str, int]:
    """What must be in a folder; raises where this machine does not see it."""
    try:
        with open(f"{path}/{MANIFEST}") as f:
            return json.load(f)
    except FileNotFoundError as e:
        raise FileNotFoundError(f"{path} has no manifest here; spark.checkpoint.dir must be one folder that every machine mounts") from e


class Sorted:
    """Look-ups in the files of `sorted_files`, mapped into memory once per worker."""

    def __init__(self, folder: str, values: list[str], key: str):
        path = local_folder(folder)
        files = sorted(read_manifest(path).items())

        def column(x: str) -> list[np.ndarray]:
            arrays = [np.load(f"{path}/{name}.{x}.npy", mmap_mode="r") for name, _ in files]
            for (name, n), array in zip(files, arrays, strict=True):
                if len(array) != n:
                    raise ValueError(f"{path}/{name}.{x}.npy holds {len(array)} rows, {n} were written")
            return arrays

        self.keys, self.values = column(key), {v: column(v) for v in values}
        self.firsts = np.array([k[0] for k in self.keys], np.int64)

    @staticmethod
    def of(folder: str, values: list[str], key: str) -> Sorted:
        state = worker_state()
        name = ("sorted", folder)
        if name not in state:
            for old in [k for k in state if isinstance(k, tuple) and k[0] == "sorted"][:-1]:
                del state[old]  # a task reads two folders at most
            state[name] = Sorted(folder, values, key)
        return state[name]

    def find(self, probes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Index of the probe and the values, for every row whose key equals a probe."""
        wanted, back = np.unique(probes.astype(np.int64, copy=False), return_inverse=True)
        n, parts = np.zeros(len(wanted), np.int64), {v: [] for v in self.values}
        cuts = np.append(np.searchsorted(wanted, self.firsts), len(wanted))
        for f, keys in enumerate(self.keys):
            own = wanted[cuts[f]: cuts[f + 1]]
            if not len(own):
                continue
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n[cuts[f]: cuts[f + 1]] = hi - lo
            at = spread(lo, hi - lo)
            for v in self.values:
                parts[v].append(self.values[v][f][at])
        begin = np.cumsum(n) - n
        which = np.repeat(np.arange(len(probes)), n[back])
        at = spread(begin[back], n[back])
        return which, {v: (np.concatenate(x) if x else np.zeros(0, np.int64))[at] for v, x in parts.items()}


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n of them, one after the other for each pair."""
    begin = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(begin, n) + np.repeat(start, n)


# ---------------------------------------------------------------- block pairs

def block_rows(node: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal members of buckets into blocks of about `size`, and give every pair of blocks a part of its own.

    A bucket of m members has b = ceil(m / size) blocks; a member goes to the b
    parts that hold its block. Returns for each resulting row the member's
    index, the part, and the side (1 or 2; 0 in a part of one block).
    """
    blocks = -(-count // size)
    own = (mix(node.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
    which = np.repeat(np.arange(len(node)), blocks)
    other = spread(np.zeros(len(node), np.int64), blocks)
    i, b = own[which], blocks[which]
    return which, np.minimum(i, other) * b + np.maximum(i, other), np.where(i == other, 0, 1 + (i > other)).astype(np.int8)


def pair_mask(side: np.ndarray) -> np.ndarray:
    """Which (i, j) of a part's members are its pairs, each once: within one block, or across its two."""
    if side.any():
        return (side[:, None] == 1) & (side[None, :] == 2)
    return np.triu(np.ones((len(side), len(side)), bool), 1)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the links, for every node that has one.

    Alternating large-star and small-star rounds, each combined before the
    shuffle by `min`; a hub's links are never held together. Each round is a
    written table, so a lost executor costs one round at most. The number of
    rounds follows the logarithm of the longest chain.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u points to the smallest node around u
        big = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u itself, point to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        same = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if same == after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = after


# ---------------------------------------------------------------- order and running totals

def running_totals(df: DataFrame, group: list[str], order: list[str], weight: str, rows: str, label: str,
                   per_slice: int = 2_000) -> DataFrame:
    """`df` with `before`: the sum of `weight` over the rows of the same group that come earlier in `order`.

    order[0] must be a string of evenly spread hex digits. A group of many rows
    is cut into slices of it, sums of slices are added up first, and only a
    slice is sorted in one task. `rows` names the group's row count.
    """
    from pyspark.sql import Window as W

    slices = F.greatest(F.lit(1), F.ceil(F.col(rows) / F.lit(per_slice)))
    head = F.conv(F.substring(F.col(order[0]), 1, 7), 16, 10).cast("long")
    cut = written(df.withColumn("_slice", F.floor(head * slices / F.lit(1 << 28)).cast("long")), label)
    by_slice = cut.groupBy(*group, "_slice").agg(F.sum(weight).alias("_sum"))
    ahead = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offset = by_slice.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"),
                             F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    on = (F.col("_slice") == F.col("_s"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    counted = cut.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (counted.join(offset, on).withColumn("before", F.col("_in") + F.col("_ahead"))
            .drop("_slice", "_s", "_in", "_ahead", *[f"_g{i}" for i in range(len(group))]))
