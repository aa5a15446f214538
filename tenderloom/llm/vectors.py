"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors are one node with a count. A node's signs against `bits` random
planes are its key in a table; nodes that share a key in some table are
candidates. Buckets are counted first; large ones are dealt into blocks, every
pair of blocks is a part of its own. In a part all cosines are taken in double
precision at once; a pair belongs to its first common table, so it counts
once. A part gives each node its links and one link to the smallest node it
reaches, never the pairs.

Two vectors at the threshold share a plane's side with probability
1 - acos(0.95) / pi = 0.899, a table of b bits with 0.899^b. `bits` follows the
number of vectors (a bucket of unlike vectors stays small), and `tables` is
chosen so that such a pair misses all tables with probability `miss` at most;
closer pairs miss far less often.

Nulls and edges: null, empty and zero vectors and those with null or
non-finite components link with nothing; vectors of different length do not
link; repeated rows are copies; extra columns are ignored; ties and empty
tables need no care.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

THRESHOLD, MISS, SEED = 0.95, 1e-5, 20_011
BLOCK = 512


def plan(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): buckets of unlike vectors hold about 64 rows; `miss` bounds the loss at the threshold."""
    bits = min(40, max(4, math.ceil(math.log2(max(rows, 1))) - 6))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-hit))


def planes(table: int, bits: int, width: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, width]).standard_normal((width, bits))


def keys_of(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) bucket keys of unit vectors."""
    n, width = unit.shape
    out = np.empty((n, tables), np.int64)
    weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    for t in range(tables):
        side = (unit @ planes(t, bits, width)) >= 0
        out[:, t] = c.mix((side * weight).sum(1, dtype=np.uint64) ^ c.mix(np.array([t, width], np.uint64) + np.array([1, 1 << 32], np.uint64)).sum(dtype=np.uint64)).view(np.int64)
    return out


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of vectors of one length, 2,048 at a time."""
    data = [np.frombuffer(x, np.float64) for x in column.to_pylist()]
    size = np.array([len(x) for x in data])
    for w in np.unique(size).tolist():
        rows = np.flatnonzero(size == w)
        for s in range(0, len(rows), 2048):
            yield rows[s: s + 2048], np.stack([data[i] for i in rows[s: s + 2048]])


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, node (hash of the vector, null if it cannot link), unit (its direction as doubles)."""
    import xxhash

    for batch in batches:
        node, unit = [], []
        for v in batch.column("embedding").to_pylist():
            x = np.array(v if v is not None and None not in v else [], np.float64)
            most = np.abs(x).max() if len(x) else 0.0
            good = bool(len(x)) and bool(np.isfinite(x).all()) and most > 0
            if good:
                x = x / most  # neither overflow nor underflow in the norm
                x = x / np.sqrt((x * x).sum())
            node.append(np.uint64(xxhash.xxh64_intdigest(x.tobytes())).view(np.int64) if good else None)
            unit.append(x.tobytes() if good else None)
        yield pa.record_batch([batch.column("vec_id"), pa.array(node, pa.int64()), pa.array(unit, pa.binary())], ["vec_id", "node", "unit"])


def _buckets(bits: int, tables: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for rows, unit in _by_width(batch.column("unit")):
                keys = keys_of(unit, bits, tables)
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))),
                                       pa.array(np.repeat(node[rows], tables))], ["bucket", "band", "node"])
    return emit


def _dealt(folder: str, bits: int, tables: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = c.Sorted.of(folder, ["band", "members"], "bucket")
        for batch in batches:
            node, same = batch.column("node").to_numpy(), batch.column("same")
            for rows, unit in _by_width(batch.column("unit")):
                keys = keys_of(unit, bits, tables)
                which, found = shared.find(keys.ravel())
                own = which % tables == found["band"]
                which, members = which[own], found["members"][own]
                again, part, side = c.block_rows(node[rows[which // tables]], members, BLOCK)
                for s in range(0, len(again), 8192):
                    k = again[s: s + 8192]
                    at = rows[which[k] // tables]
                    yield pa.record_batch([
                        pa.array(keys.ravel()[which[k]]), pa.array(part[s: s + 8192]), pa.array((which[k] % tables).astype(np.int32)),
                        pa.array(side[s: s + 8192].astype(np.int32)), pa.array(node[at]), same.take(pa.array(at)),
                        batch.column("unit").take(pa.array(at))], ["bucket", "part", "band", "side", "node", "same", "unit"])
    return emit


def _linked(bits: int, tables: int, threshold: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [[], [], []]
        for group in c.groups(batches, ["bucket", "part"]):
            unit = np.stack([np.frombuffer(x, np.float64) for x in group["unit"].to_pylist()])
            mask = c.pair_mask(group["side"].to_numpy())
            a, b = np.nonzero(mask & (unit @ unit.T >= threshold - 1e-9))
            band = group["band"][0].as_py()
            if len(a) and band:
                keys = keys_of(unit, bits, band)
                fresh = np.ones(len(a), bool)
                for t in range(band):
                    fresh &= keys[a, t] != keys[b, t]
                a, b = a[fresh], b[fresh]
            if len(a):  # products of matrices may round apart in the last place; here each pair is summed alike
                near = np.concatenate([np.einsum("ij,ij->i", unit[a[s: s + 65536]], unit[b[s: s + 65536]]) for s in range(0, len(a), 65536)]) >= threshold
                a, b = a[near], b[near]
            if len(a):
                n, same, node = len(unit), group["same"].to_numpy(), group["node"].to_numpy()
                links = np.bincount(a, same[b], n) + np.bincount(b, same[a], n)
                root, used = c.local_roots(n, a, b), np.flatnonzero(links)
                for k, x in enumerate((node[used], node[root[used]], links[used].astype(np.int64))):
                    out[k].append(x)
            if sum(map(len, out[0])) > 50_000:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], ["node", "root", "links"])
                out = [[], [], []]
        if out[0]:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], ["node", "root", "links"])
    return emit


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding)."""
    sound = c.written(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
                      .mapInArrow(c.task(_sound), "vec_id long, node long, unit binary"), "vector-units")
    nodes = c.written(sound.where("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("same"), F.first("unit").alias("unit")), "vector-nodes")
    bits, tables = plan(nodes.count(), threshold, miss)
    counts = (nodes.select("node", "unit").mapInArrow(c.task(_buckets(bits, tables)), "bucket long, band int, node long").groupBy("bucket", "band")
              .agg(F.count("*").alias("members"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("sum"))
              .where("members > 1"))
    once = counts.groupBy("members", "lo", "hi", "sum").agg(F.min(F.struct("band", "bucket")).alias("x")).select("x.bucket", "x.band", "members")
    folder = c.sorted_files(once, "bucket", ["band", "members"], "vector-buckets")
    dealt = nodes.select("node", "same", "unit").mapInArrow(
        c.task(_dealt(folder, bits, tables)), "bucket long, part long, band int, side int, node long, same long, unit binary")
    links = c.written(dealt.repartition(c.width(vectors.sparkSession), "bucket", "part").sortWithinPartitions("bucket", "part", "node")
                      .mapInArrow(c.task(_linked(bits, tables, threshold)), "node long, root long, links long"), "vector-links")
    reach = c.components(links, "node", "root")
    tied = nodes.select("node", "first_id", "same").join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = tied.groupBy("component").agg(F.min("first_id").alias("component_id"))
    placed = (tied.join(least, "component").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
              .select("node", "component_id", (F.col("same") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = sound.select("vec_id", "node").join(placed, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                      (F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id"))).alias("kept"))
