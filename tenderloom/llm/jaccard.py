"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two documents link if the Jaccard
similarity of their sets is at least the threshold.

1. One pass gives each text a MinHash signature and an id of its word sequence;
   texts with the same words are one node with a count (copies never meet).
2. Nodes that share a band of the signature are candidates. A bucket is known
   by its members' count and digest only; buckets with the same members in
   several bands count once, in their first band. Large buckets are dealt into
   blocks, every pair of blocks is a part of its own.
3. In a part the signatures are compared a few values at a time. With a uniform
   prior the similarity after m matches of n is Beta(m + 1, n - m + 1); a pair
   is dropped once P(similarity >= threshold) falls below `tolerance`. A pair
   belongs to its first common band, so it is judged once.
4. What is left is verified on the whole shingle sets. A part gives each
   member its number of links and links between each linked member and the
   smallest one it reaches there, never the pairs themselves.

A pair of similarity 0.8 misses all 32 bands with probability 5e-8.

Nulls and edges: texts without words link with nothing; fewer than five words
make one shingle of all of them; repeated rows are copies of one another, also
when they repeat a doc_id; extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WORDS, THRESHOLD = 5, 0.8
HASHES, ROWS, STEP, TOLERANCE = 128, 4, 16, 1e-6
#: Members of a block; a part holds two blocks.
BLOCK = 384
_WEIGHT = c.mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)
#: Bytes of shingle sets that a batch holds at most, one set at least.
BATCH_BYTES = 1 << 22


def fewest_matches(hashes: int = HASHES, step: int = STEP, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each step, the fewest matches for which P(similarity >= threshold) is still `tolerance`.

    P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, hashes + 1, step):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return out


def shingles(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes in text order, the first of each text (n + 1 offsets), and two sequence hashes of each text."""
    at, to, row = c.words_of(data, ends)
    n = len(ends) - 1
    word = c.span_hash(c.prefix_hash(data), at, to)
    count = np.bincount(row, minlength=n)
    made = np.where(count >= WORDS, count - WORDS + 1, (count > 0).astype(np.int64))
    first = np.cumsum(count) - count
    begin = c.spread(first, made)
    long = np.repeat(count >= WORDS, made)
    take = np.where(long, WORDS, np.repeat(count, made))
    h = take.astype(np.uint64)
    for j in range(WORDS):
        here = take > j
        h[here] += word[begin[here] + j] * _WEIGHT[j]
    h = c.mix(h)
    place = c.spread(np.zeros(n, np.int64), made).astype(np.uint64)
    sums = np.zeros((2, len(h) + 1), np.uint64)
    for k in range(2):
        np.cumsum(c.mix(h + place * np.uint64(0xA0761D6478BD642F + 2 * k)), out=sums[k, 1:])
    offsets = np.append(0, np.cumsum(made))
    return h, offsets, c.mix(sums[:, offsets[1:]] - sums[:, offsets[:-1]] + made.astype(np.uint64))


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, HASHES) 16-bit MinHash values; texts without shingles have zeros."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, HASHES), np.uint16)
    if not len(full):
        return out
    seeds = c.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64)) | np.uint64(1)
    starts, value = offsets[:-1][full], np.empty_like(h)
    for k in range(HASHES):
        np.multiply(h, seeds[2 * k], out=value)
        value += seeds[2 * k + 1]
        out[full, k] = c.mix(np.minimum.reduceat(value, starts)) >> np.uint64(48)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.ascontiguousarray(signature).view(np.uint64)  # four 16-bit values
    return c.mix(keys + np.arange(1, keys.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, data = c.as_bytes(batch.column("text"))
        for a, b in c.steps(ends):
            h, offsets, node = shingles(ends[a: b + 1] - ends[a], data[ends[a]: ends[b]])
            made = np.diff(offsets)
            sig = signatures(h, offsets)
            yield pa.record_batch([
                batch.column("doc_id").slice(a, b - a), pa.array(node[0].view(np.int64), mask=made == 0),
                pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "node", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            keys = band_keys(_matrix(part.column("sig")))
            n, m = keys.shape
            yield pa.record_batch([
                pa.array(keys.ravel()), pa.array(np.tile(np.arange(m, dtype=np.int32), n)),
                pa.array(np.repeat(part.column("node").to_numpy(), m))], ["bucket", "band", "node"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def _dealt(folder: str):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = c.Sorted.of(folder, ["band", "members"], "bucket")
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                keys, node = band_keys(_matrix(part.column("sig"))), part.column("node").to_numpy()
                which, found = shared.find(keys.ravel())
                same = which % keys.shape[1] == found["band"]
                which, members = which[same], found["members"][same]
                row = which // keys.shape[1]
                again, pair, side = c.block_rows(node[row], members, BLOCK)
                yield pa.record_batch([
                    pa.array(keys.ravel()[which[again]]), pa.array(pair), pa.array((which % keys.shape[1])[again].astype(np.int32)),
                    pa.array(side.astype(np.int32)), pa.array(node[row[again]]), part.column("sig").take(pa.array(row[again]))],
                    ["bucket", "part", "band", "side", "node", "sig"])
    return deal


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fewest = fewest_matches()
    for group in c.groups(batches, ["bucket", "part"]):
        sig = _matrix(group["sig"].combine_chunks())
        node = group["node"].to_numpy()
        a, b = np.nonzero(c.pair_mask(group["side"].to_numpy()))
        matches = np.zeros(len(a), np.int32)
        for k, least in enumerate(fewest):
            lane = sig[:, k * STEP: (k + 1) * STEP]
            for s in range(0, len(a), 1 << 16):
                matches[s: s + (1 << 16)] += (lane[a[s: s + (1 << 16)]] == lane[b[s: s + (1 << 16)]]).sum(1, dtype=np.int32)
            keep = matches >= least
            a, b, matches = a[keep], b[keep], matches[keep]
            if not len(a):
                break
        band = group["band"][0].as_py()
        keys, own = np.ascontiguousarray(sig).view(np.uint64), np.ones(len(a), bool)
        for k in range(band):
            own &= keys[a, k] != keys[b, k]
        a, b = a[own], b[own]
        if not len(a):
            continue
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        left = np.zeros((len(used), len(used)), bool)
        left[at[: len(a)], at[len(a):]] = True
        task = int(c.mix(np.array([group["bucket"][0].as_py(), group["part"][0].as_py()], np.int64).view(np.uint64) * np.array([1, 31], np.uint64)).sum().view(np.int64))
        yield pa.record_batch([
            pa.array(np.full(len(used), task)), pa.array(node[used]), pa.array(np.arange(len(used), dtype=np.int32)),
            pa.array([np.packbits(x).tobytes() for x in left], pa.binary())], ["task", "node", "place", "mates"])


def _sets(folder: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = c.Sorted.of(folder, ["doc_id", "task", "place"], "node")
        for batch in batches:
            ends, data = c.as_bytes(batch.column("text"))
            for a, b in c.steps(ends):
                h, offsets, node = shingles(ends[a: b + 1] - ends[a], data[ends[a]: ends[b]])
                node = node[0].view(np.int64)
                which, found = wanted.find(node)
                ids = batch.column("doc_id").slice(a, b - a).fill_null(-1).to_numpy()
                own = (ids[which] == found["doc_id"]) & (np.diff(offsets)[which] > 0)
                which, found = which[own], {k: v[own] for k, v in found.items()}
                sets = {i: np.unique(h[offsets[i]: offsets[i + 1]]).tobytes() for i in np.unique(which).tolist()}
                until = np.append(0, np.cumsum([len(sets[i]) for i in which.tolist()]))
                for s, t in c.steps(until, BATCH_BYTES):
                    w = which[s:t]
                    yield pa.record_batch([
                        pa.array(found["task"][s:t]), pa.array(found["place"][s:t].astype(np.int32)),
                        pa.array(node[w]), pa.array([sets[i] for i in w.tolist()], pa.binary())], ["task", "place", "node", "words"])
    return emit


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the sets' intersections."""
    n = len(sets)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    shared = times[at] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    out = np.zeros((n, n), np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [s, s + 4096])
        dense = np.zeros((n, min(4096, int(column[-1]) + 1 - s)), np.float32)
        dense[owner[i:j], column[i:j] - s] = 1
        out += dense @ dense.T
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in c.groups(batches, ["task"]):
        facts = group.filter(pc.is_valid(group["mates"])).sort_by("place")
        words = dict(zip(*(group.filter(pc.is_valid(group["words"]))[k].to_pylist() for k in ("place", "words")), strict=True))
        sets = [np.frombuffer(words[i], np.uint64) for i in facts["place"].to_pylist()]  # repeated rows of a text stand once
        n = len(sets)
        left = np.array([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x in facts["mates"].to_pylist()], bool)
        both, size = common_counts(sets), np.array([len(x) for x in sets], np.float64)
        linked = left & (both >= THRESHOLD * (size[:, None] + size[None, :] - both) - 1e-9)
        a, b = np.nonzero(linked)
        if not len(a):
            continue
        node, same = facts["node"].to_numpy(), facts["same"].to_numpy()
        links = linked.astype(np.int64) @ same + linked.T.astype(np.int64) @ same
        root = c.local_roots(n, a, b)
        used = np.flatnonzero(links)
        yield pa.record_batch([pa.array(node[used]), pa.array(node[root[used]]), pa.array(links[used])], ["node", "root", "links"])


def _classes(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, sig) of every row, and (node, first_id, same, links, component) of every node."""
    c.bounded_batches(source.sparkSession)
    sketch = c.written(source.mapInArrow(c.task(_sketch), "doc_id long, node long, sig binary"), "jaccard-sketch")
    nodes = c.written(sketch.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("same"), F.first("sig").alias("sig")), "jaccard-nodes")
    buckets = (nodes.mapInArrow(c.task(_bands), "bucket long, band int, node long").groupBy("bucket", "band")
               .agg(F.count("*").alias("members"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("sum"))
               .where("members > 1"))
    once = (buckets.groupBy("members", "lo", "hi", "sum").agg(F.min(F.struct("band", "bucket")).alias("x"))
            .select("x.bucket", "x.band", "members"))
    folder = c.sorted_files(once, "bucket", ["band", "members"], "jaccard-buckets")
    dealt = nodes.select("node", "sig").mapInArrow(c.task(_dealt(folder)), "bucket long, part long, band int, side int, node long, sig binary")
    n = c.width(source.sparkSession)
    left = c.written(dealt.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "node")
                     .mapInArrow(c.task(_pruned), "task long, node long, place int, mates binary"), "jaccard-left")
    firsts = left.select("task", "node", "place").join(nodes.select("node", "first_id", "same"), "node")
    wanted = c.sorted_files(firsts.select("node", F.coalesce("first_id", F.lit(-1)).alias("doc_id"), "task", "place"), "node", ["doc_id", "task", "place"], "jaccard-wanted")
    sets = source.mapInArrow(c.task(_sets(wanted)), "task long, place int, node long, words binary")
    facts = left.join(nodes.select("node", "same"), "node").select("task", "place", "node", F.lit(None).cast("binary").alias("words"), "mates", "same")
    parts = sets.select("task", "place", "node", "words", F.lit(None).cast("binary").alias("mates"), F.lit(None).cast("long").alias("same")).unionByName(facts)
    links = c.written(parts.repartition(n, "task").sortWithinPartitions("task", "place")
                      .mapInArrow(c.task(_verified), "node long, root long, links long"), "jaccard-links")
    reach = c.components(links, "node", "root")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    tied = nodes.select("node", "first_id", "same").join(reach, "node", "left").join(counted, "node", "left")
    return sketch, tied.select("node", "first_id", "same", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))


def similar(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) for every row: the smallest doc_id reachable by links, and the documents linked directly."""
    sketch, tied = _classes(docs.select("doc_id", F.col(text).alias("text")))
    least = tied.groupBy("component").agg(F.min("first_id").alias("class_id"))
    placed = tied.join(least, "component").select("node", "class_id", (F.col("same") - 1 + F.col("links")).alias("n_links"))
    out = sketch.select("doc_id", "node").join(placed, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _chosen(folder: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay = c.Sorted.of(folder, ["first_id", "rows"], "node")
        for batch in batches:
            ends, data = c.as_bytes(batch.column("text"))
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            for a, b in c.steps(ends):
                _, offsets, node = shingles(ends[a: b + 1] - ends[a], data[ends[a]: ends[b]])
                rows = np.where(np.diff(offsets) == 0, 1, 0)
                which, found = stay.find(node[0].view(np.int64))
                own = (ids[a:b][which] == found["first_id"]) & (rows[which] == 0)
                rows[which[own]] = found["rows"][own]
                keep = np.flatnonzero(rows)
                part = batch.slice(a, b - a).take(pa.array(keep))
                yield pa.record_batch([*part.columns, pa.array(node[0].view(np.int64)[keep]), pa.array(rows[keep])], [*part.schema.names, "_node", "_rows"])
    return emit


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) without all but the first document of each class; texts without words stay."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    source = docs.select("doc_id", "text", F.struct(*[f.name for f in others] or [F.lit(0).alias("_")]).alias("_row"))
    sketch, tied = _classes(source.select("doc_id", "text"))
    first = tied.groupBy("component").agg(F.min(F.struct("first_id", "node")).alias("x")).select("x.*")
    held = sketch.where("node is not null").select("node", "doc_id").join(first, "node").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    stay = c.written(held.groupBy("node", F.coalesce("first_id", F.lit(-1)).alias("first_id")).agg(F.count("*").alias("rows")), "jaccard-chosen")
    folder = c.sorted_files(stay, "node", ["first_id", "rows"], "jaccard-stay")
    kept = source.mapInArrow(c.task(_chosen(folder)), f"doc_id long, text string, _row {source.schema['_row'].dataType.simpleString()}, _node long, _rows long")
    columns = [F.col("_row")[n].alias(n) if n not in ("doc_id", "text") else F.col(n) for n in docs.columns]
    if stay.where("rows > 1").isEmpty():
        return kept.select(*columns)
    # rows repeated with their id: the smallest text of each
    again = kept.where("_rows > 1").groupBy("_node", "doc_id").agg(F.min_by(F.struct("text", "_row"), F.struct("text", F.to_json("_row"))).alias("x")).select("doc_id", "x.*")
    return kept.where("_rows = 1").select(*columns).union(again.select(*columns))
