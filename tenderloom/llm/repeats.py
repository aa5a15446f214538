"""Removal of long repeated passages by the common-prefix interval tree of a sparse enhanced suffix array.

Every string of `least` bytes holds one anchor: the 64-byte window of smallest
hash among its windows, the leftmost of equals. Equal strings have their anchor
at the same place, so it is enough to sort suffixes at anchors, and only those
whose anchor occurs again. All occurrences of one anchor form a shard:

* its suffixes (the text right of each anchor) are sorted, common prefixes of
  neighbours taken, and a stack scan gives the interval tree: every node is a
  right context shared by all suffixes below it, up to a depth r;
* within a node the reversed left contexts are sorted and scanned in the same
  way; a subset that shares l bytes to the left is a maximal repeat of l + r
  bytes if its members continue differently to the right (they lie under two
  children of the node) and to the left. All its members are occurrences.

Texts that occur more than once as a whole are removed as a whole and one of
each takes part in the rest. Anchors are counted first and looked up in sorted
arrays (see `common.Sorted`), so no text is shuffled. Equal contexts of an
anchor are one suffix with a count; a shard of very many different ones is
dealt into blocks, and every pair of blocks is a task.

Nulls and edges: null and short texts lose nothing; matches never cross
documents; repeated rows are copies; extra columns pass through `without_repeats`;
an empty table gives an empty table. A cut inside a character leaves half a
character: digests are taken on bytes, the text drops such halves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LEAST, ANCHOR = 400, 64
#: Different contexts in a block of a shard; a task holds two blocks.
BLOCK = 6_000
_TEXT = np.uint64(0x5851F42D4C957F2D)


def anchors(ends: np.ndarray, prefix: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all `least`-byte strings that lie within one text."""
    n, w = len(prefix) - 1, least - ANCHOR + 1
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - ANCHOR + 1)
    h = c.span_hash(prefix, at, at + ANCHOR)
    key = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    table = key.reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1]).ravel()
    windows = len(h) - w + 1
    low = np.minimum(behind[:windows], ahead[w - 1: w - 1 + windows]) & np.uint64(0xFFFFFFFF)
    inside = np.zeros(windows + 1, np.int32)  # starts of strings within one text
    first, last = ends[:-1], ends[1:] - least + 1
    whole = last > first
    np.add.at(inside, first[whole], 1)
    np.add.at(inside, last[whole], -1)
    low = low[np.cumsum(inside[:-1]) > 0].astype(np.int64)
    place = low[np.flatnonzero(np.diff(low, prepend=-1))]
    return place, h[place].view(np.int64)


def text_hashes(ends: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return (c.span_hash(prefix, ends[:-1], ends[1:]) ^ _TEXT).view(np.int64)


def row_keys(ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
    return c.mix(texts.view(np.uint64) + ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _stepped(batches: Iterator[pa.RecordBatch]):
    """(ids, offsets, bytes, prefix hash) of texts, a bounded stretch at a time."""
    for batch in batches:
        ends, data = c.as_bytes(batch.column("text"))
        ids = batch.column("doc_id").fill_null(-1).to_numpy()
        for a, b in c.steps(ends):
            part = data[ends[a]: ends[b]]
            yield slice(a, b), ids[a:b].astype(np.int64), ends[a: b + 1] - ends[a], part, c.prefix_hash(part), batch


def _counted(least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, ends, _, prefix, _ in _stepped(batches):
            place, h = anchors(ends, prefix, least)
            own, n = np.unique(h, return_counts=True)
            long = np.diff(ends) >= least
            whole = text_hashes(ends, prefix)[long]
            yield pa.record_batch([pa.array(np.concatenate([own, whole])), pa.array(np.concatenate([n, np.ones(len(whole), np.int64)])),
                                   pa.array(np.concatenate([np.zeros(len(own), np.int64), ids[long]]))], ["h", "n", "first"])
    return count


def _contexts(folder: str, least: int):
    """Occurrences of anchors that occur again, with their contexts, and stretches that are known to be repeated."""
    reach = least - ANCHOR

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = c.Sorted.of(folder, ["n", "first"], "h")
        for _, ids, ends, data, prefix, _ in _stepped(batches):
            whole = text_hashes(ends, prefix)
            keys = row_keys(ids, whole)
            copies, first = np.ones(len(ids), np.int64), ids.copy()
            which, found = known.find(whole)
            copies[which], first[which] = found["n"], found["first"]
            copied = np.flatnonzero(copies > 1)
            place, h = anchors(ends, prefix, least)
            which, found = known.find(h)
            place, h, n = place[which], h[which], found["n"]
            row = np.searchsorted(ends, place, "right") - 1
            here = first[row] == ids[row]
            place, h, n, row = place[here], h[here], n[here], row[here]
            # an anchor that only the copies of one text hold says nothing more
            pair, back, times = np.unique(np.stack([row, h]), axis=1, return_inverse=True, return_counts=True) if len(row) else (None, np.zeros(0, int), np.zeros(0, int))
            more = n > (copies[row] * times[back.ravel()] if len(row) else 0)
            more |= (times[back.ravel()] > 1) & (copies[row] == 1) if len(row) else False
            place, h, n, row = place[more], h[more], n[more], row[more]
            lo, hi = np.maximum(place - reach, ends[row]), np.minimum(place + least, ends[row + 1])
            ctx = c.mix(c.span_hash(prefix, lo, hi) + (place - lo).astype(np.uint64)).view(np.int64)
            # equal contexts of one text: their bytes go once
            _, lead = np.unique(np.stack([row, ctx]), axis=1, return_index=True) if len(row) else (None, np.zeros(0, np.int64))
            with_bytes = np.zeros(len(row), bool)
            with_bytes[lead] = True
            if len(copied):
                n = len(copied)
                yield pa.record_batch([pa.array(keys[copied]), pa.array(np.zeros(n, np.int64)), pa.array(np.diff(ends)[copied]),
                                       *[pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]], _COLUMNS)
            raw = data.tobytes()
            for s in range(0, len(row), 4096):
                i = np.arange(s, min(s + 4096, len(row)))
                yield pa.record_batch([
                    pa.array(keys[row[i]]), pa.array(place[i] - ends[row[i]]), pa.nulls(len(i), pa.int64()), pa.array(h[i]), pa.array(ctx[i]),
                    pa.array([raw[x:y] if w else None for x, y, w in zip(lo[i], place[i], with_bytes[i], strict=True)], pa.binary()),
                    pa.array([raw[x:y] if w else None for x, y, w in zip(place[i], hi[i], with_bytes[i], strict=True)], pa.binary())], _COLUMNS)
    return emit


_COLUMNS = ["key", "lo", "hi", "h", "ctx", "before", "after"]
_SCHEMA = "key long, lo long, hi long, h long, ctx long, before binary, after binary"


def _dealt(folder: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = c.Sorted.of(folder, ["n"], "h")
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                rows = batch.slice(s, 2048)
                n = np.ones(rows.num_rows, np.int64)
                which, found = large.find(rows.column("h").to_numpy())
                n[which] = found["n"]
                again, part, side = c.block_rows(rows.column("ctx").to_numpy(), n, BLOCK)
                rows = rows.take(pa.array(again))
                yield pa.record_batch([*rows.columns, pa.array(part), pa.array(side.astype(np.int32))], [*rows.schema.names, "part", "side"])
    return emit


def sorted_with_prefixes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the texts, and the common prefix of each with the next in that order."""
    order = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    width = int(size.max(initial=0))
    prefix = np.zeros(max(0, len(texts) - 1), np.int64)
    for s in range(0, len(prefix), 4096):
        own = order[s: s + 4097]
        rows = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in own), np.uint8).reshape(len(own), width)
        differ = rows[1:] != rows[:-1]
        where = np.where(differ.any(1), differ.argmax(1), width) if width else np.zeros(len(own) - 1, np.int64)
        prefix[s: s + 4096] = np.minimum(where, np.minimum(size[own[1:]], size[own[:-1]]))
    return order, prefix


def intervals(prefix: list[int], least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """Nodes (depth, first, last, cuts) of the interval tree of at least `least`, inner ones first, by a stack scan.

    The children of a node end at its cuts: places of neighbours whose common prefix is its depth.
    """
    stack: list[tuple[int, int, list[int]]] = []
    for i in range(len(prefix) + 1):
        now = prefix[i] if i < len(prefix) else -1
        first = i
        while stack and stack[-1][0] > now:
            depth, first, cuts = stack.pop()
            yield depth, first, i, cuts
        if now >= least:
            if stack and stack[-1][0] == now:
                stack[-1][2].append(i)
            else:
                stack.append((now, first, [i]))


class _Least:
    """Smallest value of stretches of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (step := 1 << len(self.levels) - 1) <= len(values):
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k).tolist():
            x = k == level
            out[x] = np.minimum(self.levels[level][a[x]], self.levels[level][b[x] - (1 << level)])
        return out


def maximal_repeats(befores: list[bytes], afters: list[bytes], least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(l, r, members): every repeat of l + r >= least bytes that is maximal within the contexts, with all its occurrences."""
    order, prefix = sorted_with_prefixes(afters)
    reversed_order, suffix = sorted_with_prefixes([b[::-1] for b in befores])
    rank = np.empty(len(order), np.int64)
    rank[reversed_order] = np.arange(len(order))
    shared = _Least(suffix) if len(suffix) else None
    deepest = max((len(b) for b in befores), default=0)
    for r, first, last, cuts in intervals(prefix.tolist(), max(1, least - deepest)):
        members = order[first: last + 1]
        child = np.zeros(len(members), np.int64)
        child[np.array(cuts) - first + 1] = 1
        child = np.cumsum(child)
        by_left = np.argsort(rank[members])
        members, child, place = members[by_left], child[by_left], rank[members[by_left]]
        left = shared.of(place[:-1], place[1:])
        if not (left >= least - r).any():
            continue
        for l, i, j, _ in intervals(left.tolist(), max(0, least - r)):
            if (child[i: j + 1] != child[i]).any():
                yield l, r, members[i: j + 1]


def _repeated(least: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in c.groups(batches, ["h", "part"]):
            before, after, times = (group[n].to_pylist() for n in ("before", "after", "times"))
            l_most, r_most = np.zeros(len(before), np.int64), np.zeros(len(before), np.int64)
            for l, r, members in maximal_repeats(before, after, least):
                l_most[members] = np.maximum(l_most[members], l)
                r_most[members] = np.maximum(r_most[members], r)
            for i, n in enumerate(times):
                if n > 1 and len(before[i]) + len(after[i]) >= least:
                    l_most[i], r_most[i] = len(before[i]), len(after[i])
            hit = np.flatnonzero(l_most + r_most)
            if len(hit):
                yield pa.record_batch([group["h"].combine_chunks().take(pa.array(hit)), group["ctx"].combine_chunks().take(pa.array(hit)),
                                       pa.array(l_most[hit]), pa.array(r_most[hit])], ["h", "ctx", "l", "r"])
    return emit


def _cut(folder: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = c.Sorted.of(folder, ["lo", "hi"], "key")
        for rows, ids, ends, data, prefix, batch in _stepped(batches):
            which, found = spans.find(row_keys(ids, text_hashes(ends, prefix)))
            raw, out = data.tobytes(), {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept")}
            begin = np.searchsorted(which, np.arange(len(ids) + 1))
            for i in range(len(ids)):
                text = raw[ends[i]: ends[i + 1]]
                lo, hi = found["lo"][begin[i]: begin[i + 1]], found["hi"][begin[i]: begin[i + 1]]
                runs = []
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *[x for run in runs for x in run], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(runs))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode("utf-8", "ignore"))
            carried = [n for n in batch.schema.names if n not in ("doc_id", "text")]
            yield pa.record_batch([batch.column("doc_id").slice(rows.start, len(ids)), pa.array(np.diff(ends)), pa.array(out["n_removed"], pa.int64()),
                                   pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"]), pa.array(out["kept"], pa.string()),
                                   *[batch.column(n).slice(rows.start, len(ids)) for n in carried]],
                                  ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *carried])
    return emit


def repeated_spans(source: DataFrame, least: int = LEAST) -> str:
    """Sorted files (key, lo, hi) of the repeated stretches of each row of (doc_id, text)."""
    c.bounded_batches(source.sparkSession)
    counts = (source.mapInArrow(c.task(_counted(least)), "h long, n long, first long").groupBy("h").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1"))
    folder = c.sorted_files(counts, "h", ["n", "first"], "repeat-anchors")
    found = c.written(source.mapInArrow(c.task(_contexts(folder, least)), _SCHEMA), "repeat-contexts")
    near = found.where("h is not null")
    # equal contexts stand for one another; shards of very many different ones are dealt into blocks
    kinds = near.groupBy("h", "ctx").agg(F.count("*").alias("times"), F.first("before", True).alias("before"), F.first("after", True).alias("after"))
    large = near.select("h", "ctx").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    dealt = kinds.mapInArrow(c.task(_dealt(c.sorted_files(large, "h", ["n"], "repeat-shards"))), "h long, ctx long, times long, before binary, after binary, part long, side int")
    shards = dealt.repartition(c.width(source.sparkSession), "h", "part").sortWithinPartitions("h", "part", "ctx")
    reach = c.written(shards.mapInArrow(c.task(_repeated(least)), "h long, ctx long, l long, r long"), "repeat-reach")
    # a written table: the join's exchange then stands alone, and a very common context can be split
    most = c.written(reach.groupBy("h", "ctx").agg(F.max("l").alias("l"), F.max("r").alias("r")), "repeat-most")
    spans = found.where("h is null").select("key", "lo", "hi").union(
        near.select("key", "lo", "h", "ctx").join(most, ["h", "ctx"]).select("key", F.col("lo") - F.col("l"), F.col("lo") + F.col("r")))
    return c.sorted_files(spans.distinct(), "key", ["lo", "hi"], "repeat-spans")


def removals(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining text)."""
    source = docs.select("doc_id", F.col(text).alias("text"))
    return source.mapInArrow(c.task(_cut(repeated_spans(source, least))), _RESULT)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`docs` (doc_id, text, ...) with the remaining texts; a null text stays null, `n_chars`, if there, is
    counted anew, and other columns go along whatever their names."""
    others = [n for n in docs.columns if n not in ("doc_id", "text")]
    row = F.struct(F.struct(*others or [F.lit(0).alias("_")]).alias("given"), F.col("text").isNull().alias("empty"))
    source = docs.select("doc_id", "text", row.alias("_row"))
    cut = source.mapInArrow(c.task(_cut(repeated_spans(source.select("doc_id", "text"), least))), f"{_RESULT}, _row {source.schema['_row'].dataType.simpleString()}")
    values = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("_row.empty"), F.col("kept")),
              "n_chars": F.when(~F.col("_row.empty"), F.length("kept")).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return cut.select(*[(values[n] if n in values else F.col("_row.given")[n]).alias(n) for n in docs.columns])
