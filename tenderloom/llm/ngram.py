"""Interpolated modified Kneser-Ney model of any order, counted in Spark and kept in sorted hash arrays.

Order n: each token is predicted from the n - 1 before it (a text begins with
n - 1 start marks). The highest order takes counts, every lower one the number
of different words before a gram, the lowest a uniform share for unknown words::

    P(w | u..) = max(c(u..w) - D(c(u..w)), 0) / c(u..) + g(u..) P(w | ..)
    P1(w)      = max(N(.w) - D'(N(.w)), 0) / N(..) + g' / (V + 1)

Fit, over every training row: words are counted by hash and stored as arrays
sorted by hash; a word's place there is its id. A task counts its grams, packs
them by part and shuffles the packs; a part is dealt by the gram's context (all
words but the last), that of very frequent words only by the whole gram, so no
context fills a part. Each part merges its packs into sorted array files with
the sums of its contexts, and packs the grams without their first word, each
counted once, for the order below; sums of contexts that lie in many parts are
packed likewise. Pairs give sums of their words. Parts grow in number with the
corpus, not in size. Workers map the files into memory and look up each
stretch's distinct grams in order. Files are written under a temporary name and
renamed, so a repeated task changes nothing. Pairs have exact keys; longer grams
go by 64-bit hashes, as words do. `fit` and `score` are for a model that is kept and
some texts beside it: stretches look their grams up in every part. A corpus that
is learnt from and scored whole goes through `crossfit`.

Nulls and edges: null text is empty and has the end token alone; a null doc_id
counts as an empty one; with nothing to learn from all tokens are unknown;
repeated rows count each time; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

END = np.int64(0x45D9F3B3335B369)
#: Order of the model that the query learns.
ORDER = 3
#: Tokens for each part of the gram files.
PART_TOKENS = 2_000_000
#: Distinct grams or words a task holds before it passes them on.
HOLD = 3_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    words: str  # sorted files h -> n
    facts: str  # sorted files id -> cc, total, n1, n2, n3
    grams: str  # folder of gram files
    order: int
    parts: int
    hot: tuple[int, ...]  # hashes of very frequent words
    tokens: int
    types: int
    gram_discounts: dict[int, tuple[float, float, float]]  # by order, from 2
    discounts: tuple[float, float, float]
    pair_types: int
    spare: float  # g': what continuation counts leave to the uniform share


def held_out(doc_id: str = "doc_id") -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 10 == 0


def tokens_of(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts in a row, an end after each; offsets of the texts."""
    data = _LOWER[data]
    at, to, row = c.words_of(data, ends)
    n = len(ends) - 1
    count = np.bincount(row, minlength=n)
    offsets = np.append(0, np.cumsum(count + 1))
    out = np.full(offsets[-1], END, np.int64)
    out[np.arange(len(at)) + row] = c.span_hash(c.prefix_hash(data), at, to).view(np.int64)
    return out, offsets


def stretches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ends, data = c.as_bytes(batch.column("text"))
        for a, b in c.steps(ends):
            yield batch, a, b, *tokens_of(ends[a: b + 1] - ends[a], data[ends[a]: ends[b]])


class _Tally:
    """Counts of 64-bit keys, merged when many are held."""

    def __init__(self):
        self.keys, self.n, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        keys, n = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.n.append(n)
        self.size += len(keys)
        return self.size > HOLD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = summed(np.concatenate(self.keys), np.concatenate(self.n))
        self.keys, self.n, self.size = [], [], 0
        return out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n[:0]


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for *_, tokens, _ in stretches(batches):
        if tally.add(tokens):
            yield pa.record_batch([pa.array(x) for x in tally.take()], ["h", "n"])
    yield pa.record_batch([pa.array(x.astype(np.int64)) for x in tally.take()], ["h", "n"])


def key_of(cols: np.ndarray) -> np.ndarray:
    """64-bit keys of grams, a column of ids for each word; exact up to two words."""
    key = cols[0].astype(np.uint64)
    if len(cols) == 2:
        return (key << np.uint64(32)) | cols[1].astype(np.uint64)
    for x in cols[1:]:
        key = c.mix((key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) ^ c.mix(x.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    return key


def part_of(cols: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    key, wide = key_of(cols[:-1]), only_hot(cols[:-1], hot)
    key[wide] = key_of(cols[:, wide])
    return (c.mix(key) % np.uint64(parts)).astype(np.int32)


def only_hot(cols: np.ndarray, hot: np.ndarray) -> np.ndarray:
    out = np.isin(cols[0], hot)
    for x in cols[1:]:
        out[out] = np.isin(x[out], hot)
    return out


def places(words: c.Sorted, hashes: np.ndarray) -> np.ndarray:
    """Ids of words: their place in the sorted arrays; -1 for unknown ones."""
    own, back = np.unique(hashes, return_inverse=True)
    out = np.full(len(own), -1, np.int64)
    begin = np.append(0, np.cumsum([len(k) for k in words.keys]))
    cuts = np.append(np.searchsorted(own, words.firsts), len(own))
    for f, keys in enumerate(words.keys):
        mine = own[cuts[f]: cuts[f + 1]]
        at = np.searchsorted(keys, mine)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == mine[hit]
        out[cuts[f]: cuts[f + 1]][hit] = at[hit] + begin[f]
    return out[back]


def often_of(known: c.Sorted, hot: tuple[int, ...], types: int) -> np.ndarray:
    """Ids of very frequent words; the start mark is as frequent as the end."""
    out = places(known, np.array(hot, np.int64))
    return (np.append(out, types) if END in hot else out).astype(np.uint32)


def contexts(back: np.ndarray, offsets: np.ndarray, start: int, order: int) -> list[np.ndarray]:
    """The words before each place: the nearest first, order - 1 of them."""
    out = []
    for _ in range(order - 1):
        last, before = out[-1] if out else back, np.empty_like(back)
        before[1:] = last[:-1]
        before[offsets[:-1]] = start
        out.append(before)
    return out


def merged(cols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of distinct grams in order, their columns, and the sums of n."""
    keys = key_of(cols)
    order = np.argsort(keys)
    keys = keys[order]
    first = starts(keys)
    return keys[first], cols[:, order[first]], np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


class _Grams:
    """Counts of grams of one order, merged when many are held, and their packs by part."""

    def __init__(self, order: int, parts: int, hot: np.ndarray):
        self.order, self.parts, self.hot = order, parts, hot
        self.cols, self.n, self.size = [], [], 0

    def add(self, cols: np.ndarray) -> bool:
        _, cols, n = merged(cols, np.ones(cols.shape[1], np.uint32))
        self.cols.append(cols)
        self.n.append(n.astype(np.uint32))
        self.size += len(n)
        return self.size > HOLD

    def packs(self) -> pa.RecordBatch:
        cols, n = np.zeros((self.order, 0), np.uint32), np.zeros(0, np.uint32)
        if self.cols:
            cols, n = np.concatenate(self.cols, axis=1), np.concatenate(self.n)
        self.cols, self.n, self.size = [], [], 0
        _, cols, n = merged(cols, n)
        order = np.lexsort(cols[1::-1])
        part = part_of(cols, self.parts, self.hot)[order]
        again = np.argsort(part, kind="stable")
        order, part = order[again], part[again]
        cols, n = cols[:, order], n[order].astype(np.uint32)
        first, blobs, press = starts(part), [], zstandard.ZstdCompressor(level=1)
        for a, b in zip(first, np.append(first, len(part))[1:], strict=True):
            blobs.append(press.compress(np.diff(cols[0, a:b], prepend=np.uint32(0)).tobytes() + cols[1:, a:b].tobytes() + n[a:b].tobytes()))
        return packed(part[first], blobs)


def packed(part: np.ndarray | list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], ["part", "pack"])


def _text_packs(words: str, types: int, parts: int, hot: tuple[int, ...], order: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = c.Sorted.of(words, ["n"], "h")
        tally = _Grams(order, parts, often_of(known, hot, types))
        for *_, tokens, offsets in stretches(batches):
            ids = places(known, tokens).astype(np.uint32)
            if tally.add(np.stack([*contexts(ids, offsets, types, order)[::-1], ids])):
                yield tally.packs()
        yield tally.packs()
    return emit


def _save(path: str, name: str, **arrays: np.ndarray) -> None:
    for kind, x in arrays.items():
        with open(f"{path}/.{name}.{kind}.{uuid.uuid4().hex}", "wb") as f:
            np.save(f, x)
        os.replace(f.name, f"{path}/{name}.{kind}.npy")


def narrow(x: np.ndarray) -> np.ndarray:
    """In the smallest type that holds every value."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _sums(key: np.ndarray, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    first = starts(key[order])
    return key[order][first], np.add.reduceat(facts[:, order], first, axis=1) if len(first) else facts[:, :0]


def _gram_files(path: str, words: str, types: int, parts: int, hot: tuple[int, ...], order: int):
    """Merge the packs of one order to files; what the order below needs goes on.

    Part numbers from `parts` on hold sums of contexts of the order above that
    lie in many parts, negative ones its numbers of grams seen 1 to 4 times.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        often = often_of(c.Sorted.of(words, ["n"], "h"), hot, types)
        below, totals, raw = _Grams(order - 1, parts, often), np.zeros(4, np.int64), zstandard.ZstdDecompressor().decompress
        for group in c.groups(batches, ["part"]):
            part, blobs = group["part"][0].as_py(), group["pack"].to_pylist()
            if part < 0:
                if order > 2:
                    yield packed([part] * len(blobs), blobs)
                else:
                    yield _rows(np.arange(10 * part, 10 * part - 4, -1), cc=np.sum([np.frombuffer(x, np.int64) for x in blobs], axis=0))
                continue
            if part >= parts:
                sums = np.concatenate([np.frombuffer(raw(x), np.int64).reshape(5, -1) for x in blobs], axis=1)
                key, facts = _sums(sums[0].view(np.uint64), sums[1:])
                _save(path, f"{order + 1}.{part}", facts=facts, keys=key)
                continue
            cols = [np.frombuffer(raw(x), np.uint32).reshape(order + 1, -1) for x in blobs]
            cols = [np.concatenate([np.cumsum(x[:1], axis=1, dtype=np.uint32), x[1:]]) for x in cols]
            cols = np.concatenate(cols, axis=1)
            keys, cols, n = merged(cols[:-1], cols[-1])
            _save(path, f"{order}.{part}", n=narrow(n), keys=keys)
            totals += [(n == k).sum() for k in (1, 2, 3, 4)]
            facts = np.stack([n, n == 1, n == 2, n > 2]).astype(np.int64)
            if order == 2:
                yield _rows(*_sums(cols[0].astype(np.int64), facts))
                second, times = np.unique(cols[1], return_counts=True)
                yield _rows(second.astype(np.int64), cc=times)
                continue
            wide = only_hot(cols[:-1], often)
            key, own = _sums(key_of(cols[:-1, ~wide]), facts[:, ~wide])
            once = own[0] == 1  # most contexts; their sums are known
            _save(path, f"{order}.{part}.of", facts=narrow(own[:, ~once]), keys=key[~once])
            _save(path, f"{order}.{part}.once", keys=key[once])
            key, own = _sums(key_of(cols[:-1, wide]), facts[:, wide])
            to = (c.mix(key) % np.uint64(parts)).astype(np.int64) + parts
            at = np.argsort(to, kind="stable")
            sums, to = np.concatenate([key.view(np.int64)[None], own])[:, at], to[at]
            first, press = starts(to), zstandard.ZstdCompressor(level=1)
            yield packed(to[first], [press.compress(sums[:, a:b].tobytes()) for a, b in zip(first, np.append(first, len(to))[1:], strict=True)])
            if below.add(cols[1:]):
                yield below.packs()
        if order > 2:
            yield below.packs()
            yield packed([-order], [totals.tobytes()])
        else:
            yield _rows(np.arange(-20, -24, -1), cc=totals)
    return emit


def _rows(key: np.ndarray, facts: np.ndarray | None = None, cc: np.ndarray | None = None) -> pa.RecordBatch:
    zero = np.zeros(len(key), np.int64)
    return pa.record_batch([pa.array(x) for x in (key, zero if cc is None else cc, *([zero] * 4 if facts is None else facts))],
                           ["id", "cc", "total", "n1", "n2", "n3"])


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of types seen once, twice, three and four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else k + 0.5 for k in range(3)]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(out))  # tiny corpora can leave the range


def discount_of(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """Learn from all rows of (text)."""
    if order < 2:
        raise ValueError(f"order {order}: a token is predicted from one before it at least")
    spark = docs.sparkSession
    c.bounded_batches(spark)
    source = docs.select("text")
    counts = c.written(source.mapInArrow(c.task(word_counts), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = c.sorted_files(counts, "h", ["n"], "lm-word-arrays")
    if types >= 2 ** 32 - 1:
        raise ValueError(f"{types} different words; word ids have 32 bits")
    parts = max(4, -(-tokens // PART_TOKENS))
    hot = tuple(r[0] for r in counts.where(F.col("n") > 2 * tokens / parts).select("h").collect())  # fewer than parts / 2
    grams = c.new_path(spark, "lm-grams")
    packs = source.mapInArrow(c.task(_text_packs(words, types, parts, hot, order)), "part int, pack binary")
    names = ("cc", "total", "n1", "n2", "n3")
    for k in range(order, 1, -1):
        packs = packs.repartition(c.width(spark), "part").sortWithinPartitions("part").mapInArrow(
            c.task(_gram_files(c.local_folder(grams), words, types, parts, hot, k)),
            "part int, pack binary" if k > 2 else "id long, " + ", ".join(f"{x} long" for x in names))
    facts = c.written(packs.groupBy("id").agg(*[F.sum(x).alias(x) for x in names]), "lm-facts")
    path = c.local_folder(grams)
    c.write_manifest(path, {x: os.path.getsize(f"{path}/{x}") for x in sorted(os.listdir(path)) if x.endswith(".npy")} if os.path.isdir(path) else {})
    seen = dict(facts.where("id < 0").select("id", "cc").collect())
    s = facts.where("id >= 0").agg(F.coalesce(F.sum("cc"), F.lit(0)), *[F.count_if(F.col("cc") == k) for k in (1, 2, 3, 4)], F.count_if(F.col("cc") > 2)).first()
    lower = discounts(list(s[1:5]))
    spare = (lower[0] * s[1] + lower[1] * s[2] + lower[2] * s[5]) / s[0] if s[0] else 1.0
    arrays = c.sorted_files(facts.where("id >= 0"), "id", list(names), "lm-fact-arrays")
    by_order = {k: discounts([seen.get(-10 * k - i, 0) for i in range(4)]) for k in range(2, order + 1)}
    return Model(words, arrays, grams, order, parts, hot, tokens, types, by_order, lower, s[0], spare)


class _Files:
    """Counts of grams and sums of contexts from the part files, mapped into memory, `OPEN` of them at a time."""

    OPEN = 512

    def __init__(self, model: Model, known: c.Sorted):
        self.path, self.parts, self.files = c.local_folder(model.grams), model.parts, {}
        self.there = c.read_manifest(self.path)
        if model.tokens and not self.there:
            raise FileNotFoundError(f"{self.path}: the driver saw no part files; spark.checkpoint.dir must be one folder that every machine mounts")
        self.hot = often_of(known, model.hot, model.types)

    def _found(self, part: np.ndarray, keys: np.ndarray, name: str, kind: str, rows: int) -> np.ndarray:
        """Values of keys, looked up in order; 0 where a key is new."""
        out = np.zeros((rows, len(keys)), np.int64)
        order = np.lexsort((keys, part))
        first = starts(part[order])
        for a, b in zip(first, np.append(first, len(order))[1:], strict=True):
            own = order[a:b]
            file = f"{self.path}/{name.format(int(part[own[0]]))}"
            if file not in self.files:
                while len(self.files) >= self.OPEN:
                    del self.files[next(iter(self.files))]
                have = f"{os.path.basename(file)}.keys.npy" in self.there
                self.files[file] = [np.load(f"{file}.{x}.npy", mmap_mode="r") for x in ("keys", kind)] if have else None
            if self.files[file]:
                known, values = self.files[file]
                at = np.searchsorted(known, keys[own])
                hit = at < len(known)
                hit[hit] = known[at[hit]] == keys[own[hit]]
                out[:, own[hit]] = values[..., at[hit]]
        return out

    def counts(self, cols: np.ndarray) -> np.ndarray:
        return self._found(part_of(cols, self.parts, self.hot), key_of(cols), f"{len(cols)}.{{}}", "n", 1)[0]

    def sums(self, cols: np.ndarray) -> np.ndarray:
        """total, n1, n2, n3 of contexts of two words or more."""
        key, wide = key_of(cols), only_hot(cols, self.hot)
        part = (c.mix(key) % np.uint64(self.parts)).astype(np.int64)
        out = np.zeros((4, len(key)), np.int64)
        out[:, ~wide] = self._found(part[~wide], key[~wide], f"{len(cols) + 1}.{{}}.of", "facts", 4)
        rest = np.flatnonzero(~wide & (out[0] == 0))
        once = self._found(part[rest], key[rest], f"{len(cols) + 1}.{{}}.once", "keys", 1)[0] != 0
        out[:2, rest[once]] = 1
        out[:, wide] = self._found(part[wide] + self.parts, key[wide], f"{len(cols) + 1}.{{}}", "facts", 4)
        return out


def _scored(model: Model):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cc", "total", "n1", "n2", "n3"]
        known, facts = c.Sorted.of(model.words, ["n"], "h"), c.Sorted.of(model.facts, names, "id")
        state = c.worker_state()
        if ("grams", model.grams) not in state:
            state["grams", model.grams] = _Files(model, known)
        files = state["grams", model.grams]
        d1, v = model.discounts, model.types
        for batch, a, b, tokens, offsets in stretches(batches):
            own, back = np.unique(tokens, return_inverse=True)
            n = np.zeros(len(own) + 1, np.int64)  # the last one is the start mark
            which, found = known.find(own)
            n[which] = found["n"]
            ids = np.append(places(known, own), v)
            fact = np.zeros((5, len(own) + 1), np.int64)
            which, found = facts.find(ids)
            for k, x in enumerate(names):
                fact[k, which] = found[x]
            fact[:, ids < 0] = 0
            p = np.maximum(fact[0] - discount_of(fact[0], d1), 0) / max(model.pair_types, 1) + model.spare / (v + 1)
            cols, where = np.arange(len(own) + 1)[None], back  # distinct grams by their words, and each place's gram
            for before in contexts(back, offsets, len(own), model.order):
                gram, where = np.unique((before.astype(np.uint64) << np.uint64(32)) | where.astype(np.uint64), return_inverse=True)
                shorter = (gram & np.uint64(0xFFFFFFFF)).astype(np.int64)
                cols = np.concatenate([(gram >> np.uint64(32)).astype(np.int64)[None], cols[:, shorter]])
                of, d = ids[cols], model.gram_discounts[len(cols)]
                sums, count = np.zeros((4, len(gram)), np.int64), np.zeros(len(gram), np.int64)
                if len(cols) == 2:
                    sums = fact[1:, cols[0]]
                else:
                    ctx, back_ = np.unique(key_of(cols[:-1]), return_index=True, return_inverse=True)[1:]
                    sound = np.flatnonzero((of[:-1, ctx] >= 0).all(0))
                    each = np.zeros((4, len(ctx)), np.int64)
                    each[:, sound] = files.sums(of[:-1, ctx[sound]].astype(np.uint32))
                    sums = each[:, back_]
                full = np.flatnonzero((of >= 0).all(0) & (sums[0] > 0))
                count[full] = files.counts(of[:, full].astype(np.uint32))
                total, gamma = np.maximum(sums[0], 1), np.array(d) @ sums[1:]
                p = np.where(sums[0] > 0, (np.maximum(count - discount_of(count, d), 0) + gamma * p[shorter]) / total, p[shorter])
            base = np.log10((n[:-1] + 0.1) / (model.tokens + 0.1 * (v + 1)))
            first = offsets[:-1]
            size = np.diff(offsets)
            yield pa.record_batch([
                batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(size),
                pa.array(np.add.reduceat((n[:-1][back] > 0).astype(np.int64), first)), pa.array(np.full(b - a, model.tokens, np.int64)),
                pa.array(np.add.reduceat(base[back], first)), pa.array(np.add.reduceat(np.log10(p)[where], first))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return emit


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of (doc_id, held_out, text) with their log10 probabilities; perplexity is 10 ** (-score / n_tokens)."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        c.task(_scored(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def cross_scored(docs: DataFrame, text: str = "text", order: int = 2) -> DataFrame:
    """Learn from the rows that are not held out and score them all."""
    from . import crossfit

    return crossfit.score(docs.select("doc_id", held_out().alias("held_out"), F.col(text).alias("text")), order)
