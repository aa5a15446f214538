"""The model of `ngram`, learnt from some rows of a corpus and applied to all of them, without look-ups of grams.

Words of the training rows are counted by hash and stored as arrays sorted by
hash; a word's place there is its id. All texts are written once as blocks of
ids. From the highest order down, each block sends its distinct grams, packed by
part, with their counts in training rows (at lower orders none). A part is dealt
by the gram's context (all words but the last), that of very frequent words only
by the whole gram, so no context fills a part. A part is read once: it adds up
its packs, answers each with the grams' counts and the sums of their contexts,
and packs the grams without their first word, each counted once, for the order
below. Sums of contexts that lie in many parts and what follows how many words
are few and go to sorted arrays. At last a block meets its answers and its texts
are scored. Nothing is looked up at random but words, so time and shuffles grow
with the texts; parts grow in number, not in size. Pairs have exact keys; longer
grams go by 64-bit hashes, as words do.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import ngram
from .ngram import contexts, discount_of, discounts, key_of, narrow, often_of, only_hot, part_of, places, starts

#: Tokens of a block of texts.
BLOCK_TOKENS = 1_000_000
#: Kinds of rows that a part gives beside the answers, whose kind is their order.
BELOW, WIDE, CONTINUED, SEEN = -1, -2, -3, -4
#: Settings under which a written table's shuffle files go once it is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
NAMES = ["total", "n1", "n2", "n3"]
ROWS = "kind int, part int, block long, pack binary, total long, n1 long, n2 long, n3 long"


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys, where their runs begin in it, and the run of each key."""
    at = np.argsort(keys)
    first = starts(keys[at])
    of = np.empty(len(at), np.uint32)
    of[at] = np.repeat(np.arange(len(first), dtype=np.uint32), np.diff(np.append(first, len(at))))
    return at, first, of


def distinct(cols: np.ndarray, n: np.ndarray | None, parts: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams by part and first words: their columns, the sums of n (None: how often they stand), their parts, and the place of each given gram."""
    at, first, of = _runs(key_of(cols))
    own, n = np.take(cols, at[first], axis=1), np.diff(np.append(first, len(at))) if n is None else _added(n[at], first)
    part = part_of(own, parts, hot)
    order = in_order([part] if len(own) == 2 else [own[1], own[0], part])  # keys of pairs are in the order of their words
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return np.take(own, order, axis=1), n[order], part[order], rank[of]


def in_order(columns: list[np.ndarray]) -> np.ndarray:
    """A stable order by the last column, then the ones before it; numpy sorts 16 bits by radix."""
    order = None
    for x in columns:
        for half in (x & 0xFFFF, x >> 16):
            if half.any():
                half = half.astype(np.uint16)
                order = np.argsort(half, kind="stable") if order is None else order[np.argsort(half[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def _added(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the runs that begin at `first`, along the last axis."""
    return np.add.reduceat(x, first, axis=-1, dtype=np.int64) if len(first) else x[..., :0].astype(np.int64)


def _packed(cols: np.ndarray, n: np.ndarray, part: np.ndarray, kind: int, block: int) -> pa.RecordBatch:
    """Distinct grams as one compressed pack for each part: all lowest bytes of a column, then the next ones."""
    first, blobs, press = starts(part), [], zstandard.ZstdCompressor(level=1)
    for a, b in zip(first, np.append(first, len(part))[1:], strict=True):
        rows = np.empty((len(cols) + 1, b - a), np.uint32)
        rows[0], rows[1:-1], rows[-1] = np.diff(cols[0, a:b], prepend=np.uint32(0)), cols[1:, a:b], n[a:b]
        blobs.append(press.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), b - a, 4).transpose(0, 2, 1))))
    return _rows(kind, len(first), part=part[first], block=np.full(len(first), block), pack=blobs)


def _rows(kind: int, size: int, part: np.ndarray | None = None, block: np.ndarray | None = None, pack: list[bytes] | None = None,
          facts: np.ndarray | None = None) -> pa.RecordBatch:
    zero = np.zeros(size, np.int64)
    return pa.record_batch(
        [pa.array(np.full(size, kind, np.int32)), pa.array((zero if part is None else part).astype(np.int32)),
         pa.array((zero if block is None else block).astype(np.int64)), pa.array([None] * size if pack is None else pack, pa.binary()),
         *[pa.array(x) for x in ([zero] * 4 if facts is None else facts)]], [x.split()[0] for x in ROWS.split(", ")])


def _unpacked(packs: pa.ChunkedArray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of some packs, one pack after the other, and where each ends; one pack is held twice at a time."""
    packs = [x.as_buffer() for x in packs]
    ends = np.append(0, np.cumsum([zstandard.frame_content_size(x) // (4 * rows) for x in packs]))
    out, raw = np.empty((rows, ends[-1]), np.uint32), zstandard.ZstdDecompressor().decompress
    for x, a, b in zip(packs, ends[:-1], ends[1:], strict=True):
        out[:, a:b] = np.frombuffer(raw(x), np.uint8).reshape(rows, 4, b - a).transpose(0, 2, 1).copy().view(np.uint32)[..., 0]
        np.cumsum(out[0, a:b], out=out[0, a:b])
    return out, ends


def _blocks(path: str, words: str, tokens: int, types: int):
    """Write texts as files of token ids with what is known of them; a row names each file."""
    def saved(docs: list[pa.RecordBatch], seq: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        os.makedirs(path, exist_ok=True)
        table, name = pa.Table.from_batches(docs).combine_chunks(), f"{uuid.uuid4().hex}.arrow"
        with pa.ipc.new_file(f"{path}/{name}", table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
            f.write_table(table)
        return _rows(0, 1, block=np.array([(TaskContext.get().partitionId() << 32) + seq]), pack=[name.encode()])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = c.Sorted.of(words, ["n"], "h")
        docs, size, seq = [], 0, 0
        for batch, a, b, hashes, offsets in ngram.stretches(batches):
            own, back = np.unique(hashes, return_inverse=True)
            n = np.zeros(len(own), np.int64)
            which, found = known.find(own)
            n[which] = found["n"]
            base, first = np.log10((n + 0.1) / (tokens + 0.1 * (types + 1))), offsets[:-1]
            ids = places(known, own).astype(np.uint32)[back]
            docs.append(pa.record_batch([
                batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(np.diff(offsets)),
                pa.array(np.add.reduceat((n[back] > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base[back], first)),
                pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids"]))
            size += len(ids)
            if size >= BLOCK_TOKENS:
                yield saved(docs, seq)
                docs, size, seq = [], 0, seq + 1
        if docs:
            yield saved(docs, seq)
    return emit


def _block(path: str, name: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's table, its ids and the offsets of its texts."""
    table = pa.ipc.open_file(f"{path}/{name.decode()}").read_all().combine_chunks()
    ids = table["ids"].combine_chunks()
    return table.drop_columns("ids"), ids.flatten().to_numpy(), np.append(0, np.cumsum(table["n_tokens"].to_numpy()))


def _grams(ids: np.ndarray, offsets: np.ndarray, start: int, order: int) -> np.ndarray:
    return np.stack([*contexts(ids, offsets, start, order)[::-1], ids])


def _asked(path: str, words: str, types: int, parts: int, hot: tuple[int, ...], order: int, counted: bool):
    """Packs of each block's grams, with their counts in training rows if `counted`."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = often_of(c.Sorted.of(words, ["n"], "h"), hot, types)
        for batch in batches:
            for block, name in zip(batch.column("block").to_pylist(), batch.column("pack").to_pylist(), strict=True):
                docs, ids, offsets = _block(path, name)
                learnt = np.repeat(~docs["held_out"].to_numpy() & counted, np.diff(offsets))
                yield _packed(*distinct(_grams(ids, offsets, types, order), learnt, parts, often)[:3], order, block)
    return emit


def _shrunk(rows: list[np.ndarray]) -> bytes:
    """Rows of whole numbers, each in the smallest type that holds its values."""
    rows = [narrow(x) for x in rows]
    return zstandard.ZstdCompressor(level=1).compress(bytes(x.itemsize for x in rows) + b"".join(x.tobytes() for x in rows))


def _grown(pack: bytes, size: int, rows: int = 5) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(pack)
    out, at = np.empty((rows, size), np.int64), rows
    for x, width in zip(out, raw[:rows], strict=True):
        x[:] = np.frombuffer(raw, f"u{width}", size, at)
        at += width * size
    return out


def wide_key(context: np.ndarray, order: int) -> np.ndarray:
    return c.mix(context ^ c.mix(np.array([order], np.uint64))).view(np.int64)


def _of_part(cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of a part's packs, the sums of their counts, and the gram of each place."""
    at, first, of = _runs(key_of(cols[:-1]))
    return np.take(cols[:-1], at[first], axis=1), _added(cols[-1, at], first), of


def _of_contexts(own: np.ndarray, n: np.ndarray, hot: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """total, n1, n2, n3 of each context (0 where it lies in many parts), the context of each gram, keys and sums of those in many parts."""
    context = key_of(own[:-1])
    at, first, of = _runs(context)
    sums = [_added(x[at], first) for x in (n, n == 1, n == 2, n > 2)]
    wide = np.flatnonzero(only_hot(own[:-1, at[first]], hot))
    key, facts = context[at[first[wide]]], np.stack([x[wide] for x in sums])
    for x in sums:
        x[wide] = 0
    return [narrow(x) for x in sums], of, key, facts


def _answered(words: str, types: int, parts: int, hot: tuple[int, ...], order: int):
    """Add up the packs of each part, answer the blocks' packs, and pass on what other orders and parts need."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = often_of(c.Sorted.of(words, ["n"], "h"), hot, types)
        seen = np.zeros(4, np.int64)
        for group in c.groups(batches, ["part"]):
            part, blocks = group["part"][0].as_py(), group["block"].to_numpy()
            cols, ends = _unpacked(group["pack"], order + 1)
            del group
            own, n, back = _of_part(cols)
            del cols
            seen += [(n == k).sum() for k in (1, 2, 3, 4)]
            sums, of, key, facts = _of_contexts(own, n, often)
            yield _rows(WIDE, len(key), block=wide_key(key, order), facts=facts)
            n, places, packs, size = narrow(n), [], [], 0
            for i in np.flatnonzero(blocks >= 0).tolist():
                gram = back[ends[i]: ends[i + 1]]
                context = of[gram]
                places.append(i)
                packs.append(_shrunk([n[gram], *[x[context] for x in sums]]))
                size += len(packs[-1])
                if size > c.STEP_BYTES:
                    yield _rows(order, len(places), np.full(len(places), part), blocks[places], packs)
                    places, packs, size = [], [], 0
            yield _rows(order, len(places), np.full(len(places), part), blocks[places], packs)
            del back, of, sums
            below = own[1:, n > 0]
            del own, n
            if order > 2:
                yield _packed(*distinct(below, None, parts, often)[:3], BELOW, -1)
            else:
                second, times = np.unique(below[0], return_counts=True)
                yield _rows(CONTINUED, len(second), block=second, facts=np.stack([times, *np.zeros((3, len(times)), np.int64)]))
        yield _rows(SEEN, 1, facts=seen[:, None])
    return emit


def _written(df: DataFrame, label: str) -> DataFrame:
    """`common.written`, and the shuffle files that led to the table go at once: nothing reads them again."""
    spark, before = df.sparkSession, df.sparkSession.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return c.written(df, label)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def score(docs: DataFrame, order: int = ngram.ORDER) -> DataFrame:
    """Learn from the rows of (doc_id, held_out, text) that are not held out and give all rows their log10 probabilities.

    Perplexity is 10 ** (-score / n_tokens). To score other texts, add them as held out.
    """
    if order < 2:
        raise ValueError(f"order {order}: a token is predicted from one before it at least")
    spark = docs.sparkSession
    c.bounded_batches(spark)
    source = docs.select("doc_id", "held_out", "text")
    learnt = source.where(~F.col("held_out")).select("text")
    counts = _written(learnt.mapInArrow(c.task(ngram.word_counts), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = c.sorted_files(counts, "h", ["n"], "lm-word-arrays")
    if types >= 2 ** 32 - 1:
        raise ValueError(f"{types} different words; word ids have 32 bits")
    parts = max(4, -(-tokens // ngram.PART_TOKENS))
    hot = tuple(r[0] for r in counts.where(F.col("n") > 2 * tokens / parts).select("h").collect())  # fewer than parts / 2
    path = c.local_folder(c.new_path(spark, "lm-blocks"))
    blocks = _written(source.mapInArrow(c.task(_blocks(path, words, tokens, types)), ROWS), "lm-block-names")
    dealt = blocks.repartition(max(1, blocks.count()))
    told, above = {}, None
    for k in range(order, 1, -1):
        packs = dealt.mapInArrow(c.task(_asked(path, words, types, parts, hot, k, k == order)), ROWS)
        packs = packs if above is None else packs.union(above)
        packs = packs.select("part", "block", "pack").repartition(c.width(spark), "part").sortWithinPartitions("part", "block")
        told[k] = _written(packs.mapInArrow(c.task(_answered(words, types, parts, hot, k)), ROWS), f"lm-answers-{k}")
        above = told[k].where(F.col("kind") == BELOW)
    by_order = {k: discounts([x or 0 for x in t.where(F.col("kind") == SEEN).agg(*[F.sum(x) for x in NAMES]).first()]) for k, t in told.items()}
    facts = _written(told[2].where(F.col("kind") == CONTINUED).groupBy(F.col("block").alias("id")).agg(F.sum("total").alias("cc")), "lm-facts")
    s = facts.agg(F.coalesce(F.sum("cc"), F.lit(0)), *[F.count_if(F.col("cc") == k) for k in (1, 2, 3, 4)], F.count_if(F.col("cc") > 2)).first()
    lower = discounts(list(s[1:5]))
    spare = (lower[0] * s[1] + lower[1] * s[2] + lower[2] * s[5]) / s[0] if s[0] else 1.0
    arrays = c.sorted_files(facts, "id", ["cc"], "lm-fact-arrays")
    answers, wide = blocks, None
    for t in told.values():
        answers = answers.union(t.where(F.col("kind") > 0))
        wide = t.where(F.col("kind") == WIDE) if wide is None else wide.union(t.where(F.col("kind") == WIDE))
    sums = c.sorted_files(wide.groupBy(F.col("block").alias("id")).agg(*[F.sum(x).alias(x) for x in NAMES]), "id", NAMES, "lm-wide-arrays")
    emit = _scored(path, words, arrays, sums, tokens, types, parts, hot, order, by_order, lower, s[0], spare)
    return answers.select("kind", "part", "block", "pack").repartition(c.width(spark), "block").sortWithinPartitions("block", "kind", "part").mapInArrow(
        c.task(emit), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _wide_sums(wide: c.Sorted, gram: np.ndarray, often: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """total, n1, n2, n3 of contexts that lie in many parts, and the places of their grams, in order."""
    place = np.flatnonzero(only_hot(gram[:-1], often))
    which, found = wide.find(wide_key(key_of(gram[:-1, place]), order))
    return [found[x] for x in NAMES], place[which]


def _scored(path: str, words: str, arrays: str, sums_path: str, tokens: int, types: int, parts: int, hot: tuple[int, ...], order: int,
            by_order: dict[int, tuple[float, float, float]], lower: tuple[float, float, float], pair_types: int, spare: float):
    """Bring a block's answers to its texts; `spare` is what continuation counts leave to the uniform share."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = often_of(c.Sorted.of(words, ["n"], "h"), hot, types)
        wide = c.Sorted(sums_path, NAMES, "id")
        for group in c.groups(batches, ["block"]):
            kind, packs = group["kind"].to_numpy(), group["pack"].to_pylist()
            docs, ids, offsets = _block(path, packs[int(np.flatnonzero(kind == 0)[0])])
            at, first, back = _runs(ids)
            own = ids[at[first]]
            del at
            cc = np.zeros(len(own), np.int64)
            which, found = c.Sorted.of(arrays, ["cc"], "id").find(own.astype(np.int64))
            cc[which] = found["cc"]
            p = (np.maximum(cc - discount_of(cc, lower), 0) / max(pair_types, 1) + spare / (types + 1))[back]
            for k in range(2, order + 1):
                gram, _, part, where = distinct(_grams(ids, offsets, types, k), None, parts, often)
                sums, key = _wide_sums(wide, gram, often, k)
                del gram
                first, mine = starts(part), np.flatnonzero(kind == k)
                own_part, rest = np.empty(len(part)), np.empty(len(part))
                for i, a, b in zip(mine, first, np.append(first, len(part))[1:], strict=True):
                    count, *facts = _grown(packs[i], b - a)
                    x, y = np.searchsorted(key, (a, b))
                    for fact, more in zip(facts, sums, strict=True):
                        fact[key[x:y] - a] = more[x:y]
                    total, met = np.maximum(facts[0], 1), facts[0] > 0
                    own_part[a:b] = np.where(met, np.maximum(count - discount_of(count, by_order[k]), 0) / total, 0)
                    rest[a:b] = np.where(met, sum(d * x for d, x in zip(by_order[k], facts[1:], strict=True)) / total, 1)
                p = own_part[where] + rest[where] * p
            out = docs.append_column("train_tokens", pa.array(np.full(len(docs), tokens, np.int64)))
            out = out.append_column("score", pa.array(np.add.reduceat(np.log10(p), offsets[:-1])))
            yield from out.select(["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).to_batches(max_chunksize=100_000)
    return emit
