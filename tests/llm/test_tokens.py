"""Token ids, plane files and packing against the library and against the texts themselves."""

import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tenderloom.llm import common, packing, planes, tokens


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokens.vocabulary())


def texts(n=80, seed=1):
    rng = random.Random(seed)
    pieces = ["the", "Thou", "é", "ü.", "don't", "12", "a1b", " ", "  ", "\n", "\t", " \n ", " ", "漢字", "<|endoftext|>", "!!", "'s", "\r\n", "🙂", " "]
    out = ["".join(rng.choice(pieces) + rng.choice([" ", " ", " ", ""]) for _ in range(rng.choice([0, 1, 4, 60]))) for _ in range(n)]
    return [*out, "", " ", "  ", "a  ", "a \n", "a\n ", "\n a", "   a", "x" * 3000, "word " * 5000]


def encode(coder, some):
    ends, data = common.as_bytes(pa.array(some, pa.string()))
    offsets, ids = coder.encode([t or "" for t in some], ends, data)
    return [ids[x:y].tolist() for x, y in zip(offsets, offsets[1:], strict=False)]


@pytest.mark.parametrize("room, ids", [(20, 400), (1000, 60), (4, 8), (1 << 12, 1 << 14)])
def test_units_equal_the_library(plain, room, ids):
    coder = tokens.Coder(tokens.vocabulary())
    coder.table = tokens.Table(room, ids)
    for seed in range(12):
        some = texts(seed=seed)
        want = [plain.encode(t, add_special_tokens=False).ids for t in some]
        assert encode(coder, some) == want
        assert encode(coder, some[::-1]) == want[::-1]
    assert coder.table.size <= room and coder.table.fill <= ids
    assert encode(coder, []) == [] and encode(coder, [None, ""]) == [[], []]


def test_units_of_many_kinds_of_space(plain):
    coder = tokens.Coder(tokens.vocabulary())
    odd = ["\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "\u1680", "é", "«a", "\u2028"]
    some = [f"a {x} b" for x in odd] + [f"a {x}b c" for x in odd] + [f"{x} {x}" for x in odd] + [" ".join(odd), "w" * 300 + " " + "w" * 300 + " w"]
    for _ in range(2):
        assert encode(coder, some) == [plain.encode(t, add_special_tokens=False).ids for t in some]


def test_a_tokenizer_that_cuts_elsewhere(plain):
    coder = tokens.Coder(tokens.vocabulary())
    coder.spaced[:] = False  # no token tells where a unit begins
    some = ["one two three", "four"]
    assert encode(coder, some) == [plain.encode(t, add_special_tokens=False).ids for t in some]


def test_table_holds_what_it_was_given():
    rng = np.random.default_rng(1)
    table = tokens.Table(2000, 9000)
    keys = np.unique(rng.integers(1, 1 << 63, 1500).astype(np.uint64) & np.uint64(0xFFF00000000000FF))  # many meet in one slot
    sizes = rng.integers(0, 6, len(keys))
    ids = np.arange(sizes.sum(), dtype="<u4")
    table.add(keys, sizes, ids)
    at = table.find(keys)
    assert (at == np.arange(len(keys))).all() and (table.find(np.setdiff1d(np.arange(1, 300, dtype=np.uint64), keys)) == -1).all()
    table.halve()
    stay = len(keys) // 2
    assert (table.find(keys[:stay]) == np.arange(stay)).all() and (table.find(keys[stay:]) == -1).all()
    assert np.array_equal(table.flat[: table.fill], ids[: sizes[:stay].sum()])


@pytest.mark.parametrize("kind", [4, 32])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.choice([0, 1, 255, 256, 50_000, 70_000, 2 ** 32 - 1], n).astype("<u4")
        back = planes.from_planes([p if p.strip(b"\0") else None for p in planes.to_planes(ids, kind)], n)
        assert back.tolist() == ids.tolist()
    out = io.BytesIO()
    out.close, keep = (lambda: None), [rng.integers(0, 60_000, n).astype("<u4") for n in (0, 3, 900, 64, 64, 1, 130)]
    w = planes.Writer(out, kind, 64)
    for i, ids in enumerate(keep):
        w.add(None if i == 0 else i, ids)
    w.close()
    r = planes.Reader(pa.BufferReader(out.getvalue()))
    assert [(d, s, x.tolist()) for d, s, x in r.documents()] == [
        (i or None, sum(map(len, keep[:i])), ids.tolist()) for i, ids in enumerate(keep)]
    whole = np.concatenate(keep)
    for a, b in ((0, 0), (0, 1), (63, 65), (100, 700), (0, len(whole))):
        assert r.read(a, b).tolist() == whole[a:b].tolist()


SCHEMA = "doc_id long, text string, start int, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(3)


def rows_of():
    some = texts(60, 7)
    return [*enumerate(some), (500, None), (501, ""), (502, "the same"), (502, "the same"), (-4, "minus"), (None, "no id")]


def test_files_hold_every_id_in_order(spark, plain):
    rows = rows_of()
    folder = common.new_path(spark, "test-planes")
    files = planes.write(frame(spark, rows), folder)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in planes.read(spark, folder, files).collect())
    want, at = [], 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((at, d, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    empty = common.new_path(spark, "test-planes")
    assert planes.read(spark, empty, planes.write(frame(spark, []), empty)).collect() == []


@pytest.mark.parametrize("room", [2, 64])
def test_packing_keeps_every_id_once(spark, plain, monkeypatch, room):
    monkeypatch.setattr(packing, "OPEN", room)
    rows = [(i, t) for i, (_, t) in enumerate(rows_of())] + [(900 + i, "of the " * (37 * i % 1500)) for i in range(60)]
    got = packing.packed(frame(spark, rows), with_ids=True).collect()
    want = {d: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        docs[r.doc_id].append((r.start, ids.tolist()))
        sequences[r.sequence_id].append((r.offset, r.length, r.fill))
    for d, ids in want.items():
        pieces = sorted(docs[d])
        assert [s for s, _ in pieces] == np.cumsum([0, *[len(x) for _, x in pieces][:-1]]).tolist()
        assert [y for _, x in pieces for y in x] == ids
    padding = 0
    for pieces in sequences.values():
        pieces.sort()
        at = 0
        for offset, length, fill in pieces:
            assert offset == at
            at += length
        assert at == fill <= 2048
        padding += 2048 - at
    assert padding <= 2048 * 2 + packing.CUT * len(sequences)


def test_packing_of_nothing(spark):
    assert packing.packed(frame(spark, [])).collect() == []
