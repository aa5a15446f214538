import glob
import hashlib
import io

import pytest
import zstandard

from tenderloom.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def archive(spark, rows, schema=SCHEMA, **how):
    folder = common.new_path(spark, "test-archives")
    files = warc.write(spark.createDataFrame(rows, schema).repartition(3), folder, **how)
    return folder, files, warc.read(spark, folder, files)


def expected(rows, least=1000):
    """The contract, plainly: sorted (page_id, bytes, digest, type, refers_to)."""
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for payload, ids in groups.items():
        ids.sort(key=lambda x: (x is not None, x), reverse=True)
        for i, page_id in enumerate(ids):
            again = len(payload) >= least and i > 0
            out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


def got(records):
    return sorted(map(tuple, records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


BIG = "<p>Gemeinde äöü Ausschreibung</p>" * 60


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"http://a.test/{i}", f"<html>{i} {'word ' * (i % 300)}</html>") for i in range(400)]
    out += [(1000 + i, f"http://b.test/ü {i}\r\nX: y", BIG) for i in range(50)]
    out += [(2000, None, None), (2001, "", ""), (2002, "u", "small"), (2003, "u", "small"), (None, "u", BIG), (None, None, "x" * 999), (2004, "u", "x" * 1000), (2005, "u", "x" * 1000)]
    return out


def test_round_trip_matches_the_contract(spark, rows):
    _, files, records = archive(spark, rows)
    assert got(records) == expected(rows)
    assert sum(f[1] for f in files) == len(rows)
    back = {r.page_id: r for r in records.where("page_id is not null").collect()}
    assert bytes(back[7].payload).decode() == rows[7][2] and back[1049].refers_to is None and bytes(back[1000].payload) == b""
    assert back[1003].target_uri == "http://b.test/%C3%BC%203%0D%0AX:%20y"
    assert warc.resolved(records).count() == len(rows)


def test_repeated_rows_have_one_response(spark):
    rows = [(5, "u", BIG)] * 4 + [(3, "u", BIG)] * 2 + [(None, "v", BIG + "x")] * 3
    _, _, records = archive(spark, rows)
    assert got(records) == expected(rows)


def test_many_groups_join_by_shuffle(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "BROUGHT", 0)
    _, _, records = archive(spark, rows)
    assert got(records) == expected(rows)


def test_files_end_at_their_size_and_stand_alone(spark, rows):
    folder, files, records = archive(spark, rows, file_bytes=2000)
    assert len(files) > 5 and got(records) == expected(rows)
    one = [f for f in files if f[1] > 3][:1]
    assert warc.read(spark, folder, one).count() == one[0][1]


def test_empty_table_and_clashing_names(spark):
    _, files, records = archive(spark, [])
    assert files == [] and records.count() == 0
    folder = common.new_path(spark, "test-archives")
    extra = "page_id long, url string, html string, " + ", ".join(f"{x} string" for x in ("payload", "digest", "size", "x", "at", "rows", "top", "first", "original"))
    table = spark.createDataFrame([(i, "u", BIG, *"abcdefghi") for i in (1, 2)], extra)
    files = warc.write(table, folder)
    assert got(warc.read(spark, folder, files)) == expected([(1, "u", BIG), (2, "u", BIG)])


# ---------------------------------------------------------------- one file

def file_of(pages, dictionary=True, least=0):
    """An archive in memory, of (page_id, html) pairs."""
    out = io.BytesIO()
    close, out.close = out.close, lambda: None
    w = warc.Writer(out, "x.warc.zst")
    if not dictionary:
        w.packer = zstandard.ZstdCompressor(write_checksum=True)
    for page_id, html in pages:
        data = html.encode()
        w.add(warc.page_record("response", warc.name_of(page_id), "http://a.test", page_id, hashlib.sha1(data).digest(), data, len(data), None))
    w.close()
    return out.getvalue()


def read_file(data):
    return [(h, payload) for _, _, h, payload, _, _ in warc.Reader(io.BytesIO(data), "x") if h["warc-type"] == "response"]


PAGES = [(i, f"<html><head><title>Bid {i}</title></head><body>{'Notice of award ' * (i % 40)}{i * 7919}</body></html>") for i in range(500)]


def test_dictionary_is_the_leading_skippable_frame():
    data = file_of(PAGES)
    assert data[:4] == warc.DICTIONARY_FRAME and data[8:12] == warc.FRAME
    assert [p.decode() for _, p in read_file(data)] == [h for _, h in PAGES]
    size = int.from_bytes(data[4:8], "little")
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(data[8: 8 + size])
    plain = warc.DICTIONARY_FRAME + len(raw).to_bytes(4, "little") + raw + data[8 + size:]
    assert len(read_file(plain)) == 500  # a dictionary that is not compressed is allowed too
    with pytest.raises(warc.ArchiveError, match="needs dictionary"):
        read_file(data[8 + size:])


def test_each_record_is_a_frame_of_its_own():
    data = file_of(PAGES)
    places = [(o, n) for o, n, *_ in warc.Reader(io.BytesIO(data), "x")]
    front = data[: places[0][0]]
    for k in (1, 250, 500):
        o, n = places[k]
        assert read_file(front + data[o: o + n])[0][1].decode() == PAGES[k - 1][1]
    assert all(o + n == p for (o, n), (p, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) == len(data)


def test_few_records_have_no_dictionary():
    data = file_of(PAGES[:2])
    assert data[:4] == warc.FRAME and len(read_file(data)) == 2


def test_a_long_record_and_other_skippable_frames():
    data = file_of([(1, "ab" * 3_000_000), (2, "")])
    other = b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"
    assert [len(p) for _, p in read_file(data + other)] == [6_000_000, 0]


def damaged(change):
    good = warc.page_record("response", warc.name_of(1), "http://a.test", 1, hashlib.sha1(b"payload").digest(), b"payload", 7, None)
    return zstandard.ZstdCompressor().compress(change(good))


@pytest.mark.parametrize("change, message", [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "version"),
    (lambda r: r.replace(b"WARC-Date", b"X-Date"), "warc-date"),
    (lambda r: r.replace(b"WARC-Type: ", b"WARC-Type "), "header line"),
    (lambda r: r[:-4], "block has"),
    (lambda r: r[:-4] + b"!\r\n\r\n", "block has"),
    (lambda r: r[:-4] + b"\n\r\n\r", "block has"),
    (lambda r: r.replace(b"payload\r\n", b"pay1oad\r\n"), "differs"),
    (lambda r: r.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A"), "SHA-1"),
    (lambda r: r.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: md5:"), "SHA-1"),
])
def test_damage_is_named(change, message):
    with pytest.raises(warc.ArchiveError, match=f"offset 0: .*{message}"):
        read_file(damaged(change))


def test_truncated_and_foreign_files():
    data = file_of(PAGES)
    for cut in (len(data) - 1, len(data) - 9, len(data) // 2, 6, 300):
        with pytest.raises(warc.ArchiveError):
            read_file(data[:cut])
    with pytest.raises(warc.ArchiveError, match="no frame begins"):
        read_file(data + b"\x1f\x8b\x08\x00 gzip")
    flipped = bytearray(data)
    flipped[-3] ^= 0xFF  # within the last frame's checksum
    with pytest.raises(warc.ArchiveError, match="broken frame"):
        read_file(bytes(flipped))


def test_lost_file_and_lost_record_raise(spark, rows):
    folder, files, _ = archive(spark, rows)
    with pytest.raises(Exception, match="were written"):
        warc.read(spark, folder, [(files[0][0], files[0][1] + 1, 0)]).count()
    with pytest.raises(Exception, match="FileNotFound|No such file"):
        warc.read(spark, folder, [("000099-0000.warc.zst", 1, 0)]).count()
    records = warc.read(spark, folder, files)
    target = records.where("record_type = 'revisit'").first().refers_to_id
    with pytest.raises(warc.ArchiveError, match="not there"):
        warc.resolved(records.where(records.record_id != target))


def test_no_temporary_files_stay(spark, rows):
    folder, files, _ = archive(spark, rows)
    found = sorted(x.rsplit("/", 1)[1] for x in glob.glob(common.local_folder(folder) + "/*") + glob.glob(common.local_folder(folder) + "/.*"))
    assert [x for x in found if not x.startswith(".")] == [f[0] for f in files]
