"""Web archives of one zstandard frame a record, with the dictionary in front.

A file `*.warc.zst` holds::

    skippable frame (magic 0x184D2A5D): the dictionary, itself a zstandard frame; left out where too few records train one
    one zstandard frame a record, with content size and checksum; the first record is `warcinfo`

Each record is WARC/1.1: headers, an empty line, `Content-Length` bytes, two
line breaks. A payload of at least `least` bytes that several pages share is
written once, as the `response` of the largest page_id; the other pages are
`revisit` records that name it. The writer trains the dictionary of a file on
its first records (`SAMPLE_BYTES` at most), so files stand alone and a task that
runs again writes the same file. Files take their name when whole.

The reader walks a file frame by frame: it loads the dictionary, finds the end
of each frame from its block headers, decodes one record at a time, and checks
the frame's dictionary id, the version line, the mandatory headers, the block's
length, and the digests of block and payload. What does not hold raises
`ArchiveError` with the file and the offset; nothing is skipped.

Nulls and edges: null html is an empty payload, a null url is written as
`urn:none`, a null page_id counts as the smallest and is left out of the
record, a page_id that occurs twice with one payload is told apart by place
(one response, the others revisit it), extra columns are ignored whatever their
names, an empty table gives no file and no rows. A record must fit in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

DICTIONARY_FRAME, FRAME, DICTIONARY = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
#: Payloads of fewer bytes are always written whole.
LEAST = 1000
#: A file is closed, and another begun, when it has so many bytes.
FILE_BYTES = 1 << 30
#: Bytes of a file's first records that its dictionary is trained on, and the dictionary's size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 15
#: Groups of shared payloads that are brought to the pages; more of them are joined by a shuffle.
BROUGHT = 100_000
LEVEL, DATE = 3, "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
COLUMNS = ("file string, offset long, frame_bytes long, record_id string, record_type string, date string, target_uri string, page_id long, "
           "payload_bytes long, payload_digest string, refers_to_id string, refers_to long, payload binary")


class ArchiveError(ValueError):
    """An archive that does not hold what its headers say."""


# ---------------------------------------------------------------- records

def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def sha1_of(label: str) -> bytes:
    """The digest that a `sha1:` header states, in base 32 or in hexadecimal digits."""
    kind, _, value = label.partition(":")
    try:
        digest = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        digest = b""
    if kind.lower() != "sha1" or len(digest) != 20:
        raise ArchiveError(f"not a SHA-1 digest: {label!r}")
    return digest


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Block-Digest", sha1_label(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*headers, *head])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def name_of(*parts: object) -> str:
    """A record id that follows from what it names, so that a repeated task gives the same."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=4)}>"


def uri(url: str | None) -> str:
    """The address with what may not stand in a header line percent-encoded."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url) if url else "urn:none"


def page_record(kind: str, record_id: str, url: str | None, page_id: int | None, digest: bytes, payload: bytes, size: int,
                original: tuple[str, int | None] | None) -> bytes:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri(url)),
               ("WARC-Payload-Digest", sha1_label(digest)), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if original:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", original[0])]
        if original[1] is not None:
            headers.append(("X-Refers-To-Page-ID", str(original[1])))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record(headers, http + payload)


def fields(lines: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space goes on with the one before."""
    found: dict[str, str] = {}
    last = None
    for line in lines.decode("utf-8").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.strip().lower()
        if not colon or not last or last != name.lower():
            raise ArchiveError(f"not a header line: {line[:80]!r}")
        found.setdefault(last, value.strip())
    return found


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    first = data.find(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", data[: max(first, 0)]):
        raise ArchiveError(f"not a WARC version line: {data[:20]!r}")
    end = data.find(b"\r\n\r\n", first)
    if end < 0:
        raise ArchiveError("headers without an end")
    head = fields(data[first + 2: end]) if end > first else {}
    missing = [name for name in MANDATORY if not head.get(name)]
    if missing:
        raise ArchiveError(f"headers are missing: {', '.join(missing)}")
    if not head["content-length"].isascii() or not head["content-length"].isdigit():
        raise ArchiveError(f"not a length: {head['content-length']!r}")
    block = data[end + 4: -4]
    if len(data) < end + 8 or data[-4:] != b"\r\n\r\n" or len(block) != int(head["content-length"]):
        raise ArchiveError(f"the block has {max(0, len(data) - end - 8)} bytes, its header says {head['content-length']}")
    if "warc-block-digest" in head and sha1_of(head["warc-block-digest"]) != hashlib.sha1(block).digest():
        raise ArchiveError("the block differs from its digest")
    return head, block


def payload_of(head: dict[str, str], block: bytes) -> tuple[bytes, int, bytes]:
    """Payload (empty in a revisit), size and SHA-1 of the full payload, checked where it is there."""
    http = head.get("content-type", "").lower().startswith("application/http")
    cut = block.find(b"\r\n\r\n") + 4 if http else 0
    if http and cut < 4:
        raise ArchiveError("HTTP headers without an end")
    payload = block[cut:]
    start = block.find(b"\r\n") + 2
    length = fields(block[start: cut - 4]).get("content-length") if http and start < cut - 2 else None
    stated = sha1_of(head["warc-payload-digest"]) if "warc-payload-digest" in head else None
    if head["warc-type"] == "revisit":
        if stated is None or length is None:
            raise ArchiveError("a revisit without digest or length of its payload")
        return b"", int(length), stated
    digest = hashlib.sha1(payload).digest()
    if stated not in (None, digest):
        raise ArchiveError("the payload differs from its digest")
    if length is not None and int(length) != len(payload):
        raise ArchiveError(f"the payload has {len(payload)} bytes, its header says {length}")
    return payload, len(payload), digest


# ---------------------------------------------------------------- files

class Writer:
    """Records into one archive; the first ones are held back until they train the dictionary."""

    def __init__(self, stream, name: str):
        self.out, self.at, self.records, self.held, self.held_bytes, self.packer = stream, 0, 0, [], 0, None
        info = f"software: tenderloom\r\nformat: WARC File Format 1.1\r\nfile: {name}\r\n".encode()
        self._add(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name_of("warcinfo", name)), ("WARC-Date", DATE),
                          ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _add(self, data: bytes) -> None:
        if self.packer:
            self._put(self.packer.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        known = None
        try:
            samples = [x[: SAMPLE_BYTES // 4] for x in self.held]
            known = zstandard.train_dictionary(min(DICTIONARY_BYTES, self.held_bytes // 8), samples, k=512, d=8)
        except zstandard.ZstdError:
            pass  # too few or too short records: the file has no dictionary
        if known:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(known.as_bytes())
            self._put(DICTIONARY_FRAME + len(packed).to_bytes(4, "little") + packed)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
        held, self.held, self.held_bytes = self.held, [], 0
        for data in held:
            self._put(self.packer.compress(data))

    def add(self, data: bytes) -> None:
        self._add(data)
        self.records += 1

    def close(self) -> None:
        if not self.packer:
            self._begin()
        self.out.close()


class Reader:
    """Records of one archive, one frame at a time; memory holds one frame and a read-ahead."""

    AHEAD = 1 << 22

    def __init__(self, stream, name: str):
        self.source, self.name, self.held, self.at, self.base, self.known, self.id = stream, name, b"", 0, 0, None, 0
        self.unpack = zstandard.ZstdDecompressor()

    def _have(self, n: int) -> bool:
        while len(self.held) - self.at < n:
            more = self.source.read(max(self.AHEAD, n))
            if not more:
                return False
            self.held, self.base, self.at = self.held[self.at:] + more, self.base + self.at, 0
        return True

    def _need(self, n: int) -> None:
        if not self._have(n):
            raise ArchiveError("the file ends within a frame")

    def _dictionary(self) -> None:
        self._need(8)
        size = int.from_bytes(self.held[self.at + 4: self.at + 8], "little")
        self._need(8 + size)
        data = self.held[self.at + 8: self.at + 8 + size]
        if data[:4] == FRAME:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        if data[:4] != DICTIONARY:
            raise ArchiveError("the leading frame holds no dictionary")
        self.known = zstandard.ZstdCompressionDict(data)
        self.id, self.unpack = self.known.dict_id(), zstandard.ZstdDecompressor(dict_data=self.known)
        self.at += 8 + size

    def _frame(self) -> tuple[bytes, int]:
        """The record in the frame that begins here, and the frame's size."""
        self._have(18)
        head = self.held[self.at: self.at + 18]
        if head[:4] != FRAME:
            raise ArchiveError(f"no frame begins here: {head[:4]!r}")
        try:
            told, size = zstandard.get_frame_parameters(head), zstandard.frame_header_size(head)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"broken frame header: {e}") from e
        if told.dict_id and told.dict_id != self.id:
            raise ArchiveError(f"the frame needs dictionary {told.dict_id}, the file holds {self.id or 'none'}")
        last = False
        while not last:
            self._need(size + 3)
            block = int.from_bytes(self.held[self.at + size: self.at + size + 3], "little")
            last, kind = bool(block & 1), block >> 1 & 3
            if kind == 3:
                raise ArchiveError("a block of reserved type")
            size += 3 + (1 if kind == 1 else block >> 3)
        size += 4 * told.has_checksum
        self._need(size)
        frame = self.held[self.at: self.at + size]
        try:  # streams of unknown content size are allowed by the format
            data = self.unpack.decompress(frame) if told.content_size not in (0, zstandard.CONTENTSIZE_UNKNOWN) else self.unpack.decompressobj().decompress(frame)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"broken frame: {e}") from e
        return data, size

    def __iter__(self) -> Iterator[tuple[int, int, dict[str, str], bytes, int, bytes]]:
        """(offset, frame bytes, headers, payload, payload size, payload digest) of every record."""
        try:
            if self._have(4) and self.held[:4] == DICTIONARY_FRAME:
                self._dictionary()
            while self._have(1):
                offset = self.base + self.at
                self._have(8)
                if self.held[self.at + 1: self.at + 4] == DICTIONARY_FRAME[1:] and 0x50 <= self.held[self.at] <= 0x5F:
                    self._need(8)  # other skippable frames carry nothing for us
                    size = 8 + int.from_bytes(self.held[self.at + 4: self.at + 8], "little")
                    self._need(size)
                    self.at += size
                    continue
                data, size = self._frame()
                head, block = parse(data)
                yield offset, size, head, *payload_of(head, block)
                self.at += size
        except (ArchiveError, UnicodeDecodeError) as e:
            raise ArchiveError(f"{self.name}, offset {self.base + self.at}: {e}") from e


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + c.local_folder(folder))


def _written(folder: str, limit: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _store(folder)
        part, k, writer, done = TaskContext.get().partitionId(), 0, None, []

        def close() -> None:
            writer.close()
            store.move(temporary, f"{base}/{name}")
            done.append((name, writer.records, writer.at))

        for batch in batches:
            for page_id, url, payload, digest, size, original, first in zip(*(batch.column(i) for i in range(7)), strict=True):
                page_id, payload, digest, size = page_id.as_py(), payload.as_py(), bytes.fromhex(digest.as_py()), size.as_py()
                if writer is None:
                    store.create_dir(base)
                    name = f"{part:06d}-{len(done):04d}.warc.zst"
                    temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
                    writer = Writer(store.open_output_stream(temporary, compression=None), name)
                k += 1
                shared, original = first.as_py() is not None, original.as_py()
                response = name_of("response", original if shared else page_id, digest, size) if shared else name_of("page", page_id, digest, part, k)
                if shared and not first.as_py():
                    writer.add(page_record("revisit", name_of("revisit", page_id, digest, part, k), url.as_py(), page_id, digest, b"", size, (response, original)))
                else:
                    writer.add(page_record("response", response, url.as_py(), page_id, digest, payload, size, None))
                if writer.at + writer.held_bytes >= limit:
                    close()
                    writer = None
        if writer:
            close()
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done, strict=True)], ["file", "records", "bytes"])
    return emit


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows to write: page_id, url, payload, digest, size, original, first.

    `first` is null where no other row has the payload; else it says whether the
    row is the response, and `original` is the response's page_id. Payloads are
    compared by SHA-1, length and a 64-bit hash; only these leave the row for it.
    """
    c.bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"),
                       F.xxhash64("payload").alias("x"))
    key = ["digest", "size", "x"]

    def shared(rows: DataFrame) -> DataFrame:
        each = rows.where(F.col("size") >= least).groupBy(*key, "page_id").agg(F.count("*").alias("n"), F.min("at").alias("at"))
        top = F.max(F.struct("page_id", "n", "at")).alias("top")
        return c.written(each.groupBy(*key).agg(F.sum("n").alias("rows"), top).where("rows > 1"), "shared-payloads")

    rows = rows.withColumn("at", F.lit(0).cast("long"))
    groups = shared(rows)
    n, ties = groups.agg(F.count("*"), F.coalesce(F.sum((F.col("top.n") > 1).cast("long")), F.lit(0))).first()
    if ties:  # one page_id twice with one payload: rows get a place that both passes see
        rows = c.written(rows.drop("at").withColumn("at", F.monotonically_increasing_id()), "pages")
        groups = shared(rows)
    mine = [F.when(F.col("rows").isNotNull(), F.col("top.page_id")).alias("original"),
            F.when(F.col("rows").isNotNull(), F.col("page_id").eqNullSafe(F.col("top.page_id")) & (F.col("at") == F.col("top.at"))).alias("first")]
    met = rows.join(F.broadcast(groups), key, "left") if n <= BROUGHT else c.looked_up(rows, groups, key, "rows")
    return met.select("page_id", "url", "payload", "digest", "size", *mine)


def write(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> list[tuple[str, int, int]]:
    """Write a record for each row of (page_id, url, html); (file, records, bytes) of each archive."""
    done = plan(pages, least).mapInArrow(c.task(_written(folder, file_bytes)), "file string, records long, bytes long")
    return sorted(map(tuple, done.collect()))  # one row an archive


def _read(folder: str, payloads: bool):
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in COLUMNS.split(", ")]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[i] for x in out], kinds[i]) for i in range(len(names))], names)

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for name, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                seen, out, held = 0, [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for offset, size, h, payload, n, digest in Reader(f, name):
                        if h["warc-type"] == "warcinfo":
                            continue
                        seen += 1
                        out.append((name, offset, size, h["warc-record-id"], h["warc-type"], h["warc-date"], h.get("warc-target-uri"), number(h.get("x-page-id")),
                                    n, digest.hex(), h.get("warc-refers-to"), number(h.get("x-refers-to-page-id")), payload if payloads else None))
                        held += len(payload) if payloads else 0
                        if len(out) == 5000 or held > 1 << 24:
                            yield rows(out)
                            out, held = [], 0
                if records is not None and seen != records:
                    raise ArchiveError(f"{name}: {seen} records, {records} were written")
                yield rows(out)
    return emit


def read(spark: SparkSession, folder: str, files: list[tuple[str, int | None, int]], payloads: bool = True) -> DataFrame:
    """Every record but `warcinfo` of the archives (COLUMNS); `files` as `write` gave them, records null where unknown."""
    table = spark.createDataFrame([(f[0], f[1]) for f in files], "file string, records long")
    return table.repartition(max(1, len(files))).mapInArrow(c.task(_read(folder, payloads)), COLUMNS)


def resolved(records: DataFrame) -> DataFrame:
    """`records` without payloads, written, once every revisit is known to name a response of its payload."""
    rows = c.written(records.drop("payload"), "archive-records")
    same = ["record_id", "page", "payload_bytes", "payload_digest"]
    told = rows.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id"), F.col("refers_to").alias("page"), *same[2:]).distinct()
    there = rows.where("record_type = 'response'").select("record_id", F.col("page_id").alias("page"), *same[2:])
    on = [told[x].eqNullSafe(there[x]) if x == "page" else told[x] == there[x] for x in same]
    lost = told.join(there, on, "left_anti").limit(1).collect()
    if lost:
        raise ArchiveError(f"a revisit names {lost[0]['record_id']}, which is not there or has another payload")
    return rows
