"""Lines of append-only logs as a data source: files split by byte range, each line with the place it begins at.

A log's order is that of its bytes, which a line reader that splits files does
not tell. Here a split begins at the first line break in its range and ends with
the line that its last byte lies in, so every line is read once, whatever the
splits, and `(file, place)` orders them. Lines are handed on as bytes; what they
hold is parsed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME, COLUMNS = "log_lines", "file string, place long, ended boolean, line binary"
SPLIT_BYTES = 128 << 20
#: Bytes read at a time, and lines in a batch at most.
BLOCK, BATCH = 1 << 22, 20_000


def opened(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def lines_of(stream, start: int, end: int, size: int, block: int = BLOCK) -> Iterator[tuple[int, bool, bytes]]:
    """(place, ends with a line break, bytes without it) of the lines that begin in start:end."""
    at = start
    if start:  # the line that holds the byte before belongs to the split before
        at = start - 1
        stream.seek(at)
        while at < size:
            data = stream.read(block)
            cut = data.find(b"\n")
            at += len(data) if cut < 0 else cut + 1
            if cut >= 0:
                break
        else:
            return
    stream.seek(at)
    held, begin = [], at
    while begin < end and begin < size:
        data = stream.read(block)
        if not data:
            yield begin, False, b"".join(held)
            return
        pieces = data.split(b"\n")
        for i, piece in enumerate(pieces):
            if i == len(pieces) - 1:
                held.append(piece)
                break
            line = b"".join([*held, piece]) if held else piece
            held = []
            yield begin, True, line
            begin += len(line) + 1
            if begin >= end:
                return


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        store, path = opened(self.root)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{self.root} is not there")
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        kept = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Split(p, a, min(a + self.split, n), n) for p, n in kept for a in range(0, n, self.split)] or [Split("", 0, 0, 0)]

    def read(self, split: Split) -> Iterator:
        import pyarrow as pa

        if not split.path:
            return
        store, _ = opened(self.root)
        name, out, held = split.path.rsplit("/", 1)[-1], [], 0

        def batch() -> pa.RecordBatch:
            place, ended, line = zip(*out, strict=True)
            return pa.record_batch([pa.array([name] * len(out)), pa.array(place, pa.int64()), pa.array(ended), pa.array(line, pa.binary())], ["file", "place", "ended", "line"])

        with store.open_input_file(split.path) as stream:
            for found in lines_of(stream, split.start, split.end, split.size):
                out.append(found)
                held += len(found[2])
                if len(out) >= BATCH or held >= BLOCK:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self.options)


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every line of a file or of a folder's files (COLUMNS)."""
    spark.dataSource.register(LogLines)
    return spark.read.format(NAME).option("splitBytes", split_bytes).load(path)


def read_json_log(spark: SparkSession, path: str, ddl: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """JSON lines with their place: file, place, torn, and the columns of `ddl`, null where torn.

    A line is torn if it is no JSON object of that shape: cut short by a crash,
    or run into by the line written after one. Blank lines are left out.
    """
    lines = read_lines(spark, path, split_bytes).withColumn("text", F.col("line").cast("string")).filter(F.trim("text") != "")
    parsed = lines.select("file", "place", F.from_json("text", f"{ddl}, __torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__torn"}).alias("v"))
    torn = F.col("v").isNull() | F.col("v.__torn").isNotNull()
    names = StructType.fromDDL(ddl).fieldNames()
    return parsed.select("file", "place", torn.alias("torn"), *[F.when(~torn, F.col("v")[n]).alias(n) for n in names])
