"""A versioned table of keyed rows in buckets, of which a change rewrites only the buckets it touches.

Rows lie in `buckets` folders by a hash of their key. A version is a manifest
that names, for each bucket, the version whose files hold it; committing a
change writes the touched buckets under the new version's number and then the
manifest, which takes its name when whole. Readers of an older version keep
seeing it; a change that is run again replaces its own files and manifest. Files
that neither of the last two versions names are removed.

    root/manifests/v00000007.json      {"buckets": 64, "at": {"3": 7, "12": 5, ...}}
    root/data/v00000007/bucket=3/...
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
KEPT = 2


class BucketTable:
    """`schema` is the rows' own; `key` must be one column without nulls. A table's number of buckets is fixed by its first manifest."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "opportunity_id", buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = self.versions()
        self.buckets = self.manifest(known[-1])["buckets"] if known else buckets

    # ---- manifests

    def versions(self) -> list[int]:
        found = self._files.globStatus(self._path(f"{self.root}/manifests/v*.json"))
        return sorted(int(f.getPath().getName()[1:-5]) for f in found or [])

    def manifest(self, version: int) -> dict:
        stream = self._files.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return {"buckets": told["buckets"], "at": {int(b): v for b, v in told["at"].items()}}

    def _write_manifest(self, version: int, at: dict[int, int]) -> None:
        whole = self._path(f"{self.root}/manifests/v{version:08d}.json")
        part = self._path(f"{self.root}/manifests/.v{version:08d}.json.part")
        stream = self._files.create(part, True)
        stream.write(bytearray(json.dumps({"buckets": self.buckets, "at": at}).encode()))
        stream.close()
        self._files.delete(whole, False)
        if not self._files.rename(part, whole):
            raise OSError(f"{whole.toString()} could not be written")

    # ---- rows

    def bucket(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(key if key is not None else F.col(self.key)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that the keys of `rows` lie in: a number of the table's buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version (the newest one), of all buckets or of some."""
        known = self.versions()
        if version is None and not known:
            return self.spark.createDataFrame([], self.schema)
        at = self.manifest(known[-1] if version is None else version)["at"]
        paths = [self._data(v, b) for b, v in sorted(at.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _data(self, version: int, bucket: int) -> str:
        return f"{self.root}/data/v{version:08d}/bucket={bucket}"

    def commit(self, version: int, rows: DataFrame, touched: list[int], before: int | None = None) -> None:
        """Write version `version`: `rows` are all rows of the touched buckets, the others stay as `before` (the newest earlier one) has them."""
        earlier = [v for v in self.versions() if v < version]
        before = earlier[-1] if before is None and earlier else before
        at = dict(self.manifest(before)["at"]) if before is not None else {}
        folder = f"{self.root}/data/v{version:08d}"
        if touched:
            width = min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            (rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], self.bucket().alias("bucket"))
             .repartition(width, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder))
        written = {int(f.getPath().getName().split("=")[1]) for f in self._files.globStatus(self._path(f"{folder}/bucket=*")) or []} if touched else set()
        beyond = written - set(touched)
        if beyond:
            raise ValueError(f"rows of buckets {sorted(beyond)[:5]}, which were not said to be touched")
        for b in touched:
            at.pop(b, None)
        at.update(dict.fromkeys(written, version))
        self._write_manifest(version, at)
        self._clean(version)

    def _clean(self, newest: int) -> None:
        keep = [v for v in self.versions() if v <= newest][-KEPT:]
        used = {(v, b) for k in keep for b, v in self.manifest(k)["at"].items()}
        for folder in self._files.globStatus(self._path(f"{self.root}/data/v*/bucket=*")) or []:
            path = folder.getPath()
            version, bucket = int(path.getParent().getName()[1:]), int(path.getName().split("=")[1])
            if version < newest and (version, bucket) not in used:
                self._files.delete(path, True)
        for v in self.versions():
            if v < newest and v not in keep:
                self._files.delete(self._path(f"{self.root}/manifests/v{v:08d}.json"), False)
