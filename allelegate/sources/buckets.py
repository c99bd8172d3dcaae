"""Stored tables in buckets of a key, so that a change writes and reads the buckets of its keys only.

    <root>/<table>/data/version=<v>/bucket=<b>    rows of a bucket as of a version, for buckets that it changed
    <root>/<table>/manifest/version=<v>           for each bucket, the version that holds it; null: it is empty

A version counts once its manifest is committed, and is built on the one before it.  So a change that runs again, also
after half a write, reads the same state and writes the same version, and readers never see half of one.  `expire`
removes what no kept version refers to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelegate.plans.schemas import TABLES

#: Buckets of a table by default; each is small enough for a task, and a manifest lists them all.
BUCKETS = 64
MANIFEST = "bucket int, version string"


@dataclass(frozen=True)
class BucketTable:
    spark: SparkSession
    root: str
    name: str
    key: str
    buckets: int = BUCKETS
    schema: T.StructType | None = None

    @property
    def columns(self) -> T.StructType:
        return self.schema or TABLES[self.name]

    def bucket(self, key: str | None = None) -> Column:
        """Bucket of a row by its key as text; a null key has one, too."""
        return F.pmod(F.xxhash64(F.col(key or self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str | None = None) -> list[int]:
        """Buckets of the keys of `rows`: at most as many numbers as there are buckets."""
        return sorted(r["bucket"] for r in rows.select(self.bucket(key).alias("bucket")).distinct().collect())

    def versions(self) -> list[str]:
        return [v for v, done in self._folders("manifest") if done]

    def manifest(self, version: str) -> dict[int, str | None]:
        found = {r["bucket"]: r["version"] for r in self.spark.read.schema(MANIFEST).parquet(self._path("manifest", version)).collect()}
        if len(found) != self.buckets:
            raise ValueError(f"{self.name} has {len(found)} buckets, not {self.buckets}")
        return found

    def before(self, version: str | None) -> str | None:
        """Newest version, or newest one before `version`."""
        earlier = [v for v in self.versions() if version is None or v < version]
        return earlier[-1] if earlier else None

    def read(self, only: list[int] | None = None, before: str | None = None) -> DataFrame:
        """Rows of all buckets, or of `only` some, as of the newest version (before `before`)."""
        version = self.before(before)
        held = self.manifest(version) if version else {}
        paths = [f"{self._path('data', v)}/bucket={b}" for b, v in sorted(held.items()) if v is not None and (only is None or b in only)]
        if not paths:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(*paths)

    def write(self, rows: DataFrame, version: str, touched: list[int] | None = None) -> None:
        """`rows` as the whole of the buckets `touched` (all by default) from `version` on; other buckets stay as they were.

        Writing the same version again replaces it.  A row of a bucket that was not touched is an error.
        """
        earlier = self.before(version)
        held = dict.fromkeys(range(self.buckets)) | (self.manifest(earlier) if earlier else {})
        changed = list(range(self.buckets)) if touched is None else touched
        if changed:
            typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.columns.fields])
            inside = F.when(self.bucket().isin(changed), self.bucket()).otherwise(F.raise_error(F.lit("a row of a bucket that was not touched")).cast("int"))
            path = self._path("data", version)
            # one file per bucket, whatever the tasks before
            typed.withColumn("bucket", inside).repartition(min(len(changed), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            there = self._listed(path)
            held |= {b: version if f"bucket={b}" in there else None for b in changed}
        self.spark.createDataFrame(list(held.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(self._path("manifest", version))

    def expire(self, keep: int) -> list[str]:
        """Remove versions before the last `keep`, and buckets that none of these refers to; the paths removed."""
        versions = self.versions()
        kept, gone = versions[-keep:], versions[:-keep]
        used = {f"version={v}/bucket={b}" for k in kept for b, v in self.manifest(k).items() if v is not None}
        paths = [self._path("manifest", v) for v in gone]
        for version in [v for v, _ in self._folders("data") if v <= kept[-1]] if kept else []:
            path = self._path("data", version)
            buckets = [n for n in self._listed(path) if n.startswith("bucket=")]
            rest = [n for n in buckets if f"version={version}/{n}" in used]
            paths += [f"{path}/{n}" for n in buckets if n not in rest] if rest else [path]
        for path in paths:
            self._fs(path)[0].delete(self._fs(path)[1], True)
        return paths

    def _path(self, kind: str, version: str) -> str:
        return f"{self.root}/{self.name}/{kind}/version={version}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _listed(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _folders(self, kind: str) -> list[tuple[str, bool]]:
        """Versions in order, and whether each is committed."""
        path = f"{self.root}/{self.name}/{kind}"
        names = [n.removeprefix("version=") for n in self._listed(path) if n.startswith("version=")]
        return [(n, "_SUCCESS" in self._listed(f"{path}/version={n}")) for n in names]
