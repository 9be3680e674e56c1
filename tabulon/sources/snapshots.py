"""Versioned tables whose versions appear whole or not at all, and keyed merges into them.

A write fills a folder of its own and then publishes a manifest, a small file named after the version, by a rename that fails
if there is one already. Readers look at manifests only, so what a failed or running write has left is never seen; of two writers of one
version the second gets ``VersionConflict`` and its files go. A manifest lists the folders of each bucket, so a merge writes only the buckets that it touches and
takes the others over. It also holds the last batch of each stream, so that a repeated batch changes nothing.

The rename is atomic on HDFS and local disks; an object store needs a committer that makes it so.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabulon.operators.windows import latest_by, top_n_per

BUCKET = "_bucket"


class VersionConflict(RuntimeError):
    """Another writer has published this version."""


class Folder:
    """The files under a table's root, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self.fs_api = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        self.none = spark.sparkContext._gateway.new_array(getattr(self.fs_api, "Options$Rename"), 0)

    def path(self, name: str):
        return self.fs_api.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        where = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, name: str, to: str) -> bool:
        """Whether the rename was done; not if there is something already."""
        self.fs.mkdirs(self.path(to).getParent())
        try:
            self.fs_api.FileContext.getFileContext(self.path(to).toUri(), self.conf).rename(self.path(name), self.path(to), self.none)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions."""
    return sorted(int(n) for n in Folder(spark, root).names("_versions") if n.isdigit())


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(Folder(spark, root).read(f"_versions/{version:012d}"))


def publish(spark: SparkSession, root: str, version: int, schema: StructType, folders: dict[str, list[str]], streams: dict[str, int]) -> None:
    """Make ``folders`` (by bucket) the content of a version."""
    folder, draft = Folder(spark, root), f"_drafts/{uuid.uuid4().hex}"
    folder.write(draft, json.dumps({"version": version, "schema": schema.json(), "folders": folders, "streams": streams, "published_at": time.time()}))
    if not folder.move(draft, f"_versions/{version:012d}"):
        folder.delete(draft)
        raise VersionConflict(f"version {version} of {root} exists")


def write_version(df: DataFrame, root: str, version: int, parts: Sequence[str] = ()) -> None:
    """Write ``df`` and publish it as a version."""
    spark = df.sparkSession
    folder, own = Folder(spark, root), f"_drafts/{uuid.uuid4().hex}"
    if version in versions(spark, root):
        raise VersionConflict(f"version {version} of {root} exists")
    (df.write.partitionBy(*parts) if parts else df.write).parquet(f"{folder.root}/{own}")
    name = f"v={version}"
    if not folder.move(own, name):  # left by a write that was not published
        name = f"v={version}-{uuid.uuid4().hex}"
        folder.move(own, name)
    try:
        publish(spark, root, version, df.schema, {"": [name]}, {})
    except VersionConflict:
        folder.delete(name)
        raise


def read_snapshot(spark: SparkSession, root: str, version: int | None = None, buckets: Sequence[str] | None = None) -> DataFrame:
    """A published version, the newest by default; or some buckets of it."""
    found = versions(spark, root)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"{root} has no version {version if version is not None else ''}".strip())
    m = manifest(spark, root, found[-1] if version is None else version)
    return _folders(spark, root, m, [f for k, fs in m["folders"].items() if buckets is None or k in buckets for f in fs])


def _folders(spark: SparkSession, root: str, m: dict, folders: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(m["schema"]))
    return spark.read.schema(schema).parquet(*[f"{root.rstrip('/')}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def clean_up(spark: SparkSession, root: str, keep: int = 2, hours: float = 24.0) -> list[str]:
    """Delete all but the newest ``keep`` versions, what only they use, and folders older than ``hours`` that no version uses; gives the names."""
    folder, found = Folder(spark, root), versions(spark, root)
    tops = lambda m: {f.split("/")[0] for fs in m["folders"].values() for f in fs}
    used = set().union(*[tops(manifest(spark, root, v)) for v in found[-keep:]], set())
    old = set().union(*[tops(manifest(spark, root, v)) for v in found[:-keep]], set()) - used
    gone = [f"_versions/{v:012d}" for v in found[:-keep]]
    stale = [n for n in folder.names("") if n.startswith(("v=", "m=")) and n not in used | old and folder.age(n) > hours * 3600]
    stale += [f"_drafts/{n}" for n in folder.names("_drafts") if folder.age(f"_drafts/{n}") > hours * 3600]
    for name in [*gone, *sorted(old), *stale]:  # manifests first: no reader finds a version without its files
        folder.delete(name)
    return [*gone, *sorted(old), *stale]


Combine = Callable[[DataFrame, DataFrame], DataFrame]


def keep_latest(keys: Sequence[str], *order: str) -> Combine:
    """Of old and new rows of a key, the one with the greatest ``order`` values."""
    return lambda old, new: latest_by(old.unionByName(new), keys, *order)


def replace_keys(keys: Sequence[str]) -> Combine:
    """All new rows, and old ones of other keys."""
    return lambda old, new: old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns).unionByName(new)


def merge(rows: DataFrame, root: str, combine: Combine, by: Sequence[str], buckets: int = 64, stream: tuple[str, int] | None = None) -> int:
    """Merge ``rows`` into the table and publish the next version; gives its number.

    Rows of equal ``by`` are in one of ``buckets`` buckets, and only buckets of ``rows`` are read and written. ``stream`` is the name and batch of a stream;
    a batch that is in the table already changes nothing.
    """
    spark = rows.sparkSession
    found = versions(spark, root)
    base = found[-1] if found else 0
    m = manifest(spark, root, base) if found else {"schema": rows.schema.json(), "folders": {}, "streams": {}, "buckets": buckets}
    if stream is not None and m["streams"].get(stream[0], -1) >= stream[1]:
        return base
    schema = StructType.fromJson(json.loads(m["schema"]))
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")
    new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    touched = [str(r[0]) for r in new.select(bucket).distinct().collect()]  # at most ``buckets``
    streams = m["streams"] | ({stream[0]: stream[1]} if stream is not None else {})
    if not touched:
        publish(spark, root, base + 1, schema, m["folders"], streams)
        return base + 1
    old = _folders(spark, root, m, [f for k in touched for f in m["folders"].get(k, [])])
    folder, name = Folder(spark, root), f"m={uuid.uuid4().hex}"
    combine(old, new).withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{folder.root}/{name}")
    written = folder.names(name)
    own = {k: [f"{name}/{BUCKET}={k}"] if f"{BUCKET}={k}" in written else [] for k in touched}
    try:
        publish(spark, root, base + 1, schema, m["folders"] | own, streams)
    except VersionConflict:
        folder.delete(name)
        raise
    return base + 1


def _for_each_batch(df: DataFrame, name: str, checkpoint: str, mode: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def start_latest(df: DataFrame, name: str, checkpoint: str, root: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> StreamingQuery:
    """A stream into a table that holds the latest row of each key, however late rows are."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            merge(kept, root, keep_latest(keys, *order), keys, buckets, (name, batch_id))
        finally:
            kept.unpersist()

    return _for_each_batch(df, name, checkpoint, "append", write)


def start_top_n(counts: DataFrame, name: str, checkpoint: str, root: str, keys: Sequence[str], item: str, by: str, n: int, buckets: int = 64) -> StreamingQuery:
    """A stream of counts (keys, item, by), each newer one replacing the one before, into the tables ``counts`` and ``ranks`` under ``root``.

    Only groups (windows) that a batch has touched are ranked again. A batch that failed between the tables is completed by its repetition.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.select(*keys, item, by).persist()
        try:
            merge(kept, f"{root}/counts", replace_keys([*keys, item]), keys, buckets, (name, batch_id))
            touched = kept.select(*keys).distinct()
            numbers = [str(r[0]) for r in touched.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).distinct().collect()]
            again = read_snapshot(batch.sparkSession, f"{root}/counts", buckets=numbers).join(touched, list(keys), "left_semi")
            merge(top_n_per(again, keys, by, n, item), f"{root}/ranks", replace_keys(keys), keys, buckets, (name, batch_id))
        finally:
            kept.unpersist()

    return _for_each_batch(counts, name, checkpoint, "update", write)
