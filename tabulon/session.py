"""Session and table access shared by all queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def get_session(app: str = "tabulon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path is only ever handed to Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``; where it is unset, a temporary one, on one machine only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as ``__``) for the jobs run within; the caller's own come back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: neither retries nor later jobs recompute it.

    The table outlives lost executors. It stays until ``free`` deletes it or the shared folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tabulon-{uuid.uuid4().hex}"
    with setting(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):  # what a written table was shuffled through can go
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


#: Bytes of input files for a task of ``spread`` (about a million rows of the given tables at most), and the tasks up to which it leaves an input as it is.
TASK_BYTES, FEW = 8 << 20, 8


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as its files have times ``TASK_BYTES``, so that a task's rows don't grow with the tables.

    What joins or groups by these keys afterwards stays in these tasks. Inputs of ``FEW`` tasks, and streams, are left as they are.
    """
    if df.isStreaming:
        return df
    context = df.sparkSession.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    tasks = -(-sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) // TASK_BYTES)
    return df.repartition(tasks, *keys) if tasks > FEW else df


def free(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and nothing will read again; anything else is left alone."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
