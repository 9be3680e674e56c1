"""Readers, writers and versioned tables; every path goes to Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tabulon.operators.cleaning import with_ingest_lineage
from tabulon.sources.snapshots import read_snapshot, write_version


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(F.trim("value").alias("line")).where("line <> ''")


def read_kafka(spark: SparkSession, servers: str, topic: str, offsets: str = "latest") -> DataFrame:
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": offsets, "failOnDataLoss": "false", "includeHeaders": "true"}).load()
    return kafka_projection(raw)


def kafka_projection(raw: DataFrame) -> DataFrame:
    """The columns that follow from a Kafka source, or from a file stream of the same columns."""
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp", "headers")


def read_json_stream(spark: SparkSession, path: str, schema: StructType | str, millis: str | None = None) -> DataFrame:
    df = spark.readStream.schema(schema).json(path)
    return df.withColumn(millis, F.timestamp_millis(millis)) if millis else df


def read_csv_stream(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).option("sep", sep).csv(path)


def evolved_schema(spark: SparkSession, path: str, hints: str) -> StructType:
    """The hinted columns, and as text all further ones that the JSON files at ``path`` have by now: a restarted stream takes new columns on."""
    hinted = StructType.fromDDL(hints)
    known = {f.name for f in hinted}
    found = spark.read.option("primitivesAsString", True).json(path).schema
    return StructType([*hinted, *[f for f in found if f.name not in known]])


def ingest_suppliers_stream(spark: SparkSession, path: str, hints: str) -> DataFrame:
    """JSON lines as they arrive, with the columns of ``evolved_schema`` and their lineage."""
    return with_ingest_lineage(spark.readStream.schema(evolved_schema(spark, path, hints)).json(path))


def ingest_inventory_stream(spark: SparkSession, path: str, hints: str, sep: str = ",") -> DataFrame:
    """CSV files as they arrive, with the hinted columns and their lineage; a row that doesn't fit them is kept in ``_rescued``."""
    schema = StructType.fromDDL(hints).add("_rescued", "string")
    rows = spark.readStream.schema(schema).options(header=True, sep=sep, columnNameOfCorruptRecord="_rescued").csv(path)
    return with_ingest_lineage(rows)


def read_csv_by_header(spark: SparkSession, files: Sequence[str], hints: str, sep: str = ",") -> DataFrame:
    """CSV files with columns by each file's own header: the hinted ones, missing ones null, and further ones as text.

    ``_rescued`` is JSON: values that don't fit their hint by column, and the whole line (``_line``) of a row with more fields than its header.
    Files of one header are read together; the headers themselves are read by the driver, a line a file.
    """
    hinted = StructType.fromDDL(hints)
    groups: dict[str, list[str]] = {}
    for f in files:
        groups.setdefault(_first_line(spark, f), []).append(f)
    parts = []
    for header, own in groups.items():
        names = [n.strip().strip('"') for n in header.lstrip("\ufeff").split(sep)]
        schema = StructType([StructField(n, StringType()) for n in [*names, "_line"]])
        rows = spark.read.schema(schema).options(header=True, sep=sep, columnNameOfCorruptRecord="_line").csv(own)
        fits = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType) for f in hinted}
        misfits = [F.when(fits[n].isNull(), F.col(f"`{n}`")).alias(n) for n in names if n in fits]
        extra = F.when(F.size(F.split("_line", sep, -1)) > len(names), F.col("_line")).alias("_line")
        rescued = F.nullif(F.to_json(F.struct(*misfits, extra)), F.lit("{}"))
        parts.append(rows.select(*[c.alias(n) for n, c in fits.items()], *[F.col(f"`{n}`") for n in names if n not in fits], rescued.alias("_rescued")))
    empty = spark.createDataFrame([], hinted.add("_rescued", "string"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else empty


def _first_line(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def start_csv_ingestion(spark: SparkSession, path: str, hints: str, name: str, checkpoint: str, out: str, sep: str = ",", files_per_trigger: int = 1000) -> StreamingQuery:
    """CSV files as they arrive into Parquet, by ``read_csv_by_header`` and with their lineage; columns that new files bring are added.

    Each micro-batch has its own folder, so a repeated one overwrites itself; read the table with ``mergeSchema``.
    """
    found = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_trigger).load(path).select("path")

    def write(batch: DataFrame, batch_id: int) -> None:
        files = sorted(r.path for r in batch.collect())  # at most ``files_per_trigger``
        with_ingest_lineage(read_csv_by_header(batch.sparkSession, files, hints, sep)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return found.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def _dated(root: str, name: str, day: str, suffix: str) -> str:
    return f"{root}/raw/{name}/{day}/{name}_{day}.{suffix}*"  # also with .gz


def load_products(spark: SparkSession, root: str, day: str, schema: StructType | str) -> DataFrame:
    """The staged CSV of a day, gzipped or not."""
    return read_csv(spark, _dated(root, "products", day, "csv"), schema)


def load_transactions(spark: SparkSession, root: str, day: str, schema: StructType | str) -> DataFrame:
    """The staged JSON lines of a day, gzipped or not."""
    return read_json(spark, _dated(root, "transactions", day, "json"), schema)


def read_partitioned_json(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """NDJSON under ``key=value`` folders; their values become columns."""
    return spark.read.schema(schema).option("basePath", root).json(root).withColumn("source_file", F.input_file_name())


def path_partition(name: str, path: Column) -> Column:
    return F.regexp_extract(path, rf"{name}=([^/]+)", 1)


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, sep: str = ",") -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, array_file: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", array_file)
    return (reader.schema(schema) if schema else reader).json(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By extension: csv, tsv, json (also gzipped), else Parquet."""
    low = path.lower().removesuffix(".gz")
    if low.endswith((".csv", ".tsv")):
        return read_csv(spark, path, sep="\t" if low.endswith(".tsv") else ",")
    if low.endswith((".json", ".jsonl", ".ndjson")):
        return read_json(spark, path)
    return spark.read.parquet(path)


def read_first_available(spark: SparkSession, readers: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The first reader whose path exists."""
    from pyspark.errors import AnalysisException

    for reader in readers[:-1]:
        try:
            return reader()
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return readers[-1]()


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A relational table, read in ``parts`` ranges of ``key`` if given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()


def write_partitioned(df: DataFrame, path: str, *keys: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def interleaved(df: DataFrame, columns: Sequence[str], bits: int = 8) -> DataFrame:
    """``df`` with ``_z``: the interleaved bits of each column's place among its approximate quantiles, so that rows near in all columns are near in ``_z``.

    Texts are placed by their first four bytes.
    """
    kinds = dict(df.dtypes)
    number = {c: F.conv(F.rpad(F.hex(F.left(F.col(c), F.lit(4))), 8, "0"), 16, 10).cast("double") if kinds[c] == "string" else F.col(c).cast("timestamp").cast("double") if kinds[c] == "date" else F.col(c).cast("double") for c in columns}
    cuts = [k / 2**bits for k in range(1, 2**bits)]
    ends = df.agg(*[F.percentile_approx(number[c], cuts).alias(f"_e{i}") for i, c in enumerate(columns)])
    both = df.join(F.broadcast(ends))  # one row

    def place_of(ends: str, value: Column) -> Column:
        return F.coalesce(F.size(F.filter(ends, lambda e: e < value)), F.lit(0))

    place = [place_of(f"_e{i}", number[c]) for i, c in enumerate(columns)]
    both = both.withColumns({f"_p{i}": p for i, p in enumerate(place)})
    z = F.lit(0).cast("long")
    for b in range(bits):
        for i in range(len(columns)):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(F.col(f"_p{i}"), b).bitwiseAND(1).cast("long"), b * len(columns) + i))
    return both.withColumn("_z", z).select(*df.columns, "_z")


def write_versioned(df: DataFrame, root: str, version: int, cluster: Sequence[str] = (), parts: Sequence[str] = ()) -> None:
    """A published snapshot, partitioned by ``parts``; rows clustered by one or several columns make its files' statistics selective."""
    out = df
    if len(cluster) == 1:
        out = df.repartitionByRange(*cluster).sortWithinPartitions(*parts, *cluster)
    elif cluster:
        out = interleaved(df, cluster).repartitionByRange(*parts, "_z").sortWithinPartitions(*parts, "_z").drop("_z")
    write_version(out, root, version, parts)


def compact(spark: SparkSession, root: str, version: int, files: int, cluster: Sequence[str] = ()) -> int:
    """The next version of a snapshot with the same rows in about ``files`` files; gives its number."""
    rows = read_version(spark, root, version)
    write_versioned(rows if cluster else rows.repartition(files), root, version + 1, cluster)
    return version + 1


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return read_snapshot(spark, root, version)


def append_by_day(df: DataFrame, path: str, time: str) -> None:
    df.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def write_quarantine(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file; for small aggregates only."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_star(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def start(df: DataFrame, name: str, checkpoint: str, path: str | None = None, keys: Sequence[str] = (), mode: str = "append", every: str | None = None) -> StreamingQuery:
    """A named query to Parquet (or to the console without ``path``); without ``every`` it ends when all is read."""
    writer = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.format("parquet").option("path", path).partitionBy(*keys) if path else writer.format("console")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_table_foreach_batch(df: DataFrame, name: str, checkpoint: str, path: str, project: Callable[[DataFrame], DataFrame], mode: str = "update") -> StreamingQuery:
    """Each micro-batch, re-shaped, in its own folder: a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        project(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
