"""Counters of every micro-batch as a table, written by a listener as batches end."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tabulon.sources.snapshots import Folder

COUNTERS = "query string, query_id string, run_id string, batch long, ended string, counter string, value double"
Row = dict[str, str | int | float | None]


def counters_of(progress) -> list[Row]:
    """(counter, value) rows of a progress: input rows and duration, rows dropped by the watermark, kept and removed state, and observed metrics.

    An aggregation sums rows before it looks at the watermark, so what it drops is counted in groups of a task.
    """
    states = progress.stateOperators
    found = {"input_rows": progress.numInputRows, "batch_ms": progress.batchDuration}
    found |= {"dropped_by_watermark": sum(s.numRowsDroppedByWatermark for s in states), "state_rows": sum(s.numRowsTotal for s in states), "state_rows_removed": sum(s.numRowsRemoved for s in states)}
    for name, row in progress.observedMetrics.items():
        found |= {f"{name}.{k}": v for k, v in row.asDict().items() if v is None or isinstance(v, (int, float)) or hasattr(v, "as_tuple")}
    one = {"query": progress.name, "query_id": str(progress.id), "run_id": str(progress.runId), "batch": progress.batchId, "ended": progress.timestamp}
    return [one | {"counter": k, "value": None if v is None else float(v)} for k, v in found.items()]


def newest_watermark(query: StreamingQuery) -> str | None:
    """The latest watermark of a stream's batches so far, as UTC text; none without a batch that has one."""
    return max((p.eventTime["watermark"] for p in query.recentProgress if "watermark" in p.eventTime), default=None)


class ProgressTable(StreamingQueryListener):
    """Writes the counters of each batch as one small file of JSON lines; one per run and batch, so that a repetition replaces it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.folder = Folder(spark, path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        rows = counters_of(event.progress)
        name, draft = f"{rows[0]['run_id']}-{rows[0]['batch']}.json", f"_draft-{uuid.uuid4().hex}"
        self.folder.write(draft, "\n".join(map(json.dumps, rows)))
        self.folder.delete(name)
        self.folder.move(draft, name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """(query, query_id, run_id, batch, ended, counter, value) of all batches."""
    return spark.read.schema(COUNTERS).json(path)


def counter_totals(counters: DataFrame) -> DataFrame:
    """(query, counter, batches, total) of the table."""
    return counters.groupBy("query", "counter").agg(F.count_distinct("run_id", "batch").alias("batches"), F.sum("value").alias("total"))
