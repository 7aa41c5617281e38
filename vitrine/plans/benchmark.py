"""Measured runs of search engines over query sets, as rows, averages and disk use."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import averages, precision_recall
from ..sources.sinks import disk_mb

#: Columns of a run, in order (fixed values).
RUN = "tamano long, tipo string, query string, motor string, latencia double, throughput_qps double, io double, precision double, recall double"
METRICS = ["latencia", "throughput_qps", "io", "precision", "recall"]


#: Bytes of a block of I/O (fixed value).
BLOCK = 8192
COSTS = "query string, motor string, jobs long, tasks long, files long, bytes_read long, rows_read long, shuffle_bytes long, plan string"


class Measure:
    """What the jobs of a block of code read and shuffled, from Spark's own metrics of them.

    All jobs count, those that write tables in between too, as they carry a tag.
    ``bytes_read`` and ``rows_read`` are what tasks read of files, ``files`` what
    the scans of the executed plans opened, each as often as it was scanned.
    """

    def __init__(self, spark: SparkSession):
        self.context, self.tag = spark.sparkContext, f"measure-{uuid.uuid4().hex}"
        self.store = spark._jsparkSession.sharedState().statusStore()
        self.jobs = self.tasks = self.files = self.bytes_read = self.rows_read = self.shuffle_bytes = 0

    def __enter__(self) -> Measure:
        self.context.addJobTag(self.tag)
        self.before = self._last()
        return self

    def _last(self) -> int:
        """The latest SQL execution so far."""
        self.context._jsc.sc().listenerBus().waitUntilEmpty()
        n = int(self.store.executionsCount())
        return self.store.executionsList(n - 1, 1).apply(0).executionId() if n else -1

    def __exit__(self, *failure) -> None:
        self.context.removeJobTag(self.tag)
        core = self.context._jsc.sc()
        n = self._last() - self.before
        jobs, seen = list(core.statusTracker().getJobIdsForTag(self.tag)), set()
        self.jobs = len(jobs)
        for job in jobs:
            for stage in core.statusTracker().getJobInfo(job).get().stageIds():
                if stage not in seen:  # later jobs name stages again that they skip
                    seen.add(stage)
                    data = core.statusStore().lastStageAttempt(stage)
                    self.tasks += data.numCompleteTasks()
                    self.bytes_read += data.inputBytes()
                    self.rows_read += data.inputRecords()
                    self.shuffle_bytes += data.shuffleWriteBytes()
        kept = int(self.store.executionsCount())
        for i in range(max(0, kept - n), kept):
            run = self.store.executionsList(i, 1).apply(0)
            if any(run.jobs().contains(job) for job in jobs):
                values = self.store.executionMetrics(run.executionId())
                metrics = [run.metrics().apply(j) for j in range(run.metrics().size())]
                opened = {m.accumulatorId() for m in metrics if m.name() == "number of files read"}  # a plan that is made anew on the way names them again
                self.files += sum(int(values.apply(m).replace(",", "")) for m in opened if values.contains(m))


def measured(spark: SparkSession, cases: list[tuple[int, str, str, str, Callable[[], DataFrame]]], labels: DataFrame, expected: dict[str, object], k: int = 50, costs: list[tuple] | None = None) -> DataFrame:
    """A row for each case (size, kind, query, engine, search): seconds, queries a second, blocks read, precision and recall at k.

    ``search`` gives the ranked answers (query_id, doc_id, rank) to one query;
    ``labels``: doc_id and label; ``expected``: the label that counts, by query.
    ``io`` counts blocks of 8 KiB that the search's tasks read of files. What each search did in full, with its
    executed plan, is appended to ``costs``, rows for ``costed``. Cases are few,
    each a job of its own, so the loop is over jobs and not rows.
    """
    runs = []
    for size, kind, query, engine, search in cases:
        with Measure(spark) as done:
            began = time.perf_counter()
            answer = search().select("query_id", "doc_id", "rank")
            rows = answer.collect()
            took = time.perf_counter() - began
        if costs is not None:
            plan = answer._jdf.queryExecution().executedPlan().toString()
            costs.append((query, engine, done.jobs, done.tasks, done.files, done.bytes_read, done.rows_read, done.shuffle_bytes, plan))
        ranked = spark.createDataFrame(rows, "query_id long, doc_id long, rank long")
        wanted = spark.createDataFrame([(rows[0].query_id if rows else 0, str(expected.get(query, "")))], "query_id long, label string")
        found = precision_recall(ranked, labels.withColumn("label", F.col("label").cast("string")), wanted, k).first()
        runs.append((size, kind, query, engine, took, 1 / took, float(-(-done.bytes_read // BLOCK)), float(found.precision), float(found.recall)))
    return spark.createDataFrame(runs, RUN)


def costed(spark: SparkSession, costs: list[tuple]) -> DataFrame:
    """Jobs, tasks, files, bytes and rows read, bytes shuffled and the executed plan of each measured search."""
    return spark.createDataFrame(costs, COSTS)


def averaged(runs: DataFrame) -> DataFrame:
    """Means of the runs by size, engine and kind."""
    return averages(runs, ["tamano", "motor", "tipo"], METRICS)


def disk(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """MB of each named folder, a column each, in one row."""
    return spark.createDataFrame([tuple(disk_mb(spark, p) for p in folders.values())], ", ".join(f"{n} double" for n in folders))
