"""What a run is doing: progress and stored blocks as tables, and runs that can be stopped by name.

Pools of workers, their restart and the guard of memory are Spark's own: the scheduler, spark.task.maxFailures and spill.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PROGRESS = "job int, stage int, name string, tasks long, done long, failed long, ratio double"
STORED = "id int, name string, partitions long, cached long, memory_bytes long, disk_bytes long"


def progress(spark: SparkSession, group: str | None = None) -> DataFrame:
    """A row for each stage of the jobs of a group that the driver still knows: tasks, done, failed, ratio (1 for no tasks)."""
    tracker, rows = spark.sparkContext.statusTracker(), []
    for job in sorted(tracker.getJobIdsForGroup(group)):
        info = tracker.getJobInfo(job)
        for stage in sorted(info.stageIds) if info else ():
            if s := tracker.getStageInfo(stage):
                rows.append((job, stage, s.name, s.numTasks, s.numCompletedTasks, s.numFailedTasks, s.numCompletedTasks / s.numTasks if s.numTasks else 1.0))
    return spark.createDataFrame(rows, PROGRESS)


def stored(spark: SparkSession) -> DataFrame:
    """A row for each cached table: partitions, how many are there, bytes in memory and on disk."""
    rows = [(r.id(), r.name(), r.numPartitions(), r.numCachedPartitions(), r.memSize(), r.diskSize()) for r in spark.sparkContext._jsc.sc().getRDDStorageInfo()]
    return spark.createDataFrame(rows, STORED)


@contextmanager
def named(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs started inside carry a name, by which progress finds them and stop ends them."""
    context = spark.sparkContext
    context.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


def stop(spark: SparkSession, name: str) -> None:
    """Ends the running jobs of a name and drops those that wait; their callers get an error."""
    spark.sparkContext.cancelJobGroup(name)
