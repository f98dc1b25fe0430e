"""Tables on all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: bytes, as Spark estimates a plan's size
MOST_SPREAD = 64 << 20
#: bytes of a task of a larger table; tasks of up to twice as much stay as they are
A_TASK = 16 << 20


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt out to the cores if it has at most MOST_SPREAD bytes, or if its tasks have more than 2 * A_TASK.

    A small file is one row group and so one task, however many cores wait; a large one is read in tasks that grow with it,
    to 128 MB, and a few of them end long after the others.  What is read in small tasks, what doesn't come from
    files, what was shuffled before and streams stay as they are.
    """
    if docs.isStreaming:
        return docs
    run = docs._jdf.queryExecution()
    size = int(str(run.optimizedPlan().stats().sizeInBytes()))
    if size <= MOST_SPREAD:
        return docs.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    plan = run.executedPlan().toString()
    if "FileScan" not in plan or "Exchange" in plan or size <= 2 * A_TASK * run.toRdd().getNumPartitions():
        return docs
    return docs.repartition(-(-size // A_TASK))
