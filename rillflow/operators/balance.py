"""Rows dealt to tasks by what they cost."""

from __future__ import annotations

from heapq import heapify, heapreplace
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of the histogram for each task; an item that costs more than the average bin is dealt by itself.
BINS = 16
#: Tasks for each core, and how far the dearest task may lie above the median before rows are dealt anew.
TASKS_EACH, UNEVEN = 4, 1.5


def dealt(weights: list[float], tasks: int) -> list[int]:
    """A task for each weight: the heaviest first, each to the task that has least so far."""
    loads = [(0.0, k) for k in range(tasks)]
    heapify(loads)
    out = [0] * len(weights)
    for k in sorted(range(len(weights)), key=lambda k: (-weights[k], k)):
        load, task = loads[0]
        heapreplace(loads, (load + weights[k], task))
        out[k] = task
    return out


def balanced(df: DataFrame, cost: Column | str, seq: str, tasks: int | None = None) -> DataFrame:
    """df in tasks of nearly equal total cost. cost: an estimate for an item, any number; null and negative ones are nothing.

    Costs are first added up by the partitions that df has: where these are even and enough for all cores, rows stay where
    they are. Otherwise rows are dealt by a hash of their index: costs are added up for BINS bins a task, in part before
    the shuffle, and bins, and one by one the items dearer than an average bin, go to tasks, the heaviest first. No more
    than BINS * tasks numbers of either kind reach the driver, by arithmetic. Only an item that costs more than a task's
    share makes a longer task, which holds nothing else. df is read twice more, for its costs alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tasks = tasks or TASKS_EACH * cores
    weight = F.greatest(F.coalesce((cost if isinstance(cost, Column) else F.expr(cost)).cast("double"), F.lit(0.0)), F.lit(0.0))
    costs = df.select(F.col(seq).alias("_item"), weight.alias("_cost"))
    parts = [r["c"] for r in costs.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("_cost").alias("c")).collect()]  # one row for each partition
    total = sum(parts)
    if total == 0 or (len(parts) >= cores and max(parts) <= UNEVEN * median(parts)):
        return df
    bins = BINS * tasks
    at = F.pmod(F.xxhash64(F.col(seq)), F.lit(bins)).cast("int")
    dear = F.col("_cost") * bins > total
    alone = costs.filter(dear).collect()
    small = {r["b"]: r["c"] for r in costs.filter(~dear).groupBy(F.pmod(F.xxhash64("_item"), F.lit(bins)).cast("int").alias("b")).agg(F.sum("_cost").alias("c")).collect()}
    goes = dealt([r["_cost"] for r in alone] + [small.get(b, 0.0) for b in range(bins)], tasks)
    of_items = spark.createDataFrame([(r["_item"], k) for r, k in zip(alone, goes)], "_item long, _own int")
    of_bins = spark.createDataFrame(list(enumerate(goes[len(alone) :])), "_bin int, _shared int")
    columns = [df[c] for c in df.columns]
    out = df.select(*columns, F.col(seq).alias("_item"), at.alias("_bin")).join(F.broadcast(of_items), "_item", "left").join(F.broadcast(of_bins), "_bin", "left")
    return out.repartitionById(tasks, F.coalesce("_own", "_shared")).select(*df.columns)
