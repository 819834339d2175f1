"""Options of a pipeline and what they mean for a Spark job."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum


class Workload(Enum):
    """BALANCED keeps the partitions of the input. SPREAD deals rows out where the input has fewer partitions than there are cores,
    as one small file has, and keeps it where it is otherwise. UNBALANCED deals rows out into more and smaller tasks."""

    BALANCED = 1
    SPREAD = 2
    UNBALANCED = 8


@dataclass(frozen=True)
class PipelineConfig:
    """Immutable; each with_* returns a changed copy. None leaves the choice to Spark."""

    compute_workers: int | None = None  # number of tasks that rows are dealt to
    async_workers: int | None = None  # event loops; a Python worker runs one, so this bounds tasks of async stages
    buffer_size: int | None = None  # rows that a Python stage takes and gives back at a time
    io_concurrency: int = 128  # async calls in flight at once, over all tasks of a stage; fewer than tasks: that many tasks
    oversubscribe: int = 1  # threads of a task that run a blocking Python stage
    workload: Workload = Workload.BALANCED
    profile: object = None  # a ResourceProfile of Python and asynchronous stages: cores and memory of the executors they run on
    cost: object = None  # what an item costs, as SQL text or a Column: tasks get nearly equal sums of it

    def __post_init__(self):
        for name in ("buffer_size", "io_concurrency", "oversubscribe"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    def with_compute_workers(self, n: int) -> PipelineConfig:
        return replace(self, compute_workers=max(1, n))

    def with_async_workers(self, n: int) -> PipelineConfig:
        return replace(self, async_workers=max(1, n))

    def with_buffer_size(self, n: int) -> PipelineConfig:
        return replace(self, buffer_size=n)

    def with_io_concurrency(self, n: int) -> PipelineConfig:
        return replace(self, io_concurrency=n)

    def with_oversubscribe(self, factor: int) -> PipelineConfig:
        return replace(self, oversubscribe=max(1, factor))

    def with_profile(self, profile: object) -> PipelineConfig:
        return replace(self, profile=profile)

    def with_cost(self, cost: object) -> PipelineConfig:
        return replace(self, cost=cost)

    def with_workload(self, workload: Workload) -> PipelineConfig:
        return replace(self, workload=workload)
