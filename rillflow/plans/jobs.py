"""Independent jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from threading import Semaphore

from pyspark import InheritableThread, SparkContext


def together(*jobs: Callable[[], object], at_once: int | None = None, pools: Sequence[str] | None = None) -> list:
    """Run jobs at the same time, each from a thread of the driver, and return their results in order.

    at_once: how many run at a time, the others wait; all of them by default. pools: a scheduler pool for each job, or one after the
    other in turn; in a session with the fair scheduler, pools share cores as they are weighted there. All jobs run to their end; the
    failure of the first job in order is raised then.
    """
    results: list = [None] * len(jobs)
    failures: dict[int, BaseException] = {}
    free = Semaphore(at_once or max(1, len(jobs)))
    context = SparkContext._active_spark_context

    def run(k: int) -> None:
        with free:
            if pools and context is not None:
                context.setLocalProperty("spark.scheduler.pool", pools[k % len(pools)])
            try:
                results[k] = jobs[k]()
            except BaseException as e:  # noqa: BLE001  raised again below
                failures[k] = e

    threads = [InheritableThread(target=run, args=(k,)) for k in range(len(jobs))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failures:
        raise failures[min(failures)]
    return results
