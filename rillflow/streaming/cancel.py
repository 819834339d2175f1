"""Cancellation of a run."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class CancellationToken:
    """A flag that its holders share; it can be reset and used again. Cancelling also stops the running job."""

    def __init__(self):
        self._flag = threading.Event()
        self._lock = threading.Lock()
        self._running: dict[str, SparkSession] = {}

    def cancel(self) -> None:
        self._flag.set()
        with self._lock:
            for group, spark in self._running.items():
                spark.sparkContext.cancelJobGroup(group)

    def is_cancelled(self) -> bool:
        return self._flag.is_set()

    def reset(self) -> None:
        self._flag.clear()

    def unless_cancelled(self, spark: SparkSession, job: Callable[[], list]) -> list | None:
        """What job returns, or None if it was cancelled on the way."""
        group = f"cancellable-{uuid.uuid4().hex}"
        with self._lock:
            self._running[group] = spark
        spark.sparkContext.setJobGroup(group, "cancellable run", interruptOnCancel=True)
        try:
            return None if self.is_cancelled() else job()
        except Exception:
            if self.is_cancelled():
                return None
            raise
        finally:
            with self._lock:
                del self._running[group]
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
