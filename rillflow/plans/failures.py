"""Failures of the session or cluster, as against those of a user's stage."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError, Py4JNetworkError
from pyspark.errors import PySparkException, PythonException
from pyspark.sql import SparkSession

#: How Spark begins to tell of a context that is gone.
STOPPED = re.compile(
    r"(?:[\w.]+(?:Exception|Error): )?(?:Job \d+ cancelled because SparkContext was shut down|Cannot call methods on a stopped SparkContext|SparkContext (?:has been shutdown|is stopped)|Master removed our application)"
)
#: How it begins to tell of a task whose executors were lost more often than it may be tried again: a stage's own words come later.
LOST = re.compile(
    r"(?:[\w.]+(?:Exception|Error): )?Job aborted due to stage failure: Task \d+ in stage [\d.]+ failed \d+ times?, most recent failure: Lost task [\d.]+ in stage [\d.]+ \(TID \d+\) \([^)]*\): ExecutorLostFailure"
)
#: Conditions of a session that is no more.
SESSION_GONE = ("NO_ACTIVE_SESSION", "SESSION_CLOSED", "INVALID_HANDLE")


def is_cluster_failure(e: BaseException, spark: SparkSession) -> bool:
    """True for a lost connection, a stopped context and lost executors; never for an exception raised in a stage, whatever it says.

    Spark's conditions and classes decide, and of a message only how it begins.
    """
    if isinstance(e, PythonException):
        return False
    if isinstance(e, (Py4JNetworkError, ConnectionError)) or spark.sparkContext._jsc is None:
        return True
    condition = (e.getCondition() or "") if isinstance(e, PySparkException) else ""
    if condition:
        return condition.startswith(SESSION_GONE)
    told = str(e.java_exception.toString()) if isinstance(e, Py4JJavaError) else str(e)
    return bool(STOPPED.match(told) or LOST.match(told))
