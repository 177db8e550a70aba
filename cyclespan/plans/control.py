"""Run control: timeouts, statuses, timings, progress."""

from __future__ import annotations

import sys
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession

COMPLETED, SKIPPED, BY_FLAG = "completed", "skipped_timeout_or_resource_limit", "skipped_by_flag"
#: Parts of messages of errors that stop one query but not the run.
_LIMITS = ("cancel", "interrupt", "timeout", "timed out", "outofmemory", "memory limit", "exceeded")


def log_line(message: str) -> None:
    print(f"[{time.strftime('%H:%M:%S')}] {message}", file=sys.stderr, flush=True)


@contextmanager
def time_limit(spark: SparkSession, seconds: float):
    """Jobs that this thread starts inside are cancelled after so many seconds; 0: never. They carry a tag of their own, so no other run is touched."""
    if seconds <= 0:
        yield
        return
    sc, over, tag = spark.sparkContext, threading.Event(), f"limit-{uuid.uuid4().hex[:12]}"

    def watch():
        until = time.monotonic() + seconds
        while not over.wait(max(0.2, until - time.monotonic())):
            sc.cancelJobsWithTag(tag)

    sc.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        yield
    finally:
        over.set()
        sc.removeJobTag(tag)


@contextmanager
def heartbeat(spark: SparkSession, what: str, interval: float = 30.0, say: Callable[[str], None] = log_line):
    """A line every interval seconds, with the tasks at work; 0: none."""
    done, began = threading.Event(), time.perf_counter()

    def beat():
        while not done.wait(interval):
            tracker = spark.sparkContext.statusTracker()
            stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
            say(f"{what}: {time.perf_counter() - began:.0f} s, {sum(s.numActiveTasks for s in stages if s)} tasks at work")

    if interval > 0:
        threading.Thread(target=beat, daemon=True).start()
    try:
        yield
    finally:
        done.set()


def guarded(spark: SparkSession, action: Callable[[], Any], seconds: float = 0.0, skip: bool = False) -> dict[str, Any]:
    """{status, elapsed_ms, result, error} of an action; limits make a status, other errors are raised."""
    if skip:
        return {"status": BY_FLAG, "elapsed_ms": 0.0, "result": None, "error": None}
    began = time.perf_counter()
    spent = lambda: round((time.perf_counter() - began) * 1000, 3)
    try:
        with time_limit(spark, seconds):
            result = action()
        return {"status": COMPLETED, "elapsed_ms": spent(), "result": result, "error": None}
    except Exception as e:
        if not any(x in str(e).lower() for x in _LIMITS):
            raise
        return {"status": SKIPPED, "elapsed_ms": spent(), "result": None, "error": str(e)[:500]}


def plan_text(df) -> str:
    """The physical plan, without running it: a dry run."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
