"""Cancellation of a running action."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Cancelled(Exception):
    pass


def run_cancellable(spark: SparkSession, action: Callable[[], object], should_stop: Callable[[], bool] = lambda: False, every: float = 0.2) -> object:
    """The action's result. Its jobs bear a tag, and are cancelled when should_stop, which is asked again and again, says so."""
    sc, tag, out = spark.sparkContext, f"lattica-{uuid.uuid4().hex}", {}

    def run() -> None:
        sc.addJobTag(tag)
        try:
            out["value"] = action()
        except Exception as e:  # handed on to the caller
            out["error"] = e
        finally:
            sc.removeJobTag(tag)

    thread = threading.Thread(target=inheritable_thread_target(spark)(run), daemon=True)
    thread.start()
    stopped = False
    while thread.is_alive():
        thread.join(every)
        if thread.is_alive() and should_stop():
            stopped = True
            sc.cancelJobsWithTag(tag)
    if stopped and "value" not in out:
        raise Cancelled("the action was cancelled")
    if "error" in out:
        raise out["error"]
    return out["value"]
