"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths written by this process and not yet discarded, with the session that wrote each.
_MADE: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset, as in tests on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def path(spark: SparkSession) -> str:
    """A new path in the shared folder, known to `clean`."""
    out = f"{folder(spark)}/lattica-{uuid.uuid4().hex}"
    _MADE[out] = spark
    return out


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: lineage ends here, and a lost executor
    costs no more than the tasks it ran. Rows that depend on a task's own state are fixed from here on."""
    to = path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(to)
    out = df.sparkSession.read.schema(df.schema).parquet(to)
    out._scratch = to
    return out


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a path of any store that Spark can write to."""
    _MADE.pop(at, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave, once nothing reads them any more; others are left alone."""
    for df in tables:
        if at := getattr(df, "_scratch", None):
            remove(df.sparkSession, at)


@contextlib.contextmanager
def cleaned(keep: list[DataFrame] | None = None) -> Iterator[None]:
    """Deletes what was written inside when it ends, but for the tables that are in `keep` by then."""
    before = set(_MADE)
    try:
        yield
    finally:
        spared = {getattr(df, "_scratch", None) for df in keep or []}
        for at, spark in list(_MADE.items()):
            if at not in before and at not in spared:
                remove(spark, at)


def clean() -> None:
    """Deletes all that this process has written and not discarded."""
    for at, spark in list(_MADE.items()):
        with contextlib.suppress(Exception):  # the session may have ended, and its folder with it
            remove(spark, at)


atexit.register(clean)
