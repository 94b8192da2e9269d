"""Point and particle sources: frames, random points, headerless float32 files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.metrics import AXES

_NUMERIC = (T.NumericType,)


def check_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fails at analysis time when a column is missing or isn't numeric."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    for c in columns:
        if c not in fields:
            raise ValueError(f"column {c!r} is missing")
        if not isinstance(fields[c], _NUMERIC):
            raise ValueError(f"column {c!r} isn't numeric")
    return df


def points(df: DataFrame, id_col: str = "id", columns: Sequence[str] = AXES, precision: str = "double") -> DataFrame:
    """id, x, y, z as DOUBLE; rows without a position are left out. precision="float32" rounds positions first."""
    if len(columns) != 3:
        raise ValueError("positions have three columns")
    check_columns(df, [id_col, *columns])
    kind = {"double": "double", "float32": "float"}[precision]
    out = df.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast(kind).cast("double").alias(a) for c, a in zip(columns, AXES, strict=True)))
    return out.dropna(subset=list(AXES))


def points_from_array(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """Points whose position is a column of three-element arrays."""
    return points(df.select(F.col(id_col).alias("id"), *(F.col(array_col)[i].alias(a) for i, a in enumerate(AXES))))


def points_from_numpy(spark: SparkSession, positions: np.ndarray) -> DataFrame:
    """An (N, 3) array; ids are 0..N-1."""
    if positions.ndim != 2 or positions.shape[1] != 3:
        raise ValueError("positions must be of shape (N, 3)")
    import pandas as pd

    frame = pd.DataFrame(np.asarray(positions, dtype=np.float64), columns=list(AXES))
    frame.insert(0, "id", np.arange(len(frame), dtype=np.int64))
    return spark.createDataFrame(frame, "id long, x double, y double, z double")


def particles(df: DataFrame, columns: Sequence[str] = ("x", "y", "z", "weight", "radius")) -> DataFrame:
    check_columns(df, columns)
    return df.select(*(F.col(c).cast("double").alias(a) for c, a in zip(columns, ("x", "y", "z", "weight", "radius"), strict=True))).dropna()


def particles_from(positions: DataFrame, weights: DataFrame, radii: DataFrame, id_col: str = "id") -> DataFrame:
    """Particles whose positions(id, x, y, z), weights(id, weight) and radii(id, radius) are tables of their own, met by id. Each
    must have the same ids, each once."""
    tables = [check_columns(positions, [id_col, *AXES]).select(id_col, *AXES), check_columns(weights, [id_col, "weight"]).select(id_col, "weight"), check_columns(radii, [id_col, "radius"]).select(id_col, "radius")]
    joined = tables[0].join(tables[1], id_col).join(tables[2], id_col)
    if len({joined.count(), *(t.count() for t in tables)}) > 1:
        raise ValueError("positions, weights and radii must have the same ids, each once")
    return particles(joined)


def random_points(spark: SparkSession, n: int, seed: int = 42, box: float = 1.0) -> DataFrame:
    """n points, uniform over a cube; the same for the same seed and number of partitions."""
    return spark.range(n).select("id", *(F.expr(f"rand({seed + i}) * {float(box)}D").alias(a) for i, a in enumerate(AXES)))


def single_sphere(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 0.5D AS x, 0.5D AS y, 0.5D AS z, 1.0D AS weight, 0.25D AS radius")


def _records(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Headerless float32 records. Files are split by record, so one large file is read by many tasks."""
    width = 4 * len(names)

    def packed(rows):
        while part := list(islice(rows, 1 << 16)):
            yield (b"".join(part),)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                values = np.frombuffer(raw, dtype="<f4").reshape(-1, len(names)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(names))], names=list(names))

    chunks = spark.createDataFrame(spark.sparkContext.binaryRecords(path, width).mapPartitions(packed), "raw binary")
    return chunks.mapInArrow(decode, T.StructType([T.StructField(n, T.DoubleType()) for n in names]))


def read_points_binary(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path, AXES)


def read_particles_binary(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path, (*AXES, "weight", "radius"))
