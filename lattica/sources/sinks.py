"""Field sinks. Dense forms are for one slice or a grid whose size the caller bounds; files go through Spark's file systems."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.field import slice_bytes

MAX_DENSE_CELLS = 1 << 26


def dense_field(field: DataFrame, grid: tuple[int, ...]) -> DataFrame:
    """Every cell of the grid, with 0 where the sparse field has none."""
    spark = field.sparkSession
    names = ["ix", "iy", "iz"][: len(grid)]
    n = int(np.prod([int(g) for g in grid]))
    offset, cells = F.col("id"), []
    for name, g in zip(names, grid, strict=True):
        cells.append((offset % g).cast("int").alias(name))
        offset = F.floor(offset / g)
    return spark.range(n).select(*cells).join(field, names, "left").select(*names, F.coalesce("value", F.lit(0.0)).alias("value"))


def to_numpy(field: DataFrame, grid: tuple[int, ...]) -> np.ndarray:
    """Fortran-ordered float32 array on the driver; refused above MAX_DENSE_CELLS cells."""
    if np.prod(grid, dtype=float) > MAX_DENSE_CELLS:
        raise ValueError(f"a dense array of {grid} cells is too large for the driver")
    names = ["ix", "iy", "iz"][: len(grid)]
    out = np.zeros(grid, dtype=np.float32, order="F")
    part = field.select(*names, "value").toPandas()
    out[tuple(part[n].to_numpy() for n in names)] = part["value"].to_numpy()
    return out


def knn_to_numpy(result: DataFrame, k: int, pad: str = "sentinel", queries: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(M, k) distances and ids, queries by qid; missing neighbours hold the sentinels. With the queries, each of them has a row,
    those without a neighbour too. Refused above MAX_DENSE_CELLS values."""
    qids = result.select("qid") if queries is None else queries.select(F.col("id").alias("qid"))
    qids = qids.distinct()
    if qids.count() * k > MAX_DENSE_CELLS:
        raise ValueError("a result of so many neighbours is too large for the driver; write it as a table")
    qids = np.sort(qids.toPandas()["qid"].to_numpy())
    part = result.filter(F.col("rank") <= k).toPandas()
    row = np.searchsorted(qids, part["qid"].to_numpy())
    dist = np.full((len(qids), k), np.sqrt(np.float32(np.finfo(np.float32).max)) if pad == "sentinel" else np.nan, dtype=np.float32)
    ids = np.full((len(qids), k), np.iinfo(np.uint32).max, dtype=np.uint32)
    rank = part["rank"].to_numpy() - 1
    dist[row, rank], ids[row, rank] = part["dist"], part["id"]
    return dist, ids


def png_bytes(pixels: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG; rows of the array are rows of the image."""
    height, width = pixels.shape
    raw = b"".join(b"\0" + pixels[i].astype(np.uint8).tobytes() for i in range(height))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """The pixels of an image that png_bytes made."""
    width, height = struct.unpack(">II", data[16:24])
    size = struct.unpack(">I", data[33:37])[0]
    raw = np.frombuffer(zlib.decompress(data[41 : 41 + size]), dtype=np.uint8).reshape(height, width + 1)
    return raw[:, 1:]


def png_of(field2d: DataFrame, grid: tuple[int, int]) -> bytes:
    """One slice as an image, its values rescaled to its own range; columns are ix, rows iy."""
    if np.prod(grid, dtype=float) > MAX_DENSE_CELLS:
        raise ValueError(f"an image of {grid} pixels is too large for the driver")
    rows = slice_bytes(dense_field(field2d, grid)).toPandas()
    pixels = np.zeros(grid, dtype=np.uint8)
    pixels[rows["ix"], rows["iy"]] = rows["pixel"].fillna(0)
    return png_bytes(pixels.T)


def write_bytes(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """One file in any store that Spark can write to, part by part."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()


def write_png(field2d: DataFrame, grid: tuple[int, int], path: str) -> None:
    write_bytes(field2d.sparkSession, path, [png_of(field2d, grid)])


def write_raw_float32(field: DataFrame, grid: tuple[int, ...], path: str) -> None:
    write_bytes(field.sparkSession, path, [to_numpy(field, grid).tobytes(order="F")])


def write_records(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Headerless float32 records in one file. Tasks make the records; they pass through the driver a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw], type=pa.binary())], names=["raw"])

    chunks = df.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(run, "raw binary")
    write_bytes(df.sparkSession, path, (r.raw for r in chunks.toLocalIterator()))
