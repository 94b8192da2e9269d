"""Tables in the folder that all executors share, and plan helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources.scratch import cleaned, discard, folder, written

__all__ = ["SMALL_SIDE", "bitmap", "cleaned", "column_or_null", "discard", "folder", "id_and_text", "parallelism", "small", "struct", "written"]

#: Bytes up to which a looked-up side is broadcast.
SMALL_SIDE = 32 << 20


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column_or_null(df: DataFrame, name: str, kind: str):
    """The column, or null of that type where a table lacks it."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def id_and_text(docs: DataFrame, id_col: str, text_col: str, as_id: str = "doc_id", as_text: str = "text") -> DataFrame:
    """Only these two, under fixed names: other columns, whatever their names, stay out of an operator's way."""
    return docs.select(column_or_null(docs, id_col, "long").alias(as_id), column_or_null(docs, text_col, "string").alias(as_text))


def small(df: DataFrame, size, limit: int = SMALL_SIDE) -> DataFrame:
    """The side of a join, broadcast if its measured bytes (`size` in a row, and 64) allow."""
    return F.broadcast(df) if (df.agg(F.sum(size + F.lit(64))).first()[0] or 0) <= limit else df


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value of a column of hashes, by its low bits, packed: collected in blocks of a fixed total size."""
    block = min(bits, 1 << 18)

    def run(table: pa.Table) -> pa.Table:
        out = np.zeros(block, dtype=bool)
        out[table.column("bit").to_numpy()] = True
        return pa.table({"slot": table.column("slot").slice(0, 1), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], type=pa.binary())})

    spot = F.col(column).bitwiseAND(bits - 1)
    # distinct spots are at most `bits`, and a block's at most 2 ** 18
    spots = rows.select(F.floor(spot / block).cast("long").alias("slot"), spot.bitwiseAND(block - 1).alias("bit")).distinct()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for slot, raw in spots.groupBy("slot").applyInArrow(run, "slot long, bits binary").collect():
        out[slot * block // 8 : (slot + 1) * block // 8] = np.frombuffer(raw, dtype=np.uint8)
    return out


def struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
