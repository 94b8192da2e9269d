"""Order statistics and partitions of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that are sorted in one task at most, unless they are alike.
SORTED = 100_000


def _narrowed(rows: DataFrame, column: str, k: int, limit: int) -> tuple[DataFrame, int, int]:
    """Rows among which the one at position k is, its position there, and how many there are: at most `limit`, or all of one
    value. Every round keeps the values between two approximate quantiles around k."""
    c, n = F.col(column), rows.count()
    while n > limit:
        eps = 1e-3
        low, high = rows.stat.approxQuantile(column, [max(0.0, k / n - 2 * eps), min(1.0, k / n + 2 * eps)], eps)
        below, at_low, inside, at_high = rows.agg(F.count_if(c < low), F.count_if(c == low), F.count_if((c > low) & (c < high)), F.count_if(c == high)).first()
        if low == high:
            at_high = 0
        # the four parts that the values fall into, each with where it begins
        parts = [(c < low, 0, below), (c == low, below, at_low), ((c > low) & (c < high), below + at_low, inside), (c == high, below + at_low + inside, at_high)]
        parts.append((c > high, sum(p[2] for p in parts), n - sum(p[2] for p in parts)))
        where, begin, m = next(p for p in parts if p[1] <= k < p[1] + p[2])
        rows, k, n = rows.filter(where), k - begin, m
        if where is parts[1][0] or where is parts[3][0]:
            break
    return rows, k, n


def order_statistic(df: DataFrame, column: str, k: int, carry: tuple[str, ...] = (), limit: int = SORTED) -> DataFrame:
    """The row that a sort by (column, carry...) has at position k (from 0), rows without a value left out.

    Counts between approximate quantiles narrow the table, by one column after another where rows are tied, until few enough
    rows are left to sort. Rows alike in all columns aren't sorted.
    """
    rows = df.select(column, *carry).filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    n = rows.count()
    if not 0 <= k < n:
        raise ValueError(f"k must be in [0, {n})")
    kinds = dict(rows.dtypes)
    for c in (column, *carry):
        if n <= limit or kinds[c] not in ("double", "float", "int", "bigint", "smallint", "tinyint"):
            break
        if c != column:  # rows without a value come first
            blank = rows.filter(F.col(c).isNull()).count()
            if k < blank:
                rows, n = rows.filter(F.col(c).isNull()), blank
                continue
            rows, k, n = rows.filter(F.col(c).isNotNull()), k - blank, n - blank
        rows, k, n = _narrowed(rows, c, k, limit)
    else:
        if n > limit:
            return rows.limit(1)
    return rows.orderBy(column, *carry).limit(k + 1).orderBy(F.desc(column), *(F.desc(x) for x in carry)).limit(1)


def partition_pivot(df: DataFrame, column: str, pivot: float) -> DataFrame:
    """side 0: below the pivot; side 1: the rest."""
    return df.withColumn("side", (F.col(column) >= F.lit(pivot)).cast("int"))


def partition_counts(df: DataFrame, column: str, pivot: float) -> DataFrame:
    return df.agg(F.count_if(F.col(column) < pivot).alias("split"), F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))


def top_k_smallest(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.orderBy(column).limit(k)
