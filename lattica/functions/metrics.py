"""Distance metrics as Column builders. Arithmetic is DOUBLE, summed as (x + y) + z, so results are reproducible in SQL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def _sum(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


@dataclass(frozen=True)
class L2:
    """Plain Euclidean distance."""

    box: float = 0.0

    @property
    def periodic(self) -> bool:
        return False

    def wrap(self, c: Column) -> Column:
        return c

    def axis2(self, a: Column, b: Column) -> Column:
        d = a - b
        return d * d

    def dist2(self, a: Sequence[Column], b: Sequence[Column]) -> Column:
        return _sum([self.axis2(x, y) for x, y in zip(a, b, strict=True)])

    def axis_box_min(self, p: Column, lo: Column, hi: Column) -> Column:
        return F.greatest(lo - p, F.lit(0.0)) + F.greatest(p - hi, F.lit(0.0))

    def axis_box_max(self, p: Column, lo: Column, hi: Column) -> Column:
        return F.greatest(F.abs(p - lo), F.abs(p - hi))

    def box_min2(self, p: Sequence[Column], lo: Sequence[Column], hi: Sequence[Column]) -> Column:
        """Smallest squared distance from a point to an axis-parallel box."""
        return _sum([(d := self.axis_box_min(a, b, c)) * d for a, b, c in zip(p, lo, hi, strict=True)])

    def box_max2(self, p: Sequence[Column], lo: Sequence[Column], hi: Sequence[Column]) -> Column:
        """Upper bound of the squared distance from a point to anything in the box."""
        return _sum([(d := self.axis_box_max(a, b, c)) * d for a, b, c in zip(p, lo, hi, strict=True)])


@dataclass(frozen=True)
class PeriodicL2(L2):
    """Euclidean distance in a cube of side ``box`` whose opposite faces meet."""

    box: float = 1.0

    def __post_init__(self) -> None:
        if not self.box > 0:
            raise ValueError("box must be positive")

    @property
    def periodic(self) -> bool:
        return True

    def wrap(self, c: Column) -> Column:
        """Positions inside the box are left bit for bit as they are."""
        side = F.lit(float(self.box))
        return F.when((c >= 0) & (c <= side), c).otherwise(F.pmod(c, side))

    def axis2(self, a: Column, b: Column) -> Column:
        d, side = a - b, F.lit(float(self.box))
        return F.least(d * d, (d + side) * (d + side), (d - side) * (d - side))

    def axis_box_min(self, p: Column, lo: Column, hi: Column) -> Column:
        side = F.lit(float(self.box))
        return (
            F.when(p < lo, F.least(lo - p, p + side - hi))
            .when(p > hi, F.least(p - hi, lo + side - p))
            .otherwise(F.lit(0.0))
        )

    def axis_box_max(self, p: Column, lo: Column, hi: Column) -> Column:
        return F.least(super().axis_box_max(p, lo, hi), F.lit(self.box / 2))


def metric_for(boxsize: float | None) -> L2:
    return L2() if boxsize is None or boxsize <= 0 else PeriodicL2(float(boxsize))
