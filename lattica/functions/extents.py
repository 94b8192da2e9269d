"""Grid extents and periods: an int or a tuple; a bool, a number or a tuple."""

from __future__ import annotations

from collections.abc import Sequence


def extent(value: int | Sequence[int], dims: int) -> tuple[int, ...]:
    out = (int(value),) * dims if isinstance(value, int) else tuple(int(v) for v in value)
    if len(out) != dims or min(out) <= 0:
        raise ValueError(f"expected {dims} positive sizes, got {value!r}")
    return out


def period(deduced: Sequence[float], value: bool | float | Sequence[float]) -> tuple[float, float, float]:
    """Sides of the periodic box; an axis with a side <= 0 isn't periodic."""
    if value is True:
        return tuple(map(float, deduced))
    if value is False:
        return (-1.0, -1.0, -1.0)
    if isinstance(value, (int, float)):
        return (float(value),) * 3
    sides = tuple(map(float, value))
    if len(sides) == 2:
        return (*sides, -1.0)
    if len(sides) != 3:
        raise ValueError(f"a period has 2 or 3 sides, got {value!r}")
    return sides
