"""Cleaning of raw coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INT32_MAX = 2**31 - 1


def round_down(points: DataFrame, coords: Sequence[str], factor: float = 1) -> DataFrame:
    return points.withColumns({c: F.floor(F.col(c) * factor).cast("long") for c in coords})


def dedup(points: DataFrame, coords: Sequence[str], id: str | None = None) -> DataFrame:
    """One row for each place: that of the smallest id. Minima combine before the shuffle."""
    if id is None:
        return points.select(*coords).distinct()
    return points.groupBy(*coords).agg(F.min(id).alias(id)).select(id, *coords)


def shift_to_origin(points: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Coordinates less their minima; other columns go. The minima are one row, joined to all."""
    low = points.agg(*[F.min(c).alias(f"_lo_{c}") for c in coords])
    return points.select(*coords).join(F.broadcast(low)).select(*[(F.col(c) - F.col(f"_lo_{c}")).alias(c) for c in coords])


def in_range(points: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Whether all coordinates lie in 0 .. 2**31 - 1."""
    return points.agg(F.coalesce(F.bool_and(reduce(and_, (F.col(c).between(0, INT32_MAX) for c in coords))), F.lit(True)).alias("ok"))


def wash(points: DataFrame, coords: Sequence[str], factor: float = 1) -> DataFrame:
    """Round, keep one of each place, move to the origin, and raise if a coordinate is out of range."""
    out = shift_to_origin(dedup(round_down(points, coords, factor), coords), coords)
    if not in_range(out, coords).first().ok:
        raise ValueError("coordinates exceed 2**31 - 1")
    return out


def sweepline(points: DataFrame, coord: str, *ties: str) -> DataFrame:
    return points.orderBy(coord, *ties)
