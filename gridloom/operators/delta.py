"""Differences between two snapshots of identified points, and their merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.curves import encode
from gridloom.functions.geometry import cols
from gridloom.operators.keyed import ranked


def _both(old: DataFrame, new: DataFrame, id: str, coords: Sequence[str]) -> DataFrame:
    a, b = (d.select(F.col(id), F.struct(*coords).alias(n)) for d, n in ((old, "_a"), (new, "_b")))
    return a.join(b, id, "full")


def diff_by_id(old: DataFrame, new: DataFrame, id: str, coords: Sequence[str]) -> DataFrame:
    """(id, coords, kind): removed and added rows; a moved point is in both."""
    both = _both(old, new, id, coords).where(~F.col("_a").eqNullSafe(F.col("_b")))
    sides = F.array(F.struct(F.lit("removed").alias("kind"), F.col("_a").alias("p")), F.struct(F.lit("added").alias("kind"), F.col("_b").alias("p")))
    out = both.select(id, F.explode(sides).alias("s")).where("s.p is not null")
    return out.select(id, *[F.col("s")["p"][c].alias(c) for c in coords], F.col("s.kind").alias("kind"))


def classify(old: DataFrame, new: DataFrame, id: str, coords: Sequence[str]) -> DataFrame:
    """(id, kind): insert, delete or update of every id that differs."""
    both = _both(old, new, id, coords).where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(id, F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").otherwise("update").alias("kind"))


def merge(a: DataFrame, b: DataFrame, id: str, coords: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without conflict, conflicts with both sides' coordinates as a_c and b_c)."""
    both = _both(a, b, id, coords)
    clash = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))
    calm = both.where(~F.coalesce(clash, F.lit(False))).select(id, *[F.coalesce(F.col("_a")[c], F.col("_b")[c]).alias(c) for c in coords])
    return calm, both.where(clash).select(id, *[F.col("_a")[c].alias(f"a_{c}") for c in coords], *[F.col("_b")[c].alias(f"b_{c}") for c in coords])


def apply(points: DataFrame, deleted: DataFrame, inserted: DataFrame, id: str) -> DataFrame:
    return points.join(deleted.select(id), id, "left_anti").unionByName(inserted.select(*points.columns))


def repeated_ids(points: DataFrame, id: str) -> DataFrame:
    """How many ids occur more than once, and how many rows there are."""
    n = points.groupBy(id).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("n_repeated"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def repeated_codes(points: DataFrame, coords: Sequence[str], curve: str = "morton") -> DataFrame:
    n = points.select(encode(curve, cols(coords)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("n_repeated"))


def split_workload(batch: DataFrame, id: str, bias: int, share: float = 0.1, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(inserts with ids moved by bias, deletes): the first share of the rows by order, and the rest."""
    place = ranked(batch, [order, id] if order and order != id else [id], "_place")
    first = F.col("_place") < int(batch.count() * share)
    return place.where(first).drop("_place").withColumn(id, F.col(id) + bias), place.where(~first).drop("_place")


def merge_ordered(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Two lists in order as one: a range partitioning, so that no task holds both."""
    return a.unionByName(b).repartitionByRange(*key).sortWithinPartitions(*key)
