"""Generated points and workloads, reproducible by seed."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_SEED = 20260816
#: Points a bracket's boxes hold, from and to.
BRACKETS = {"small": (1, 100), "medium": (100, 10_000), "large": (10_000, 1_000_000)}


class Seeds:
    """A distinct seed for each call; GRIDLOOM_SEED overrides the first."""

    def __init__(self, seed: int | None = None):
        self.seed, self.calls = seed if seed is not None else int(os.environ.get("GRIDLOOM_SEED", DEFAULT_SEED)), 0

    def __call__(self) -> int:
        self.calls += 1
        return self.seed + 1_000_003 * self.calls


def names(d: int) -> list[str]:
    return ["x", "y", "z"][:d] if d <= 3 else [f"c{i}" for i in range(d)]


def uniform(spark: SparkSession, n: int, d: int = 2, axis_max: int = 10**9, seed: int | None = None) -> DataFrame:
    """Integer points, uniform in a cube from 0 to axis_max."""
    seeds = Seeds(seed)
    return spark.range(n).select("id", *[F.floor(F.rand(seeds()) * (axis_max + 1)).alias(c) for c in names(d)])


def sphere(spark: SparkSession, n: int, d: int = 2, radius: float = 1e9, seed: int | None = None) -> DataFrame:
    """Points in a ball: a direction from the cube, a radius by the d-th root of a uniform number."""
    seeds = Seeds(seed)
    df = spark.range(n).select("id", F.rand(seeds()).alias("_u"), *[(F.rand(seeds()) * 2 - 1).alias(f"_{c}") for c in names(d)])
    length = F.sqrt(sum((F.col(f"_{c}") * F.col(f"_{c}") for c in names(d)), F.lit(0.0)))
    return df.select("id", *[(F.lit(radius) * F.pow("_u", F.lit(1 / d)) * F.col(f"_{c}") / F.greatest(length, F.lit(1e-12))).alias(c) for c in names(d)])


def varden(spark: SparkSession, n: int, d: int = 2, axis_max: int = 10**9, noise: float = 1e-4, seed: int | None = None) -> DataFrame:
    """Clusters of varying density: walkers that restart now and then shed points around them; a little uniform noise.

    About ten clusters; the i-th has radius 100 * (i % 10 + 1). Walks are running sums within a cluster and slice of it, so no task walks alone."""
    seeds = Seeds(seed)
    slices = max(1, n // 1_000_000)
    base = spark.range(n).select("id", (F.rand(seeds()) < noise).alias("_noise"), F.floor(F.rand(seeds()) * 10).alias("_cluster"), (F.col("id") % slices).alias("_slice"))
    centers = spark.range(10 * slices).select((F.col("id") % 10).alias("_cluster"), F.floor(F.col("id") / 10).alias("_slice"), *[(F.rand(seeds()) * axis_max).alias(f"_at_{c}") for c in names(d)])
    walk = W.partitionBy("_cluster", "_slice").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    radius = 100 * (F.col("_cluster") % 10 + 1)
    steps = base.join(centers, ["_cluster", "_slice"]).withColumns({f"_step_{c}": (F.rand(seeds()) * 2 - 1) * radius * 0.1 for c in names(d)})
    at = lambda c: F.col(f"_at_{c}") + F.sum(f"_step_{c}").over(walk) + (F.rand(seeds()) * 2 - 1) * radius
    place = lambda c: F.when(F.col("_noise"), F.rand(seeds()) * axis_max).otherwise(at(c))
    return steps.select("id", *[F.greatest(F.lit(0), F.least(F.lit(axis_max), F.floor(place(c)))).cast("long").alias(c) for c in names(d)])


def boxes(points: DataFrame, coords: Sequence[str], n: int, extent: float, seed: int | None = None) -> DataFrame:
    """(qid, lo_c, hi_c): boxes around n points picked by hash, of random sides up to extent."""
    seeds = Seeds(seed)
    picked = points.select(*coords).orderBy(F.xxhash64(*coords, F.lit(seeds()))).limit(n)
    sides = picked.select(F.monotonically_increasing_id().alias("qid"), *coords, *[F.floor(F.rand(seeds()) * extent / 2).cast("long").alias(f"_h_{c}") for c in coords])
    return sides.select("qid", *[e for c in coords for e in ((F.col(c) - F.col(f"_h_{c}")).alias(f"lo_{c}"), (F.col(c) + F.col(f"_h_{c}")).alias(f"hi_{c}"))])


def subset_boxes(points: DataFrame, coords: Sequence[str], least: int, most: int, seed: int | None = None) -> DataFrame:
    """(qid, lo_c, hi_c, n): tight boxes of subsets of least to most points (a bracket), found by random cuts.

    Every subset that is too large is cut, in turn across each dimension, at the coordinate of a member picked by hash; those
    within the bracket are kept, smaller ones given up. All subsets are cut at once, so the rounds are as many as the deepest needs."""
    seeds = Seeds(seed)
    out, found, level = points.select(*coords, F.lit(1).cast("long").alias("qid")), None, 0
    while True:
        made = [e for c in coords for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
        c = coords[level % len(coords)]
        cells = out.groupBy("qid").agg(*made, F.count(F.lit(1)).alias("n"), F.max_by(c, F.xxhash64(*coords, F.lit(seeds()))).alias("_cut"))
        kept = cells.where(F.col("n").between(least, most)).drop("_cut")
        found = kept if found is None else found.unionByName(kept)
        alike = reduce(and_, (F.col(f"lo_{x}") == F.col(f"hi_{x}") for x in coords))
        large = cells.where((F.col("n") > most) & ~alike).select("qid", "_cut")
        if level >= 62 or large.isEmpty():
            return found
        out = out.join(large, "qid").select(*coords, (F.col("qid") * 2 + (F.col(c) >= F.col("_cut")).cast("long")).alias("qid"))
        level += 1


def box_of_two(a: Sequence[str], b: Sequence[str], coords: Sequence[str]) -> list:
    """Corners of the box of two points given as columns."""
    return [e for p, q, c in zip(a, b, coords, strict=True) for e in (F.least(p, q).alias(f"lo_{c}"), F.greatest(p, q).alias(f"hi_{c}"))]


def sample(points: DataFrame, n: int, *keys: str, seed: int | None = None) -> DataFrame:
    """n rows, the same for a seed whatever the partitions."""
    return points.orderBy(F.xxhash64(*keys, F.lit(Seeds(seed)())), *keys).limit(n)


def knn_queries(points: DataFrame, id: str, n: int, share: float = 0.01, kind: str = "strided") -> DataFrame:
    """Query points of n identified 0 .. n - 1: the first or last share of them, or every so many."""
    k = max(1, int(n * share))
    pick = {"first": F.col(id) < k, "last": F.col(id) >= n - k, "strided": F.col(id) % max(1, n // k) == 0}[kind]
    return points.where(pick)


def diff_workload(points: DataFrame, id: str, coords: Sequence[str], overlap: int) -> DataFrame:
    """Rows to take away: those of id < overlap as they are, the others negated and so absent."""
    keep = F.col(id) < overlap
    return points.select(*[F.when(keep, F.col(c)).otherwise(-F.col(c) - 1).alias(c) for c in (id, *coords)])
