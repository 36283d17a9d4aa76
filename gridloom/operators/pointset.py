"""Point sets: a DataFrame with named coordinate columns and the queries and updates on it.

A point set is a bag: equal points are kept and counted. It is never changed; an update
returns a new one. With an id column the set is keyed: ids are distinct, deletes match id
and coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import geometry as G

Number = int | float


@dataclass(frozen=True)
class Box:
    """A closed box; empty if lo exceeds hi in some dimension."""

    lo: tuple[Number, ...]
    hi: tuple[Number, ...]

    def __post_init__(self):
        if len(self.lo) != len(self.hi):
            raise ValueError("corners of a box have one dimension")

    @property
    def empty(self) -> bool:
        return any(a > b for a, b in zip(self.lo, self.hi, strict=True))


@dataclass(frozen=True)
class PointSet:
    df: DataFrame
    coords: tuple[str, ...]
    id: str | None = None
    #: A pinned bounding box; inserts outside raise.
    pinned: Box | None = None

    @classmethod
    def build(cls, df: DataFrame, coords: Sequence[str], id: str | None = None, bounds: Box | None = None, check: bool = True) -> PointSet:
        """Widens coordinates to BIGINT or DOUBLE. check: reject null coordinates, repeated ids and points outside `bounds`."""
        fields = {f.name: f.dataType for f in df.schema.fields}
        for c in (*coords, *([id] if id else [])):
            if c not in fields:
                raise ValueError(f"no column {c}")
        if not coords:
            raise ValueError("a point has coordinates")
        wide = []
        for c in coords:
            t = fields[c]
            if isinstance(t, T.IntegralType):
                wide.append(F.col(c).cast("long").alias(c))
            elif isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType):
                wide.append(F.col(c).cast("double").alias(c))
            else:
                raise ValueError(f"coordinate {c} is {t.simpleString()}, not a number")
        rest = [F.col(c) for c in df.columns if c not in coords and c != id]
        out = cls(df.select(*([F.col(id)] if id else []), *wide, *rest), tuple(coords), id, bounds)
        if check:
            out._reject(out.df)
            if id:
                out._reject_repeated(out.df)
        return out

    def _reject(self, df: DataFrame) -> None:
        bad = reduce(or_, (F.col(c).isNull() for c in self.coords))
        if self.pinned is not None:
            bad = bad | ~G.in_box(G.cols(self.coords), G.lits(self.pinned.lo), G.lits(self.pinned.hi))
        if df.where(bad).limit(1).count():
            raise ValueError("a point has a null coordinate or lies outside the pinned bounds")

    def _reject_repeated(self, df: DataFrame) -> None:
        if df.groupBy(self.id).count().where(F.col("count") > 1).limit(1).count():
            raise ValueError(f"ids in {self.id} are not distinct")

    @property
    def _key(self) -> list[str]:
        return ([self.id] if self.id else []) + list(self.coords)

    def _with(self, df: DataFrame) -> PointSet:
        return replace(self, df=df)

    def _in(self, box: Box):
        if len(box.lo) != len(self.coords):
            raise ValueError("box and points differ in dimensions")
        return G.in_box(G.cols(self.coords), G.lits(box.lo), G.lits(box.hi))

    def _d2(self, q: Sequence[Number]):
        return G.d2(G.cols(self.coords), G.lits(q))

    # Queries

    def range_count(self, box: Box) -> DataFrame:
        return self.df.where(self._in(box)).agg(F.count(F.lit(1)).alias("n"))

    def range_query(self, box: Box, limit: int | None = None) -> DataFrame:
        out = self.df.where(self._in(box))
        return out if limit is None else out.limit(limit)

    def radius_count(self, center: Sequence[Number], radius: Number) -> DataFrame:
        """Points within radius; the box around the circle reaches the scan as a filter."""
        box = Box(tuple(c - radius for c in center), tuple(c + radius for c in center))
        return self.df.where(self._in(box) & (self._d2(center) <= radius * radius)).agg(F.count(F.lit(1)).alias("n"))

    def knn(self, q: Sequence[Number], k: int) -> DataFrame:
        """The min(k, n) nearest points with `d2`, ties by id or coordinates. A stored q is its own neighbour."""
        out = self.df.select(*self._key, self._d2(q).alias("d2"))
        return out.orderBy("d2", *self._key).limit(k)

    def knn_distance(self, q: Sequence[Number], k: int) -> DataFrame:
        return self.knn(q, k).agg(F.max("d2").alias("d2"))

    def count(self, p: Sequence[Number]) -> DataFrame:
        """How many points have these coordinates, whatever their ids."""
        return self.df.where(G.same_point(G.cols(self.coords), G.lits(p))).agg(F.count(F.lit(1)).alias("n"))

    def contains(self, p: Sequence[Number]) -> DataFrame:
        return self.count(p).select((F.col("n") > 0).alias("found"))

    def count_each(self, probes: DataFrame) -> DataFrame:
        """count() for every row of probes (same coordinate columns), as `n`."""
        mine = self.df.groupBy(*self.coords).agg(F.count(F.lit(1)).alias("n"))
        return probes.join(mine, list(self.coords), "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def flatten(self) -> DataFrame:
        return self.df

    def size(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def bounds(self, *by: str) -> DataFrame:
        """Tight bounding box and count, of all points or of each group; nulls for no points."""
        made = [e for c in self.coords for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
        return self.df.groupBy(*by).agg(*made, F.count(F.lit(1)).alias("n"))

    def describe(self) -> dict:
        return {"coords": self.coords, "id": self.id, "types": [self.df.schema[c].dataType.simpleString() for c in self.coords], "pinned": self.pinned}

    # Updates

    def insert(self, more: DataFrame, check: bool = True) -> PointSet:
        if check:
            self._reject(more)
        out = self.df.unionByName(more.select(*self.df.columns))
        if check and self.id:
            self._reject_repeated(out)
        return self._with(out)

    def _minus(self, gone: DataFrame) -> DataFrame:
        if self.id:
            return self.df.join(gone.select(*self._key).distinct(), self._key, "left_anti")
        # One occurrence for each row of gone. Counts combine before the shuffle, so a point with very many copies is no hot key.
        return self.df.select(*self.coords).exceptAll(gone.select(*self.coords))

    def delete(self, gone: DataFrame, check: bool = True) -> PointSet:
        """Every row of gone must be present; one occurrence goes for each."""
        if check:
            have, want = (d.groupBy(*self._key).agg(F.count(F.lit(1)).alias(n)) for d, n in ((self.df, "have"), (gone, "want")))
            if want.join(have, self._key, "left").where(F.col("want") > F.coalesce("have", F.lit(0))).limit(1).count():
                raise ValueError("a point to delete is not present")
        return self._with(self._minus(gone))

    def diff(self, gone: DataFrame) -> PointSet:
        """As delete(), but absent points are fine."""
        return self._with(self._minus(gone))

    def insert_point(self, *values) -> PointSet:
        return self.insert(self.df.sparkSession.createDataFrame([values], self.df.schema))

    def erase(self, *values) -> tuple[PointSet, int]:
        """diff() by one point (its key columns); also how many went away."""
        one = self.df.sparkSession.createDataFrame([values], self.df.select(*self._key).schema)
        out = self.diff(one)
        return out, self.df.count() - out.df.count()

    def clear(self) -> PointSet:
        return self._with(self.df.limit(0))
