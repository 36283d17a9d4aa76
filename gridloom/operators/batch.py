"""Queries in bulk: many boxes or many query points against a point set, as equi-joins on grid cells.

Catalyst plans a box join or a nearest-neighbour join as a nested loop. Here boxes and
queries are sent to the cells of a grid they can touch, and points to the one cell they
lie in; the join is then by cell, hashed, and splittable where a cell is hot.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.functions import geometry as G
from gridloom.operators.pointset import PointSet

#: Cells of one level that a box touches along an axis, at most.
SPAN = 4
#: Levels are multiples of this, so that points are repeated for few of them.
STEP = 2
#: Queries in a block, and points in one, of the plain searches.
QUERY_BLOCK = 256
POINT_BLOCK = 8192
#: Points of a block that tell for each query how far its k nearest are at most, and pairs measured at once.
PROBE = 1024
PAIRS = 65536
#: Queries that a task meets its vectors with, about.
TASK_QUERIES = 2048


def _cut(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint where the session has a folder for it."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _cell(c: Column, width: Column) -> Column:
    return F.floor(c / width)


def _width(c: str) -> Column:
    return F.pow(F.lit(2.0), F.col(f"_level_{c}"))


def _leveled(boxes: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Non-empty boxes with, for each axis, the level at which they touch at most SPAN cells; cells of a level are 2**level wide.

    Levels follow the box, axis by axis, and may be negative; sides without extent take the least level of the others, or
    one by which all boxes' places fall in about a thousand cells."""
    lo, hi = [F.col(f"lo_{c}") for c in coords], [F.col(f"hi_{c}") for c in coords]
    some = boxes.where(~G.box_is_empty(lo, hi))
    level = {c: F.ceil(F.log2(F.when(h > a, (h - a).cast("double")) / F.lit(SPAN - 1.0)) / STEP) * STEP for c, a, h in zip(coords, lo, hi, strict=True)}
    stats = some.agg(*[e for c, a, h in zip(coords, lo, hi, strict=True) for e in (F.min(level[c]).alias(f"least_{c}"), F.max(F.greatest(F.abs(a), F.abs(h))).alias(f"far_{c}"), (F.max(h) - F.min(a)).alias(f"all_{c}"))]).first()
    for c in coords:
        far, whole = float(stats[f"far_{c}"] or 1), float(stats[f"all_{c}"] or 0)
        # A cell's number must stay exact in a double.
        floor = math.ceil((math.log2(far) if far > 0 else 0) - 50)
        flat = stats[f"least_{c}"] if stats[f"least_{c}"] is not None else STEP * math.ceil(math.log2(whole / 1024) / STEP) if whole > 0 else 0
        some = some.withColumn(f"_level_{c}", F.greatest(F.coalesce(level[c], F.lit(flat)), F.lit(floor)).cast("int"))
    return some


def _cells_of_boxes(df: DataFrame, coords: Sequence[str], lo: str = "lo_", hi: str = "hi_") -> DataFrame:
    for c in coords:
        df = df.withColumn(f"_cell_{c}", F.explode(F.sequence(_cell(F.col(f"{lo}{c}"), _width(c)), _cell(F.col(f"{hi}{c}"), _width(c)))))
    return df


def _at_levels(df: DataFrame, leveled: DataFrame, coords: Sequence[str]) -> DataFrame:
    """df once for each combination of levels that some box uses: at most a few dozen an axis, whatever the number of boxes."""
    names = [f"_level_{c}" for c in coords]
    used = sorted(tuple(r) for r in leveled.select(*names).distinct().collect())
    levels = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in used]) if used else F.array().cast("array<struct<" + ",".join(f"{n}:int" for n in names) + ">>")
    return df.withColumn("_l", F.explode(levels)).select(*df.columns, "_l.*")


def _keys(coords: Sequence[str]) -> list[str]:
    return [f"{k}_{c}" for c in coords for k in ("_level", "_cell")]


def range_join(points: PointSet, boxes: DataFrame) -> DataFrame:
    """Rows of boxes (lo_c and hi_c for each coordinate c, and any others) with each point inside.

    A point lies in one cell of a combination of levels, so no pair comes twice."""
    coords = points.coords
    leveled = _leveled(boxes, coords)
    at = _at_levels(points.df, leveled, coords)
    for c in coords:
        at = at.withColumn(f"_cell_{c}", _cell(F.col(c), _width(c)))
    inside = G.in_box(G.cols(coords), [F.col(f"lo_{c}") for c in coords], [F.col(f"hi_{c}") for c in coords])
    return at.join(_cells_of_boxes(leveled, coords), _keys(coords)).where(inside).drop(*_keys(coords))


def box_join(cells: DataFrame, boxes: DataFrame, coords: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Rows of boxes with each row of cells (corners in columns lo + c and hi + c) that they meet.

    Both go to the cells of the boxes' levels that they touch; of the places where a pair meets, the one at the
    greater of the two lower corners counts. Meant for cells no larger than most boxes."""
    leveled = _leveled(boxes, coords)
    left = _cells_of_boxes(_at_levels(cells, leveled, coords), coords, lo, hi)
    pairs = left.join(_cells_of_boxes(leveled, coords), _keys(coords))
    meets = G.boxes_intersect([F.col(f"{lo}{c}") for c in coords], [F.col(f"{hi}{c}") for c in coords], [F.col(f"lo_{c}") for c in coords], [F.col(f"hi_{c}") for c in coords])
    once = reduce(lambda a, b: a & b, (F.col(f"_cell_{c}") == _cell(F.greatest(f"{lo}{c}", f"lo_{c}"), _width(c)) for c in coords))
    return pairs.where(meets & once).drop(*_keys(coords))


def range_query(points: PointSet, boxes: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, key columns) of every point in every box."""
    return range_join(points, boxes).select(qid, *points._key)


def range_count(points: PointSet, boxes: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, n), 0 for boxes that hold nothing."""
    found = range_join(points, boxes).groupBy(qid).agg(F.count(F.lit(1)).alias("n"))
    return boxes.select(qid).join(found, qid, "left").select(qid, F.coalesce("n", F.lit(0)).alias("n"))


def distance_join(points: PointSet, centers: DataFrame, radius: str = "r", qid: str = "qid") -> DataFrame:
    """(qid, key columns, d2) of every point within its radius of every center (coordinates, and the radius, as columns)."""
    coords = points.coords
    boxes = centers.where(F.col(radius) >= 0).select(qid, F.col(radius).alias("_r"), *[e for c in coords for e in (F.col(c).alias(f"_q{c}"), (F.col(c) - F.col(radius)).alias(f"lo_{c}"), (F.col(c) + F.col(radius)).alias(f"hi_{c}"))])
    d2 = G.d2(G.cols(coords), [F.col(f"_q{c}") for c in coords])
    return range_join(points, boxes).withColumn("d2", d2).where(F.col("d2") <= F.col("_r") * F.col("_r")).select(qid, *points._key, "d2")


def radius_counts(points: PointSet, centers: DataFrame, radius: str = "r", qid: str = "qid") -> DataFrame:
    """(qid, n): PointSet.radius_count for every center."""
    found = distance_join(points, centers, radius, qid).groupBy(qid).agg(F.count(F.lit(1)).alias("n"))
    return centers.select(qid).join(found, qid, "left").select(qid, F.coalesce("n", F.lit(0)).alias("n"))


def _packed(df: DataFrame, block: int, columns: Sequence[str], prefix: str) -> DataFrame:
    """Rows packed by blocks into one row of arrays each. Blocks are those of the task that reads them: nothing is shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, block):
                part = b.slice(k, block)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns], part.schema.names)

    renamed = df.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return renamed.mapInArrow(run, ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in renamed.schema.fields))


def _blockwise(points: DataFrame, queries: DataFrame, keys: Sequence[str], qid: str, k: int, distances: Callable, point_columns: Sequence[str], query_columns: Sequence[str]) -> DataFrame:
    """(qid, keys, d2, rank): every query against every point, block by block, of which each block of points hands on k a query.

    distances: of a block of queries' and a block of points' columns, as (queries, points)."""
    blocks = _packed(points, POINT_BLOCK, point_columns, "p_").join(_packed(queries, QUERY_BLOCK, query_columns, "q_"))
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    ids = {f.name: f.dataType.simpleString() for f in queries.schema.fields}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in range(b.num_rows):
                one = {n: b.column(n)[row].values for n in b.schema.names}
                d2 = distances({c: one[f"q_{c}"] for c in query_columns}, {c: one[f"p_{c}"] for c in point_columns})
                order = [one[f"p_{c}"].to_numpy(zero_copy_only=False) for c in keys][::-1]
                queried, at = [], []
                for i in range(d2.shape[0]):
                    near = np.arange(d2.shape[1]) if d2.shape[1] <= k else np.flatnonzero(d2[i] <= np.partition(d2[i], k - 1)[k - 1])
                    first = near[np.lexsort([*(o[near] for o in order), d2[i][near]])][:k]
                    queried.append(np.full(len(first), i))
                    at.append(first)
                q, p = np.concatenate(queried), np.concatenate(at)
                yield pa.RecordBatch.from_arrays([one[f"q_{qid}"].take(pa.array(q)), *[one[f"p_{c}"].take(pa.array(p)) for c in keys], pa.array(d2[q, p])], [qid, *keys, "d2"])

    distance = "double" if any(kinds[c] not in ("bigint", "int", "smallint", "tinyint") for c in point_columns if c not in keys or c in query_columns) else "bigint"
    found = blocks.mapInArrow(run, f"`{qid}` {ids[qid]}, " + ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", d2 {distance}")
    by = W.partitionBy(qid).orderBy("d2", *keys)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def knn_naive(points: PointSet, queries: DataFrame, k: int, qid: str = "qid") -> DataFrame:
    """The plain form: every query against every point, in blocks."""
    coords = list(points.coords)

    def distances(q: dict, p: dict) -> np.ndarray:
        return reduce(add, ((p[c].to_numpy(zero_copy_only=False)[None, :] - q[c].to_numpy(zero_copy_only=False)[:, None]) ** 2 for c in coords))

    if k <= 0:
        d2 = G.d2(G.cols(coords), G.cols(coords))
        return points.df.limit(0).join(queries.select(qid)).select(qid, *points._key, d2.alias("d2"), F.lit(1).alias("rank"))
    kinds = {c: points.df.schema[c].dataType for c in coords}
    queries = queries.select(qid, *[F.col(c).cast(kinds[c]).alias(c) for c in coords])
    return _blockwise(points.df, queries, points._key, qid, k, distances, points._key, [qid, *coords])


def _nearest(pairs: DataFrame, points: PointSet, k: int, qid: str) -> DataFrame:
    by = W.partitionBy(qid).orderBy("d2", *points._key)
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(qid, *points._key, "d2", "rank")


def _around(todo: DataFrame, coords: Sequence[str], width: Column) -> DataFrame:
    for c in coords:
        todo = todo.withColumn(f"_{c}", F.explode(F.sequence(_cell(F.col(f"_q{c}"), width) - 1, _cell(F.col(f"_q{c}"), width) + 1)))
    return todo


def knn(points: PointSet, queries: DataFrame, k: int, qid: str = "qid") -> DataFrame:
    """Exact k nearest points of every query: (qid, key columns, d2, rank), ties by id or coordinates.

    Counts of cells of doubling width, each level added up from the one below, tell for each query the least width at which
    its cell and the cells around it hold k points, so that dense and thin places get cells of their own size. A query meets the
    points of those cells. All points within one cell width of it are among them, so it is done once its k-th distance is no
    larger; the others go on at the width of that distance. Of points in one place only the k first take part.
    queries: qid and the coordinate columns."""
    coords = points.coords
    if k <= 0:
        return knn_naive(points, queries, 0, qid)
    key = points.df.select(*points._key)
    places = key.groupBy(*coords).agg(F.count(F.lit(1)).alias("_n"))
    both = places.agg(F.max("_n").alias("most"), F.sum("_n").alias("n"), *[e for c in coords for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    if not both.n:
        return knn_naive(points, queries, k, qid)
    few = key
    if both.most > k:
        place = W.partitionBy(*coords).orderBy(*points._key)
        few = key.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).drop("_n")
    extent = max(float(both[f"hi_{c}"] - both[f"lo_{c}"]) for c in coords) or 1.0
    far = max(abs(float(both[f"{s}_{c}"])) for c in coords for s in ("lo", "hi")) or 1.0
    # The finest width: of a level at which even crowded places hold few points a cell, as far as doubles tell cells apart.
    top = math.ceil(math.log2(extent)) + 1
    bottom = max(top - max(4, 2 * math.ceil(math.log2(both.n / k + 1) / len(coords))), math.ceil(math.log2(far)) - 50)
    bottom = top - (top - bottom) // STEP * STEP
    finest = F.lit(2.0**bottom)
    names = [f"_{c}" for c in coords]
    counts = _cut(few.groupBy(*[_cell(F.col(c), finest).alias(f"_{c}") for c in coords]).agg(F.count(F.lit(1)).alias("_n")))
    # One row for each level; each counted from the finest cells, which are many fewer than points where points are dense.
    levels = F.explode(F.sequence(F.lit(bottom), F.lit(top), F.lit(STEP))).alias("_level")
    at_level = counts.select(levels, *[F.col(f"_{c}") for c in coords], "_n").select("_level", *[F.floor(F.col(f"_{c}") / F.pow(F.lit(2.0), F.col("_level") - bottom)).alias(f"_{c}") for c in coords], "_n")
    at_level = at_level.groupBy("_level", *names).agg(F.sum("_n").alias("_n"))
    todo = queries.select(qid, *[F.col(c).alias(f"_q{c}") for c in coords])
    asked = _around(todo.select("*", levels), coords, F.pow(F.lit(2.0), F.col("_level")))
    enough = asked.join(at_level, ["_level", *names]).groupBy(qid, "_level").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= k).groupBy(qid).agg(F.min("_level").alias("_level"))
    todo = _cut(todo.join(enough, qid, "left").withColumn("_level", F.coalesce("_level", F.lit(top + 1))))
    done: list[DataFrame] = []
    while True:
        used = sorted(r[0] for r in todo.select("_level").distinct().collect())  # as many as there are levels, at most
        if not used:
            return reduce(DataFrame.unionByName, done) if done else knn_naive(points, queries, k, qid)
        near, whole = todo.where(F.col("_level") <= top), todo.where(F.col("_level") > top)
        width = F.pow(F.lit(2.0), F.col("_level"))
        at = few.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in used if v <= top]).cast("array<int>")))
        for c in coords:
            at = at.withColumn(f"_{c}", _cell(F.col(c), width))
        d2 = G.d2(G.cols(coords), [F.col(f"_q{c}") for c in coords])
        pairs = at.join(_around(near, coords, width), ["_level", *names]).withColumn("d2", d2)
        found = _cut(_nearest(pairs, points, k, qid))
        if used[-1] > top:  # places so far from all points, or k so large, that no cell is enough
            done.append(knn_naive(points._with(few), whole.select(qid, *[F.col(f"_q{c}").alias(c) for c in coords]), k, qid).select(*found.columns))
        reach = found.groupBy(qid).agg(F.count(F.lit(1)).alias("_found"), F.max("d2").alias("_far"))
        state = near.join(reach, qid, "left")
        enough = (F.col("_found") >= k) & (F.col("_far") <= width * width)
        done.append(found.join(state.where(enough).select(qid), qid, "left_semi"))
        # At a width of the k-th distance found so far, all nearer points are in reach.
        wider = F.when(F.col("_found") >= k, F.ceil(F.log2(F.sqrt(F.col("_far").cast("double"))) + 1e-9)).otherwise(F.col("_level") + 2)
        rest = state.where(~F.coalesce(enough, F.lit(False))).withColumn("_level", F.least(F.greatest(wider, F.col("_level") + 1), F.lit(top + 1)).cast("int"))
        todo = _cut(rest.select(*todo.columns))


def knn_distances(points: PointSet, queries: DataFrame, k: int, qid: str = "qid") -> DataFrame:
    """(qid, d2): squared distance of the k-th (or last) neighbour."""
    return knn(points, queries, k, qid).groupBy(qid).agg(F.max("d2").alias("d2"))


def _sealed(df: DataFrame, block: int, prefix: str) -> DataFrame:
    """Rows by blocks, each an Arrow stream in one cell, with a key. Such cells pass Spark as they are; of arrays every number would be copied by itself."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, block):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, b.schema) as stream:
                    stream.write_batch(b.slice(k, block))
                yield pa.RecordBatch.from_arrays([pa.array([os.urandom(16)]), pa.array([out.getvalue().to_pybytes()])], [f"{prefix}_key", f"{prefix}_block"])

    return df.mapInArrow(run, f"{prefix}_key binary, {prefix}_block binary")


def _opened(sealed: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(sealed.as_buffer()).read_next_batch()


def _first(k: int, group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the k first of every group, in the order of group and keys."""
    order = np.lexsort([*keys[::-1], group])
    by = group[order]
    start = np.flatnonzero(np.r_[True, by[1:] != by[:-1]][: len(by)])
    return order[np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)])) < k]


def _numbers(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, with some other value for nulls, and where those are."""
    null = c.is_null().to_numpy(zero_copy_only=False)
    if null.all():
        return np.zeros(len(c), np.int64), null
    return (c.fill_null(c.drop_null()[0]) if null.any() else c).to_numpy(zero_copy_only=False), null


class _Vectors:
    """A block of vectors (a name and v), one a column of numbers, 0 where there is none.

    even: those of the block's usual length, of finite squares and without nulls; the others are never screened."""

    def __init__(self, rows: pa.RecordBatch, name: str, copies: int = 0) -> None:
        """copies: of more equal vectors than that, only so many stay, by name; 0 for all."""
        self.names, v = rows.column(name), rows.column("v")
        size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = v.flatten()  # of a slice, .values would be all rows'
        numbers, null = _numbers(flat)
        if (size == size[0]).all() and not null.any():
            self.values = np.ascontiguousarray(numbers.reshape(len(v), size[0]).T, dtype=float)
            self.there = np.ones(self.values.shape, bool)
        else:
            row, at = np.repeat(np.arange(len(v)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            self.values, self.there = np.zeros((size.max(), len(v))), np.zeros((size.max(), len(v)), bool)
            self.values[at, row], self.there[at, row] = np.where(null, 0, numbers), ~null
        self.usual = int(np.bincount(size).argmax())
        self._measure(size)
        if copies:
            order, null = _numbers(self.names)
            _, same, often = np.unique(self.norm, return_inverse=True, return_counts=True)
            many = np.flatnonzero(often[same] > copies)
            if len(many):
                bits = np.hstack([np.ascontiguousarray(x[:, many].T).view(np.uint8).reshape(len(many), -1) for x in (self.values, self.there)])
                place = np.unique(bits.view(f"V{bits.shape[1]}").ravel(), return_inverse=True)[1] if bits.shape[1] else np.zeros(len(many), np.int64)
                stay = np.ones(len(v), bool)
                stay[many] = False
                stay[many[_first(copies, place, null[many], order[many])]] = True
                self.names, self.values, self.there = self.names.filter(pa.array(stay)), self.values[:, stay], self.there[:, stay]
                self._measure(size[stay])

    def _measure(self, size: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = (self.values**2).sum(axis=0)
        self.full = bool(self.there.all())
        self.even = np.isfinite(self.norm) & (size == self.usual) & (self.full or self.there.sum(axis=0) == self.usual)
        self.some, self.all = bool(self.even.any()), bool(self.even.all())
        # For products: the even ones' numbers and squares, of the others 0.
        self.numbers, self.square = (self.values, self.norm) if self.all else (np.where(self.even, self.values[: self.usual], 0), np.where(self.even, self.norm, 0))
        self.numbers = np.vstack([self.numbers, self.square])


def _may_be_near(q: _Vectors, p: _Vectors, reach: np.ndarray, k: int) -> np.ndarray:
    """Which points may be among the k nearest of which queries: all but those that a product of matrices, with its rounding
    allowed for, shows to be further off than reach, or than k others."""
    n = len(p.norm)
    if q.usual != p.usual or not q.some or not p.some:
        return np.ones((len(q.norm), n), bool)
    rest = np.vstack([q.numbers[:-1] * -2, np.ones(len(q.norm))]).T @ p.numbers  # the distance without the query's square
    error = (8 * q.usual + 64) * np.finfo(float).eps * (q.square + p.square.max()) + np.finfo(float).tiny
    if not p.all:
        rest[:, ~p.even] = np.inf
    if n >= k and not np.isfinite(reach).all():
        reach = np.minimum(reach, np.partition(rest[:, : max(k, PROBE)], k - 1, axis=1)[:, k - 1] + q.square + error)
    near = rest <= (reach - q.square + error)[:, None]
    near[~q.even] = True
    near[:, ~p.even] = True
    return near


def _squares(q: _Vectors, p: _Vectors, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of pairs, one dimension after another, as a running sum has them, and which have none."""
    total, none = np.zeros(len(i)), np.ones(len(i), bool)
    for s in range(0, len(i), PAIRS):
        a, b = i[s : s + PAIRS], j[s : s + PAIRS]
        for x in range(min(len(q.values), len(p.values))):
            with np.errstate(over="ignore", invalid="ignore"):
                d = (p.values[x, b] - q.values[x, a]) ** 2
            if not (q.full and p.full):
                both = p.there[x, b] & q.there[x, a]
                d[~both] = 0
                none[s : s + PAIRS] &= ~both
            else:
                none[s : s + PAIRS] = False
            total[s : s + PAIRS] += d
    return total, none


def vector_knn(vectors: DataFrame, queries: DataFrame, k: int, qid: str = "qid") -> DataFrame:
    """(qid, id, d2, rank) by whole arrays: vectors (id, v), queries (qid, v). A stated query set against all vectors, in blocks: grids prune nothing in so many dimensions.

    Exact. A product of matrices tells which pairs of a block of queries and one of vectors may count, and only these are
    measured; a task hands on k a query. Numbers that only one of two vectors has, or that are null, count for nothing; vectors
    without a common number have a null distance and come after all others, NaN being the largest of those. Ids that are null
    come after others at the same distance; queries of one id are one query of all their rows."""
    ids = {n: t.schema[c].dataType.simpleString() for n, t, c in (("id", vectors, "id"), (qid, queries, qid))}
    # Gathered once, or each task would read all vectors for its queries. Vectors on the left: of a product, Spark keeps the right side of a task.
    queries = queries.select(qid, "v").where(F.lit(k > 0))
    queries = queries.repartition(max(1, math.ceil(queries.count() / TASK_QUERIES)))
    blocks = _sealed(vectors.select("id", "v"), POINT_BLOCK, "p").join(_sealed(queries, 2 * TASK_QUERIES, "q"))
    at_once = QUERY_BLOCK

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[bytes, list[_Vectors]] = {}
        best: dict[tuple[bytes, int], tuple] = {}  # of some queries: number among them, no distance, distance, null id, id of their nearest
        last, p = None, None
        for b in it:
            for p_key, p_block, q_key, q_block in zip(*(b.column(n) for n in ("p_key", "p_block", "q_key", "q_block")), strict=True):
                if p_key.as_py() != last:
                    last, p = p_key.as_py(), _Vectors(_opened(p_block), "id", k)
                    order, null = _numbers(p.names)
                key = q_key.as_py()
                if key not in asked:
                    rows = _opened(q_block)
                    asked[key] = [_Vectors(rows.slice(s, at_once), qid) for s in range(0, rows.num_rows, at_once)]
                for s, q in enumerate(asked[key]):
                    reach, had = np.full(len(q.norm), np.inf), best.get((key, s))
                    if had:
                        end = np.flatnonzero(np.bincount(had[0], minlength=len(reach)) == k)
                        kth = np.searchsorted(had[0], end, "right") - 1
                        reach[end] = np.where(had[1][kth] | np.isnan(had[2][kth]), np.inf, had[2][kth])
                    i, j = np.divmod(np.flatnonzero(_may_be_near(q, p, reach, k)), len(p.norm))
                    d2, none = _squares(q, p, i, j)
                    found = (i, none, d2, null[j], order[j])
                    if had:
                        found = tuple(np.concatenate([x, y]) for x, y in zip(had, found, strict=True))
                    first = _first(k, *found)
                    best[key, s] = tuple(x[first] for x in found)
        for (key, s), (i, none, d2, null, near) in best.items():
            yield pa.RecordBatch.from_arrays([asked[key][s].names.take(pa.array(i)), pa.array(near, names_type, mask=null), pa.array(d2, mask=none)], [qid, "id", "d2"])

    names_type = to_arrow_type(vectors.schema["id"].dataType)
    found = blocks.mapInArrow(run, f"`{qid}` {ids[qid]}, id {ids['id']}, d2 double")
    by = W.partitionBy(qid).orderBy(F.col("d2").asc_nulls_last(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
