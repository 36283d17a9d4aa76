"""Registered queries over the reference's own operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import curves
from gridloom.functions import geometry as G
from gridloom.operators import batch, clean, datagen, delta, keyed, layout
from gridloom.operators.pointset import Box, PointSet
from gridloom.plans.fixtures import view, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

BOX = Box((0, 0), (1499, 100_000))
DOT = Box((370, 172_799), (370, 172_799))
XY = ("x", "y")


def query(sql: str | None = None, *views: str):
    """Register a function under its name; sql is the DuckDB twin over the views."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _p2(spark, d):
    return PointSet.build(view(spark, d, "p2"), XY, "id", check=False)


def _b2(spark, d):
    return PointSet.build(view(spark, d, "b2"), XY, check=False)


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy(*XY).agg(F.count(F.lit(1)).alias("n"))


_IN = "x BETWEEN 0 AND 1499 AND y BETWEEN 0 AND 100000"


# Range operators


@query(f"SELECT count(*) AS n FROM p2 WHERE {_IN}", "p2")
def range_count(spark, d):
    return _p2(spark, d).range_count(BOX)


@query("SELECT count(*) AS n FROM p2 WHERE x BETWEEN 150 AND 50", "p2")
def range_count_inverted(spark, d):
    return _p2(spark, d).range_count(Box((150, 0), (50, 10**6)))


@query("SELECT count(*) AS n FROM p2 WHERE x = 370 AND y = 172799", "p2")
def range_count_dot(spark, d):
    return _p2(spark, d).range_count(DOT)


@query(f"SELECT id, x, y FROM p2 WHERE {_IN}", "p2")
def range_query(spark, d):
    return _p2(spark, d).range_query(BOX)


@query("SELECT id, x, y, z FROM p3 WHERE x BETWEEN 10 AND 400 AND y BETWEEN 0 AND 5000 AND z BETWEEN 100 AND 600", "p3")
def range_query_3d(spark, d):
    return PointSet.build(view(spark, d, "p3"), ("x", "y", "z"), "id", check=False).range_query(Box((10, 0, 100), (400, 5000, 600)))


@query(f"SELECT count(*) AS n FROM (SELECT * FROM p2 WHERE {_IN} LIMIT 100)", "p2")
def truncate_limit(spark, d):
    return _p2(spark, d).range_query(BOX, limit=100).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM p2 WHERE (x - 700) * (x - 700) + (y - 90000) * (y - 90000) <= 30000 * 30000", "p2")
def radius_count(spark, d):
    return _p2(spark, d).radius_count((700, 90_000), 30_000)


@query("SELECT count(*) AS n FROM b2 WHERE x = 1 AND y = 1", "b2")
def point_count(spark, d):
    return _b2(spark, d).count((1, 1))


@query("SELECT count(*) > 0 AS found FROM b2 WHERE x = 1 AND y = 1", "b2")
def point_contains(spark, d):
    return _b2(spark, d).contains((1, 1))


@query("SELECT qid, count(b2.x) AS n FROM q2 LEFT JOIN b2 ON b2.x = q2.x AND b2.y = q2.y GROUP BY qid", "b2", "q2")
def batch_point_count(spark, d):
    return _b2(spark, d).count_each(view(spark, d, "q2")).select("qid", "n")


_INSIDE = "p2.x BETWEEN box2.lo_x AND box2.hi_x AND p2.y BETWEEN box2.lo_y AND box2.hi_y"


@query(f"SELECT qid, count(p2.id) AS n FROM box2 LEFT JOIN p2 ON {_INSIDE} GROUP BY qid", "p2", "box2")
def batch_range_count(spark, d):
    return batch.range_count(_p2(spark, d), view(spark, d, "box2"))


@query(f"SELECT qid, id, p2.x, p2.y FROM box2 JOIN p2 ON {_INSIDE}", "p2", "box2")
def batch_range_query(spark, d):
    return batch.range_query(_p2(spark, d), view(spark, d, "box2"))


@query(f"SELECT count(*) AS n FROM p2 WHERE {_IN}", "p2")
def range_count_by_cells(spark, d):
    p = _p2(spark, d)
    return layout.range_count(p, layout.cell_summary(p.df, XY, 2000), 2000, BOX)


# Nearest neighbours

_D2 = "(p2.x - q2.x) * (p2.x - q2.x) + (p2.y - q2.y) * (p2.y - q2.y)"
_NEAR = f"SELECT q2.qid, p2.id, p2.x, p2.y, {_D2} AS d2, row_number() OVER (PARTITION BY q2.qid ORDER BY {_D2}, p2.id) AS rank FROM q2 CROSS JOIN p2 QUALIFY rank <= 10"


@query("SELECT *, row_number() OVER (ORDER BY d2, id) AS rank FROM (SELECT id, x, y, (x - 700) * (x - 700) + (y - 90000) * (y - 90000) AS d2 FROM p2) ORDER BY d2, id LIMIT 10", "p2")
def knn_single(spark, d):
    """With the place of each row as it comes."""
    return _p2(spark, d).knn((700, 90_000), 10).withColumn("rank", (F.monotonically_increasing_id() + 1).cast("long"))


@query("SELECT id, x, y, x * x + y * y AS d2 FROM c2 ORDER BY d2, id", "c2")
def knn_k_exceeds_n(spark, d):
    return PointSet.build(view(spark, d, "c2"), XY, "id", check=False).knn((0, 0), 10**6)


@query("SELECT max(d2) AS d2 FROM (SELECT (x - 700) * (x - 700) + (y - 90000) * (y - 90000) AS d2 FROM p2 ORDER BY d2 LIMIT 32)", "p2")
def knn_kth_distance(spark, d):
    return _p2(spark, d).knn_distance((700, 90_000), 32)


@query(_NEAR, "p2", "q2")
def batch_knn(spark, d):
    return batch.knn(_p2(spark, d), view(spark, d, "q2"), 10)


@query(_NEAR, "p2", "q2")
def batch_knn_naive(spark, d):
    return batch.knn_naive(_p2(spark, d), view(spark, d, "q2"), 10)


@query(f"SELECT qid, max(d2) AS d2 FROM ({_NEAR}) GROUP BY qid", "p2", "q2")
def batch_knn_distance(spark, d):
    return batch.knn_distances(_p2(spark, d), view(spark, d, "q2"), 10)


@query("SELECT qid, id FROM (SELECT b.id AS qid, a.id, row_number() OVER (PARTITION BY b.id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda t: (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)) * (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)))), a.id) AS rank FROM e64 a CROSS JOIN e64 b WHERE b.id % 100 = 0) WHERE rank <= 5", "e64")
def knn_vectors(spark, d):
    v = view(spark, d, "e64")
    return batch.vector_knn(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid"), 5).select("qid", "id")


# Updates


@query("SELECT x, y, count(*) AS n FROM (SELECT * FROM b2 UNION ALL SELECT * FROM del2) GROUP BY x, y", "b2", "del2")
def insert(spark, d):
    return _counted(_b2(spark, d).insert(view(spark, d, "del2")).flatten())


@query("SELECT x, y, count(*) AS n FROM (SELECT * FROM b2 EXCEPT ALL SELECT * FROM del2) GROUP BY x, y", "b2", "del2")
def delete(spark, d):
    return _counted(_b2(spark, d).delete(view(spark, d, "del2")).flatten())


@query("SELECT x, y, count(*) AS n FROM (SELECT * FROM b2 EXCEPT ALL (SELECT * FROM del2 UNION ALL SELECT x + 1000000, y FROM del2)) GROUP BY x, y", "b2", "del2")
def diff(spark, d):
    gone = view(spark, d, "del2")
    return _counted(_b2(spark, d).diff(gone.unionByName(gone.withColumn("x", F.col("x") + 1_000_000))).flatten())


@query("SELECT x, y, count(*) AS n FROM (SELECT * FROM b2 EXCEPT ALL SELECT 1, 1) GROUP BY x, y", "b2")
def erase(spark, d):
    return _counted(_b2(spark, d).erase(1, 1)[0].flatten())


@query("SELECT * FROM p2 WHERE id % 5 <> 0", "p2")
def keyed_delete(spark, d):
    p = _p2(spark, d)
    return p.delete(p.df.where("id % 5 = 0")).flatten()


@query("SELECT * FROM snap_b UNION ALL SELECT * FROM snap_a WHERE id NOT IN (SELECT id FROM snap_b)", "snap_a", "snap_b")
def keyed_union(spark, d):
    return keyed.union(view(spark, d, "snap_a"), view(spark, d, "snap_b"), ["id"])


@query("SELECT * FROM snap_b WHERE id IN (SELECT id FROM snap_a)", "snap_a", "snap_b")
def keyed_intersect(spark, d):
    return keyed.intersect(view(spark, d, "snap_a"), view(spark, d, "snap_b"), ["id"])


@query("SELECT a.id, a.x + b.x AS x, a.y + b.y AS y FROM snap_a a JOIN snap_b b ON a.id = b.id", "snap_a", "snap_b")
def keyed_intersect_combine(spark, d):
    return keyed.intersect(view(spark, d, "snap_a"), view(spark, d, "snap_b"), ["id"], lambda a, b: a + b)


@query("SELECT * FROM snap_a WHERE id NOT IN (SELECT id FROM snap_b)", "snap_a", "snap_b")
def keyed_difference(spark, d):
    return keyed.difference(view(spark, d, "snap_a"), view(spark, d, "snap_b"), ["id"])


@query("SELECT * FROM p2 WHERE x > 100 AND x < 300 OR x = 100 AND id >= 50 OR x = 300 AND id <= 7000", "p2")
def key_range(spark, d):
    return keyed.key_range(view(spark, d, "p2"), ["x", "id"], (100, 50), (300, 7000))


@query("SELECT count(*) AS n FROM p2 WHERE x < 300 OR x = 300 AND id < 7000", "p2")
def rank(spark, d):
    return keyed.rank(view(spark, d, "p2"), ["x", "id"], (300, 7000))


@query("SELECT * FROM p2 ORDER BY x, id LIMIT 1 OFFSET 123", "p2")
def select_rank(spark, d):
    return keyed.select(view(spark, d, "p2"), ["x", "id"], 123)


@query("SELECT id, x, y, row_number() OVER (ORDER BY x, id) - 1 AS rank FROM p2", "p2")
def ranked(spark, d):
    return keyed.ranked(view(spark, d, "p2"), ["x", "id"])


@query("SELECT id, sum(x)::BIGINT AS x, max(y) AS y FROM (SELECT * FROM snap_a UNION ALL SELECT * FROM snap_b) GROUP BY id", "snap_a", "snap_b")
def insert_combine(spark, d):
    return keyed.insert_combine(view(spark, d, "snap_a"), view(spark, d, "snap_b"), ["id"], x=F.sum, y=F.max)


@query("SELECT * FROM snap_a WHERE id NOT IN (SELECT id FROM snap_b) UNION ALL SELECT id, sum(x)::BIGINT AS x, min(y) AS y FROM (SELECT * FROM snap_b UNION ALL SELECT * FROM snap_b) GROUP BY id", "snap_a", "snap_b")
def insert_reduce(spark, d):
    b = view(spark, d, "snap_b")
    return keyed.insert_reduce(view(spark, d, "snap_a"), b.unionByName(b), ["id"], x=F.sum, y=F.min)


@query("SELECT min(y) AS lo_y, max(y) AS hi_y, count(*) AS n FROM p2 WHERE id BETWEEN 1000 AND 5000", "p2")
def aggregate_range(spark, d):
    return keyed.aggregate_range(view(spark, d, "p2"), ["id"], (1000,), (5000,), lo_y=F.min("y"), hi_y=F.max("y"), n=F.count(F.lit(1)))


@query("SELECT id, x, y, running FROM (SELECT *, (sum(x) OVER (ORDER BY id))::BIGINT AS running FROM p2) WHERE running > 100000 ORDER BY id LIMIT 1", "p2")
def aggregate_select(spark, d):
    return keyed.aggregate_select(view(spark, d, "p2"), ["id"], "x", 100_000)


@query("SELECT min(id) AS at FROM (SELECT id, x, lag(x) OVER (ORDER BY id) AS before, lag(id) OVER (ORDER BY id) AS before_id FROM p2) WHERE x < before AND id = before_id + 1", "p2")
def first_unsorted(spark, d):
    return keyed.first_unsorted(view(spark, d, "p2"), "id", "x")


# Aggregates and cells


@query("SELECT count(*) AS n FROM b2", "b2")
def size(spark, d):
    return _b2(spark, d).size()


@query("SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, count(*) AS n FROM p2", "p2")
def bounds(spark, d):
    return _p2(spark, d).bounds()


@query("SELECT g, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, count(*) AS n FROM (SELECT *, id % 7 AS g FROM p2) GROUP BY g", "p2")
def bounds_per_group(spark, d):
    p = _p2(spark, d)
    return p._with(p.df.withColumn("g", F.col("id") % 7)).bounds("g")


@query("SELECT CAST(floor(x / 500.0) AS BIGINT) AS cell_x, CAST(floor(y / 500.0) AS BIGINT) AS cell_y, count(*) AS n, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y FROM p2 GROUP BY 1, 2", "p2")
def cell_summary(spark, d):
    return layout.cell_summary(view(spark, d, "p2"), XY, 500)


@query("SELECT id, CASE WHEN x >= 700 THEN 2 ELSE 0 END + CASE WHEN y >= 200000 THEN 1 ELSE 0 END AS cell FROM p2", "p2")
def orth_cell_id(spark, d):
    return view(spark, d, "p2").select("id", layout.orth_cell(G.cols(XY), G.lits((0, 0)), G.lits((1399, 399_999))).alias("cell"))


@query("SELECT cut, count(*) FILTER (x < cut) AS n_left, count(*) FILTER (x >= cut) AS n_right FROM p2, (SELECT min(x) + (max(x) - min(x) + 1) // 2 AS cut FROM p2) GROUP BY cut", "p2")
def split_spatial_median(spark, d):
    p = view(spark, d, "p2")
    cut = p.agg(G.box_mid(F.min("x"), F.max("x")).alias("cut"))
    return p.join(F.broadcast(cut)).groupBy("cut").agg(F.count_if(F.col("x") < F.col("cut")).alias("n_left"), F.count_if(F.col("x") >= F.col("cut")).alias("n_right"))


@query("SELECT cut, count(*) FILTER (x < cut) AS n_left, count(*) FILTER (x >= cut) AS n_right FROM p2, (SELECT x AS cut FROM p2 ORDER BY x LIMIT 1 OFFSET (SELECT count(*) // 2 FROM p2)) GROUP BY cut", "p2")
def split_object_median(spark, d):
    return layout.object_median(view(spark, d, "p2"), "x")


@query("SELECT CASE WHEN max(y) - min(y) > max(x) - min(x) THEN 1 ELSE 0 END AS dim FROM p2", "p2")
def split_max_stretch(spark, d):
    low = view(spark, d, "p2").agg(*[F.min(c).alias(f"lo_{c}") for c in XY], *[F.max(c).alias(f"hi_{c}") for c in XY])
    return low.select(layout.cut_dim([F.col("lo_x"), F.col("lo_y")], [F.col("hi_x"), F.col("hi_y")], 0, "stretch").alias("dim"))


def _duck_kd(depth: int, leaf: int) -> str:
    """Cells halved at the middle of the wider side of their points' box, level by level."""
    out = "(SELECT id, x, y, 1::BIGINT AS cell FROM p2)"
    for _ in range(depth):
        boxed = f"(SELECT *, min(x) OVER c AS lx, max(x) OVER c AS hx, min(y) OVER c AS ly, max(y) OVER c AS hy, count(*) OVER c AS n FROM {out} WINDOW c AS (PARTITION BY cell))"
        right = "CASE WHEN hy - ly > hx - lx THEN y >= ly + (hy - ly + 1) // 2 ELSE x >= lx + (hx - lx + 1) // 2 END"
        out = f"(SELECT id, x, y, CASE WHEN n <= {leaf} OR lx = hx AND ly = hy THEN cell ELSE 2 * cell + ({right})::INT END AS cell FROM {boxed})"
    return f"SELECT cell, count(*) AS n FROM {out} GROUP BY cell"


@query(_duck_kd(4, 32), "p2")
def kd_cells(spark, d):
    return layout.kd_cells(_p2(spark, d), 4, dim="stretch", rule="spatial").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (x1 <= 1499 AND x0 >= 0 AND y0 >= 0 AND y1 <= 100000) AS cells_full, count(*) FILTER (NOT (x1 < 0 OR x0 > 1499 OR y1 < 0 OR y0 > 100000) AND NOT (x1 <= 1499 AND x0 >= 0 AND y0 >= 0 AND y1 <= 100000)) AS cells_edge, count(*) FILTER (x1 < 0 OR x0 > 1499 OR y1 < 0 OR y0 > 100000) AS cells_skipped FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p2 GROUP BY floor(x / 2000.0), floor(y / 2000.0))", "p2")
def cells_touched(spark, d):
    return layout.touched(layout.cell_summary(view(spark, d, "p2"), XY, 2000), XY, BOX)


# Curves


def _duck_morton(names: tuple[str, ...], bits: int) -> str:
    """Bit by bit, as the definition has it."""
    return " | ".join(f"((({c} >> {k}) & 1) << {k * len(names) + i})" for k in range(bits) for i, c in enumerate(names))


def _duck_hilbert(names: tuple[str, ...], bits: int, src: str) -> str:
    """Digit by digit from the highest, each in a column of its own; digit, frame and flip of a level follow from the one above."""
    d = len(names)
    mask, every = (1 << d) - 1, sum(1 << (d * k) for k in range(bits)) >> 1
    turn = "CASE " + " ".join(f"WHEN t = {t} THEN {1 + ((t & -t).bit_length() if (t & -t).bit_length() < d else 0)}" for t in range(1 << d)) + " END"
    inner = f"(SELECT id, {', '.join(names)}, 0::BIGINT AS above, 0::BIGINT AS flip, 0::BIGINT AS frame, 0::BIGINT AS code FROM {src})"
    for k in range(bits - 1, -1, -1):
        here = " | ".join(f"((({c} >> {k}) & 1) << {i})" for i, c in enumerate(names))
        one = f"(SELECT *, {here} AS here FROM {inner})"
        two = f"(SELECT *, xor(xor(here, above), flip) AS f FROM {one})"
        three = f"(SELECT *, ((f >> frame) | (f << ({d} - frame))) & {mask} AS t FROM {two})"
        inner = f"(SELECT id, {', '.join(names)}, here AS above, 1::BIGINT << frame AS flip, (frame + {turn}) % {d} AS frame, (code << {d}) | t AS code FROM {three})"
    out = f"(SELECT id, xor(code, {every}) AS code FROM {inner})"
    for k in (1, 2, 4, 8, 16, 32):
        out = f"(SELECT id, xor(code, code >> {k}) AS code FROM {out})"
    return f"SELECT id, code FROM {out}"


_P3 = "(SELECT id, x, greatest(y, 0) AS y, z FROM p3)"


@query(f"SELECT id, {_duck_morton(XY, 31)} AS code FROM p2", "p2")
def morton2(spark, d):
    return view(spark, d, "p2").select("id", curves.morton(G.cols(XY)).alias("code"))


@query(f"SELECT id, {_duck_morton(('x', 'y', 'z'), 21)} AS code FROM {_P3}", "p3")
def morton3(spark, d):
    return view(spark, d, "p3").select("id", curves.morton([F.col("x"), F.greatest("y", F.lit(0)), F.col("z")]).alias("code"))


@query(_duck_hilbert(XY, 32, "p2"), "p2")
def hilbert2(spark, d):
    return view(spark, d, "p2").select("id", curves.hilbert(G.cols(XY)).alias("code"))


@query(_duck_hilbert(("x", "y", "z"), 21, _P3), "p3")
def hilbert3(spark, d):
    return view(spark, d, "p3").select("id", curves.hilbert([F.col("x"), F.greatest("y", F.lit(0)), F.col("z")]).alias("code"))


@query("SELECT id, x, y FROM p2", "p2")
def hilbert_decode2(spark, d):
    p = view(spark, d, "p2").select("id", curves.hilbert(G.cols(XY)).alias("code"))
    return p.select("id", *[c.alias(n) for n, c in zip(XY, curves.hilbert_decode(F.col("code"), 2), strict=True)])


@query(f"SELECT id, x, y, z FROM {_P3}", "p3")
def hilbert_decode3(spark, d):
    p = view(spark, d, "p3").select("id", curves.hilbert([F.col("x"), F.greatest("y", F.lit(0)), F.col("z")]).alias("code"))
    return p.select("id", *[c.alias(n) for n, c in zip("xyz", curves.hilbert_decode(F.col("code"), 3), strict=True)])


@query("SELECT id, x, y FROM p2 WHERE x BETWEEN 300 AND 700 AND y BETWEEN 20000 AND 150000", "p2")
def hilbert_ranges(spark, d):
    """A box query through ranges of codes: the ranges cover it, the box itself decides."""
    lo, hi = (300, 20_000), (700, 150_000)
    coded = view(spark, d, "p2").withColumn("code", curves.hilbert(G.cols(XY)))
    return coded.where(curves.in_code_ranges(F.col("code"), curves.code_ranges(lo, hi))).where(G.in_box(G.cols(XY), G.lits(lo), G.lits(hi))).drop("code")


# Boxes and scalars

_BOXES = "(SELECT id, x AS lo_x, x + id % 90 AS hi_x, y AS lo_y, y + 500 AS hi_y FROM c2)"


def _boxes(spark, d):
    return view(spark, d, "c2").select("id", F.col("x").alias("lo_x"), (F.col("x") + F.col("id") % 90).alias("hi_x"), F.col("y").alias("lo_y"), (F.col("y") + 500).alias("hi_y"))


def _lo():
    return G.cols(("lo_x", "lo_y"))


def _hi():
    return G.cols(("hi_x", "hi_y"))


@query(f"SELECT id, hi_x >= 100 AND lo_x <= 900 AND hi_y >= 0 AND lo_y <= 4000 AS meets FROM {_BOXES}", "c2")
def box_intersects(spark, d):
    return _boxes(spark, d).select("id", G.boxes_intersect(_lo(), _hi(), G.lits((100, 0)), G.lits((900, 4000))).alias("meets"))


@query(f"SELECT id, CASE WHEN lo_x >= 100 AND hi_x <= 900 AND lo_y >= 0 AND hi_y <= 4000 THEN 1 WHEN hi_x < 100 OR lo_x > 900 OR hi_y < 0 OR lo_y > 4000 THEN -1 ELSE 0 END AS relation FROM {_BOXES}", "c2")
def box_relation(spark, d):
    return _boxes(spark, d).select("id", G.box_relation(_lo(), _hi(), G.lits((100, 0)), G.lits((900, 4000))).alias("relation"))


@query(f"SELECT id, dx * dx + dy * dy AS d2 FROM (SELECT id, greatest(lo_x - 500, 0, 500 - hi_x) AS dx, greatest(lo_y - 1000, 0, 1000 - hi_y) AS dy FROM {_BOXES})", "c2")
def box_min_d2(spark, d):
    return _boxes(spark, d).select("id", G.box_min_d2(G.lits((500, 1000)), _lo(), _hi()).alias("d2"))


@query(f"SELECT id, dx * dx + dy * dy AS d2 FROM (SELECT id, greatest(abs(500 - lo_x), abs(hi_x - 500)) AS dx, greatest(abs(1000 - lo_y), abs(hi_y - 1000)) AS dy FROM {_BOXES})", "c2")
def box_max_d2(spark, d):
    return _boxes(spark, d).select("id", G.box_max_d2(G.lits((500, 1000)), _lo(), _hi()).alias("d2"))


@query(f"SELECT id, lo_x + (hi_x - lo_x + 1) // 2 AS mid_x, lo_y + (hi_y - lo_y + 1) // 2 AS mid_y FROM {_BOXES}", "c2")
def box_mid(spark, d):
    return _boxes(spark, d).select("id", G.box_mid(F.col("lo_x"), F.col("hi_x")).alias("mid_x"), G.box_mid(F.col("lo_y"), F.col("hi_y")).alias("mid_y"))


@query(f"SELECT min(lo_x) AS lo_x, max(hi_x) AS hi_x, min(lo_y) AS lo_y, max(hi_y) AS hi_y FROM {_BOXES}", "c2")
def box_of_boxes(spark, d):
    return _boxes(spark, d).agg(*G.box_of_boxes(XY))


@query(f"SELECT id, CASE WHEN 700 < lo_x THEN 'left' WHEN 700 > hi_x THEN 'right' WHEN 700 = lo_x OR 700 = hi_x THEN 'edge' ELSE 'through' END AS side FROM {_BOXES}", "c2")
def line_side(spark, d):
    return _boxes(spark, d).select("id", G.line_side(F.col("lo_x"), F.col("hi_x"), F.lit(700)).alias("side"))


# Cleaning, snapshots, order, workloads


@query("SELECT DISTINCT x, y FROM b2", "b2")
def dedup(spark, d):
    return clean.dedup(view(spark, d, "b2"), XY)


@query("SELECT min(id) AS id, x, g AS y FROM (SELECT id, x, y // 50000 AS g FROM p2) GROUP BY x, g", "p2")
def dedup_ids(spark, d):
    return clean.dedup(view(spark, d, "p2").withColumn("y", F.floor(F.col("y") / 50000)), XY, "id")


@query("SELECT id, CAST(floor(x * 0.25) AS BIGINT) AS x, CAST(floor(y * 0.25) AS BIGINT) AS y FROM c2", "c2")
def round_down(spark, d):
    return clean.round_down(view(spark, d, "c2"), XY, 0.25)


@query("SELECT x - min(x) OVER () AS x, y - min(y) OVER () AS y FROM c2", "c2")
def shift_to_origin(spark, d):
    return clean.shift_to_origin(view(spark, d, "c2"), XY)


@query("SELECT bool_and(x BETWEEN 0 AND 2147483647 AND y BETWEEN 0 AND 2147483647) AS ok FROM c2", "c2")
def coord_check(spark, d):
    return clean.in_range(view(spark, d, "c2"), XY)


@query("SELECT x - min(x) OVER () AS x, y - min(y) OVER () AS y FROM (SELECT DISTINCT CAST(floor(x * 0.1) AS BIGINT) AS x, CAST(floor(y * 0.1) AS BIGINT) AS y FROM c2)", "c2")
def wash(spark, d):
    return clean.wash(view(spark, d, "c2"), XY, 0.1)


_SNAPS = ("snap_a", "snap_b")
_FULL = "(SELECT coalesce(a.id, b.id) AS id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.id AS aid, b.id AS bid FROM snap_a a FULL JOIN snap_b b ON a.id = b.id)"


@query("(SELECT *, 'removed' AS kind FROM (SELECT * FROM snap_a EXCEPT SELECT * FROM snap_b)) UNION ALL (SELECT *, 'added' AS kind FROM (SELECT * FROM snap_b EXCEPT SELECT * FROM snap_a))", *_SNAPS)
def diff_by_id(spark, d):
    return delta.diff_by_id(view(spark, d, "snap_a"), view(spark, d, "snap_b"), "id", XY)


@query(f"SELECT id, CASE WHEN aid IS NULL THEN 'insert' WHEN bid IS NULL THEN 'delete' ELSE 'update' END AS kind FROM {_FULL} WHERE aid IS NULL OR bid IS NULL OR ax <> bx OR ay <> by_", *_SNAPS)
def classify_delta(spark, d):
    return delta.classify(view(spark, d, "snap_a"), view(spark, d, "snap_b"), "id", XY)


@query(f"SELECT id, ax AS a_x, ay AS a_y, bx AS b_x, by_ AS b_y FROM {_FULL} WHERE ax <> bx OR ay <> by_", *_SNAPS)
def merge_conflict(spark, d):
    return delta.merge(view(spark, d, "snap_a"), view(spark, d, "snap_b"), "id", XY)[1]


@query(f"SELECT id, coalesce(ax, bx) AS x, coalesce(ay, by_) AS y FROM {_FULL} WHERE aid IS NULL OR bid IS NULL OR (ax = bx AND ay = by_)", *_SNAPS)
def merge_calm(spark, d):
    return delta.merge(view(spark, d, "snap_a"), view(spark, d, "snap_b"), "id", XY)[0]


@query("SELECT * FROM snap_a WHERE id % 3 <> 0 UNION ALL SELECT * FROM snap_b WHERE id % 10 = 0", *_SNAPS)
def apply_delta(spark, d):
    a, b = view(spark, d, "snap_a"), view(spark, d, "snap_b")
    return delta.apply(a, a.where("id % 3 = 0"), b.where("id % 10 = 0"), "id")


@query("SELECT count(*) FILTER (n > 1) AS n_repeated, sum(n)::BIGINT AS n_rows FROM (SELECT id, count(*) AS n FROM (SELECT * FROM snap_a UNION ALL SELECT * FROM snap_b) GROUP BY id)", *_SNAPS)
def dup_ids(spark, d):
    return delta.repeated_ids(view(spark, d, "snap_a").unionByName(view(spark, d, "snap_b")), "id")


@query("SELECT count(*) FILTER (n > 1) AS n_repeated FROM (SELECT x, y, count(*) AS n FROM b2 GROUP BY x, y)", "b2")
def dup_codes(spark, d):
    return delta.repeated_codes(view(spark, d, "b2"), XY)


@query("SELECT id, x, y FROM p2 ORDER BY x, id", "p2")
def sweepline_sort(spark, d):
    return clean.sweepline(view(spark, d, "p2"), "x", "id")


@query(f"SELECT id, x, y, {_duck_morton(XY, 31)} AS code FROM p2", "p2")
def curve_sorted(spark, d):
    return layout.curve_sorted(view(spark, d, "p2"), XY, "id")


@query("SELECT id, x, y FROM p2 WHERE id % 100 = 0", "p2")
def knn_queries_strided(spark, d):
    return datagen.knn_queries(view(spark, d, "p2"), "id", 100_000, 0.01)


# Joins by distance, counters


@query(f"SELECT q2.qid, p2.id, p2.x, p2.y, {_D2} AS d2 FROM q2 JOIN p2 ON {_D2} <= (2000 + 100 * (q2.qid % 7)) * (2000 + 100 * (q2.qid % 7))", "p2", "q2")
def distance_join(spark, d):
    return batch.distance_join(_p2(spark, d), view(spark, d, "q2").withColumn("r", 2000 + F.col("qid") % 7 * 100))


@query(f"SELECT q2.qid, count(p2.id) AS n FROM q2 LEFT JOIN p2 ON {_D2} <= 5000 * 5000 GROUP BY q2.qid", "p2", "q2")
def batch_radius_count(spark, d):
    return batch.radius_counts(_p2(spark, d), view(spark, d, "q2").withColumn("r", F.lit(5000)))


#: Doubles within a few units, crowded in places.
_FLOATS = "(SELECT event_id AS id, value * value / 1000 AS x, (event_id % 1000) / 997.0::DOUBLE AS y FROM events)"


def _floats(spark, d):
    from gridloom.plans.fixtures import table

    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") * F.col("value") / 1000).alias("x"), (F.col("event_id") % 1000 / F.lit(997.0)).alias("y"))


_FD2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)"


@query(f"SELECT q.id AS qid, p.id, {_FD2} AS d2, row_number() OVER (PARTITION BY q.id ORDER BY {_FD2}, p.id) AS rank FROM {_FLOATS} q JOIN {_FLOATS} p ON q.id % 100 = 0 QUALIFY rank <= 5")
def batch_knn_floats(spark, d):
    p = _floats(spark, d)
    return batch.knn(PointSet.build(p, XY, "id", check=False), p.where("id % 100 = 0").withColumnRenamed("id", "qid"), 5).select("qid", "id", "d2", "rank")


@query(f"SELECT q.id AS qid, count(*) AS n FROM {_FLOATS} q JOIN {_FLOATS} p ON q.id % 100 = 0 AND p.x BETWEEN q.x - 0.01 AND q.x + 0.01 AND p.y BETWEEN q.y - 0.05 AND q.y + 0.05 GROUP BY q.id")
def batch_range_count_floats(spark, d):
    p = _floats(spark, d)
    boxes = p.where("id % 100 = 0").select(F.col("id").alias("qid"), (F.col("x") - 0.01).alias("lo_x"), (F.col("x") + 0.01).alias("hi_x"), (F.col("y") - 0.05).alias("lo_y"), (F.col("y") + 0.05).alias("hi_y"))
    return batch.range_count(PointSet.build(p, XY, "id", check=False), boxes)


_CELLS = "(SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p2 GROUP BY floor(x / 2000.0), floor(y / 2000.0))"
_TOUCH = f"SELECT qid, count(x0) FILTER (x0 >= lo_x AND x1 <= hi_x AND y0 >= lo_y AND y1 <= hi_y) AS cells_full, count(x0) FILTER (NOT (x0 >= lo_x AND x1 <= hi_x AND y0 >= lo_y AND y1 <= hi_y)) AS cells_edge, (SELECT count(*) FROM {_CELLS}) - count(x0) AS cells_skipped FROM box2 LEFT JOIN {_CELLS} ON x0 <= hi_x AND x1 >= lo_x AND y0 <= hi_y AND y1 >= lo_y AND lo_x <= hi_x AND lo_y <= hi_y GROUP BY qid"


def _touched(spark, d):
    return layout.touched_each(layout.cell_summary(view(spark, d, "p2"), XY, 2000), view(spark, d, "box2"), XY)


@query(_TOUCH, "p2", "box2")
def cells_touched_each(spark, d):
    return _touched(spark, d)


@query(f"SELECT avg(cells_full) AS cells_full, avg(cells_edge) AS cells_edge, avg(cells_skipped) AS cells_skipped FROM ({_TOUCH})", "p2", "box2")
def cells_touched_mean(spark, d):
    return layout.mean_touched(_touched(spark, d))


@query(f"SELECT count(*) FILTER (g <= 100000000) AS cells_checked, count(*) FILTER (g > 100000000) AS cells_skipped FROM (SELECT greatest(x0 - 700, 0, 700 - x1) * greatest(x0 - 700, 0, 700 - x1) + greatest(y0 - 90000, 0, 90000 - y1) * greatest(y0 - 90000, 0, 90000 - y1) AS g FROM {_CELLS})", "p2")
def knn_cells_touched(spark, d):
    return layout.knn_touched(layout.cell_summary(view(spark, d, "p2"), XY, 2000), XY, (700, 90_000), 10**8)


# Predicates and parts of boxes


@query(
    f"SELECT id, lo_x = 500 AND lo_y = 1000 AND hi_x = 590 AND hi_y = 1500 AS same, lo_x = hi_x AS flat, (lo_x + hi_x) // 2 AS center_x, CASE WHEN lo_y + hi_y < 0 THEN -(-(lo_y + hi_y) // 2) ELSE (lo_y + hi_y) // 2 END AS center_y, "
    f"lo_x - 25 <= hi_x + 7 AND lo_x - 10 <= 600 AND hi_x + 10 >= 100 AND lo_y - 10 <= 4000 AND hi_y + 10 >= 0 AS near, hi_x - 40 >= lo_x AS legal, least(lo_x, 300) AS union_lo_x, greatest(hi_y, 2000) AS union_hi_y, sqrt(((lo_x - 500) * (lo_x - 500) + (lo_y - 1000) * (lo_y - 1000))::DOUBLE) - 250 AS gap, lo_x < 700 OR lo_x = 700 AND lo_y < 100 AS before, (lo_x + 1) // 2 AS half FROM {_BOXES}",
    "c2",
)
def box_predicates(spark, d):
    lo, hi = _lo(), _hi()
    union = G.box_union(lo, hi, G.lits((300, 0)), G.lits((400, 2000)))
    return _boxes(spark, d).select(
        "id", G.same_box(lo, hi, G.lits((500, 1000)), G.lits((590, 1500))).alias("same"), G.box_is_flat(lo, hi, 0).alias("flat"),
        G.box_center(lo[0], hi[0]).alias("center_x"), G.box_center(lo[1], hi[1]).alias("center_y"), G.boxes_within(lo, hi, G.lits((100, 0)), G.lits((600, 4000)), F.lit(10)).alias("near"),
        G.box_is_legal([lo[0]], [hi[0] - 40]).alias("legal"), union[0][0].alias("union_lo_x"), union[1][1].alias("union_hi_y"),
        G.circle_gap(lo, G.lits((500, 1000)), F.lit(250)).alias("gap"), G.precedes(lo, G.lits((700, 100))).alias("before"), G.half_up(lo[0]).alias("half"),
    )


@query("SELECT id, x - 0.5 > 2.220446049250313e-16 AS gt, x - 0.5 < -2.220446049250313e-16 AS lt, abs(x - 0.5) < 2.220446049250313e-16 AS eq, NOT (x - 0.5 < -2.220446049250313e-16) AS geq, NOT (x - 0.5 > 2.220446049250313e-16) AS leq, CASE WHEN x - 0.5 < -2.220446049250313e-16 THEN x ELSE 0.5 END AS least, CASE WHEN x - 0.5 > 2.220446049250313e-16 THEN x ELSE 0.5 END AS greatest, CASE WHEN x < -2.220446049250313e-16 THEN -x ELSE x END AS absolute, abs(x) < 2.220446049250313e-16 AS zero, NOT (x - 0.25 < -2.220446049250313e-16) AND NOT (x - 0.5 > 2.220446049250313e-16) AS inside, ceil(x / 2)::BIGINT AS half FROM (SELECT event_id AS id, 0.5 + (event_id % 3 - 1) * 1.1102230246251565e-16 * (event_id % 5) + CASE WHEN event_id % 4 = 0 THEN 0 ELSE value - 30 END AS x FROM events)")
def epsilon_comparisons(spark, d):
    from gridloom.plans.fixtures import table

    tiny = (F.col("event_id") % 3 - 1) * F.lit(2.0**-53) * (F.col("event_id") % 5)
    p = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.lit(0.5) + tiny + F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value") - 30)).alias("x"))
    x, at = F.col("x"), F.lit(0.5)
    return p.select(
        "id", G.eps_gt(x, at).alias("gt"), G.eps_lt(x, at).alias("lt"), G.eps_eq(x, at).alias("eq"), G.eps_geq(x, at).alias("geq"), G.eps_leq(x, at).alias("leq"), G.eps_min(x, at).alias("least"),
        G.eps_max(x, at).alias("greatest"), G.eps_abs(x).alias("absolute"), G.eps_is_zero(x).alias("zero"), G.eps_in_box([x], [F.lit(0.25)], [at]).alias("inside"), G.half_up(x, False).alias("half"),
    )


@query("SELECT id, CASE WHEN x < 700 THEN CASE WHEN y < 100000 THEN CASE WHEN x < 350 THEN 0 ELSE 1 END ELSE CASE WHEN x < 200 THEN 2 ELSE 3 END END ELSE CASE WHEN y < 200000 THEN CASE WHEN x < 1000 THEN 4 ELSE 5 END ELSE CASE WHEN y < 300000 THEN 6 ELSE 7 END END END AS bucket FROM p2", "p2")
def find_bucket(spark, d):
    pivots = [(0, 700), (1, 100_000), (1, 200_000), (0, 350), (0, 200), (0, 1000), (1, 300_000)]
    return view(spark, d, "p2").select("id", G.find_bucket(G.cols(XY), pivots).alias("bucket"))


@query(f"SELECT id, part, CASE WHEN part >= 2 THEN lo_x + (hi_x - lo_x + 1) // 2 ELSE lo_x END AS lo_x, CASE WHEN part >= 2 THEN hi_x ELSE lo_x + (hi_x - lo_x + 1) // 2 END AS hi_x, CASE WHEN part % 2 = 1 THEN lo_y + (hi_y - lo_y + 1) // 2 ELSE lo_y END AS lo_y, CASE WHEN part % 2 = 1 THEN hi_y ELSE lo_y + (hi_y - lo_y + 1) // 2 END AS hi_y FROM {_BOXES}, (SELECT unnest([0, 1, 2, 3]) AS part)", "c2")
def child_boxes(spark, d):
    lo, hi = _lo(), _hi()
    parts = G.child_boxes(lo, hi, [G.box_mid(a, b) for a, b in zip(lo, hi, strict=True)])
    each = F.array(*[F.struct(F.lit(i).alias("part"), a[0].alias("lo_x"), b[0].alias("hi_x"), a[1].alias("lo_y"), b[1].alias("hi_y")) for i, (a, b) in enumerate(parts)])
    return _boxes(spark, d).select("id", F.explode(each).alias("p")).select("id", "p.*")


@query("SELECT g, n - gone < 24 AS sparse, abs(100.0::DOUBLE * low / n - 50) > 30 AS imbalanced FROM (SELECT x % 500 AS g, count(*) AS n, count(*) FILTER (id % 3 > 0) AS gone, count(*) FILTER (y < 100000) AS low FROM p2 GROUP BY 1)", "p2")
def merge_tests(spark, d):
    cells = view(spark, d, "p2").groupBy((F.col("x") % 500).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % 3 > 0).alias("gone"), F.count_if(F.col("y") < 100_000).alias("low"))
    return cells.select("g", layout.sparse(F.col("n"), F.col("gone")).alias("sparse"), layout.imbalanced(F.col("low"), F.col("n")).alias("imbalanced"))


# Ordered sets: single entries, parts, conditions


@query("SELECT * FROM p2 WHERE x < (SELECT min(x) FROM p2 WHERE y > 450000) OR x = (SELECT min(x) FROM p2 WHERE y > 450000) AND id < (SELECT arg_min(id, (x, id)) FROM p2 WHERE y > 450000)", "p2")
def take_while(spark, d):
    return keyed.take_while(view(spark, d, "p2"), ["x", "id"], F.col("y") <= 450_000)


@query("SELECT x, n, hi_y FROM (SELECT x, count(*) AS n, max(y) AS hi_y FROM p2 GROUP BY x) WHERE hi_y > 300000", "p2")
def aggregate_filter(spark, d):
    groups = view(spark, d, "p2").groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("hi_y"))
    return keyed.aggregate_filter(groups, F.col("hi_y") > 300_000)


@query("SELECT sum(y)::BIGINT AS total FROM p2 WHERE id >= 5000", "p2")
def range_sum(spark, d):
    return keyed.aggregate_range(view(spark, d, "p2"), ["id"], (5000,), None, total=F.sum("y"))


@query("SELECT id, x, y FROM p2 ORDER BY x, id LIMIT 50 OFFSET 20", "p2")
def subsequence(spark, d):
    return keyed.between_ranks(view(spark, d, "p2"), ["x", "id"], 20, 70)


@query("SELECT id, x, y, row_number() OVER (ORDER BY x DESC, id DESC) - 1 AS rank FROM p2 ORDER BY x DESC, id DESC LIMIT 30", "p2")
def reverse(spark, d):
    return keyed.reverse(view(spark, d, "p2"), ["x", "id"]).limit(30).withColumn("rank", F.monotonically_increasing_id())


@query("SELECT q2.qid AS id, snap_a.x, snap_a.y FROM q2 LEFT JOIN snap_a ON snap_a.id = q2.qid", "q2", "snap_a")
def find(spark, d):
    return keyed.find(view(spark, d, "snap_a"), view(spark, d, "q2").select(F.col("qid").alias("id")), ["id"])


@query("SELECT a.id, coalesce(b.x, a.x) AS x, coalesce(b.y, a.y) AS y FROM snap_a a LEFT JOIN snap_b b ON a.id = b.id", *_SNAPS)
def update_found(spark, d):
    return keyed.update_found(view(spark, d, "snap_a"), view(spark, d, "snap_b"), ["id"])


@query("SELECT * FROM c2 WHERE id NOT IN (1, 2) UNION ALL SELECT 1, 7, 9", "c2")
def single_updates(spark, d):
    return keyed.remove_one(keyed.insert_one(view(spark, d, "c2"), id=1, x=7, y=9), ["id"], (2,))


@query("SELECT true AS same, false AS other", "c2")
def keyed_equal(spark, d):
    a, b = view(spark, d, "c2"), view(spark, d, "c2").where("id >= 0")
    return spark.createDataFrame([(keyed.equal(a, b), keyed.equal(a, b.where("id > 5")))], "same boolean, other boolean")


@query("SELECT id, x + 1 AS x, y FROM c2 WHERE id <= 100 UNION ALL SELECT id, x, y FROM c2 WHERE id > 100", "c2")
def append(spark, d):
    c = view(spark, d, "c2")
    return keyed.append(keyed.map_values(c.where("id <= 100"), x=F.col("x") + 1), c.where("id > 100"))


@query("SELECT x, max(y) AS y FROM p2 GROUP BY x", "p2")
def from_sorted(spark, d):
    p = view(spark, d, "p2").select("x", "y")
    return keyed.from_sorted(p.repartition("x").sortWithinPartitions("x", "y"), ["x"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
