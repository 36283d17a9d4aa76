"""How points lie on disk: grid cells with summaries, curve order, median and midpoint cells.

A layout never changes an answer. Summaries let a box count add whole cells and scan only
the cells on the box's edge; curve order gives files narrow ranges of all coordinates, so
that the scan's own statistics skip most of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions.curves import encode
from gridloom.operators.pointset import Box, PointSet

LEAF = 32


def with_cells(points: DataFrame, coords: Sequence[str], width: float) -> DataFrame:
    """Adds the grid cell of each point, cell_c for each coordinate c."""
    return points.withColumns({f"cell_{c}": F.floor(F.col(c) / F.lit(width)) for c in coords})


def cell_summary(points: DataFrame, coords: Sequence[str], width: float, **more: Column) -> DataFrame:
    """Count and tight box of every occupied cell, and any further aggregates."""
    made = [e for c in coords for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    return with_cells(points, coords, width).groupBy(*(f"cell_{c}" for c in coords)).agg(F.count(F.lit(1)).alias("n"), *made, *[e.alias(c) for c, e in more.items()])


def range_count(points: PointSet, summary: DataFrame, width: float, box: Box) -> DataFrame:
    """As PointSet.range_count: cells inside the box count whole, points are scanned only in those on its edge."""
    coords = points.coords
    lo, hi, blo, bhi = [F.col(f"lo_{c}") for c in coords], [F.col(f"hi_{c}") for c in coords], G.lits(box.lo), G.lits(box.hi)
    inside = G.box_in_box(lo, hi, blo, bhi)
    whole = summary.where(inside).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    cells = [f"cell_{c}" for c in coords]
    edge = summary.where(G.boxes_intersect(lo, hi, blo, bhi) & ~inside).select(*cells)
    scan = with_cells(points.df.where(points._in(box)), coords, width).join(edge, cells, "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return whole.unionByName(scan).agg(F.sum("n").cast("long").alias("n"))


def touched(summary: DataFrame, coords: Sequence[str], box: Box) -> DataFrame:
    """How many cells a box takes whole, must scan, and skips."""
    lo, hi, blo, bhi = [F.col(f"lo_{c}") for c in coords], [F.col(f"hi_{c}") for c in coords], G.lits(box.lo), G.lits(box.hi)
    relation = G.box_relation(lo, hi, blo, bhi)
    return summary.agg(F.count_if(relation == 1).alias("cells_full"), F.count_if(relation == 0).alias("cells_edge"), F.count_if(relation == -1).alias("cells_skipped"))


def curve_sorted(points: DataFrame, coords: Sequence[str], id: str | None = None, curve: str = "morton", tasks: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by (code, id); adds `code`. Shift to the origin first: curves take no negatives."""
    keys = ["code", *([id] if id else [])]
    coded = points.withColumn("code", encode(curve, G.cols(coords)))
    n = tasks or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return coded.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def write_sorted(points: DataFrame, path: str, coords: Sequence[str], id: str | None = None, curve: str = "morton", tasks: int | None = None) -> None:
    curve_sorted(points, coords, id, curve, tasks).write.mode("overwrite").parquet(path)


def compact(points: DataFrame, path: str, coords: Sequence[str], id: str | None = None, curve: str = "morton") -> DataFrame:
    """Rewrite after many updates: lineage and small files go. path must not hold the input."""
    write_sorted(points.drop("code"), path, coords, id, curve)
    return points.sparkSession.read.parquet(path)


def orth_cell(p: Sequence[Column], lo: Sequence[Column], hi: Sequence[Column], integral: bool = True) -> Column:
    """Which of the 2**d halves-by-midpoint of a box a point is in: a bit for each dimension, the first highest; on the cut is right."""
    code = F.lit(0)
    for c, a, b in zip(p, lo, hi, strict=True):
        code = code * 2 + (c >= G.box_mid(a, b, integral)).cast("int")
    return code


def cut_dim(lo: Sequence[Column], hi: Sequence[Column], depth: int | Column, rule: str) -> Column:
    """rotate: by depth; stretch: the widest side, the first of equals."""
    if rule == "rotate":
        return F.lit(depth) % F.lit(len(lo))
    out, widest = F.lit(0), hi[0] - lo[0]
    for i in range(1, len(lo)):
        out, widest = F.when(hi[i] - lo[i] > widest, i).otherwise(out), F.greatest(widest, hi[i] - lo[i])
    return out


def divided_dim(lo: Sequence[Column], hi: Sequence[Column], dim: Column) -> Column:
    """The first dimension from dim on, around the end, in which points differ: a cut across another one would divide nothing."""
    d, out = len(lo), dim
    for step in range(d - 1, -1, -1):
        at = (dim + step) % d
        out = F.when(F.element_at(F.array(*hi), at + 1) > F.element_at(F.array(*lo), at + 1), at).otherwise(out)
    return out


def _boxes(df: DataFrame, coords: Sequence[str]) -> DataFrame:
    return df.groupBy("cell").agg(*[e for c in coords for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))], F.count(F.lit(1)).alias("n"))


def median_position(values: DataFrame, value: str, place: int) -> DataFrame:
    """The value at a 0-based place in order, as `cut`. Counts of equal values are added up, not rows sorted in one task."""
    n = values.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    parts = n.repartitionByRange(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), value).withColumn("_part", F.spark_partition_id()).persist()
    starts = parts.groupBy("_part").agg(F.sum("n").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    upto = F.col("_start") + F.sum("n").over(W.partitionBy("_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return parts.join(starts, "_part").withColumn("upto", upto).where(F.col("upto") > place).agg(F.min(value).alias("cut"))


def object_median(values: DataFrame, value: str) -> DataFrame:
    """The cut at the n/2-th value (0-based) and how many go left of it.

    Equal values go right, unless the cut is the minimum: then they go left."""
    n = values.count()
    cut = median_position(values, value, n // 2)
    low = values.agg(F.min(value).alias("low"))
    left = F.when(F.col("cut") == F.col("low"), F.col(value) <= F.col("cut")).otherwise(F.col(value) < F.col("cut"))
    one = cut.join(F.broadcast(low))  # a row each
    return values.select(value).join(F.broadcast(one)).groupBy("cut").agg(F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"))


def kd_cells(points: PointSet, depth: int, dim: str = "rotate", rule: str = "object", leaf: int = LEAF) -> DataFrame:
    """Points with the `cell` that `depth` levels of cuts put them in (1 is all; 2c and 2c + 1 are halves of c).

    rule: cut at the median of the points (object; to within percentile_approx's 1/10000) or at the
    middle of their box (spatial). Cells of at most `leaf` points, and of points all alike, stay."""
    coords = points.coords
    out = points.df.withColumn("cell", F.lit(1).cast("long"))
    for level in range(depth):
        box = _boxes(out, coords)
        lo, hi = [F.col(f"lo_{c}") for c in coords], [F.col(f"hi_{c}") for c in coords]
        box = box.withColumn("dim", divided_dim(lo, hi, cut_dim(lo, hi, level, dim))).where((F.col("n") > leaf) & ~G.same_point(lo, hi))
        value = F.element_at(F.array(*coords), F.col("dim") + 1)
        if rule == "spatial":
            integral = points.df.schema[coords[0]].dataType.simpleString() == "bigint"
            box = box.withColumn("cut", F.element_at(F.array(*[G.box_mid(a, b, integral) for a, b in zip(lo, hi, strict=True)]), F.col("dim") + 1)).select("cell", "dim", "cut", F.lit(False).alias("least"))
        else:
            cuts = out.join(box.select("cell", "dim"), "cell").groupBy("cell", "dim").agg(F.percentile_approx(value, 0.5).alias("cut"), F.min(value).alias("low"))
            # The median itself goes right; where it is the minimum, what exceeds it does.
            box = cuts.select("cell", "dim", "cut", (F.col("cut") == F.col("low")).alias("least"))
        value = F.element_at(F.array(*coords), F.col("dim") + 1)
        right = F.coalesce((value > F.col("cut")) | (value == F.col("cut")) & ~F.col("least"), F.lit(False))
        split = F.when(F.col("cut").isNull(), F.col("cell")).otherwise(F.col("cell") * 2 + right.cast("long"))
        out = out.join(box, "cell", "left").withColumn("cell", split).drop("dim", "cut", "least")
    return out


def cell_statistics(cells: DataFrame) -> DataFrame:
    """Leaves, deepest and mean depth of kd_cells()' result."""
    depth = F.floor(F.log2("cell"))
    return cells.select("cell").distinct().agg(F.count(F.lit(1)).alias("n_leaves"), F.max(depth).alias("max_depth"), F.avg(depth).alias("avg_depth"))


def imbalanced(left: Column, n: Column, ratio: int = 30) -> Column:
    """Whether the left of n points is further than ratio percent from half."""
    return (n == 0) | (F.abs(F.lit(100.0) * left / n - 50) > ratio)


def sparse(n: Column, removed: Column, least: int = 24) -> Column:
    """Whether so few of n points are left that their cell should be merged."""
    return n - removed < least


def touched_each(summary: DataFrame, boxes: DataFrame, coords: Sequence[str], qid: str = "qid") -> DataFrame:
    """touched() for every row of boxes (lo_c, hi_c): cells meet boxes by the coarse grid of batch.range_join, as boxes with boxes."""
    from gridloom.operators.batch import box_join

    cells = summary.select(*[F.col(f"lo_{c}").alias(f"cell_lo_{c}") for c in coords], *[F.col(f"hi_{c}").alias(f"cell_hi_{c}") for c in coords])
    met = box_join(cells, boxes, coords, "cell_lo_", "cell_hi_")
    inside = G.box_in_box([F.col(f"cell_lo_{c}") for c in coords], [F.col(f"cell_hi_{c}") for c in coords], [F.col(f"lo_{c}") for c in coords], [F.col(f"hi_{c}") for c in coords])
    found = met.groupBy(qid).agg(F.count_if(inside).alias("cells_full"), F.count_if(~inside).alias("cells_edge"))
    total = summary.agg(F.count(F.lit(1)).alias("_all"))
    out = boxes.select(qid).join(found, qid, "left").fillna(0, ["cells_full", "cells_edge"]).join(F.broadcast(total))  # one row
    return out.select(qid, "cells_full", "cells_edge", (F.col("_all") - F.col("cells_full") - F.col("cells_edge")).alias("cells_skipped"))


def mean_touched(touched: DataFrame) -> DataFrame:
    """The mean of each counter over all queries."""
    return touched.agg(*[F.avg(c).alias(c) for c in touched.columns if c.startswith("cells_")])


def knn_touched(summary: DataFrame, coords: Sequence[str], q: Sequence[int | float], far: int | float) -> DataFrame:
    """How many cells a nearest-neighbour search whose k-th squared distance is far must check, and skips."""
    near = G.box_min_d2(G.lits(q), [F.col(f"lo_{c}") for c in coords], [F.col(f"hi_{c}") for c in coords])
    return summary.agg(F.count_if(near <= far).alias("cells_checked"), F.count_if(near > far).alias("cells_skipped"))


def validate(points: PointSet, summary: DataFrame, width: float) -> list[str]:
    """What is wrong with a summary of these points; nothing if it holds."""
    fresh = cell_summary(points.df, points.coords, width)
    out = [] if fresh.select(*summary.columns).exceptAll(summary).isEmpty() and summary.exceptAll(fresh.select(*summary.columns)).isEmpty() else ["cells differ from the points"]
    lo, hi = [F.col(f"lo_{c}") for c in points.coords], [F.col(f"hi_{c}") for c in points.coords]
    return out + ([] if summary.where(G.box_is_empty(lo, hi) | (F.col("n") <= 0)).isEmpty() else ["a cell is empty"])
