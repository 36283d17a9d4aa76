"""The text format of points: a first line `N d`, then a point of d numbers on each line; and imports that lead to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.datagen import names


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(_line, value): the lines of text that are not blank, numbered from 0 in the order of files and of places in them.

    A split of a file is known by its offset; one row for each split is enough to tell at which number it begins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")).where(F.trim("value") != "")
    lines = lines.withColumn("_i", F.monotonically_increasing_id())
    splits = lines.groupBy("_f", "_b").agg(F.count("_i").alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.withColumn("_start", before).drop("_n")
    return lines.join(starts, ["_f", "_b"]).select((F.col("_start") + F.col("_i") - F.col("_first")).alias("_line"), "value")


def read_points(spark: SparkSession, path: str, d: int, coord_type: str = "long", id_offset: int = 0) -> DataFrame:
    """(id, coordinates); ids count the lines from id_offset. One pass of the text, one more to count lines by split."""
    numbered = _numbered(spark, path)
    head = numbered.where("_line = 0").first()
    if head is None:
        return spark.createDataFrame([], "id long, " + ", ".join(f"{c} {coord_type}" for c in names(d)))
    n, dims = (int(x) for x in head.value.split()[:2])
    if dims != d:
        raise ValueError(f"{path} has {dims} dimensions, not {d}")
    return _points(numbered.where((F.col("_line") > 0) & (F.col("_line") <= n)), 1 - id_offset, d, coord_type)


def _points(lines: DataFrame, first: int, d: int, coord_type: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    kind = "double" if coord_type == "double" else "long"
    return lines.select((F.col("_line") - first).alias("id"), *[F.get(parts, i).cast(kind).alias(c) for i, c in enumerate(names(d))])


#: First lines of geometry files.
HEADERS = {2: "pbbs_sequencePoint2d", 3: "pbbs_sequencePoint3d"}
TRIANGLES = "pbbs_triangles"


def read_geometry_points(spark: SparkSession, path: str, d: int) -> DataFrame:
    """(id, coordinates as doubles) of a geometry file: a header, then a point on each line."""
    numbered = _numbered(spark, path)
    head = numbered.where("_line = 0").first()
    if head is None or head.value.strip() != HEADERS[d]:
        raise ValueError(f"{path} does not begin with {HEADERS[d]}")
    return _points(numbered.where("_line > 0"), 1, d, "double")


def write_geometry_points(points: DataFrame, path: str, coords: Sequence[str], order: str | None = None) -> None:
    _write_lines(points, path, coords, HEADERS[len(coords)], order)


def read_triangles(spark: SparkSession, path: str, d: int = 3) -> tuple[DataFrame, DataFrame]:
    """Points (id, coordinates) and triangles (id, a, b, c: ids of points) of a file: a header, both numbers, then their lines."""
    numbered = _numbered(spark, path)
    head = [r.value.strip() for r in numbered.where("_line < 3").orderBy("_line").collect()]
    if len(head) < 3 or head[0] != TRIANGLES:
        raise ValueError(f"{path} does not begin with {TRIANGLES}")
    n, m = int(head[1]), int(head[2])
    corners = F.split(F.trim("value"), r"\s+")
    triangles = numbered.where((F.col("_line") >= 3 + n) & (F.col("_line") < 3 + n + m)).select((F.col("_line") - 3 - n).alias("id"), *[F.get(corners, i).cast("long").alias(c) for i, c in enumerate("abc")])
    return _points(numbered.where((F.col("_line") >= 3) & (F.col("_line") < 3 + n)), 3, d, "double"), triangles


def log_summary(spark: SparkSession, path: str, columns: Sequence[int] = (2, -6, -4, -2)) -> DataFrame:
    """(alpha, column, avg, max) of logs with lines of numbers under `alpha: N`; negative columns count from the end of a line."""
    lines = _numbered(spark, path).withColumn("_alpha", F.regexp_extract("value", r"alpha: ([0-9]+)", 1))
    heads = lines.where("_alpha <> ''").select(F.col("_line").alias("_from"), F.col("_alpha").cast("int").alias("alpha"))
    ends = heads.withColumn("_to", F.lead("_from").over(W.orderBy("_from")))  # one row for each section
    rows = lines.where("_alpha = ''").join(ends, (F.col("_line") > F.col("_from")) & (F.col("_to").isNull() | (F.col("_line") < F.col("_to"))))
    parts = F.split(F.trim("value"), r"\s+")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.try_element_at(parts, F.lit(c + 1 if c >= 0 else c)).cast("double").alias("value")) for c in columns]))
    return rows.select("alpha", each.alias("v")).groupBy("alpha", "v.column").agg(F.avg("v.value").alias("avg"), F.max("v.value").alias("max"))


def write_points(points: DataFrame, path: str, coords: Sequence[str], order: str | None = None) -> None:
    """A text file with its header; for large sets keep Parquet, which this is not meant to replace."""
    _write_lines(points, path, coords, f"{points.count()} {len(coords)}", order)


def _write_lines(points: DataFrame, path: str, coords: Sequence[str], header: str, order: str | None) -> None:
    """Lines in the order of the column, a file for each range of it, under names that sort alike; the header begins the first."""
    place = F.col(order).cast("double") if order else F.monotonically_increasing_id().cast("double")
    head = points.sparkSession.createDataFrame([(header,)], "value string").select("value", F.lit(float("-inf")).alias("_o"))
    rows = points.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in coords]).alias("value"), place.alias("_o"))
    head.unionByName(rows).repartitionByRange("_o").sortWithinPartitions("_o").select("value").write.mode("overwrite").text(path)


def drop_leading(spark: SparkSession, path: str, out: str) -> None:
    """Take the first number off every line but the header."""
    numbered = _numbered(spark, path)
    stripped = F.when(F.col("_line") == 0, F.col("value")).otherwise(F.regexp_replace(F.trim("value"), r"^\S+\s*", ""))
    numbered.repartitionByRange("_line").sortWithinPartitions("_line").select(stripped.alias("value")).write.mode("overwrite").text(out)


def sibling(path: str, ways: int = 3) -> str:
    """The insert file that goes with 1.in, 2.in, ...: the next number, around `ways`."""
    head, _, name = path.rpartition("/")
    stem, dot, kind = name.partition(".")
    return f"{head}{'/' if head else ''}{(int(stem) + 1) % ways}{dot}{kind}"


def import_nodes(spark: SparkSession, path: str, out: str, start: str, end: str, time: str = "timestamp", lon: str = "lon", lat: str = "lat") -> None:
    """A map extract in CSV (with time, lon, lat) as de-duplicated points by year and month."""
    rows = spark.read.csv(path, header=True, schema=f"{time} timestamp, {lon} double, {lat} double", enforceSchema=False)
    kept = rows.where(F.col(time).between(start, end)).dropDuplicates()
    kept.select(lon, lat, F.year(time).alias("year"), F.month(time).alias("month")).write.mode("overwrite").partitionBy("year", "month").parquet(out)
