from itertools import pairwise, product

import pytest
from pyspark.sql import functions as F

from gridloom.functions import curves
from gridloom.operators import datagen, layout
from gridloom.operators.pointset import PointSet
from gridloom.sources import points_text


@pytest.mark.parametrize(("d", "side"), [(2, 8), (3, 4)])
def test_hilbert_visits_every_cell_by_unit_steps(spark, d, side):
    names = ["x", "y", "z"][:d]
    df = spark.createDataFrame(list(product(range(side), repeat=d)), ", ".join(f"{c} long" for c in names))
    rows = sorted((r[-1], r[:-1]) for r in map(tuple, df.select(*names, curves.hilbert([F.col(c) for c in names])).collect()))
    assert [r[0] for r in rows] == list(range(side**d))
    assert all(sum(abs(p - q) for p, q in zip(a[1], b[1], strict=True)) == 1 for a, b in pairwise(rows))


def test_known_codes(spark):
    df = spark.createDataFrame([(2, 3, 14, 11), (10**9, 10**9, 1139344515728670720, 759563010485780480), (2**31 - 1, 0, None, 2**62 - 1)], "x long, y long, m long, h long")
    for r in df.select("m", "h", curves.morton([F.col("x"), F.col("y")]).alias("gm"), curves.hilbert([F.col("x"), F.col("y")]).alias("gh")).collect():
        assert r.m in (None, r.gm) and r.h == r.gh
    back = df.select("x", "y", *[c.alias(n) for c, n in zip(curves.morton_decode(curves.morton([F.col("x"), F.col("y")]), 2), "ab", strict=True)]).collect()
    assert all((r.x, r.y) == (r.a, r.b) for r in back)
    with pytest.raises(ValueError):
        curves.morton([F.lit(1)] * 4)


def test_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, 7 * i % 1000, 13 * i % 1000) for i in range(100)], "id long, x long, y long")
    points_text.write_points(df, str(tmp_path / "p"), ("x", "y"), order="id")
    back = points_text.read_points(spark, str(tmp_path / "p"), 2, id_offset=0)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        points_text.read_points(spark, str(tmp_path / "p"), 3)
    assert points_text.sibling("a/1.in") == "a/2.in" and points_text.sibling("2.in") == "0.in"


def test_generators_are_reproducible_and_in_range(spark):
    for made in (datagen.uniform, datagen.varden):
        a, b = (sorted(map(tuple, made(spark, 500, 2, 1000, seed=3).collect())) for _ in range(2))
        assert a == b and len(a) == 500 and all(0 <= v <= 1000 for r in a for v in r[1:])
    ball = datagen.sphere(spark, 200, 3, 10.0, seed=1).collect()
    assert all(r.x**2 + r.y**2 + r.z**2 <= 100.001 for r in ball)


def test_kd_cells_hold_all_points(spark):
    df = datagen.uniform(spark, 400, 2, 1000, seed=5)
    cells = layout.kd_cells(PointSet.build(df, ("x", "y"), "id"), 3)
    sizes = [r["count"] for r in cells.groupBy("cell").count().collect()]
    assert sum(sizes) == 400 and len(sizes) == 8 and max(sizes) < 80
    assert layout.cell_statistics(cells).first().max_depth == 3
