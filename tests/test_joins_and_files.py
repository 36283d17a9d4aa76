import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.functions import curves
from gridloom.operators import batch, datagen, delta, layout
from gridloom.operators.pointset import PointSet
from gridloom.sources import points_text


def clouds():
    r = random.Random(5)
    clustered = [(i, 1000 * (i % 3) + r.gauss(0, 10 ** -(i % 5)), 50 + r.gauss(0, 10 ** -(i % 4))) for i in range(500)]
    return {
        "unit": [(i, r.random(), r.random()) for i in range(400)],
        "clustered": clustered + [(500 + i, 1e6 * r.random(), -1e6 * r.random()) for i in range(5)],
        "tiny": [(i, 1e-7 * r.random(), 5.0) for i in range(300)],
        "alike": [(i, 0.25, -0.25) for i in range(60)],
    }


@pytest.mark.parametrize("cloud", list(clouds()))
def test_joins_of_doubles(spark, cloud):
    rows = clouds()[cloud]
    p = PointSet.build(spark.createDataFrame(rows, "id long, x double, y double"), ("x", "y"), "id")
    asked = [(q, x + 1e-3 * (q % 2), y) for q, x, y in rows if q % 20 == 0] + [(9000, -5.0, 7.5)]
    queries = spark.createDataFrame(asked, "qid long, x double, y double")
    for k in (1, 7, 1000):
        want = {q: sorted(((a - x) * (a - x) + (b - y) * (b - y), i) for i, a, b in rows)[:k] for q, x, y in asked}
        for f in (batch.knn, batch.knn_naive):
            got = {}
            for r in f(p, queries, k).orderBy("qid", "rank").collect():
                got.setdefault(r.qid, []).append((r.d2, r.id))
            assert got == want, (f.__name__, k)
    sides = [(q, x - w, x + w, y - h, y + h) for q, x, y in asked for w, h in [((q % 7) * 1e-3, (q % 5) * 10.0**-(q % 9))]] + [(9001, 1.0, 0.0, 0.0, 1.0)]
    boxes = spark.createDataFrame(sides, "qid long, lo_x double, hi_x double, lo_y double, hi_y double")
    found = Counter((r.qid, r.id) for r in batch.range_query(p, boxes).collect())
    assert found == Counter((q, i) for q, a, b, c, d in sides for i, x, y in rows if a <= x <= b and c <= y <= d)
    near = batch.distance_join(p, queries.withColumn("r", F.lit(0.05)))
    assert Counter((r.qid, r.id) for r in near.collect()) == Counter((q, i) for q, x, y in asked for i, a, b in rows if (a - x) * (a - x) + (b - y) * (b - y) <= 0.05 * 0.05)


def test_thin_boxes_and_boxes_of_boxes(spark):
    r = random.Random(3)
    rows = [(i, r.randint(-1000, 1000), r.randint(0, 10**9)) for i in range(800)]
    p = PointSet.build(spark.createDataFrame(rows, "id long, x long, y long"), ("x", "y"), "id")
    sides = [(0, 5, 6, 0, 10**9), (1, -1000, 1000, 7, 7), (2, 0, 0, 0, 0), (3, -1000, 1000, 0, 10**9)] + [(4 + k, rows[k][1], rows[k][1], rows[k][2], rows[k][2]) for k in range(5)]
    boxes = spark.createDataFrame(sides, "qid long, lo_x long, hi_x long, lo_y long, hi_y long")
    want = {q: sum(a <= x <= b and c <= y <= d for _, x, y in rows) for q, a, b, c, d in sides}
    assert {r.qid: r.n for r in batch.range_count(p, boxes).collect()} == want
    cells = layout.cell_summary(p.df, ("x", "y"), 250)
    for row in layout.touched_each(cells, boxes, ("x", "y")).collect():
        _, a, b, c, d = sides[row.qid]
        kinds = Counter("full" if a <= s.lo_x and s.hi_x <= b and c <= s.lo_y and s.hi_y <= d else "edge" if s.lo_x <= b and s.hi_x >= a and s.lo_y <= d and s.hi_y >= c else "skipped" for s in cells.collect())
        assert (row.cells_full, row.cells_edge, row.cells_skipped) == (kinds["full"], kinds["edge"], kinds["skipped"])
    none = spark.createDataFrame([(1, 5, 4, 0, 1)], "qid long, lo_x long, hi_x long, lo_y long, hi_y long")
    assert [tuple(x) for x in batch.range_count(p, none).collect()] == [(1, 0)]


@pytest.mark.parametrize("name", ["hilbert", "morton"])
def test_code_ranges_and_successors(name, spark):
    side = range(16)
    cells = spark.createDataFrame([(x, y) for x in side for y in side], "x long, y long")
    code = {(r.x, r.y): r.c for r in cells.select("x", "y", curves.encode(name, [F.col("x"), F.col("y")]).alias("c")).collect()}
    r = random.Random(1)
    for most in (4, 10**6):
        for _ in range(12):
            lo = [r.randint(0, 15), r.randint(0, 15)]
            hi = [r.randint(lo[0], 15), r.randint(lo[1], 15)]
            inside = {c for (x, y), c in code.items() if lo[0] <= x <= hi[0] and lo[1] <= y <= hi[1]}
            ranges = curves.code_ranges(lo, hi, name, most)
            covered = {c for c in code.values() if any(a <= c <= b for a, b in ranges)}
            assert inside <= covered and (most == 4 or inside == covered) and ranges == sorted(ranges)
            at = r.randint(0, 260)
            assert curves.next_in_box(at, lo, hi, name) == min((c for c in inside if c >= at), default=None)
    some = spark.createDataFrame([(r.randint(0, 2**21 - 1), r.randint(0, 2**21 - 1), r.randint(0, 2**21 - 1)) for _ in range(50)], "x long, y long, z long")
    back = curves.hilbert_decode(curves.hilbert([F.col(c) for c in "xyz"]), 3)
    assert all((q.x, q.y, q.z) == (q.a, q.b, q.c) for q in some.select("x", "y", "z", *[v.alias(n) for v, n in zip(back, "abc", strict=True)]).collect())


def test_subset_boxes_hold_what_they_say(spark):
    rows = datagen.uniform(spark, 3000, 2, 10_000, seed=4).cache()
    points = [(r.x, r.y) for r in rows.collect()]
    made = datagen.subset_boxes(rows, ("x", "y"), 50, 200, seed=9).collect()
    assert len(made) > 10 and all(50 <= m.n <= 200 for m in made)
    # A cut across one side leaves subsets apart, so their tight boxes hold no more points than they count.
    assert all(sum(m.lo_x <= x <= m.hi_x and m.lo_y <= y <= m.hi_y for x, y in points) >= m.n for m in made)
    assert datagen.subset_boxes(rows.limit(0), ("x", "y"), 1, 2).collect() == []


def test_object_median_cells_by_brute_force(spark):
    r = random.Random(6)
    rows = [(i, r.choice([0.0, 0.25, 0.5, 7.0]), r.random()) for i in range(300)]
    cells = layout.kd_cells(PointSet.build(spark.createDataFrame(rows, "id long, x double, y double"), ("x", "y"), "id"), 2)
    got = {x.id: x.cell for x in cells.collect()}

    def cut(own, cell, level):
        if level == 2 or len(own) <= 32:
            return dict.fromkeys((i for i, *_ in own), cell)
        dim = 1 + level % 2
        if len({p[dim] for p in own}) == 1:
            dim = 3 - dim
        values = sorted(p[dim] for p in own)
        at = values[(len(values) + 1) // 2 - 1]
        right = [p for p in own if (p[dim] > at if at == values[0] else p[dim] >= at)]
        return cut([p for p in own if p not in right], 2 * cell, level + 1) | cut(right, 2 * cell + 1, level + 1)

    assert got == cut(rows, 1, 0)


def test_geometry_files_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 0.5, -1.0 * i, float(i % 7)) for i in range(200)], "id long, x double, y double, z double")
    at = str(tmp_path / "g")
    points_text.write_geometry_points(df, at, ("x", "y", "z"), order="id")
    assert sorted(map(tuple, points_text.read_geometry_points(spark, at, 3).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        points_text.read_geometry_points(spark, at, 2)
    (tmp_path / "t.txt").write_text("pbbs_triangles\n3\n1\n0 0 0\n1 0 0\n0 1 0\n0 1 2\n")
    points, triangles = points_text.read_triangles(spark, str(tmp_path / "t.txt"))
    assert [tuple(r) for r in points.orderBy("id").collect()] == [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)]
    assert [tuple(r) for r in triangles.collect()] == [(0, 0, 1, 2)]
    (tmp_path / "log.txt").write_text("alpha: 1\n1 2 3 4 5 6 7 8\n1 2 5 4 5 6 7 8\nalpha: 2\n0 0 9 1 1 1 1 1\n")
    got = {(r.alpha, r.column): (r.avg, r.max) for r in points_text.log_summary(spark, str(tmp_path / "log.txt")).collect()}
    assert got[1, 2] == (4.0, 5.0) and got[2, 2] == (9.0, 9.0) and got[1, -2] == (7.0, 7.0) and got[1, -6] == (4.0, 5.0)
    points_text.write_points(df, str(tmp_path / "p"), ("x", "y", "z"), order="id")
    points_text.drop_leading(spark, str(tmp_path / "p"), str(tmp_path / "q"))
    lines = [r._line for r in points_text._numbered(spark, str(tmp_path / "q")).orderBy("_line").collect()]
    assert lines == list(range(201))


def test_workloads(spark):
    df = spark.createDataFrame([(i, i % 10, i) for i in range(100)], "id long, x long, y long")
    inserts, deletes = delta.split_workload(df, "id", 1000, 0.25, order="x")
    assert inserts.count() == 25 and deletes.count() == 75 and inserts.agg(F.min("id")).first()[0] >= 1000
    assert inserts.agg(F.max("x")).first()[0] <= deletes.agg(F.min("x")).first()[0]
    both = delta.merge_ordered(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["x", "id"]).collect()
    assert [(r.x, r.id) for r in both] == sorted((r.x, r.id) for r in both)
    assert datagen.sample(df, 10, "id", seed=1).collect() == datagen.sample(df.repartition(7), 10, "id", seed=1).collect()
    gone = datagen.diff_workload(df, "id", ("x", "y"), 30)
    assert gone.join(df, ["id", "x", "y"]).count() == 30
    corners = df.select(*datagen.box_of_two([F.col("x")], [F.col("y")], ["c"]))
    assert corners.where("lo_c > hi_c").isEmpty()


def nearest(rows, asked, k):
    """(qid, id, d2) by brute force; numbers that only one side has count for nothing, no distance comes last, NaN before it."""
    out = []
    for q, v in asked:
        found = []
        for i, w in rows:
            both = [(b - a) * (b - a) for a, b in zip(v or [], w or []) if a is not None and b is not None]
            d2 = 0.0
            for x in both:
                d2 += x
            found.append((not both, d2 != d2, 0.0 if not both or d2 != d2 else d2, i, d2))
        out += [(q, i, None if none else repr(d2)) for none, _, _, i, d2 in sorted(found)[:k]]
    return sorted(out)


def found(spark, rows, asked, k):
    v = spark.createDataFrame(rows, "id long, v array<float>").repartition(2)
    q = spark.createDataFrame(asked, "qid long, v array<float>").coalesce(1)
    return sorted((r.qid, r.id, r.d2 if r.d2 is None else repr(r.d2)) for r in batch.vector_knn(v, q, k).collect())


def test_nearest_vectors_of_many_blocks(spark):
    r = random.Random(8)
    rows = [(i, [float(r.randrange(-9, 10)) for _ in range(4)]) for i in range(20_000)]
    assert found(spark, rows, rows[:600:150], 5) == nearest(rows, rows[:600:150], 5)


@pytest.mark.parametrize("blocks", [(8192, 256), (64, 8), (7, 3)])
def test_nearest_of_odd_vectors(spark, monkeypatch, blocks):
    for name, n in zip(("POINT_BLOCK", "QUERY_BLOCK"), blocks, strict=True):
        monkeypatch.setattr(batch, name, n)
    r = random.Random(9)
    odd = [None, [], [1.0], [None, 2.0, 3.0], [None] * 3, [1.0, float("nan"), 2.0], [float("inf"), 0.0, 1.0], [1.0, 2.0, 3.0, 4.0], [2.0**127, 0.0, 0.0], [1.0, 2.0, 3.0]]
    rows = [(i, [r.gauss(0, 1) // 2**-9 * 2**-9 for _ in range(3)] if i % 3 else odd[i // 3 % 10]) for i in range(300)]
    asked = rows[:60:2]
    for k in (1, 5, 299, 400):
        assert found(spark, rows, asked, k) == nearest(rows, asked, k), k
    assert found(spark, rows, asked, 0) == []
    same = [(i, [1.0, 2.0, 3.0]) for i in range(300)]
    assert found(spark, same, same[:3], 4) == nearest(same, same[:3], 4)
