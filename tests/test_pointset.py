import random
from collections import Counter

import pytest

from gridloom.operators import batch, layout
from gridloom.operators.pointset import Box, PointSet

SEED = 20260816


def shapes():
    r = random.Random(SEED)
    return {
        "random": [(i, r.randint(0, 100), r.randint(0, 100)) for i in range(600)],
        "one": [(0, 5, 7)],
        "alike": [(i, 42, 42) for i in range(200)],
        "plane": [(i, 50, r.randint(0, 100)) for i in range(200)],
    }


def points(spark, rows, id="id"):
    df = spark.createDataFrame(rows, "id long, x long, y long")
    return PointSet.build(df, ("x", "y"), id, check=False)


def d2(a, b):
    return (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2


@pytest.mark.parametrize("shape", ["random", "one", "alike", "plane"])
def test_boxes_and_neighbours_match_brute_force(spark, shape):
    rows, r = shapes()[shape], random.Random(SEED + 1)
    p = points(spark, rows)
    boxes = []
    for q in range(12):
        a, b = sorted(r.randint(-40, 140) for _ in range(2)), sorted(r.randint(-40, 140) for _ in range(2))
        boxes.append((q, a[0], a[1], b[0], b[1]))
    boxes.append((12, 80, 20, 0, 100))  # inverted
    boxes.append((13, rows[0][1], rows[0][1], rows[0][2], rows[0][2]))  # a dot
    frame = spark.createDataFrame(boxes, "qid long, lo_x long, hi_x long, lo_y long, hi_y long")
    inside = {q: {i for i, x, y in rows if lx <= x <= hx and ly <= y <= hy} for q, lx, hx, ly, hy in boxes}
    got = {}
    for row in batch.range_query(p, frame).collect():
        got.setdefault(row.qid, []).append(row.id)
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in inside.items() if v}
    assert {x.qid: x.n for x in batch.range_count(p, frame).collect()} == {q: len(v) for q, v in inside.items()}
    queries = [(q, r.randint(-20, 120), r.randint(-20, 120)) for q in range(6)]
    for k in (1, 5, len(rows) + 7):
        near = {}
        for row in batch.knn(p, spark.createDataFrame(queries, "qid long, x long, y long"), k).collect():
            near.setdefault(row.qid, []).append((row.d2, row.id))
        for q, x, y in queries:
            assert sorted(near[q]) == sorted((d2((x, y), (a, b)), i) for i, a, b in rows)[:k]


def test_single_queries(spark):
    rows = shapes()["random"]
    p = points(spark, rows)
    box = Box((10, 20), (60, 70))
    want = [i for i, x, y in rows if 10 <= x <= 60 and 20 <= y <= 70]
    assert p.range_count(box).first().n == len(want)
    assert sorted(r.id for r in p.range_query(box).collect()) == sorted(want)
    assert len(p.range_query(box, 3).collect()) == min(3, len(want))
    assert layout.range_count(p, layout.cell_summary(p.df, p.coords, 16), 16, box).first().n == len(want)
    assert layout.validate(p, layout.cell_summary(p.df, p.coords, 16), 16) == []
    assert p.knn((3, 3), 0).collect() == []
    assert [r.d2 for r in p.knn((3, 3), 5).collect()] == sorted(d2((3, 3), (x, y)) for _, x, y in rows)[:5]
    b = p.bounds().first()
    assert (b.lo_x, b.hi_x) == (min(r[1] for r in rows), max(r[1] for r in rows))
    assert p.clear().bounds().first().lo_x is None
    with pytest.raises(ValueError):
        p.range_count(Box((0,), (1,)))


def test_churn_keeps_the_bag(spark):
    r = random.Random(SEED)
    rows = [(r.randint(0, 20), r.randint(0, 20)) for _ in range(300)]
    frame = lambda x: spark.createDataFrame(x, "x long, y long")
    p, model = PointSet.build(frame(rows), ("x", "y")), Counter(rows)
    for _ in range(2):
        gone = r.sample(sorted(model.elements()), sum(model.values()) // 3)
        more = [(r.randint(0, 20), r.randint(0, 20)) for _ in range(len(gone))]
        p, model = p.delete(frame(gone)).insert(frame(more)), model - Counter(gone) + Counter(more)
    assert Counter((x.x, x.y) for x in p.flatten().collect()) == model
    assert Counter((x.x, x.y) for x in p.diff(frame([(900, 900), rows[0]])).flatten().collect()) == model - Counter([rows[0]])
    with pytest.raises(ValueError):
        p.delete(frame([(900, 900)]))
    with pytest.raises(ValueError):
        p.insert(spark.createDataFrame([(None, 1)], "x long, y long"))


def test_keyed_identity_and_pinned_bounds(spark):
    p = points(spark, [(1, 0, 0), (2, 5, 5)])
    with pytest.raises(ValueError):
        p.insert(spark.createDataFrame([(1, 9, 9)], "id long, x long, y long"))
    assert p.erase(1, 0, 0)[1] == 1 and p.erase(1, 3, 3)[1] == 0
    assert p.count((5, 5)).first().n == 1 and p.contains((6, 6)).first().found is False
    with pytest.raises(ValueError):
        PointSet.build(p.df, ("x", "y"), "id", bounds=Box((0, 0), (4, 4)))
    with pytest.raises(ValueError):
        PointSet.build(spark.createDataFrame([("a", 1)], "x string, y long"), ("x", "y"))


def test_double_coordinates(spark):
    df = spark.createDataFrame([(i, i / 7, (i * 3 % 11) / 3) for i in range(50)], "id long, x double, y double")
    p = PointSet.build(df, ("x", "y"), "id")
    assert p.range_count(Box((1.0, 0.0), (3.0, 2.0))).first().n == sum(1.0 <= i / 7 <= 3.0 and (i * 3 % 11) / 3 <= 2.0 for i in range(50))
