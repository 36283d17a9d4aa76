import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_every_point_query_matches_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from gridloom.plans import catalogue

    con = duckdb.connect()
    for t in ("orders", "events", "lineitem", "customer", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    sql = catalogue.oracle_sql()
    for name, f in catalogue.queries().items():
        df = f(spark, SF)
        if name not in sql:
            assert df.columns, name
            continue
        made = con.execute(sql[name])
        names = [c[0] for c in made.description]
        want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in made.fetchall()), key=str)
        got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
        assert sorted(names) == sorted(df.columns) and got == want, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_entry(spark):
    assert not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streamed_updates(spark, tmp_path):
    from gridloom.streaming import incremental

    src = tmp_path / "in"
    schema = "id long, x long, y long, op string, seq long"
    spark.createDataFrame([(1, 1, 1, "insert", 1), (2, 2, 2, "insert", 2), (1, 0, 0, "delete", 3)], schema).coalesce(1).write.parquet(str(src))
    empty = spark.createDataFrame([], "id long, x long, y long")
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = incremental.follow(stream, str(tmp_path / "state"), "id", ("x", "y"), str(tmp_path / "cp"), empty)
    q.awaitTermination(120)
    assert [tuple(r) for r in incremental.latest(spark, str(tmp_path / "state")).collect()] == [(2, 2, 2)]
