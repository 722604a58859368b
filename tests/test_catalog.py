"""Registered queries against DuckDB, whole plans, sinks and the stream."""

import os

import duckdb
import pytest
from orolith import catalog
from orolith.plans import abstraction as plans
from orolith.sources import cells as sources
from orolith.sources import sinks
from orolith.streaming import updates

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_plan_end_to_end(spark, tmp_path):
    cells = sources.load_cells(spark, SF)
    built = plans.build(cells, plans.Settings(budget=60, alpha=0.7, min_area=2))
    quality = plans.evaluate(built).first()
    assert 0 <= quality.mean_iou <= 1 and 0 <= quality.accuracy <= 1 and quality.region_count > 5
    found, points, report = plans.answer(built.edges, plans.retained(built), plans.sample_queries(cells))
    rows = report.collect()
    assert len(rows) == 10 and all(r.cost >= 0 for r in rows if r.solved)
    sinks.write_tables(str(tmp_path / "t"), nodes=built.nodes, edges=built.edges)
    assert sinks.read_tables(spark, str(tmp_path / "t"), "nodes")["nodes"].count() == quality.region_count
    sinks.write_paths(points, str(tmp_path / "p"), "demo")
    sinks.write_json(report, str(tmp_path / "j"))
    sinks.write_csv(report, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 10


def test_merge_and_cache(spark, tmp_path):
    path = str(tmp_path / "kept")
    sinks.merge(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    merged = sinks.merge(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    calls = []
    for _ in range(2):
        sinks.cached(spark, str(tmp_path / "c"), lambda: calls.append(1) or spark.range(3))
    assert calls == [1]


def test_stream_of_updates(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 5, 1, "2024-01-01 00:00:00"), (0, 0, 9, 2, "2024-01-01 00:01:00"), (1, 0, 3, 1, "2024-01-01 00:00:00")], "x int, y int, elevation int, landcover int, ts string").selectExpr("x", "y", "elevation", "landcover", "CAST(ts AS TIMESTAMP) AS ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = updates.keep(stream, str(tmp_path / "cells"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "cells")).select("x", "y", "elevation", "landcover").collect())) == [(0, 0, 9, 2), (1, 0, 3, 1)]
