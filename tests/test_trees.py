"""Trees as a table of nodes: the same predictions as the fitted model's and as SQL over the nodes' files."""

import duckdb
import pytest
from pyspark.sql import functions as F

from meterline.plans import duration, trees
from meterline.plans.queries import QUERIES, SQL
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.range(900).select(
        F.col("id"), (F.col("id") % 20 + 1).cast("double").alias("trip_distance"), (F.col("id") * 7 % 24).cast("int").alias("pickup_hour"), (F.col("id") % 7 + 1).cast("int").alias("pickup_dow"), F.lit(1.0).alias("passenger_count"),
        F.element_at(F.array(*map(F.lit, ("Slow", "Fast", "Odd"))), (F.col("id") % 3 + 1).cast("int")).alias("pu_borough"), F.lit("Fast").alias("do_borough"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("part"),
    ).withColumn("duration_min", F.col("trip_distance") * F.when(F.col("pu_borough") == "Slow", 6.0).otherwise(3.0) + F.col("pickup_hour") * 0.5)
    return rows, duration.duration_pipeline(duration.feature_selection("yellow"), max_iter=4, depth=3).fit(rows.where("part = 'train'"))


#: A row goes from node to node until a leaf; nodes and rows are files that Spark wrote.
WALK = """WITH RECURSIVE n AS (SELECT * FROM read_parquet('{0}/*.parquet')), r AS (SELECT id, v FROM read_parquet('{1}/*.parquet')),
w AS (SELECT id, v, tree, 0 AS node FROM r, (SELECT DISTINCT tree FROM n) UNION ALL
 SELECT id, v, w.tree, CASE WHEN CASE WHEN n.left_values IS NOT NULL THEN list_contains(n.left_values, v[n.feature + 1]) ELSE v[n.feature + 1] <= n.threshold END THEN n."left" ELSE n."right" END FROM w JOIN n ON w.tree = n.tree AND w.node = n.node WHERE n."left" >= 0)
SELECT id, sum(n.value*n.weight) AS prediction FROM w JOIN n ON w.tree = n.tree AND w.node = n.node WHERE n."left" < 0 GROUP BY id"""


def test_joins_equal_the_model_and_sql(spark, fitted, tmp_path):
    rows, model = fitted
    mine = {r.id: r.prediction for r in trees.score_model(rows, model, str(tmp_path / "model")).collect()}
    theirs = model.transform(rows)
    assert len(mine) == 900 and all(abs(mine[r.id] - r.prediction) < 1e-9 for r in theirs.collect())
    nodes = trees.node_table(model, str(tmp_path / "again"))
    nodes.write.parquet(str(tmp_path / "nodes"))
    theirs.select("id", trees.vector_to_array("features").alias("v")).write.parquet(str(tmp_path / "rows"))
    for i, value in duckdb.sql(WALK.format(tmp_path / "nodes", tmp_path / "rows")).fetchall():
        assert abs(mine[i] - value) < 1e-9
    assert {f.name: f.dataType.simpleString() for f in nodes.schema} == {"tree": "int", "node": "int", "feature": "int", "threshold": "double", "left_values": "array<double>", "left": "int", "right": "int", "value": "double", "weight": "double"}
    assert nodes.where("left_values is not null and feature is not null").count() > 0 and nodes.where("threshold is not null and feature is not null").count() > 0


def test_errors_grid_and_lookups_from_the_nodes(spark, fitted, tmp_path):
    rows, model = fitted
    scored = trees.score_model(rows.where("part = 'test'"), model, str(tmp_path / "model")).select("duration_min", "prediction").collect()
    errors = [r.prediction - r.duration_min for r in scored]
    mean = sum(r.duration_min for r in scored) / len(scored)
    told = duration.evaluate_model(model, rows, 10.0).first()
    assert abs(told.rmse - (sum(e * e for e in errors) / len(errors)) ** 0.5) < 1e-9 and abs(told.mae - sum(map(abs, errors)) / len(errors)) < 1e-9
    assert abs(told.r2 - (1 - sum(e * e for e in errors) / sum((r.duration_min - mean) ** 2 for r in scored))) < 1e-9
    grid = duration.prediction_grid(spark, ["Slow", "Fast"], 4)
    key = lambda r: (r.pickup_hour, r.pickup_dow, r.trip_distance, r.pu_borough, r.do_borough)
    mine = {key(r): round(r.prediction + 1e-12, 1) for r in trees.score_model(grid, model, str(tmp_path / "grid")).collect()}
    theirs = duration.score_grid(model, grid)
    assert len(mine) == theirs.count() and all(abs(mine[key(r)] - r.predicted_min) < 0.11 for r in theirs.collect())
    curve = duration.predict_lookup(theirs, "Slow", "Fast", 4, 3.0).collect()
    assert [r.pickup_hour for r in curve] == list(range(24)) and all(abs(r.predicted_min - mine[key(r)]) < 0.11 for r in curve)
    best = duration.fastest_hour(duration.predict_lookup(theirs, "Slow", "Fast", 4, 3.0), 8).first()
    least = min(curve, key=lambda r: (r.predicted_min, r.pickup_hour))
    assert (best.fastest_hour, best.minutes) == (least.pickup_hour, least.predicted_min) and abs(best.saved - (curve[8].predicted_min - least.predicted_min)) < 0.051


def test_nulls_and_large_tables(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (2, 9.0, None), (3, None, 5.0), (4, 9.0, 9.0)], "id long, a double, b double")
    nodes = trees.level_tree(rows.where("a is not null"), [F.col("a"), F.col("b")], F.col("id"), [(0, 2.0), (1, 6.0)])
    want = {1: 1.0, 2: None, 3: None, 4: 3.0}
    for most in (trees.MOST_BROADCAST, 0):
        monkeypatch.setattr(trees, "MOST_BROADCAST", most)
        scored = trees.score_nodes(rows, nodes, F.array("a", "b"), 2)
        assert {r.id: r.prediction for r in scored.collect()} == want and scored.columns == ["id", "a", "b", "prediction"]


@pytest.mark.parametrize("name", ["level_tree", "score_node_table", "naive_baseline"])
def test_queries(spark, sf, name):
    same(connection(sf), SQL[name], QUERIES[name](spark, sf))
