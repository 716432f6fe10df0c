"""Boosted trees as a table of nodes, and scoring by joins down the levels.

A node table (``NODES``) holds every node of every tree: an inner node's feature and which side its values go to, a leaf's
value, and the tree's weight. It can be kept, queried and scored without the library that fitted the trees. A row goes down all
trees at once: at each level it is joined with the nodes that it has reached. The table has at most 2**(depth + 1) nodes a tree and is broadcast up to
``MOST_BROADCAST`` nodes, which is checked; a larger one is joined by shuffling.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "tree int, node int, feature int, threshold double, left_values array<double>, left int, right int, value double, weight double"
MOST_BROADCAST = 1_000_000


def node_table(model: PipelineModel, path: str) -> DataFrame:
    """The nodes of a fitted pipeline's trees, of the files that saving the model at ``path`` writes."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(path)
    spark, uid = SparkSession.active(), model.stages[-1].uid
    saved = spark.read.parquet(f"{path}/stages/*_{uid}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/stages/*_{uid}/treesMetadata").toDF("of", "metadata", "weight").select("of", "weight")
    categories = F.col("split.numCategories") >= 0
    of_split = F.col("split.leftCategoriesOrThreshold")
    # a leaf has no children and splits nothing
    nodes = saved.join(weights, saved["treeID"] == weights["of"]).select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"), F.when(~categories, F.get(of_split, F.lit(0))).alias("threshold"), F.when(categories, of_split).alias("left_values"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("prediction").alias("value"), "weight",
    )
    return nodes.withColumn("feature", F.when(F.col("left") >= 0, F.col("feature")))


def level_tree(rows: DataFrame, features: list[Column], label: Column, splits: list[tuple[int, float]], tree: int = 0, weight: float = 1.0, places: int = 6) -> DataFrame:
    """A tree that splits at each level on one feature's threshold, the same in all nodes of the level; a leaf's value is the mean label of its rows, rounded. Grown in one aggregate."""
    depth, first = len(splits), 2 ** len(splits) - 1
    place = F.lit(0)
    for feature, threshold in splits:
        place = 2 * place + F.when(features[feature] <= threshold, 1).otherwise(2)
    leaves = rows.groupBy(place.alias("node")).agg(F.round(F.avg(label).cast("decimal(38,12)"), places).cast("double").alias("value"))
    shape = rows.sparkSession.range(2 * first + 1).select(F.lit(tree).alias("tree"), F.col("id").cast("int").alias("node"))
    level = F.floor(F.log2(F.col("node") + 1)).cast("int")
    inner = F.col("node") < first
    by_level = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(float(t)).alias("threshold")) for f, t in splits))
    split = F.when(inner, F.get(by_level, level))
    return shape.join(F.broadcast(leaves), "node", "left").select(
        "tree", "node", split["feature"].alias("feature"), split["threshold"].alias("threshold"), F.lit(None).cast("array<double>").alias("left_values"),
        F.when(inner, 2 * F.col("node") + 1).otherwise(-1).alias("left"), F.when(inner, 2 * F.col("node") + 2).otherwise(-1).alias("right"), F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(float(weight)).alias("weight"),
    )


def score_nodes(rows: DataFrame, nodes: DataFrame, features: Column, depth: int) -> DataFrame:
    """``rows`` with ``prediction``: the weighted sum of the leaves that each row reaches in at most ``depth`` steps; ``features`` is an array of doubles. A null feature makes the prediction null."""
    count = nodes.count()
    side = (lambda t: F.broadcast(t)) if count <= MOST_BROADCAST else (lambda t: t)
    split = nodes.select(F.struct("tree", "node").alias("place"), F.struct("feature", "threshold", "left_values", "left", "right").alias("split"))
    roots = nodes.where("node = 0").select(F.struct("tree", "node").alias("at"))
    walk = rows.withColumns({"_row": F.monotonically_increasing_id(), "_values": features})
    kept = walk.drop("_values")
    # a row for each tree; as many as there are trees
    walk = walk.select("_row", "_values").crossJoin(F.broadcast(roots))
    for _ in range(depth):
        met = walk.join(side(split), F.col("at") == F.col("place"), "left")
        value, s = F.get("_values", F.col("split.feature")), F.col("split")
        goes_left = F.when(s["left_values"].isNotNull(), F.array_contains(s["left_values"], value)).otherwise(value <= s["threshold"])
        child = F.when(s["left"] < 0, F.col("at.node")).when(goes_left, s["left"]).when(~goes_left, s["right"])
        walk = met.select("_row", "_values", F.struct(F.col("at.tree").alias("tree"), child.alias("node")).alias("at"))
    leaves = nodes.select(F.struct("tree", "node").alias("place"), (F.col("value") * F.col("weight")).alias("part"))
    ended = walk.join(side(leaves), F.col("at") == F.col("place"), "left")
    lost = F.max(F.col("part").isNull())
    total = ended.groupBy("_row").agg(F.when(~lost, F.sum("part")).alias("prediction"))
    return kept.join(total, "_row").drop("_row")


def score_model(rows: DataFrame, model: PipelineModel, path: str) -> DataFrame:
    """``rows`` with ``prediction`` of a fitted pipeline, by its node table; the files of the model stay at ``path``."""
    trees = model.stages[-1]
    ready = PipelineModel(model.stages[:-1]).transform(rows)
    depth = max(t.depth for t in trees.trees)
    scored = score_nodes(ready, node_table(model, path), vector_to_array(trees.getFeaturesCol()), depth)
    return scored.select(*rows.columns, "prediction")
