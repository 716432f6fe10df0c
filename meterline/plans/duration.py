"""The trip duration model: features, split, pipeline, evaluation, importance and the prediction grid."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.derive import rounded

NUMERIC = ["trip_distance", "pickup_hour", "pickup_dow", "passenger_count"]
CATEGORIES = ["pu_borough", "do_borough"]
LABEL = "duration_min"
#: Dataset kinds that do not count passengers.
NO_PASSENGERS = {"fhvhv", "fhv"}


def feature_selection(dataset: str) -> list[str]:
    return [c for c in NUMERIC if not (dataset in NO_PASSENGERS and c == "passenger_count")] + CATEGORIES


def equal_rows(rows: DataFrame, features: list[str]) -> DataFrame:
    """One row for all of equal features, with the mean of their labels and their number as ``weight``.

    Trees of squared error fitted on these are those of all rows: gains of splits, means of leaves and residuals of the next tree are the same, as
    what labels of equal features differ by lies on one side of every split.
    """
    return rows.groupBy(*features).agg(F.avg(LABEL).alias(LABEL), F.count("*").cast("double").alias("weight"))


def duration_pipeline(features: list[str], max_iter: int = 30, depth: int = 5, seed: int = 42, weight: str | None = None) -> Pipeline:
    """Unseen boroughs get a slot of their own. ``weight`` names the column that tells how many rows each stands for."""
    named = [c for c in features if c in CATEGORIES]
    index = StringIndexer(inputCols=named, outputCols=[f"{c}_index" for c in named], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_index" for c in named], outputCols=[f"{c}_hot" for c in named], handleInvalid="keep")
    vector = VectorAssembler(inputCols=[c for c in features if c not in named] + [f"{c}_hot" for c in named], outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol=LABEL, maxIter=max_iter, maxDepth=depth, seed=seed)
    return Pipeline(stages=[index, hot, vector, trees.setWeightCol(weight) if weight else trees])


def naive_baseline(split: DataFrame) -> DataFrame:
    """RMSE and MAE of distance over the train rows' mean speed; ``split`` has part train or test."""
    speed = split.where("part = 'train'").agg(F.avg("speed_mph").alias("mean_speed"))
    error = F.col("trip_distance") / F.col("mean_speed") * 60 - F.col(LABEL)
    test = split.where("part = 'test'").crossJoin(F.broadcast(speed))
    return test.agg(rounded(F.sqrt(F.avg(error * error)), 4).alias("rmse"), rounded(F.avg(F.abs(error)), 4).alias("mae"), F.count("*").alias("test_rows"))


def evaluate_model(model: PipelineModel, split: DataFrame, baseline_rmse: float) -> DataFrame:
    scored = model.transform(split.where("part = 'test'")).select(F.col(LABEL).cast("double").alias("told"), (F.col(LABEL) - F.col("prediction")).alias("error"))
    one = scored.agg(F.avg(F.col("error") * F.col("error")).alias("square"), F.avg(F.abs("error")).alias("mae"), F.var_pop("told").alias("spread")).first()  # all measures in one pass
    square, mae, spread = (math.nan if x is None else x for x in one)
    values = (math.sqrt(square), mae, 1 - square / spread if spread else -math.inf if square else math.nan)
    rows = split.groupBy().agg(F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "test").alias("test_rows"))
    improvement = 100 * (1 - values[0] / baseline_rmse)
    return rows.select(*(F.lit(float(v)).alias(n) for n, v in zip(("rmse", "mae", "r2", "improvement_pct"), (*values, improvement))), "train_rows", "test_rows")


def slot_inputs(model: PipelineModel, rows: DataFrame) -> list[str]:
    """For each slot of the assembled vector, the input column that it was made from: the assembler takes its columns in order, each as wide as its attributes tell, and indexers and encoders tell what they were given."""
    made_from = {out: given for stage in model.stages if stage.hasParam("inputCols") and stage.hasParam("outputCols") for out, given in zip(stage.getOutputCols(), stage.getInputCols())}
    schema, slots = model.transform(rows.limit(1)).schema, []
    for column in model.stages[-2].getInputCols():
        told = schema[column].metadata.get("ml_attr", {})
        width = told.get("num_attrs") or sum(map(len, told.get("attrs", {}).values())) or 1
        while column in made_from:
            column = made_from[column]
        slots += [column] * width
    return slots


def feature_importance(model: PipelineModel, rows: DataFrame, inputs: list[str]) -> DataFrame:
    """Importance of each input, its slots added up. A slot of no input is an error."""
    values, slots = model.stages[-1].featureImportances.toArray().tolist(), slot_inputs(model, rows)
    if len(values) != len(slots) or not set(slots) <= set(inputs):
        raise ValueError(f"{len(values)} slots of the model, {len(slots)} of {sorted(set(slots))}; the inputs are {inputs}")
    pairs = rows.sparkSession.createDataFrame(list(zip(slots, values)) + [(c, 0.0) for c in inputs], "feature string, part double")
    summed = pairs.groupBy("feature").agg(F.round(F.sum("part"), 4).alias("importance"))
    return summed.orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def rescore_importance(path: str, rows: DataFrame, inputs: list[str]) -> DataFrame:
    return feature_importance(load_model(path), rows, inputs)


def prediction_grid(spark: SparkSession, boroughs: list[str], distances: int = 30) -> DataFrame:
    """Every hour, day type, distance and pair of boroughs; made in the plan."""
    hours = spark.range(24).select(F.col("id").cast("int").alias("pickup_hour"))
    days = spark.range(2).select(F.when(F.col("id") == 0, 4).otherwise(7).alias("pickup_dow"))
    miles = spark.range(1, distances + 1).select(F.col("id").cast("double").alias("trip_distance"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, boroughs))).alias("pu_borough"))
    others = names.withColumnRenamed("pu_borough", "do_borough")
    return hours.crossJoin(days).crossJoin(miles).crossJoin(names).crossJoin(others).withColumn("passenger_count", F.lit(1.0))


def score_grid(model: PipelineModel, grid: DataFrame) -> DataFrame:
    scored = model.transform(grid)
    return scored.select("pickup_hour", "pickup_dow", "trip_distance", "pu_borough", "do_borough", rounded("prediction", 1).alias("predicted_min"))


def predict_lookup(scored: DataFrame, pu: str, do: str, dow: int, miles: float, hour: int | None = None) -> DataFrame:
    """One prediction, or the curve over all hours."""
    rows = scored.where((F.col("pu_borough") == pu) & (F.col("do_borough") == do) & (F.col("pickup_dow") == dow) & (F.col("trip_distance") == miles))
    return rows.where(F.col("pickup_hour") == hour) if hour is not None else rows.orderBy("pickup_hour")


def nearest_grid_distance(scored: DataFrame, routes: DataFrame) -> DataFrame:
    """For each route, the grid distance next to its average; ties go to the shorter."""
    grid = scored.select("trip_distance").distinct().agg(F.collect_list("trip_distance").alias("miles"))  # one value a grid distance
    near = F.array_min(F.transform("miles", lambda m: F.struct(F.abs(m - F.col("avg_distance")).alias("off"), m.alias("miles"))))["miles"]
    return routes.where("avg_distance is not null").crossJoin(F.broadcast(grid)).select("pu_borough", "do_borough", near.alias("grid_miles"))


def fastest_hour(curve: DataFrame, chosen: int) -> DataFrame:
    """The hour of least predicted duration, and the minutes it saves against a chosen hour."""
    best = F.min_by(F.struct("pickup_hour", "predicted_min"), F.struct("predicted_min", "pickup_hour")).alias("best")
    then = F.max(F.when(F.col("pickup_hour") == chosen, F.col("predicted_min"))).alias("then")
    return curve.agg(best, then).select(F.col("best.pickup_hour").alias("fastest_hour"), F.col("best.predicted_min").alias("minutes"), rounded(F.col("then") - F.col("best.predicted_min"), 1).alias("saved"))
