"""The registered queries fit the whole duration model."""

from meterline.plans import duration, queries
from meterline.sources import fixtures


def test_the_model_has_all_trees(spark, sf, monkeypatch):
    asked, whole = [], duration.duration_pipeline

    def small(*args, **options):
        asked.append(whole(*args, **options).getStages()[-1])
        return whole(*args, max_iter=1, depth=2)

    monkeypatch.setattr(duration, "duration_pipeline", small)
    queries._fitted(fixtures.curated(spark, sf))
    assert [(t.getMaxIter(), t.getMaxDepth(), t.getSeed()) for t in asked] == [(30, 5, 42)]


def test_equal_rows_are_fitted_as_one(spark):
    rows = spark.range(2000).selectExpr(
        "cast(id % 5 + 1 as double) AS trip_distance", "cast(id % 3 as int) AS pickup_hour", "cast(id % 2 + 1 as int) AS pickup_dow", "1.0D AS passenger_count", "if(id % 7 < 3, 'A', 'B') AS pu_borough", "if(id % 11 < 5, 'A', 'B') AS do_borough",
        "cast((id % 5) * 4 + (id % 3) * (id % 2) + (id * 7919) % 13 + if(id % 7 < 3, 6, 0) as double) AS duration_min",
    )
    inputs = duration.feature_selection("yellow")
    once, thrice = duration.equal_rows(rows, inputs), duration.equal_rows(rows.union(rows).union(rows), inputs)
    assert once.count() == thrice.count() == rows.select(*inputs).distinct().count() < 200
    assert once.groupBy().sum("weight").first()[0] == 2000 and thrice.groupBy().sum("weight").first()[0] == 6000
    grid = rows.select(*inputs).distinct()

    def told(model):
        return {tuple(r[c] for c in inputs): r.prediction for r in model.transform(grid).collect()}

    all_rows = told(duration.duration_pipeline(inputs, max_iter=5, depth=4).fit(rows))
    grouped = told(duration.duration_pipeline(inputs, max_iter=5, depth=4, weight="weight").fit(thrice))
    assert len(set(all_rows.values())) > 10 and all(abs(all_rows[k] - grouped[k]) < 1e-6 for k in all_rows)


def test_the_query_fits_distinct_vectors(spark, sf, monkeypatch):
    fitted, whole = [], duration.duration_pipeline

    class Watched:
        def __init__(self, pipeline):
            self.pipeline = pipeline

        def fit(self, rows):
            fitted.append(rows)
            return self.pipeline.fit(rows)

    monkeypatch.setattr(duration, "duration_pipeline", lambda inputs, weight=None: Watched(whole(inputs, max_iter=1, depth=2, weight=weight)))
    inputs, split, _ = queries._fitted(fixtures.curated(spark, sf))
    train = split.where("part = 'train'")
    assert fitted[0].count() == train.select(*inputs).distinct().count() and fitted[0].groupBy().sum("weight").first()[0] == train.count()
