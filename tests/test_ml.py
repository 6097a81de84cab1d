"""Small models: selection, per-hour loop, scoring floor, class probabilities, importance ranking."""

import pytest
from pyspark.sql import functions as F

from skytally.ml import splits as S
from skytally.ml import train as TR
from skytally.operators import features as FT


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(400).select(
        F.col("id").alias("seq"), (F.col("id") % 3).cast("int").alias("local_hour"), (F.col("id") % 40 + 50).cast("double").alias("temp_f"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 7).cast("string")).otherwise("bad").alias("noise"), F.lit(None).cast("double").alias("empty"),
        F.when((F.col("id") % 4 == 0) & (F.col("id") % 3 != 2), "validation").otherwise("train").alias("split"))
    return df.withColumn("daily_high_f", F.col("temp_f") + 5.0 + F.col("local_hour")).cache()


def test_hour_models_scoring_and_importance(spark, data):
    runs = TR.train_by_hour(data, ["temp_f", "noise", "empty"], rounds=3, depth=3)
    assert sorted(runs) == [0, 1]  # hour 2 has no validation rows
    run = runs[0]
    assert run.features == ["temp_f", "noise"] and run.validation["rmse"] < 3 and run.validation["r2"] > 0.9
    united = TR.score_by_hour(data, runs)
    assert united.count() == data.filter("local_hour < 2").count() and united.select("seq").distinct().count() == united.count()
    top = TR.importances(spark, run).first()
    assert top.feature == "temp_f"
    rows = data.filter("local_hour = 0").withColumn("seen", F.lit(91.94))
    floor = TR.score(rows, run.model, run.features, observed="seen")
    assert floor.agg(F.min("predicted_high_f")).first()[0] == 91.94
    plain, c = TR.score(rows, run.model, run.features), TR.score(rows, run.model, run.features, celsius=True)
    both = plain.select("seq", F.col("predicted_high_f").alias("p")).join(c.select("seq", F.col("predicted_high_f").alias("q")), "seq")
    assert both.filter(F.abs(F.col("p") * 9 / 5 + 32 - F.col("q")) > 1e-9).count() == 0


def test_class_probabilities_sum_to_one(data):
    model, low, cols = TR.train_classifier(data.filter("local_hour = 0"), ["temp_f"], trees=3, depth=3)
    p = TR.class_probabilities(data.filter("seq < 9"), model, low, cols, ["seq"])
    sums = p.groupBy("seq").agg(F.sum("p").alias("s"), F.min("temp_f").alias("lo"))
    assert sums.count() == 9 and sums.filter("abs(s - 1) > 1e-9 OR lo < 55").count() == 0


def test_float_matrix(data):
    f = TR.as_float(data, ["noise"])
    assert dict(f.dtypes)["noise"] == "float" and f.filter("noise IS NULL").count() == 80


def test_feature_columns():
    names = FT.columns(6, 6)
    assert len(names) == 4 + 63 + 19 + 12 and len(set(names)) == len(names)
    assert {"temp_f_lag_6h", "metar_obs_temp_range_f_past_6h", "has_extra_metar_past_6h", "temp_f_change_from_min_extra_metar_past_6h"} <= set(names)
    kept = S.feature_columns(names, "month_day")
    assert "local_month" in kept and "local_doy_sin" not in kept and "metar" not in kept
    assert "local_day_of_week" not in S.feature_columns(names, "month_day", weekly=True)


def test_celsius_features(spark, views):
    rows = views.metar.filter("station = 'K100'").withColumn("station_id", F.lit(1)).withColumn("daily_high_f", F.lit(1.0))
    rows = rows.select("station", "station_id", "tz", "seq", "valid_utc", "metar", "daily_high_f")
    c = FT.feature_table(rows, celsius=True, half_hour_lags=3)
    f = FT.feature_table(rows, half_hour_lags=3)
    assert {"temp_c_lag_1h", "temp_c_change_0_5h", "previous_local_day_high_c", "current_local_day_min_temp_c_so_far", "metar_obs_temp_range_c_past_6h", "heat_index_c"} <= set(c.columns)
    pair = c.select("seq", "metar_obs_max_temp_c_past_6h").join(f.select("seq", "metar_obs_max_temp_f_past_6h"), "seq")
    off = F.abs(F.col("metar_obs_max_temp_c_past_6h") * 9 / 5 + 32 - F.col("metar_obs_max_temp_f_past_6h")) > 1e-9
    assert pair.filter(off).count() == 0 and pair.count() == rows.count()
    assert f.columns[1:] == FT.columns(6, 6) + ["temp_f_change_0_5h", "temp_f_change_1_5h"]
    regular = FT.feature_table(rows, regular_only=True)
    assert regular.count() == f.filter("is_extra_metar_report = 0").count()


def test_training_queries_are_of_production_size(spark, views, monkeypatch):
    from skytally.plans import q_ml

    runs, forests = [], []
    train, classify = TR.train_variant, TR.train_classifier
    monkeypatch.setattr(TR, "train_variant", lambda *a, **o: runs.append(train(*a, **o)) or runs[-1])
    monkeypatch.setattr(TR, "train_classifier", lambda *a, **o: forests.append(classify(*a, **o)) or forests[-1])
    rows = {(r["station"], r["seq"]) for r in q_ml._training(views).filter("split = 'validation'").collect()}
    scored = q_ml.ml5(views).collect()
    assert [t.variant for t in runs] == list(S.VARIANT_DROPS)
    assert {(t.model.stages[-1].getOrDefault("maxDepth"), t.model.stages[-1].getNumTrees <= 20) for t in runs} == {(5, True)}
    assert {(r["station"], r["seq"]) for r in scored} == rows and len(scored) == len(rows)
    sums = {}
    for r in q_ml.ml10(views).collect():
        sums[r["station"], r["seq"]] = sums.get((r["station"], r["seq"]), 0) + r["p"]
    assert set(sums) == rows and all(abs(x - 1) < 1e-6 for x in sums.values())
    assert forests[0][0].stages[-1].getNumTrees == 20
