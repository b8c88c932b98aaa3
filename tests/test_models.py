"""Models, recommendation and streaming on planted data (FIXTURES.md section 3)."""

import math
import os

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from reelsight.operators.genres import user_genre_matrix
from reelsight.operators.models import (evaluate_rmse, load_als, predict_als, predict_linear, save_model,
                                        train_als, train_linear, tune_als)
from reelsight.operators.recommend import (axis_variances, genre_coordinates, recommend_for_all, recommend_for_user,
                                           user_projection)
from reelsight.operators.sampling import split_train_test


def planted_ratings(spark, n_users=60, n_items=40, seed=7):
    """Rank-2 factors + small noise, clipped to 1..5, normalised to [0, 1]; each user rates ~60 % of items."""
    rng = np.random.default_rng(seed)
    u = rng.normal(0, 1, (n_users, 2))
    v = rng.normal(0, 1, (n_items, 2))
    rows = []
    for i in range(n_users):
        for j in range(n_items):
            if rng.random() < 0.6:
                r = float(np.clip(3 + u[i] @ v[j] + rng.normal(0, 0.1), 1, 5))
                rows.append((i, j, r, (r - 1) / 4))
    return spark.createDataFrame(rows, "UserID int, MovieID int, UserRating double, NormUserRating double")


def test_als_beats_global_mean(spark):
    df = planted_ratings(spark)
    train, test = split_train_test(df)
    # ALS has no bias term: rank 3 = the planted rank 2 plus the constant offset
    model = train_als(train, rank=3, reg=0.01, iters=15)
    pred = predict_als(model, test)
    als_rmse = evaluate_rmse(pred, "NormUserRating", "als_prediction")
    mean = train.agg(F.avg("NormUserRating")).first()[0]
    base = test.select(F.sqrt(F.avg(F.pow(F.col("NormUserRating") - mean, 2)))).first()[0]
    assert als_rmse < 0.5 * base


def test_save_load_same_predictions(spark, tmp_out):
    df = planted_ratings(spark, 20, 10)
    model = train_als(df, rank=2, iters=5)
    save_model(model, os.path.join(tmp_out, "als"))
    back = load_als(os.path.join(tmp_out, "als"))
    a = {(r.UserID, r.MovieID): r.prediction for r in model.transform(df).collect()}
    b = {(r.UserID, r.MovieID): r.prediction for r in back.transform(df).collect()}
    assert a == b


def test_tune_small_grid(spark):
    df = planted_ratings(spark, 30, 20)
    t = tune_als(df, ranks=[2, 4], regs=[0.01, 0.1], iters=[5], folds=2, parallelism=2)
    rows = t.results.collect()
    assert len(rows) == 4
    assert t.best["avg_rmse"] == min(r.avg_rmse for r in rows)
    assert t.model.rank == t.best["rank"]


def test_save_tuning(spark, tmp_out):
    from reelsight.operators.models import save_tuning
    df = planted_ratings(spark, 20, 10)
    t = tune_als(df, ranks=[2], regs=[0.1], iters=[3], folds=2, parallelism=1)
    save_tuning(t, os.path.join(tmp_out, "tuned"))
    assert load_als(os.path.join(tmp_out, "tuned", "model")).rank == 2
    assert spark.read.parquet(os.path.join(tmp_out, "tuned", "tuning_results")).count() == 1


def test_linear_recovers_planted_weights(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 3))
    y = x @ np.array([0.5, -0.2, 0.1]) + 0.3
    df = spark.createDataFrame([(Vectors.dense(xi.tolist()), float(yi)) for xi, yi in zip(x, y)],
                               ["content_features", "NormUserRating"])
    from pyspark.ml.regression import LinearRegression
    m = LinearRegression(featuresCol="content_features", labelCol="NormUserRating", regParam=0.0).fit(df)
    assert np.allclose(m.coefficients.toArray(), [0.5, -0.2, 0.1], atol=1e-6)
    # the reference settings shrink (elastic net) but keep the sign of the strong weight
    m2 = train_linear(df)
    assert m2.coefficients[0] > 0
    assert predict_linear(m2, df).count() == 400


def _brute_force(model, ratings_rows, n, lo, hi):
    uf = {r.id: np.array(r.features) for r in model.userFactors.collect()}
    itf = {r.id: np.array(r.features) for r in model.itemFactors.collect()}
    seen = {(u, m) for u, m in ratings_rows}
    out = {}
    for u, fu in uf.items():
        scored = []
        for m, fm in itf.items():
            if (u, m) in seen:
                continue
            s = float(np.float32(fu @ fm)) * 4 + 1
            if lo <= s <= hi:
                scored.append((-s, m))
        out[u] = [m for _, m in sorted(scored)[:n]]
    return out


def test_recommend_for_all_equals_brute_force(spark):
    df = planted_ratings(spark, 40, 60, seed=11)
    model = train_als(df, rank=3, iters=10)
    rows = [(r.UserID, r.MovieID) for r in df.select("UserID", "MovieID").collect()]
    for lo, hi in [(4.0, 5.0), (2.0, 3.5)]:
        got = recommend_for_all(model, df, n=5, lo=lo, hi=hi, user_block=7, item_block=9)   # many blocks
        g = {}
        for r in got.orderBy("UserID", "rank").collect():
            g.setdefault(r.UserID, []).append(r.MovieID)
            assert (r.UserID, r.MovieID) not in set(rows) and lo <= r.DenormalizedPrediction <= hi
        ref = _brute_force(model, rows, 5, lo, hi)
        assert {u: v for u, v in ref.items() if v} == g


def test_recommend_for_user_excludes_all_seen(spark):
    df = planted_ratings(spark, 10, 30).withColumn("Title", F.concat(F.lit("t"), F.col("MovieID").cast("string"))) \
        .withColumn("Genres", F.lit("A|B")).withColumn("date_time", F.current_timestamp())
    model = train_als(df, rank=2, iters=5)
    recs, watched = recommend_for_user(model, df, 3, n=10, lo=1.0, hi=5.0)
    seen = {r.MovieID for r in df.filter("UserID = 3").collect()}
    got = recs.collect()
    assert len(got) <= 10 and not ({r.MovieID for r in got} & seen)
    scores = [r.DenormalizedPrediction for r in recs.orderBy(F.col("DenormalizedPrediction").desc()).collect()]
    assert scores == sorted(scores, reverse=True)
    assert watched.count() == min(20, len(seen))


def test_user_projection_shape(spark):
    df = spark.createDataFrame([(u, g) for u in range(20) for g in ["A|B", "C", "B|C", "A"][: 1 + u % 4]],
                               "UserID int, Genres string")
    out = user_projection(df, ["A", "B", "C"]).collect()
    assert len(out) == 20 and all(r.x is not None and r.y is not None for r in out)


def test_projection_equals_eigenvectors(spark):
    genres = ["A", "B", "C", "D"]
    df = spark.createDataFrame([(u, g) for u in range(30) for g in ["A|B", "C", "B|C", "A", "D|A"][: 1 + (u * u) % 5]],
                               "UserID int, Genres string")
    shares = user_genre_matrix(df, genres, "UserID").toPandas().sort_values("UserID")
    x = shares[[c for c in shares.columns if c != "UserID"]].to_numpy(float)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = genre_coordinates(df, genres, 4)
    cov = {(r.axis_a, r.axis_b): r.covariance for r in axis_variances(got, 4).collect()}
    assert [cov[i, i] for i in range(4)] == pytest.approx(values.tolist(), abs=1e-9)
    assert all(abs(c) < 1e-9 for (a, b), c in cov.items() if a != b)
    at = np.array([r.coordinates for r in got.orderBy("UserID").collect()])
    assert (at ** 2).sum(axis=1) == pytest.approx((x ** 2).sum(axis=1))
    two = np.array([(r.x, r.y) for r in user_projection(df, genres).orderBy("UserID").collect()])
    assert two == pytest.approx(at[:, :2])


def _feature_rows(spark):
    rows = []
    for u in range(12):
        for m in range(8):
            if (u + m) % 3:
                rows.append((u, m, 1 + (u * m) % 5, f"g{m % 3}|g{m % 2}", ["F", "M"][u % 2], f"occ{u % 4}", 18 + u % 3,
                             f"d{m % 2}", f"s{m % 3}", m % 9, None if m == 3 else 90 + m))
    df = spark.createDataFrame(rows, "UserID int, MovieID int, UserRating int, Genres string, Gender string, "
                                     "Occupation_Name string, Age int, directedBy string, starring string, "
                                     "rating_imdb int, runtimes int")
    df = df.withColumn("NormUserRating", (F.col("UserRating") - 1) / 4.0) \
        .withColumn("date_time", F.lit("2020-05-01 00:00:00").cast("timestamp_ntz"))
    items = spark.createDataFrame([(m, None if m == 5 else f"Plot of title {m} with the hero and a villain {m % 2}")
                                   for m in range(8)], "MovieID int, plot_outline string")
    return df, items


def test_feature_model_save_load_same_vectors(spark, tmp_out):
    from reelsight.operators.features import FeatureModel, prepare_features
    df, items = _feature_rows(spark)
    feats, fm = prepare_features(df, items=items, model_path=os.path.join(tmp_out, "fm"))
    a = {(r.UserID, r.MovieID): r.content_features for r in feats.collect()}
    assert len(a) == df.count()                      # no row skipped, NULL runtimes mean-filled
    back = FeatureModel.load(spark, "file://" + os.path.join(tmp_out, "fm"))
    b = {(r.UserID, r.MovieID): r.content_features for r in back.transform(df).collect()}
    assert a == b
    # three L2-normalised groups: the norm is sqrt(number of non-empty groups)
    assert all(abs(v.norm(2) - math.sqrt(3)) < 1e-9 for v in a.values())


def test_score_requests_decisions(spark):
    from reelsight.operators.features import prepare_features
    from reelsight.operators.hybrid import score_requests
    df, items = _feature_rows(spark)
    feats, fm = prepare_features(df, items=items)
    als = train_als(df, rank=2, iters=5)
    lr = train_linear(feats)
    req = spark.createDataFrame([(1, 1, 1), (2, 99, 1), (3, 1, 77), (4, 0, 0)],
                                "RequestID long, UserID int, MovieID int")
    for c, t in [("Gender", "string"), ("Occupation", "string"), ("Age", "int"), ("Genres", "string"),
                 ("Year", "int"), ("Runtime", "int"), ("IMDBRating", "double")]:
        req = req.withColumn(c, F.lit(None).cast(t))
    users = df.select("UserID", "Gender", "Occupation_Name", "Age").dropDuplicates(["UserID"])
    dims = df.select("MovieID", "Genres", "directedBy", "starring", "rating_imdb", "runtimes").dropDuplicates(["MovieID"])
    out = {r.RequestID: r for r in score_requests(req, als, lr, fm, users, dims).collect()}
    assert len(out) == 4
    assert out[1].model_used == "Hybrid"
    assert abs(out[1].PredictedScore - (0.7 * out[1].als_prediction + 0.3 * out[1].lr_prediction)) < 1e-12
    assert abs(out[1].PredictedRating - (out[1].PredictedScore * 4 + 1)) < 1e-12
    assert out[2].model_used == "LR" and out[2].als_prediction is None      # unknown user
    assert out[3].model_used == "Fallback" and out[3].PredictedScore is None   # unknown item, no metadata
    told = req.filter("RequestID = 3").withColumn("Genres", F.lit("Drama"))
    assert score_requests(told, als, lr, fm, users, dims).first().model_used == "LR"   # the request brings it
    gated = {r.RequestID: r for r in score_requests(req, als, lr, fm, users, dims, gate="seen_pair",
                                                     ratings=df).collect()}
    seen = {(r.UserID, r.MovieID) for r in df.collect()}
    assert (gated[4].als_prediction is not None) == ((0, 0) in seen)


def test_projection_helpers(spark):
    from reelsight.operators.clean import constant_column, optional_columns, project_prediction
    df = spark.createDataFrame([(1, 2, 0.5)], "UserID int, MovieID int, prediction double")
    p = project_prediction(df, {"UserID": "UserID", "prediction": "als_prediction"}, alias="p")
    assert p.columns == ["UserID", "als_prediction"]
    assert constant_column(df, "k", 7).first().k == 7
    assert optional_columns(df, ["MovieID", "DirectorVec"]) == ["MovieID"]


def test_known_ids(spark):
    from reelsight.operators.models import known_ids
    df = planted_ratings(spark, 6, 5)
    users, items = known_ids(train_als(df, rank=2, iters=2))
    assert {r.UserID for r in users.collect()} == {r.UserID for r in df.select("UserID").distinct().collect()}
    assert items.columns == ["MovieID"]


def test_grid_fits_write_no_checkpoints_and_run_side_by_side(spark, monkeypatch):
    """F8: a short fit of the grid computes no half-iteration again; all cores are used, whatever their number."""
    from reelsight.operators import models
    seen = []
    made = models.CrossValidator

    def noted(**options):
        seen.append((options["estimator"].getCheckpointInterval(), options["parallelism"]))
        return made(**options)
    monkeypatch.setattr(models, "CrossValidator", noted)
    monkeypatch.setattr(models, "FITS_AT_ONCE", 6)
    monkeypatch.setattr(models, "UNCHECKED_ITERS", 2)
    df = planted_ratings(spark, 20, 10)
    few = tune_als(df, ranks=[2], regs=[0.1], iters=[2], folds=2)
    tune_als(df, ranks=[2], regs=[0.1], iters=[3], folds=2, parallelism=1)
    cores = spark.sparkContext.defaultParallelism
    assert seen == [(-1, max(4, min(6, cores))), (5, 1)]
    als = models.als_estimator(2, 0.1, 2)
    data = df.withColumn("_fold", models.hash_bucket(("UserID", "MovieID"), salt="fold", buckets=2))
    scores = [models.rmse_evaluator().evaluate(als.fit(data.where(f"_fold != {k}")).transform(data.where(f"_fold = {k}")))
              for k in range(2)]
    assert few.best["avg_rmse"] == pytest.approx(sum(scores) / 2, abs=1e-6)


def test_term_weights_deals_texts_to_tasks(spark, monkeypatch):
    """the terms of all texts are not counted in the one task that reads the titles."""
    from reelsight.operators import features
    rows = [(i, f"common word{i} word{i}" if i % 5 else None) for i in range(40)] + [(1, "common again"), (None, "common")]
    docs = spark.createDataFrame(rows, "MovieID int, plot_outline string").coalesce(1)
    monkeypatch.setattr(features, "TASK_TEXT_BYTES", 100)
    size = sum(len(t or "") for _, t in rows)
    got = features.term_weights(docs, stop_words=["again"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    dealt = [x for x in plan.split("\n") if "RepartitionByExpression" in x]
    assert dealt and all(x.endswith(f", {-(-size // 100)}") for x in dealt)
    found = {(r.MovieID, r.term): (r.tf, r.df) for r in got.collect()}
    assert found[(1, "common")] == (2, 33) and found[(None, "common")] == (1, 33) and found[(7, "word7")] == (2, 1)
    assert len(found) == 32 * 2 + 1
    assert features.term_weights(docs.where("false")).count() == 0
