"""Cleaning, joins, aggregates and ordering on small hand-made frames."""

import math

import pytest
from pyspark.sql import functions as F

from reelsight.operators.aggregates import density, histogram, minmax_scale, rmse
from reelsight.operators.clean import clean_ratings, fill_mean, null_profile
from reelsight.operators.genres import dominant_genre, user_genre_matrix
from reelsight.operators.hybrid import best_weights, choose_model, sweep_weights
from reelsight.operators.joins import (exclude_seen, join_enrichment, join_metadata, known_pairs)
from reelsight.operators.ordering import latest_rating_per_pair, top_k_per_group
from reelsight.operators.sampling import sample_fraction, split_train_test


def test_clean_ratings_parses_and_drops(spark):
    df = spark.createDataFrame(
        [(1, 10, "4", "7.8", "90, 100", "x", 1.0, 12), (2, 11, "N/A", "N/A", None, "y", 2.0, 21),
         (3, 12, "5", "", "71", "z", 3.0, None)],
        "UserID int, MovieID int, Rating string, rating_imdb string, runtimes string, director string, "
        "avgRating double, Occupation int")
    out = clean_ratings(df).orderBy("UserID").collect()
    assert [r.UserID for r in out] == [1, 3]            # NULL rating dropped
    assert out[0].UserRating == 4 and out[0].rating_imdb == 7 and out[0].runtimes == 90
    assert out[1].rating_imdb is None and out[1].runtimes == 71
    assert out[0].Occupation_Name == "programmer" and out[1].Occupation_Name == "Unknown"
    assert "director" not in clean_ratings(df).columns and "avgRating" not in clean_ratings(df).columns


def test_fill_mean_truncates_int(spark):
    df = spark.createDataFrame([(3,), (4,), (4,), (None,)], "x int")  # mean 3.67 -> 3
    assert sorted(r.x for r in fill_mean(df, ["x"]).collect()) == [3, 3, 4, 4]


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "a")], "a int, b string")
    r = null_profile(df).collect()[0]
    assert (r.a, r.b) == (1, 2)


def test_join_metadata_dedupes_titles(spark):
    titles = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "MovieID int, Title string")
    meta = spark.createDataFrame([("A", "d1", 5), ("A", "d2", 3), ("B", "d3", 9)],
                                 "title string, directedBy string, imdbId int")
    out = {r.MovieID: (r.directedBy, r.imdbId) for r in join_metadata(titles, meta).collect()}
    assert out == {1: ("d2", 3), 2: ("d3", 9)}         # one row per title, unmatched C gone


def test_join_enrichment_text_ids(spark):
    left = spark.createDataFrame([(114709, "a"), (5, "b")], "imdbId int, x string")
    right = spark.createDataFrame([("0114709", "p"), ("N/A", "q")], "imdbID string, plot string")
    out = join_enrichment(left, right).collect()
    assert [(r.imdbId, r.plot) for r in out] == [(114709, "p")]


def test_exclude_seen_full_history(spark):
    cand = spark.createDataFrame([(1, m) for m in range(30)], "UserID int, MovieID int")
    seen = spark.createDataFrame([(1, m) for m in range(25)], "UserID int, MovieID int")
    assert sorted(r.MovieID for r in exclude_seen(cand, seen).collect()) == list(range(25, 30))


def test_known_pairs_keeps_each_request_once(spark):
    req = spark.createDataFrame([(1, 1, 10), (2, 1, 11)], "RequestID int, UserID int, MovieID int")
    ratings = spark.createDataFrame([(1, 10), (1, 10)], "UserID int, MovieID int")
    out = {r.RequestID: r.pair_known for r in known_pairs(req, ratings).collect()}
    assert out == {1: True, 2: False}


def test_latest_rating_per_pair_ties(spark):
    df = spark.createDataFrame([(1, 1, 100, 3), (1, 1, 200, 2), (1, 1, 200, 4), (2, 1, 50, 1)],
                               "UserID int, MovieID int, date_time long, UserRating int")
    out = {(r.UserID, r.MovieID): (r.date_time, r.UserRating) for r in latest_rating_per_pair(df).collect()}
    assert out == {(1, 1): (200, 4), (2, 1): (50, 1)}


def test_top_k_per_group_with_hot_group(spark):
    rows = [(0, i) for i in range(5000)] + [(1, i) for i in range(3)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(8)
    out = top_k_per_group(df, "g", [F.col("v").desc()], 2).collect()
    assert sorted((r.g, r.v, r["rank"]) for r in out) == [(0, 4998, 2), (0, 4999, 1), (1, 1, 2), (1, 2, 1)]


def test_histogram_properties(spark):
    vals = [1.0, 2.0, 2.5, 3.0, 10.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = histogram(df, "x", 4).orderBy("bin").collect()
    assert sum(r["count"] for r in h) == 5
    assert h[-1]["count"] == 1 and h[0]["lo"] == 1.0 and h[-1]["hi"] == 10.0   # max in the closed last bin
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    hc = histogram(const, "x", 3).orderBy("bin").collect()
    assert [r["count"] for r in hc] == [2, 0, 0]


def test_density_matches_numpy_and_integrates(spark):
    import numpy as np
    data = [0.0, 0.25, 0.25, 0.5, 1.0, 1.0, 0.75]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    d = density(df, "v", grid=200, cut=3.0).orderBy("point").collect()
    x = np.array([r.x for r in d])
    arr = np.array(data)
    bw = len(arr) ** (-0.2) * arr.std(ddof=1)
    ref = np.exp(-0.5 * ((x[:, None] - arr[None, :]) / bw) ** 2).sum(1) / (len(arr) * bw * math.sqrt(2 * math.pi))
    assert np.allclose([r.density for r in d], ref, atol=1e-12)
    assert abs(np.trapezoid(ref, x) - 1.0) < 1e-3


def test_minmax_and_rmse(spark):
    df = spark.createDataFrame([(1.0, 1.5), (3.0, 2.0), (5.0, 5.0)], "y double, p double")
    s = [r.y_scaled for r in minmax_scale(df, ["y"]).orderBy("y").collect()]
    assert s == [0.0, 0.5, 1.0]
    r = rmse(df, "y", "p").collect()[0]
    assert abs(r.rmse - math.sqrt((0.25 + 1.0 + 0.0) / 3)) < 1e-12


def test_sweep_equals_naive_per_weight_rmse(spark):
    rows = [(1, 1, 0.2, 0.25, 0.4, 0.25), (1, 2, 0.9, 1.0, 0.6, 1.0), (2, 1, 0.5, 0.5, 0.1, 0.5),
            (2, 2, 0.0, 0.0, 0.3, 0.0), (3, 1, 0.7, 0.75, 0.8, 0.75), (3, 2, 1.0, 0.75, 0.9, 0.75)]
    df = spark.createDataFrame(rows, "UserID int, MovieID int, als_prediction double, NormUserRating_als double, "
                                     "lr_prediction double, NormUserRating_lr double")
    weights = [(0.6, 0.4), (0.9, 0.1), (0.8, 0.2)]
    got = {(r.weight_als, r.weight_lr): r.rmse for r in sweep_weights(df, weights).collect()}
    for wa, wl in weights:
        errs = [(wa * a + wl * b - (la + lb) / 2) ** 2 for _, _, a, la, b, lb in rows]
        assert abs(got[(wa, wl)] - math.sqrt(sum(errs) / len(errs))) < 1e-12
    best = best_weights(sweep_weights(df, weights)).collect()[0]
    assert best.rmse == min(got.values())


def test_choose_model(spark):
    req = spark.createDataFrame([(1, 1, 10, None), (2, 1, 99, None), (3, 7, 10, None), (4, 7, 98, "Drama"),
                                 (5, 7, 97, None)], "RequestID int, UserID int, MovieID int, Genres string")
    users = spark.createDataFrame([(1,)], "UserID int")
    items = spark.createDataFrame([(10,)], "MovieID int")
    meta = spark.createDataFrame([(10,), (99,)], "MovieID int")
    out = {r.RequestID: r.model_choice for r in choose_model(req, users, items, meta).collect()}
    assert out == {1: "ALS", 2: "LR", 3: "LR", 4: "LR", 5: "Fallback"}


def test_dominant_genre_tie_goes_to_first(spark):
    df = spark.createDataFrame([(1, "A|B"), (1, "B|A"), (2, "B"), (2, "C"), (2, "C")], "UserID int, Genres string")
    m = dominant_genre(user_genre_matrix(df, ["A", "B", "C"]), ["A", "B", "C"])
    assert {r.UserID: r.Dominant_Genre for r in m.collect()} == {1: "A", 2: "C"}


def test_split_is_disjoint_complete_and_layout_free(spark):
    df = spark.range(2000).select(F.col("id").cast("int").alias("UserID"), (F.col("id") % 7).cast("int").alias("MovieID"))
    tr, te = split_train_test(df)
    a, b = {tuple(r) for r in tr.collect()}, {tuple(r) for r in te.collect()}
    assert not (a & b) and len(a | b) == 2000 and 0.75 < len(a) / 2000 < 0.85
    tr2, _ = split_train_test(df.repartition(13))
    assert {tuple(r) for r in tr2.collect()} == a
    s = sample_fraction(df, 0.1).count()
    assert 120 < s < 280
    many = spark.range(50_000).select(F.col("id").alias("UserID"), F.lit(2**33).alias("MovieID"))
    assert 100 < sample_fraction(many, 0.004).count() < 300
    train, test = split_train_test(many, 0.996)
    assert 100 < test.count() < 300 and train.count() + test.count() == 50_000
    assert sample_fraction(many, 1.0).count() == 50_000 and sample_fraction(many, 0.0).count() == 0
    with pytest.raises(ValueError):
        sample_fraction(many, 1.5)


def test_predict_by_choice(spark):
    from reelsight.operators.hybrid import predict_by_choice
    df = spark.createDataFrame([("ALS", 0.1, 0.2), ("LR", 0.1, 0.2), ("Fallback", 0.1, 0.2), ("LR", 0.1, None)],
                               "model_choice string, als_prediction double, lr_prediction double")
    assert [r.prediction for r in predict_by_choice(df).collect()] == [0.1, 0.2, None, None]


def test_fill_and_sentinels(spark):
    from reelsight.operators.clean import fill_constant, sentinel_to_null
    df = spark.createDataFrame([("N/A", None), ("7.5", "p"), ("0.0", None)], "r string, plot string")
    out = fill_constant(sentinel_to_null(df, {"r": ["N/A", "", "0.0"]}), {"plot": ""}).collect()
    assert [(x.r, x.plot) for x in out] == [(None, ""), ("7.5", "p"), (None, "")]


def test_append_columns_and_select_pairs(spark):
    from reelsight.operators.clean import select_pair, select_pairs
    from reelsight.operators.ordering import append_columns, limit_rows
    df = spark.createDataFrame([(1, 10, 3), (1, 11, 4), (2, 10, 5)], "UserID int, MovieID int, UserRating int")
    assert append_columns(df, {"x2": F.col("UserRating") * 2}).columns == ["UserID", "MovieID", "UserRating", "x2"]
    pairs = spark.createDataFrame([(1, 11), (1, 11), (3, 10)], "UserID int, MovieID int")
    assert [tuple(r) for r in select_pairs(df, pairs).collect()] == [(1, 11, 4)]
    assert select_pair(df, 2, 10).count() == 1
    assert [r.MovieID for r in limit_rows(df, 2, [F.col("UserRating").desc(), "MovieID"]).collect()] == [10, 11]


def test_transpose_both_paths(spark):
    from reelsight.operators.aggregates import transpose_matrix
    m = spark.createDataFrame([("F", 1.0, 2.0), ("M", 3.0, 4.0)], "Gender string, a double, b double")
    known = {r.genre: (r.F, r.M) for r in transpose_matrix(m, "Gender", "genre", ["F", "M"]).collect()}
    found = {r.genre: (r.F, r.M) for r in transpose_matrix(m, "Gender", "genre").collect()}
    assert known == found == {"a": (1.0, 3.0), "b": (2.0, 4.0)}


def test_density_minmax_equals_density_of_scaled_rows(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 2, 3, 5, 5, None]], "x int")
    a = density(df, "x", scale="minmax").orderBy("point").collect()
    b = density(minmax_scale(df, ["x"]), "x_scaled").orderBy("point").collect()
    assert all(abs(p.x - q.x) < 1e-12 and abs(p.density - q.density) < 1e-12 for p, q in zip(a, b))


def test_fine_bins_keep_the_stated_error_and_nothing_is_stored(spark):
    import numpy as np
    from reelsight.operators.aggregates import FINE_BIN
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0, 1, 3000), rng.gamma(2, 3, 2000), [40.0]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double")
    for fine in (FINE_BIN, 0.5):
        binned = density(df, "x", fine=fine)
        bandwidth = len(v) ** -0.2 * v.std(ddof=1)
        exact = {r.point: r for r in density(df, "x").collect()}
        got = binned.collect()
        assert len(got) == 200 and all(abs(r.x - exact[r.point].x) < 1e-9 for r in got)
        assert max(abs(r.density - exact[r.point].density) for r in got) <= 0.05 * fine**2 / bandwidth
        assert "LogicalRDD [x#" in binned._jdf.queryExecution().optimizedPlan().toString()     # down to the input itself
    counts, edges = np.histogram(v, 10)
    h = histogram(df, "x", 10).orderBy("bin").collect()
    assert [r["count"] for r in h] == counts.tolist() and np.allclose([r.lo for r in h], edges[:-1])


def test_density_without_bandwidth(spark):
    for rows in ([], [(None,)], [(2.0,)], [(2.0,), (2.0,)]):
        assert density(spark.createDataFrame(rows, "x double"), "x", scale="minmax").count() == 0


def test_sketches_of_slices_merge_to_the_sketch_of_all(spark):
    from reelsight.operators.aggregates import merge_sketches, user_sketches
    rows = spark.range(30_000).select(
        (F.col("id") * 7 % 9000).alias("UserID"), (F.col("id") % 3).alias("g"), (F.col("id") % 5 + 1).alias("UserRating"),
        (F.col("id") % 11).alias("day"))
    sliced = merge_sketches(user_sketches(rows, "g", F.col("day")), "g")
    whole = merge_sketches(user_sketches(rows, "g", F.lit(0)), "g")
    want = {r.g: r for r in rows.groupBy("g").agg(F.countDistinct("UserID").alias("u"), F.avg("UserRating").alias("a")).collect()}
    got = {r.g: r for r in sliced.collect()}
    assert {g: r.user_estimate for g, r in got.items()} == {r.g: r.user_estimate for r in whole.collect()}
    for g, r in got.items():
        assert abs(r.user_estimate - want[g].u) <= 5 * 0.01625 * want[g].u and abs(r.avg_rating - want[g].a) < 1e-12
    assert merge_sketches(user_sketches(rows.where("false"), "g", F.col("day")), "g").count() == 0
