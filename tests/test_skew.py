"""One user holds a third of all ratings: per-key jobs stay exact (pandas as the reference)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from reelsight.operators.aggregates import rating_summary
from reelsight.operators.genres import user_genre_matrix
from reelsight.operators.joins import exclude_seen, known_pairs
from reelsight.operators.ordering import latest_rating_per_pair, top_k_per_group


def _skewed(spark, n=30000, seed=5):
    rng = np.random.default_rng(seed)
    users = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 500, n))
    items = rng.integers(0, 300, n)
    ts = rng.integers(0, 10_000, n)
    ratings = rng.integers(1, 6, n)
    genres = np.array(["A|B", "B", "C|A", "C"])[rng.integers(0, 4, n)]
    pdf = pd.DataFrame({"UserID": users.astype("int32"), "MovieID": items.astype("int32"),
                        "date_time": ts.astype("int64"), "UserRating": ratings.astype("int32"), "Genres": genres})
    return pdf, spark.createDataFrame(pdf).repartition(16)


def test_latest_per_pair_under_skew(spark):
    pdf, df = _skewed(spark)
    got = {(r.UserID, r.MovieID): (r.date_time, r.UserRating)
           for r in latest_rating_per_pair(df.select("UserID", "MovieID", "date_time", "UserRating")).collect()}
    ref = (pdf.sort_values(["date_time", "UserRating"]).groupby(["UserID", "MovieID"]).tail(1)
           .set_index(["UserID", "MovieID"]))
    assert got == {k: (int(v.date_time), int(v.UserRating)) for k, v in ref.iterrows()}


def test_top_k_per_user_under_skew(spark):
    pdf, df = _skewed(spark)
    out = top_k_per_group(df, "UserID", [F.col("date_time").desc(), F.col("MovieID").asc(),
                                         F.col("UserRating").desc()], 20)
    got = sorted((r.UserID, r.date_time, r.MovieID, r.UserRating) for r in out.collect())
    ref = (pdf.sort_values(["UserID", "date_time", "MovieID", "UserRating"], ascending=[True, False, True, False])
           .groupby("UserID").head(20))
    assert got == sorted(zip(ref.UserID, ref.date_time, ref.MovieID, ref.UserRating))


def test_pair_tests_under_skew(spark):
    pdf, df = _skewed(spark)
    cand = spark.createDataFrame([(0, m) for m in range(300)] + [(7, m) for m in range(300)], "UserID int, MovieID int")
    got = {(r.UserID, r.MovieID) for r in exclude_seen(cand, df).collect()}
    seen = set(zip(pdf.UserID, pdf.MovieID))
    assert got == {(u, m) for u in (0, 7) for m in range(300) if (u, m) not in seen}
    req = cand.withColumn("RequestID", F.monotonically_increasing_id())
    flags = known_pairs(req, df).collect()
    assert len(flags) == 600 and all(r.pair_known == ((r.UserID, r.MovieID) in seen) for r in flags)


def test_group_aggregates_under_skew(spark):
    pdf, df = _skewed(spark)
    m = {r.UserID: (r.A, r.B, r.C) for r in user_genre_matrix(df, ["A", "B", "C"]).collect()}
    for g in "ABC":
        pdf[g] = pdf.Genres.str.split("|").apply(lambda xs, g=g: int(g in xs))
    ref = pdf.groupby("UserID")[["A", "B", "C"]].mean()
    assert all(np.allclose(m[u], ref.loc[u].values) for u in ref.index)
    s = {r.Genres: (r.rating_count, r.user_count) for r in rating_summary(df, "Genres").collect()}
    ref2 = pdf.groupby("Genres").agg(n=("UserID", "size"), u=("UserID", "nunique"))
    assert s == {k: (int(v.n), int(v.u)) for k, v in ref2.iterrows()}
