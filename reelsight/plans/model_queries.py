"""Registered queries: features, models, hybrid scoring, recommendation, streaming
(build steps 5 to 9).

SQL can express the parts that are not model fitting: category indices
(F-01), explainable term weights (F-07), routing of requests (R-02), and
the prediction algebra (J-10, R-01, G-13, X-12, X-13).  For the algebra the
two "models" are stand-ins Spark derives from the training split - the
user's mean normalised rating plays the factor model, the item's mean the
content model - so the blend, sweep and error jobs can be checked exactly.
Queries that fit ALS / linear models register no SQL; the test suite
checks them (planted data, brute force, stream = batch).
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsight.functions.lookups import SERVING_WEIGHTS, SWEEP_WEIGHTS
from reelsight.functions.scalars import blend, denormalize_rating, mean_label, normalize_rating
from reelsight.operators.aggregates import rmse
from reelsight.operators.category_slots import category_slots, encode_slots
from reelsight.operators.factorised import train_factorised
from reelsight.operators.features import CATEGORICAL, VECTOR_NAMES, category_index_table, fit_features, \
    fit_text_model, item_text_features, term_weights, text_stages
from reelsight.operators.hybrid import choose_model, predict_by_choice, score_requests, sweep_weights
from reelsight.operators.joins import combine_predictions
from reelsight.operators.id_dictionary import IdDictionary, train_als_by_ids
from reelsight.operators.model_store import ServingModels, load_models, publish_models
from reelsight.operators.models import predict_als, predict_linear, train_als, train_linear, tune_als
from reelsight.operators.ordering import latest_rating_per_pair
from reelsight.operators.pruned_recommend import recommend_for_all_pruned
from reelsight.operators.recommend import (axis_variances, candidate_items, genre_coordinates, recommend_for_all,
                                           recommend_for_user, user_projection)
from reelsight.operators.sampling import with_split
from reelsight.plans.eda_queries import clean, clean_columns
from reelsight.plans.genre_queries import STANDIN_GENRES
from reelsight.plans.registry import register
from reelsight.plans.sql import with_ctes
from reelsight.plans.standin import (items_standin, raw_titles, requests, serving_items, serving_users,
                                     session_key)
from reelsight.session import checkpoint_dir
from reelsight.sources.files import read_ratings, write_parquet

# ------------------------------------------------------------------ shared inputs


def rated(spark: SparkSession, sf_dir: str, method: str = "minmax") -> DataFrame:
    """Cleaned ratings with the normalised label (X-10; min-max: 1..5 onto 0..1) and the split flag (L-03)."""
    return _rated(clean(spark, sf_dir), method)


def _rated(df: DataFrame, method: str = "minmax") -> DataFrame:
    return with_split(df.withColumn("NormUserRating", normalize_rating("UserRating", method)))


_LABELLED: dict = {}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow labelled split (user, item, time, rating, label, side), written once.

    Three branches read it (user means, item means, test pairs), each some of
    its columns, so it stands as Parquet in the shared checkpoint folder (lineage
    cut, survives lost executors), packed by column, and is reused per session.
    It needs none of the texts and user attributes of the wide table, so it does
    not have that built.
    """
    key = (session_key(spark), sf_dir)
    if key not in _LABELLED:
        path = f"{checkpoint_dir(spark).rstrip('/')}/labelled-{uuid.uuid4().hex}"
        narrow = _rated(clean_columns(spark, sf_dir, "UserID", "MovieID", "date_time", "UserRating")).select(
            "UserID", "MovieID", "date_time", "UserRating", "NormUserRating", "is_train")
        write_parquet(narrow, path, compression="zstd")
        _LABELLED[key] = read_ratings(spark, path)
    return _LABELLED[key]


def mean_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stand-in model outputs on the latest test rating of each pair.

    ``als_prediction`` = the user's mean training label, ``lr_prediction``
    = the item's mean training label.  Returns (als_preds, lr_preds).
    """
    df = labelled(spark, sf_dir)
    train = df.filter("is_train")
    test = latest_rating_per_pair(df.filter(~F.col("is_train")).select(
        "UserID", "MovieID", "date_time", "UserRating", "NormUserRating"))
    um = train.groupBy("UserID").agg(F.avg("NormUserRating").alias("als_prediction"))
    im = train.groupBy("MovieID").agg(F.avg("NormUserRating").alias("lr_prediction"))
    als = test.join(um, "UserID").select("UserID", "MovieID", "als_prediction", "NormUserRating")
    lr = test.join(im, "MovieID").select("UserID", "MovieID", "lr_prediction", "NormUserRating")
    return als, lr


MEAN_PRED_CTES = {
    "base": "SELECT UserID, MovieID, date_time, UserRating, (UserRating - 1.0) / 4.0 AS NormUserRating, is_train "
            "FROM split",
    "test_latest": """SELECT UserID, MovieID, NormUserRating FROM (
                        SELECT *, row_number() OVER (PARTITION BY UserID, MovieID
                                                     ORDER BY date_time DESC, UserRating DESC) AS rn
                        FROM base WHERE NOT is_train) WHERE rn = 1""",
    "um": "SELECT UserID, avg(NormUserRating) AS als_prediction FROM base WHERE is_train GROUP BY UserID",
    "im": "SELECT MovieID, avg(NormUserRating) AS lr_prediction FROM base WHERE is_train GROUP BY MovieID",
    "combined": """SELECT t.UserID, t.MovieID, um.als_prediction, t.NormUserRating AS NormUserRating_als,
                          im.lr_prediction, t.NormUserRating AS NormUserRating_lr
                   FROM test_latest t JOIN um ON t.UserID = um.UserID JOIN im ON t.MovieID = im.MovieID""",
}


def _mp_sql(body: str) -> str:
    return with_ctes(body, "split", extra=MEAN_PRED_CTES)


# ------------------------------------------------------------------ prediction algebra (SQL-checked)

@register("combined_predictions", _mp_sql("""
SELECT UserID, MovieID, round(als_prediction, 9) AS als_prediction, NormUserRating_als,
       round(lr_prediction, 9) AS lr_prediction, NormUserRating_lr FROM combined"""))
def q_combined_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10 (after O-07): both models' predictions on the same test pairs, both labels kept."""
    als, lr = mean_predictions(spark, sf_dir)
    c = combine_predictions(als, lr)
    return c.withColumns({"als_prediction": F.round("als_prediction", 9),
                          "lr_prediction": F.round("lr_prediction", 9)})


_W_VALUES = ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in SWEEP_WEIGHTS)


@register("weight_sweep", _mp_sql(f"""
SELECT w.weight_als, w.weight_lr,
       round(sqrt(avg(pow(w.weight_als * c.als_prediction + w.weight_lr * c.lr_prediction
                          - (c.NormUserRating_als + c.NormUserRating_lr) / 2.0, 2))), 9) AS rmse,
       count(*) AS n
FROM combined c CROSS JOIN (VALUES {_W_VALUES}) AS w(weight_als, weight_lr)
GROUP BY w.weight_als, w.weight_lr"""))
def q_weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-01: blend RMSE for each weight pair in one aggregation pass."""
    als, lr = mean_predictions(spark, sf_dir)
    s = sweep_weights(combine_predictions(als, lr))
    return s.withColumn("rmse", F.round("rmse", 9))


@register("prediction_rmse", _mp_sql("""
SELECT 'als' AS model, round(sqrt(avg(pow(NormUserRating_als - als_prediction, 2))), 9) AS rmse, count(*) AS n
FROM combined
UNION ALL
SELECT 'lr' AS model, round(sqrt(avg(pow(NormUserRating_lr - lr_prediction, 2))), 9) AS rmse, count(*) AS n
FROM combined"""))
def q_prediction_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-13: holdout RMSE of each model on the shared test pairs."""
    als, lr = mean_predictions(spark, sf_dir)
    c = combine_predictions(als, lr)
    one = c.select(F.sqrt(F.avg(F.pow(F.col("NormUserRating_als") - F.col("als_prediction"), 2))).alias("als"),
                   F.sqrt(F.avg(F.pow(F.col("NormUserRating_lr") - F.col("lr_prediction"), 2))).alias("lr"),
                   F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.round(F.col(m), 9).alias("rmse")) for m in ("als", "lr")])
    return one.select(F.inline(rows), "n")   # both errors in one aggregation pass


@register("blend_scores", _mp_sql(f"""
SELECT UserID, MovieID,
       round({SERVING_WEIGHTS[0]} * als_prediction + {SERVING_WEIGHTS[1]} * lr_prediction, 9) AS hybrid_score,
       round((NormUserRating_als + NormUserRating_lr) / 2.0, 9) AS label,
       round(({SERVING_WEIGHTS[0]} * als_prediction + {SERVING_WEIGHTS[1]} * lr_prediction) * 4.0 + 1.0, 9)
           AS hybrid_rating
FROM combined"""))
def q_blend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-12 + X-13 + X-11: serving blend (.7/.3), mean label, blend on the 1..5 scale."""
    als, lr = mean_predictions(spark, sf_dir)
    c = combine_predictions(als, lr)
    h = blend("als_prediction", "lr_prediction", *SERVING_WEIGHTS)
    return c.select("UserID", "MovieID", F.round(h, 9).alias("hybrid_score"),
                    F.round(mean_label("NormUserRating_als", "NormUserRating_lr"), 9).alias("label"),
                    F.round(denormalize_rating(h, "minmax"), 9).alias("hybrid_rating"))


@register("request_routing", with_ctes("""
SELECT q.RequestID, q.UserID, q.MovieID,
       CASE WHEN q.UserID IN (SELECT UserID FROM split WHERE is_train)
             AND q.MovieID IN (SELECT MovieID FROM split WHERE is_train) THEN 'ALS'
            WHEN q.MovieID IN (SELECT p_partkey FROM part) THEN 'LR'
            ELSE 'Fallback' END AS model_choice
FROM requests q""", "split", "requests"))
def q_request_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-02: per request, ALS if user and item are known to the factor model
    (= present in its training split), else LR if the item is in the title table, else Fallback."""
    df = labelled(spark, sf_dir)
    train = df.filter("is_train")
    r = choose_model(requests(spark, sf_dir).select("RequestID", "UserID", "MovieID"),
                     train.select("UserID"), train.select("MovieID"), raw_titles(spark, sf_dir))
    return r.select("RequestID", "UserID", "MovieID", "model_choice")


@register("routed_predictions", with_ctes("""
SELECT q.RequestID, q.UserID, q.MovieID, model_choice,
       round(CASE model_choice WHEN 'ALS' THEN um.als_prediction WHEN 'LR' THEN im.lr_prediction END, 9) AS prediction
FROM (SELECT *, CASE WHEN UserID IN (SELECT UserID FROM um) AND MovieID IN (SELECT MovieID FROM im) THEN 'ALS'
                     WHEN MovieID IN (SELECT p_partkey FROM part) THEN 'LR' ELSE 'Fallback' END AS model_choice
      FROM requests) q
LEFT JOIN um ON um.UserID = q.UserID LEFT JOIN im ON im.MovieID = q.MovieID""", "split", "requests",
    extra=MEAN_PRED_CTES))
def q_routed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-02 + R-03: each request routed, then the chosen model's score (user and title means as the models)."""
    train = labelled(spark, sf_dir).filter("is_train")
    um = train.groupBy("UserID").agg(F.avg("NormUserRating").alias("als_prediction"))
    im = train.groupBy("MovieID").agg(F.avg("NormUserRating").alias("lr_prediction"))
    routed = choose_model(requests(spark, sf_dir).select("RequestID", "UserID", "MovieID"), um, im,
                          raw_titles(spark, sf_dir))
    scored = predict_by_choice(routed.join(um, "UserID", "left").join(im, "MovieID", "left"))
    return scored.select("RequestID", "UserID", "MovieID", "model_choice", F.round("prediction", 9).alias("prediction"))


# ------------------------------------------------------------------ features (F-01 to F-05 and F-07 SQL-checked)

def _index_sql() -> str:
    parts = []
    for c in CATEGORICAL:
        parts.append(f"""SELECT '{c}' AS "column", value,
                 CAST(row_number() OVER (ORDER BY cnt DESC, value) - 1 AS DOUBLE) AS "index"
          FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM clean
                WHERE {c} IS NOT NULL GROUP BY 1)""")
    return with_ctes("\nUNION ALL\n".join(parts), "clean")


@register("category_index", _index_sql())
def q_category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-01: frequency-descending index of each categorical value (ties alphabetical)."""
    return category_index_table(clean(spark, sf_dir), CATEGORICAL)


def _stop_words() -> list[str]:
    from reelsight.operators.features import default_stop_words
    return default_stop_words("english")


def _term_sql() -> str:
    sw = ", ".join("'" + w.replace("'", "''") + "'" for w in _stop_words())
    return with_ctes("""
SELECT tf.MovieID, tf.term, tf.tf, d.df, round(tf.tf * ln((n.n + 1.0) / (d.df + 1.0)), 9) AS weight
FROM tf JOIN dfq d ON tf.term = d.term CROSS JOIN n""", "clean", extra={
        "docs": "SELECT DISTINCT MovieID, plot_outline FROM clean WHERE plot_outline IS NOT NULL",
        "tok": "SELECT MovieID, unnest(regexp_split_to_array(lower(plot_outline), '[ \\t\\n\\x0B\\f\\r]+')) AS term "
               "FROM docs",
        "tf": f"SELECT MovieID, term, count(*) AS tf FROM tok WHERE term <> '' AND term NOT IN ({sw}) GROUP BY 1, 2",
        "dfq": "SELECT term, count(*) AS df FROM tf GROUP BY term",
        "n": "SELECT count(*) AS n FROM docs"})


@register("term_weights", _term_sql())
def q_term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-07: TF-IDF weights per (title, term) over every title's whole plot."""
    docs = items_standin(spark, sf_dir).filter(F.col("plot_outline").isNotNull())
    tw = term_weights(docs, "MovieID", "plot_outline")
    return tw.withColumn("weight", F.round("weight", 9))


def _token_sql() -> str:
    sw = ", ".join("'" + w.replace("'", "''") + "'" for w in _stop_words())
    return f"""
WITH texts AS (SELECT p_partkey AS MovieID, lower(CASE WHEN p_partkey % 31 = 0 THEN '' ELSE coalesce(d.text, '') END) AS t
               FROM part LEFT JOIN documents d ON d.doc_id = p_partkey % (SELECT count(*) FROM documents)),
tok AS (SELECT MovieID, CASE WHEN t <> '' AND regexp_full_match(t, '[ \t\n\x0B\f\r]+') THEN []
                        ELSE regexp_split_to_array(regexp_replace(t, '[ \t\n\x0B\f\r]+$', ''), '[ \t\n\x0B\f\r]')
                        END AS tokens FROM texts),
kept AS (SELECT MovieID, tokens, list_filter(tokens, lambda x: x NOT IN ({sw})) AS filtered FROM tok)
SELECT MovieID, CAST(len(tokens) AS INT) AS n_tokens, CAST(len(filtered) AS INT) AS n_filtered,
       CAST(len(filtered) AS DOUBLE) AS n_hashed FROM kept"""


@register("plot_tokens", _token_sql())
def q_plot_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-03 to F-05 per title: tokens, tokens without stop words, and the sum of the hashed counts (the same)."""
    df = items_standin(spark, sf_dir)
    for stage in text_stages()[:-1]:   # all but the fitted IDF
        df = stage.transform(df)
    counts = F.unwrap_udt("plot_tf")["values"]
    return df.select("MovieID", F.size("plot_tokens").alias("n_tokens"), F.size("plot_filtered").alias("n_filtered"),
                     F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x).alias("n_hashed"))


def _slot_sql() -> str:
    index = {f"ix_{c}": f"""SELECT {c} AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) - 1
                              AS INT) AS slot FROM split WHERE is_train AND {c} IS NOT NULL GROUP BY {c}"""
             for c in CATEGORICAL}
    cols = ", ".join(f"ix_{c}.slot AS {VECTOR_NAMES[c]}" for c in CATEGORICAL)
    joins = " ".join(f"LEFT JOIN ix_{c} ON s.{c} = ix_{c}.v" for c in CATEGORICAL)
    return with_ctes(f"SELECT s.UserID, s.MovieID, s.date_time, {cols} FROM split s {joins}", "split", extra=index)


@register("one_hot_slots", _slot_sql())
def q_one_hot_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-02 per rating row: the active slot of each one-hot vector (NULL: a value the fit has not seen)."""
    t = trained(spark, sf_dir)
    encoded = t["df"].select("UserID", "MovieID", "date_time", *CATEGORICAL)
    for stage in t["feature_model"].row_model.stages:
        if isinstance(stage, (StringIndexerModel, OneHotEncoderModel)):
            encoded = stage.transform(encoded)
    return encoded.select("UserID", "MovieID", "date_time", *[
        F.get(F.unwrap_udt(VECTOR_NAMES[c])["indices"], F.lit(0)).alias(VECTOR_NAMES[c]) for c in CATEGORICAL])


# ------------------------------------------------------------------ fitted models (checked by tests)

_CACHE: dict = {}


#: Label the models train on; "identity" (1..5 stars) keeps the documented penalties on their own scale.
LABEL_METHOD = "identity"


class Trained:
    """The split and the fitted models of one input, each made when it is first asked for.

    No rating row is stored here: the split is read from the stored wide table,
    and the content vectors, a text vector's size each, pass by as they are read.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, method: str):
        self._spark, self._sf_dir, self._made = spark, sf_dir, {"method": method}

    def __getitem__(self, part: str):
        if part not in self._made:
            self._made[part] = getattr(self, f"_make_{part}")()
        return self._made[part]

    def __contains__(self, part: str) -> bool:
        """Whether the part has been made."""
        return part in self._made

    def _make_df(self) -> DataFrame:
        return rated(self._spark, self._sf_dir, self["method"])

    def _make_train(self) -> DataFrame:
        return self["df"].filter("is_train")

    def _make_test(self) -> DataFrame:
        return self["df"].filter(~F.col("is_train"))

    def _make_als(self):
        return train_als(self["train"].select("UserID", "MovieID", "NormUserRating"), rank=10, reg=0.1, iters=10)

    def _make_feature_model(self):
        return fit_features(self["train"], items_standin(self._spark, self._sf_dir))

    def _make_features(self) -> DataFrame:
        return self["feature_model"].transform(self["df"]).select(
            "UserID", "MovieID", "date_time", "UserRating", "NormUserRating", "is_train", "content_features")

    def _make_lr(self):
        return train_linear(self["features"].filter("is_train"), cache_input=False)   # one pass, no vector is stored


def trained(spark: SparkSession, sf_dir: str, method: str = LABEL_METHOD) -> Trained:
    """Split, ALS, features and linear model, each fitted once per session, scale factor and label method.

    A query pays for the parts it reads.  The penalties (ALS 0.1, linear 0.1)
    belong to a label in stars.  On the 0..1 label of ``method="minmax"`` the
    same numbers weigh more (the linear one four times), and the elastic net
    keeps fewer coefficients.
    """
    key = (session_key(spark), sf_dir, method)
    if key not in _CACHE:
        checkpoint_dir(spark)
        _CACHE[key] = Trained(spark, sf_dir, method)
    return _CACHE[key]


@register("content_features")
def q_content_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-08..F-11: content feature vector per rating row (size, non-zeros, L2 norm reported)."""
    f = trained(spark, sf_dir)["features"]
    v = F.unwrap_udt("content_features")   # type 0 sparse (size, indices, values), 1 dense (values)
    size = F.coalesce(v["size"], F.size(v["values"]))
    return f.select("UserID", "MovieID", "NormUserRating", size.alias("n_features"),
                    F.size(F.filter(v["values"], lambda x: x != 0)).alias("n_nonzero"),
                    F.round(F.sqrt(F.aggregate(v["values"], F.lit(0.0), lambda acc, x: acc + x * x)), 6).alias("l2"))


@register("als_holdout")
def q_als_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-01 + L-04 + L-05: ALS (rank 10, reg 0.1, 10 iterations) fitted on the train split, RMSE on test."""
    t = trained(spark, sf_dir)
    pred = predict_als(t["als"], latest_rating_per_pair(t["test"].select(
        "UserID", "MovieID", "date_time", "UserRating", "NormUserRating")))
    return rmse(pred, "NormUserRating", "als_prediction")


@register("als_tuning")
def q_als_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-02: the 27-point grid (rank x reg x iterations), 3 hash folds; one row per grid point."""
    t = trained(spark, sf_dir)
    tuned = tune_als(t["train"].select("UserID", "MovieID", "NormUserRating"),
                     parallelism=int(os.environ.get("REELSIGHT_CV_PARALLELISM", "0")) or None)
    return tuned.results


@register("linear_holdout")
def q_linear_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-06 + L-07: elastic-net content model on the train split, RMSE on test."""
    t = trained(spark, sf_dir)
    pred = predict_linear(t["lr"], t["test"], features=t["feature_model"])
    return rmse(pred, "NormUserRating", "lr_prediction")


def _dimensions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per title and one per user of the wide table, without its texts."""
    def one(key: str, cols: list[str]) -> DataFrame:
        # the same for every rating of the id, so any aggregate that skips nothing will do
        return df.groupBy(key).agg(F.max(F.struct(*cols)).alias("_d")).select(key, "_d.*")
    return (one("MovieID", ["Genres", "directedBy", "starring", "rating_imdb", "runtimes"]),
            one("UserID", ["Gender", "Occupation_Name", "Age"]))


@register("joined_slots", _slot_sql())
def q_joined_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-01 + F-02 by joins: the slots of titles and of users, looked up in a distributed index, per rating row."""
    df = rated(spark, sf_dir)
    slots = category_slots(df.filter("is_train")).checkpoint()
    titles, users = _dimensions(df)
    t = encode_slots(titles, slots, {c: VECTOR_NAMES[c] for c in ("Genres", "directedBy", "starring")})
    u = encode_slots(users, slots, {c: VECTOR_NAMES[c] for c in ("Occupation_Name", "Gender", "Age")})
    return df.select("UserID", "MovieID", "date_time").join(t, "MovieID").join(u, "UserID").select(
        "UserID", "MovieID", "date_time", *[VECTOR_NAMES[c] for c in CATEGORICAL])


_SHARE = 0.01


@register("frequent_categories", with_ctes("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", value, CAST(row_number() OVER (ORDER BY cnt DESC, value) - 1 AS INT) AS slot
        FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM clean WHERE {c} IS NOT NULL GROUP BY 1)
        WHERE cnt >= {_SHARE} * (SELECT count({c}) FROM clean)""" for c in CATEGORICAL), "clean"))
def q_frequent_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-01 with a cut-off: only values that at least one rating row in a hundred has get a slot."""
    return category_slots(clean(spark, sf_dir), min_share=_SHARE)


@register("factorised_holdout")
def q_factorised_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-06 + L-07 over the un-joined tables: the content model without a vector per rating row, RMSE on test."""
    df = rated(spark, sf_dir, LABEL_METHOD)
    titles, users = _dimensions(df)
    items = items_standin(spark, sf_dir)
    train = df.filter("is_train")
    text = fit_text_model(items.join(train.select("MovieID").distinct(), "MovieID", "left_semi"))
    model = train_factorised(train, titles, users, item_text_features(text, items))
    return rmse(model.predict(df.filter(~F.col("is_train"))), "NormUserRating", "lr_prediction")


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10 on the fitted models: ALS and LR predictions for the latest test rating of each pair."""
    t = trained(spark, sf_dir)
    test_latest = latest_rating_per_pair(t["test"].select("UserID", "MovieID", "date_time", "UserRating",
                                                          "NormUserRating"))
    als = predict_als(t["als"], test_latest)
    lr = predict_linear(t["lr"], t["test"], features=t["feature_model"]).select(
        "UserID", "MovieID", "date_time", "UserRating", "NormUserRating", "lr_prediction")
    lr = lr.join(test_latest.select("UserID", "MovieID", "date_time"), ["UserID", "MovieID", "date_time"], "left_semi")
    return combine_predictions(als, latest_rating_per_pair(lr))     # no feature moves: the score is taken first


@register("hybrid_sweep")
def q_hybrid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-01 on the fitted models: RMSE per weight pair."""
    return sweep_weights(model_predictions(spark, sf_dir))


@register("score_requests")
def q_score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-06: every request scored (blend, single model or none) with the model used."""
    t = trained(spark, sf_dir)
    return score_requests(requests(spark, sf_dir), t["als"], t["lr"], t["feature_model"],
                          serving_users(spark, sf_dir), serving_items(spark, sf_dir), method=t["method"])


DECISIONS = with_ctes("""
SELECT RequestID, UserID, MovieID, has_als, has_lr,
       CASE WHEN has_als AND has_lr THEN 'Hybrid' WHEN has_als THEN 'ALS' WHEN has_lr THEN 'LR'
            ELSE 'Fallback' END AS model_used
FROM (SELECT q.RequestID, q.UserID, q.MovieID,
             q.UserID IN (SELECT UserID FROM split WHERE is_train)
               AND q.MovieID IN (SELECT MovieID FROM split WHERE is_train) AS has_als,
             q.MovieID IN (SELECT p_partkey FROM part) AS has_lr
      FROM requests q)""", "split", "requests")


def decisions(scored: DataFrame) -> DataFrame:
    """Which scores each scored request has, and the model used."""
    return scored.select("RequestID", "UserID", "MovieID", F.col("als_prediction").isNotNull().alias("has_als"),
                         F.col("lr_prediction").isNotNull().alias("has_lr"), "model_used")


@register("score_decisions", DECISIONS)
def q_score_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-06: which models scored each request, on the fitted models' output."""
    return decisions(q_score_requests(spark, sf_dir))


@register("als_holdout_pairs", _mp_sql("""
SELECT t.UserID, t.MovieID, t.NormUserRating * 4.0 + 1.0 AS NormUserRating FROM test_latest t
WHERE t.UserID IN (SELECT UserID FROM base WHERE is_train)
  AND t.MovieID IN (SELECT MovieID FROM base WHERE is_train)"""))
def q_als_holdout_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-04: the test pairs that the factor model predicts (cold-start rows dropped), with their label."""
    t = trained(spark, sf_dir)
    return predict_als(t["als"], latest_rating_per_pair(t["test"].select(
        "UserID", "MovieID", "date_time", "UserRating", "NormUserRating"))).select(
        "UserID", "MovieID", "NormUserRating")


@register("recommend_all")
def q_recommend_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-05: per user, the 10 best unseen titles predicted in the 4..5 band."""
    t = trained(spark, sf_dir)
    return recommend_for_all(t["als"], t["df"], n=10, method=t["method"])


@register("recommend_all_pruned")
def q_recommend_all_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-05, fast mode: the same lists from norm-ordered blocks, without those that cannot reach them."""
    t = trained(spark, sf_dir)
    return recommend_for_all_pruned(t["als"], t["df"], n=10, method=t["method"]).recommendations


#: Stands for ids beyond INT: users above 2^33, titles above 2^31.
WIDE_USER, WIDE_ITEM = 1 << 33, 1 << 31


def _wide_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({"UserID": F.col("UserID").cast("long") * 3 + WIDE_USER,
                           "MovieID": F.col("MovieID").cast("long") + WIDE_ITEM})


@register("id_numbers", with_ctes(f"""
SELECT id, CAST(CASE WHEN early THEN row_number() OVER (PARTITION BY early ORDER BY id) - 1
                     ELSE (SELECT count(*) FROM ids WHERE early) + row_number() OVER (PARTITION BY early ORDER BY id) - 1
                     END AS INT) AS number
FROM ids""", "clean", extra={"ids": f"""
SELECT UserID * 3 + {WIDE_USER} AS id, min(date_time) < TIMESTAMP '1993-01-01' AS early FROM clean GROUP BY UserID"""}))
def q_id_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-01's dictionary, built from the users of the first time slice and extended by all others."""
    df = _wide_ids(clean(spark, sf_dir).select("UserID", "MovieID", "date_time"))
    numbers = IdDictionary(spark, f"{checkpoint_dir(spark).rstrip('/')}/user-numbers-{uuid.uuid4().hex}")
    numbers.extend(df.where(F.col("date_time") < F.lit("1993-01-01").cast("timestamp_ntz")).select("UserID"))
    numbers.extend(df.select("UserID"))
    return numbers.table()


@register("wide_id_holdout_pairs", _mp_sql(f"""
SELECT t.UserID * 3 + {WIDE_USER} AS UserID, t.MovieID + {WIDE_ITEM} AS MovieID, t.NormUserRating FROM test_latest t
WHERE t.UserID IN (SELECT UserID FROM base WHERE is_train)
  AND t.MovieID IN (SELECT MovieID FROM base WHERE is_train)"""))
def q_wide_id_holdout_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-01 + L-04 on ids beyond INT: the test pairs that the model trained through the dictionaries predicts."""
    df = labelled(spark, sf_dir)
    base = f"{checkpoint_dir(spark).rstrip('/')}/wide-ids-{uuid.uuid4().hex}"
    model = train_als_by_ids(_wide_ids(df.filter("is_train").select("UserID", "MovieID", "NormUserRating")),
                             IdDictionary(spark, f"{base}/users"), IdDictionary(spark, f"{base}/items"), rank=5, iters=5)
    test = latest_rating_per_pair(df.filter(~F.col("is_train")).select(
        "UserID", "MovieID", "date_time", "UserRating", "NormUserRating"))
    scored = model.transform(_wide_ids(test.select("UserID", "MovieID", "NormUserRating")))
    return scored.where(~F.isnan("prediction")).select("UserID", "MovieID", "NormUserRating")


@register("saved_model_decisions", DECISIONS)
def q_saved_model_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-10: the fitted models published as one version, loaded again, and used to score every request (R-06)."""
    t = trained(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    publish_models(spark, path, ServingModels(t["als"], t["lr"], t["feature_model"]), {"method": t["method"]})
    m = load_models(spark, path)
    return decisions(score_requests(requests(spark, sf_dir), m.als, m.linear, m.features, serving_users(spark, sf_dir),
                                    serving_items(spark, sf_dir), method=t["method"]))


#: The user whose lists the one-user queries show.
SHOWN_USER = 1


@register("user_candidates", with_ctes(f"""
SELECT DISTINCT c.MovieID, CAST({SHOWN_USER} AS BIGINT) AS UserID FROM clean c
WHERE c.MovieID NOT IN (SELECT MovieID FROM clean WHERE UserID = {SHOWN_USER})""", "clean"))
def q_user_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-04's candidates: every rated title that the user has not rated."""
    return candidate_items(clean(spark, sf_dir), SHOWN_USER)


@register("recommend_user")
def q_recommend_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-04 + O-05 + J-09: the user's 10 best candidates in the 4..5 band, with title and genres."""
    t = trained(spark, sf_dir)
    return recommend_for_user(t["als"], t["df"], SHOWN_USER, n=10, method=t["method"])[0]


@register("user_projection")
def q_user_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-08: 2-D PCA coordinates of each user's genre-share vector, with the dominant genre."""
    return user_projection(clean(spark, sf_dir), STANDIN_GENRES)


def _shares_sql(body: str) -> str:
    """``body`` over ``shares``: one row per user, one column per genre."""
    cells = ", ".join(f"avg(CAST(coalesce(list_contains(string_split(Genres, '|'), '{g}'), false) AS INT)) AS \"{g}\""
                      for g in STANDIN_GENRES)
    return with_ctes(body, "clean", extra={"shares": f"SELECT UserID, {cells} FROM clean GROUP BY UserID"})


_SQUARES = " + ".join(f'"{g}" * "{g}"' for g in STANDIN_GENRES)
_TRACE = " + ".join(f'var_samp("{g}")' for g in STANDIN_GENRES)
_FROBENIUS = " + ".join(f'{1 if g == h else 2} * pow(covar_samp("{g}", "{h}"), 2)'
                        for i, g in enumerate(STANDIN_GENRES) for h in STANDIN_GENRES[i:])


@register("projection_lengths", _shares_sql(f"SELECT UserID, round({_SQUARES}, 9) AS squared_length FROM shares"))
def q_projection_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-08 along all axes: a rotation, so a user's squared length is that of the genre shares."""
    c = genre_coordinates(clean(spark, sf_dir), STANDIN_GENRES, len(STANDIN_GENRES))
    return c.select("UserID", F.round(F.aggregate("coordinates", F.lit(0.0), lambda s, x: s + x * x), 9)
                    .alias("squared_length"))


@register("projection_variances", _shares_sql(f"""
SELECT round({_TRACE}, 9) AS total_variance, round({_FROBENIUS}, 9) AS squared_variances,
       CAST(0 AS DOUBLE) AS correlation, true AS falling FROM shares"""))
def q_projection_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-08: the axes keep the shares' variance and the sum of squares of its matrix, don't correlate, and fall.

    A matrix and its eigenvalues agree in both sums, and only the covariance's own
    axes leave coordinates without correlation.
    """
    d = len(STANDIN_GENRES)
    v = axis_variances(genre_coordinates(clean(spark, sf_dir), STANDIN_GENRES, d), d)
    own = F.when(F.col("axis_a") == F.col("axis_b"), F.col("covariance"))
    other = F.when(F.col("axis_a") != F.col("axis_b"), F.abs("covariance"))
    falling = F.sort_array(F.collect_list(F.when(own.isNotNull(), F.struct(F.col("axis_a"), own.alias("variance")))))
    return v.agg(F.round(F.sum(own), 9).alias("total_variance"), F.round(F.sum(own * own), 9).alias("squared_variances"),
                 F.abs(F.round(F.max(other), 9)).alias("correlation"), falling.alias("by_axis")).select(
        "total_variance", "squared_variances", "correlation",
        F.forall(F.sequence(F.lit(0), F.lit(d - 2)), lambda i: F.col("by_axis")[i]["variance"] + 1e-12
                 >= F.col("by_axis")[i + 1]["variance"]).alias("falling"))


@register("request_stream")
def q_request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-01: the requests landed as files, scored by a file-source stream (foreachBatch R-06)."""
    from reelsight.schemas import REQUEST_SCHEMA
    from reelsight.streaming.requests import read_scored, request_stream, score_request_stream
    t = trained(spark, sf_dir)
    users, items = serving_users(spark, sf_dir), serving_items(spark, sf_dir)
    base = checkpoint_dir(spark).rstrip("/") + f"/request-stream-{uuid.uuid4().hex}"
    reqs = requests(spark, sf_dir).select(*[f.name for f in REQUEST_SCHEMA.fields])
    reqs.write.mode("overwrite").json(f"{base}/source")
    q = score_request_stream(
        request_stream(spark, f"{base}/source", max_files_per_trigger=4),
        lambda b: score_requests(b, t["als"], t["lr"], t["feature_model"], users, items, method=t["method"]),
        f"{base}/sink", f"{base}/checkpoint")
    q.awaitTermination()
    return read_scored(spark, f"{base}/sink").drop("batch_id")


@register("stream_decisions", DECISIONS)
def q_stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-01: the decisions of the streamed requests; the same as of the batch."""
    return decisions(q_request_stream(spark, sf_dir))
