"""Registered queries: ingest joins, distinct/latest, requests (build step 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsight.operators.joins import (annotate_items, build_wide_ratings, dedupe_metadata, exclude_seen,
                                       join_enrichment, join_metadata, join_titles, join_users, known_pairs,
                                       unmatched_titles)
from reelsight.operators.ordering import distinct_items, latest_rating_per_pair
from reelsight.plans.eda_queries import clean
from reelsight.plans.registry import register
from reelsight.plans.sql import RATING, TITLE, with_ctes
from reelsight.plans.standin import (raw_details, raw_metadata, raw_ratings, raw_titles, raw_users,
                                     requests)
from reelsight.sources.enrichment import pending_enrichment_ids
from reelsight.sources.files import profile_shape

RAW = {
    "raw_ratings": f"""SELECT o.o_custkey AS UserID, l.l_partkey AS MovieID, {RATING} AS Rating,
                             CAST(epoch(l.l_shipdate) AS BIGINT) AS Timestamp
                      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "raw_titles": f"""SELECT p_partkey AS MovieID, {TITLE} AS Title, REPLACE(p_name, ' ', '|') AS Genres
                     FROM part""",
    "raw_users": """SELECT c_custkey AS UserID, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS Gender,
                      CASE WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 1500 THEN 18
                           WHEN c_acctbal < 3500 THEN 25 WHEN c_acctbal < 5500 THEN 35
                           WHEN c_acctbal < 7000 THEN 45 WHEN c_acctbal < 8500 THEN 50 ELSE 56 END AS Age,
                      CAST(c_nationkey % 21 AS INT) AS Occupation,
                      CONCAT(LPAD(CAST(c_custkey % 40 AS VARCHAR), 3, '0'), '00') AS Zip_Code
                    FROM customer""",
    "raw_metadata": f"""SELECT {TITLE} AS title, p_brand AS directedBy, p_type AS starring,
                              p_retailprice / 400 AS avgRating, p_partkey AS imdbId
                       FROM part WHERE p_partkey % 37 <> 5""",
    "meta_one": """SELECT title AS Title, imdbId, directedBy, starring, avgRating FROM (
                     SELECT *, row_number() OVER (PARTITION BY title ORDER BY imdbId) AS rn FROM raw_metadata)
                   WHERE rn = 1""",
    "raw_details": f"""SELECT {TITLE} AS localized_title,
                        CASE WHEN p.p_partkey % 23 = 0 THEN '90, 100' WHEN p.p_partkey % 29 = 0 THEN NULL
                             ELSE CAST(60 + p.p_size AS VARCHAR) END AS runtimes,
                        CASE WHEN p.p_partkey % 17 = 0 THEN 'N/A'
                             ELSE CONCAT(CAST(p.p_partkey % 10 AS VARCHAR), '.5') END AS rating_imdb,
                        CASE WHEN p.p_partkey % 31 = 0 THEN NULL ELSE d.text END AS plot_outline,
                        p.p_brand AS director,
                        LPAD(CAST(p.p_partkey AS VARCHAR), 19, '0') AS imdbID
                      FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey % (SELECT count(*) FROM documents)""",
}


def _raw(body: str, *names: str, common: tuple[str, ...] = ()) -> str:
    return with_ctes(body, *common, extra={n: RAW[n] for n in names})


@register("join_titles", _raw("""
SELECT r.UserID, r.MovieID, r.Rating, r.Timestamp, t.Title, t.Genres
FROM raw_ratings r JOIN raw_titles t ON r.MovieID = t.MovieID""", "raw_ratings", "raw_titles"))
def q_join_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-01: ratings with title and genres."""
    return join_titles(raw_ratings(spark, sf_dir), raw_titles(spark, sf_dir)).select(
        "UserID", "MovieID", "Rating", "Timestamp", "Title", "Genres")


@register("join_users", _raw("""
SELECT r.UserID, r.MovieID, r.Rating, u.Gender, u.Age, u.Occupation, u.Zip_Code
FROM raw_ratings r JOIN raw_users u ON r.UserID = u.UserID""", "raw_ratings", "raw_users"))
def q_join_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-02: ratings with user attributes."""
    return join_users(raw_ratings(spark, sf_dir), raw_users(spark, sf_dir)).select(
        "UserID", "MovieID", "Rating", "Gender", "Age", "Occupation", "Zip_Code")


@register("join_metadata", _raw("""
SELECT t.MovieID, t.Title, t.Genres, m.imdbId, m.directedBy, m.starring, m.avgRating
FROM raw_titles t JOIN meta_one m ON t.Title = m.Title""", "raw_titles", "raw_metadata", "meta_one"))
def q_join_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-03: metadata on title text, one metadata row per title (smallest id)."""
    return join_metadata(raw_titles(spark, sf_dir), raw_metadata(spark, sf_dir)).select(
        "MovieID", "Title", "Genres", "imdbId", "directedBy", "starring", "avgRating")


@register("join_metadata_all", _raw("""
SELECT t.MovieID, t.Title, t.Genres, m.imdbId, m.directedBy, m.starring, m.avgRating
FROM raw_titles t JOIN raw_metadata m ON t.Title = m.title""", "raw_titles", "raw_metadata"))
def q_join_metadata_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-03 with every match kept: a title text that repeats yields a row per metadata row."""
    return join_metadata(raw_titles(spark, sf_dir), raw_metadata(spark, sf_dir), dedupe=False).select(
        "MovieID", "Title", "Genres", "imdbId", "directedBy", "starring", "avgRating")


@register("unmatched_titles", _raw("""
SELECT t.MovieID, t.Title FROM raw_titles t
WHERE NOT EXISTS (SELECT 1 FROM raw_metadata m WHERE m.title = t.Title)""", "raw_titles", "raw_metadata"))
def q_unmatched_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-03: titles that the inner title join loses, because no metadata row has their text."""
    return unmatched_titles(raw_titles(spark, sf_dir), raw_metadata(spark, sf_dir)).select("MovieID", "Title")


@register("join_enrichment", _raw("""
SELECT m.Title, m.imdbId, m.directedBy, d.localized_title, d.runtimes, d.rating_imdb, d.plot_outline, d.director
FROM meta_one m JOIN raw_details d ON TRY_CAST(CAST(m.imdbId AS VARCHAR) AS BIGINT) = TRY_CAST(d.imdbID AS BIGINT)""",
    "raw_metadata", "meta_one", "raw_details"))
def q_join_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-04: details on the external id (int on the left, zero-padded text on the right)."""
    meta = dedupe_metadata(raw_metadata(spark, sf_dir).withColumnRenamed("title", "Title"))
    return join_enrichment(meta, raw_details(spark, sf_dir)).select(
        "Title", "imdbId", "directedBy", "localized_title", "runtimes", "rating_imdb", "plot_outline", "director")


WIDE_COLS = ["UserID", "MovieID", "Rating", "Timestamp", "date_time", "Title", "Genres", "Gender", "Age",
             "Occupation", "Zip_Code", "imdbId", "directedBy", "starring", "avgRating", "localized_title",
             "runtimes", "rating_imdb", "director"]


@register("wide_ratings", _raw("""
SELECT r.UserID, r.MovieID, r.Rating, r.Timestamp, make_timestamp(r.Timestamp * 1000000) AS date_time, t.Title, t.Genres,
       u.Gender, u.Age, u.Occupation, u.Zip_Code, m.imdbId, m.directedBy, m.starring, m.avgRating,
       d.localized_title, d.runtimes, d.rating_imdb, d.director, length(d.plot_outline) AS plot_chars
FROM raw_ratings r
JOIN raw_titles t ON r.MovieID = t.MovieID
JOIN raw_users u ON r.UserID = u.UserID
JOIN meta_one m ON t.Title = m.Title
JOIN raw_details d ON TRY_CAST(CAST(m.imdbId AS VARCHAR) AS BIGINT) = TRY_CAST(d.imdbID AS BIGINT)""",
    "raw_ratings", "raw_titles", "raw_users", "raw_metadata", "meta_one", "raw_details"))
def q_wide_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-05: ratings with titles, users, metadata and details; the plot enters by its length."""
    details = raw_details(spark, sf_dir, of_plot=F.length).withColumn("plot_chars", F.col("plot_outline").cast("bigint"))
    wide = build_wide_ratings(raw_ratings(spark, sf_dir), raw_titles(spark, sf_dir), raw_users(spark, sf_dir),
                              raw_metadata(spark, sf_dir), details.drop("plot_outline"))
    return wide.select(*WIDE_COLS, "plot_chars")


@register("unseen_requests", with_ctes("""
SELECT q.RequestID, q.UserID, q.MovieID FROM requests q
WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.UserID = q.UserID AND c.MovieID = q.MovieID)""",
    "clean", "requests"))
def q_unseen_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-08: requested pairs the user has not rated (anti join on the full history)."""
    return exclude_seen(requests(spark, sf_dir).select("RequestID", "UserID", "MovieID"), clean(spark, sf_dir))


@register("annotated_requests", with_ctes("""
SELECT q.RequestID, q.UserID, q.MovieID, i.Title, i.Genres FROM requests q
LEFT JOIN (SELECT DISTINCT MovieID, Title, Genres FROM clean) i ON q.MovieID = i.MovieID""",
    "clean", "requests"))
def q_annotated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-09: requests with the item's title and genres (left join, one row per item)."""
    return annotate_items(requests(spark, sf_dir).select("RequestID", "UserID", "MovieID"), clean(spark, sf_dir))


@register("known_pairs", with_ctes("""
SELECT q.RequestID, q.UserID, q.MovieID,
       EXISTS (SELECT 1 FROM clean c WHERE c.UserID = q.UserID AND c.MovieID = q.MovieID) AS pair_known
FROM requests q""", "clean", "requests"))
def q_known_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-11 + C-08: does each requested (user, item) pair have a rating row?"""
    return known_pairs(requests(spark, sf_dir).select("RequestID", "UserID", "MovieID"), clean(spark, sf_dir))


@register("distinct_items", with_ctes("SELECT DISTINCT MovieID, Title, Genres FROM clean", "clean"))
def q_distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-06: distinct rated items with title and genres."""
    return distinct_items(clean(spark, sf_dir), ["MovieID", "Title", "Genres"])


@register("latest_pairs", with_ctes("""
SELECT UserID, MovieID, date_time, UserRating, Title FROM (
  SELECT *, row_number() OVER (PARTITION BY UserID, MovieID ORDER BY date_time DESC, UserRating DESC) AS rn
  FROM clean) WHERE rn = 1""", "clean"))
def q_latest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-07: one rating per (user, item): the latest, the higher rating on a tie."""
    df = clean(spark, sf_dir).select("UserID", "MovieID", "date_time", "UserRating", "Title")
    return latest_rating_per_pair(df)


@register("pending_enrichment_ids", _raw("""
SELECT DISTINCT m.imdbId FROM raw_titles t JOIN meta_one m ON t.Title = m.Title
WHERE NOT EXISTS (SELECT 1 FROM raw_details d
                  WHERE d.plot_outline IS NOT NULL AND d.runtimes IS NOT NULL
                    AND TRY_CAST(d.imdbID AS BIGINT) = TRY_CAST(CAST(m.imdbId AS VARCHAR) AS BIGINT))""",
    "raw_titles", "raw_metadata", "meta_one", "raw_details"))
def q_pending_enrichment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-09: external ids of rated titles whose details are missing or incomplete (the fetch list)."""
    titled = join_metadata(raw_titles(spark, sf_dir), raw_metadata(spark, sf_dir))
    return pending_enrichment_ids(titled, raw_details(spark, sf_dir))


@register("profile_shape", with_ctes(
    "SELECT count(*) AS row_count, CAST(15 AS INT) AS column_count FROM clean", "clean"))
def q_profile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-11: row and column count of the cleaned table."""
    from reelsight.plans.eda_queries import CLEAN_COLS
    return profile_shape(clean(spark, sf_dir).select(*CLEAN_COLS))
