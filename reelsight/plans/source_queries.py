"""Registered queries: text parsing and file round trips (S-01 .. S-06, X-01).

The inputs are lines and files Spark derives from the driver's tables, so
the work grows with them: ratings and titles rendered as '::'-separated
lines and parsed back, titles written as CSV and read back with a declared
schema, the wide table written as Parquet partitioned by age and read back.
Files go to a fresh folder under the session's checkpoint folder (the
cluster's shared storage).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsight.plans.eda_queries import CLEAN_COLS, clean
from reelsight.plans.join_queries import RAW
from reelsight.plans.registry import register
from reelsight.plans.sql import with_ctes
from reelsight.plans.standin import raw_ratings, raw_titles
from reelsight.schemas import RATINGS_TEXT, TITLES_TEXT
from reelsight.session import checkpoint_dir
from reelsight.sources.files import read_csv, read_ratings, rows_with_schema, write_csv, write_parquet
from reelsight.sources.text import land_delimited, landed_rows, parse_delimited, rejected_lines


def _scratch(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@register("parse_ratings_text", with_ctes("""
SELECT CAST(split_part(value, '::', 1) AS BIGINT) AS UserID, CAST(split_part(value, '::', 2) AS BIGINT) AS MovieID,
       CAST(split_part(value, '::', 3) AS INT) AS Rating, CAST(split_part(value, '::', 4) AS BIGINT) AS Timestamp,
       false AS _corrupt
FROM (SELECT concat_ws('::', UserID, MovieID, Rating, Timestamp) AS value FROM raw_ratings)""",
    extra={"raw_ratings": RAW["raw_ratings"]}))
def q_parse_ratings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-01 + X-01: ratings rendered as 'UserID::MovieID::Rating::Timestamp' lines, parsed and typed."""
    r = raw_ratings(spark, sf_dir)
    lines = r.select(F.concat_ws("::", *[F.col(c).cast("string") for c in r.columns]).alias("value"))
    return parse_delimited(lines, RATINGS_TEXT)


_DIRTY = """SELECT *, CASE WHEN MovieID % 13 = 0 THEN 'short' WHEN UserID % 11 = 0 THEN 'bad_key' END AS reason FROM raw_ratings"""


def _dirty_files(spark: SparkSession, sf_dir: str) -> str:
    """Ratings as text files; some lines lack fields, some have a user that is no number, some are empty."""
    r = raw_ratings(spark, sf_dir)
    whole = F.concat_ws("::", *[F.col(c).cast("string") for c in r.columns])
    line = (F.when(F.col("MovieID") % 13 == 0, F.concat_ws("::", F.col("UserID").cast("string"), F.col("MovieID").cast("string")))
            .when(F.col("UserID") % 11 == 0, F.concat(F.lit("u"), whole)).otherwise(whole))
    blank = F.when(F.col("MovieID") % 17 == 0, F.array(line, F.lit("  "))).otherwise(F.array(line))
    path = _scratch(spark, "ratings-text")
    r.select(F.explode(blank).alias("value")).write.text(path)
    return path


@register("landing_counts", with_ctes("""
SELECT count(*) + count(*) FILTER (WHERE MovieID % 17 = 0) AS lines, count(*) FILTER (WHERE MovieID % 17 = 0) AS empty,
       count(*) FILTER (WHERE reason = 'short') AS short, count(*) FILTER (WHERE reason = 'bad_key') AS bad_key,
       count(*) FILTER (WHERE reason IS NULL) AS loaded FROM dirty""",
    extra={"raw_ratings": RAW["raw_ratings"], "dirty": _DIRTY}))
def q_landing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-01 + S-07: text files landed as a table; what became of their lines, counted in the same pass, as a typed row."""
    counts = land_delimited(spark, _dirty_files(spark, sf_dir), RATINGS_TEXT, _scratch(spark, "landed-ratings"))
    names = ["lines", "empty", "short", "bad_key", "loaded"]
    return rows_with_schema(spark, [counts], T.StructType([T.StructField(n, T.LongType()) for n in names]))


@register("landed_ratings", with_ctes("""
SELECT CAST(UserID AS BIGINT) AS UserID, CAST(MovieID AS BIGINT) AS MovieID, CAST(Rating AS INT) AS Rating,
       CAST(Timestamp AS BIGINT) AS Timestamp FROM dirty WHERE reason IS NULL""",
    extra={"raw_ratings": RAW["raw_ratings"], "dirty": _DIRTY}))
def q_landed_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-01: the rows that came through the landing."""
    target = _scratch(spark, "landed-ratings")
    land_delimited(spark, _dirty_files(spark, sf_dir), RATINGS_TEXT, target)
    return landed_rows(spark, target, RATINGS_TEXT)


@register("rejected_ratings", with_ctes("""
SELECT CASE reason WHEN 'short' THEN concat_ws('::', UserID, MovieID)
            ELSE 'u' || concat_ws('::', UserID, MovieID, Rating, Timestamp) END AS line, reason
FROM dirty WHERE reason IS NOT NULL""", extra={"raw_ratings": RAW["raw_ratings"], "dirty": _DIRTY}))
def q_rejected_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-01: the lines that the landing set aside, as they were, with the reason."""
    target = _scratch(spark, "landed-ratings")
    land_delimited(spark, _dirty_files(spark, sf_dir), RATINGS_TEXT, target)
    return rejected_lines(spark, target, RATINGS_TEXT)


@register("parse_titles_text", with_ctes("""
SELECT CAST(split_part(value, '::', 1) AS BIGINT) AS MovieID, split_part(value, '::', 2) AS Title,
       split_part(value, '::', 3) AS Genres, false AS _corrupt
FROM (SELECT concat_ws('::', MovieID, Title, Genres) AS value FROM raw_titles)""",
    extra={"raw_titles": RAW["raw_titles"]}))
def q_parse_titles_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-01: titles rendered as 'MovieID::Title::Genres' lines, parsed and typed."""
    t = raw_titles(spark, sf_dir)
    lines = t.select(F.concat_ws("::", *[F.col(c).cast("string") for c in t.columns]).alias("value"))
    return parse_delimited(lines, TITLES_TEXT)


@register("titles_csv_round_trip", with_ctes("SELECT MovieID, Title, Genres FROM raw_titles",
                                             extra={"raw_titles": RAW["raw_titles"]}))
def q_titles_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-05 + S-02: titles written as header CSV (one file per task) and read back with a declared schema."""
    path = _scratch(spark, "titles-csv")
    write_csv(raw_titles(spark, sf_dir), path)
    return read_csv(spark, path, TITLES_TEXT)


@register("wide_parquet_round_trip", with_ctes(f"SELECT {', '.join(CLEAN_COLS)} FROM clean", "clean"))
def q_wide_parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-06 + S-04: the cleaned wide table written as Parquet partitioned by age, read back pruned."""
    path = _scratch(spark, "wide-parquet")
    write_parquet(clean(spark, sf_dir).select(*CLEAN_COLS), path, partition_by=["Age"])
    return read_ratings(spark, path, CLEAN_COLS)


@register("landed_details", with_ctes("""
SELECT localized_title, runtimes, rating_imdb, plot_outline, director, imdbID FROM (
  SELECT *, row_number() OVER (PARTITION BY imdbID ORDER BY fetched_at DESC) AS rn FROM (
    SELECT 'old ' || localized_title AS localized_title, runtimes, rating_imdb, plot_outline, director, imdbID,
           1 AS fetched_at FROM raw_details
    UNION ALL
    SELECT localized_title, runtimes, rating_imdb, plot_outline, director,
           CASE WHEN CAST(imdbID AS BIGINT) % 31 = 0 THEN NULL ELSE imdbID END AS imdbID, 2 AS fetched_at
    FROM raw_details) WHERE imdbID IS NOT NULL) WHERE rn = 1""", extra={"raw_details": RAW["raw_details"]}))
def q_landed_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-08 + X-14: two fetch rounds of title details landed as JSON lines (list-valued
    runtimes and directors; every 31st id failed in the second round), read back:
    lists joined with ', ', failed records dropped, the latest record per id kept."""
    from reelsight.plans.standin import raw_details
    from reelsight.sources.enrichment import read_enrichment
    d = raw_details(spark, sf_dir)
    lists = {"runtimes": F.split(F.col("runtimes"), ", "), "director": F.array(F.col("director")),
             "rating": F.col("rating_imdb")}
    base = d.withColumns(lists).drop("rating_imdb")
    old = base.withColumns({"localized_title": F.concat(F.lit("old "), F.col("localized_title")),
                            "fetched_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    new = base.withColumns({"imdbID": F.when(F.col("imdbID").cast("bigint") % 31 == 0, F.lit(None))
                            .otherwise(F.col("imdbID")),
                            "fetched_at": F.lit("2024-02-01 00:00:00").cast("timestamp")})
    path = _scratch(spark, "landed-details")
    old.unionByName(new).write.mode("overwrite").json(path, compression="gzip")
    return read_enrichment(spark, path)


@register("merged_details", with_ctes("""
SELECT CASE WHEN CAST(imdbID AS BIGINT) % 7 = 0 THEN localized_title ELSE 'old ' || localized_title END AS localized_title,
       runtimes, rating_imdb, plot_outline, director, imdbID FROM raw_details""", extra={"raw_details": RAW["raw_details"]}))
def q_merged_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-08 as a table that grows: all details landed, then every seventh again, newer; the second landing twice."""
    from reelsight.plans.standin import raw_details
    from reelsight.sources.enrichment import DetailsTable
    d = raw_details(spark, sf_dir).withColumns({
        "runtimes": F.split("runtimes", ", "), "director": F.array("director")}).withColumnRenamed("rating_imdb", "rating")
    old = d.withColumns({"localized_title": F.concat(F.lit("old "), "localized_title"),
                         "fetched_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    new = d.where(F.col("imdbID").cast("bigint") % 7 == 0).withColumn("fetched_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    details = DetailsTable(spark, _scratch(spark, "details"), buckets=8)
    for landing in (old, new, new):
        details.land(landing)
    return details.table()


@register("metadata_json_round_trip", with_ctes("""
SELECT title, directedBy, starring, avgRating, CAST(imdbId AS VARCHAR) AS imdbId FROM raw_metadata""",
    extra={"raw_metadata": RAW["raw_metadata"]}))
def q_metadata_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-03: title metadata landed as JSON lines and read back with the declared schema."""
    from reelsight.plans.standin import raw_metadata
    from reelsight.schemas import METADATA_JSON
    from reelsight.sources.files import read_title_metadata
    path = _scratch(spark, "metadata-json")
    raw_metadata(spark, sf_dir).write.mode("overwrite").json(path)
    return read_title_metadata(spark, path, METADATA_JSON)
