"""Registered queries: the genre family and per-group top-k (build step 3, R-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsight.functions.scalars import zip_region
from reelsight.operators.aggregates import avg_rating_by, group_sizes, pivot_first, transpose_matrix
from reelsight.operators.genres import (dominant_genre, dominant_genre_counts, explode_genres,
                                        genre_indicators, user_genre_matrix)
from reelsight.operators.joins import keep_top_groups, semi_join_values
from reelsight.operators.ordering import top_groups, top_k_per_group
from reelsight.plans.eda_queries import clean
from reelsight.plans.registry import register
from reelsight.plans.sql import with_ctes

# Genre vocabulary of the stand-in titles: the words of the driver's part
# names (the same 16 at every scale factor).  A parameter of the genre
# operators, in the role the 17 movie genres play for real ratings data.
STANDIN_GENRES = ["anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate",
                  "red", "ring", "rod", "small", "widget"]

GENDERS = ["F", "M"]


def _ind_sql(g: str) -> str:
    return f"CAST(list_contains(string_split(Genres, '|'), '{g}') AS INTEGER)"


def _indicators_sql() -> str:
    return ", ".join(f"coalesce({_ind_sql(g)}, 0) AS \"{g}\"" for g in STANDIN_GENRES)


LONG = "SELECT *, unnest(string_split(Genres, '|')) AS genre FROM clean"
TOP10_OCC = """SELECT Occupation_Name FROM clean GROUP BY Occupation_Name
               ORDER BY count(*) DESC, Occupation_Name LIMIT 10"""
TOP20_REGIONS = """SELECT substr(Zip_Code, 1, 3) AS zip_region FROM clean GROUP BY 1
                   ORDER BY count(*) DESC, zip_region LIMIT 20"""


def _top10_occupations(df: DataFrame) -> DataFrame:
    sizes = group_sizes(df, "Occupation_Name", "rating_count")
    return top_groups(sizes, [F.col("rating_count").desc(), F.col("Occupation_Name").asc()], 10)


@register("genre_indicators", with_ctes(
    f"SELECT UserID, MovieID, date_time, {_indicators_sql()} FROM clean", "clean"))
def q_genre_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-05 + O-08: a 0/1 column per genre next to each rating."""
    df = clean(spark, sf_dir).select("UserID", "MovieID", "date_time", "Genres")
    return genre_indicators(df, STANDIN_GENRES).drop("Genres")


@register("genre_long", with_ctes("SELECT UserID, MovieID, date_time, genre FROM long", "clean",
                                  extra={"long": LONG}))
def q_genre_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-06: one row per (rating, listed genre)."""
    df = clean(spark, sf_dir).select("UserID", "MovieID", "date_time", "Genres")
    return explode_genres(df).drop("Genres")


@register("occupation_genre_avg", with_ctes("""
SELECT Occupation_Name, Genres, avg(UserRating) AS avg_rating FROM clean GROUP BY 1, 2""", "clean"))
def q_occupation_genre_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-03: mean rating per (occupation, genre combination)."""
    return avg_rating_by(clean(spark, sf_dir), "Occupation_Name", "Genres")


@register("top_occupation_genres", with_ctes("""
SELECT a.Occupation_Name, a.Genres, avg(a.UserRating) AS avg_rating
FROM clean a JOIN top10 t ON a.Occupation_Name = t.Occupation_Name GROUP BY 1, 2""", "clean",
    extra={"top10": TOP10_OCC}))
def q_top_occupation_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-06 + G-03: genre-combination means for the 10 largest occupations."""
    df = clean(spark, sf_dir)
    return keep_top_groups(avg_rating_by(df, "Occupation_Name", "Genres"), _top10_occupations(df),
                           ["Occupation_Name"])


def _matrix_sql(row: str, keep: str | None) -> str:
    cells = ", ".join(f"avg(UserRating) FILTER (WHERE genre = '{g}') AS \"{g}\"" for g in STANDIN_GENRES)
    join = f" JOIN top10 t ON l.{row} = t.{row}" if keep else ""
    extra = {"long": LONG}
    if keep:
        extra["top10"] = keep
    return with_ctes(f"SELECT l.{row}, {cells} FROM long l{join} GROUP BY l.{row}", "clean", extra=extra)


@register("occupation_genre_matrix", _matrix_sql("Occupation_Name", TOP10_OCC))
def q_occupation_genre_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-04: top-10 occupations x genres matrix of mean ratings."""
    df = clean(spark, sf_dir)
    long = keep_top_groups(explode_genres(df), _top10_occupations(df), ["Occupation_Name"])
    return pivot_first(avg_rating_by(long, "Occupation_Name", "genre"), "Occupation_Name", "genre",
                       "avg_rating", STANDIN_GENRES)


@register("gender_genre_matrix", _matrix_sql("Gender", None))
def q_gender_genre_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-04: gender x genres matrix of mean ratings."""
    long = explode_genres(clean(spark, sf_dir))
    return pivot_first(avg_rating_by(long, "Gender", "genre"), "Gender", "genre", "avg_rating", STANDIN_GENRES)


@register("genre_gender_matrix", with_ctes(f"""
SELECT genre, avg(UserRating) FILTER (WHERE Gender = 'F') AS "F", avg(UserRating) FILTER (WHERE Gender = 'M') AS "M"
FROM long WHERE genre IN ({", ".join(f"'{g}'" for g in STANDIN_GENRES)}) GROUP BY genre""", "clean",
    extra={"long": LONG}))
def q_genre_gender_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-05: the gender x genres matrix transposed (genres as rows)."""
    m = q_gender_genre_matrix(spark, sf_dir)
    return transpose_matrix(m, "Gender", "genre", GENDERS)


def _share_sql(by: str, key_expr: str, keep: str | None = None) -> str:
    cells = ", ".join(f"avg(CAST(coalesce({_ind_sql(g)}, 0) AS DOUBLE)) AS \"{g}\"" for g in STANDIN_GENRES)
    extra = {}
    where = ""
    if keep:
        extra["top20"] = keep
        where = f" WHERE {key_expr} IN (SELECT zip_region FROM top20)"
    return with_ctes(f"SELECT {key_expr} AS {by}, {cells} FROM clean{where} GROUP BY 1", "clean", extra=extra)


@register("genre_share_by_user", _share_sql("UserID", "UserID"))
def q_genre_share_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-06: per user, share of their ratings carrying each genre."""
    return user_genre_matrix(clean(spark, sf_dir), STANDIN_GENRES, "UserID")


@register("genre_share_by_age", _share_sql("Age", "Age"))
def q_genre_share_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-06: genre shares per age band."""
    return user_genre_matrix(clean(spark, sf_dir), STANDIN_GENRES, "Age")


@register("region_genre_share", _share_sql("zip_region", "substr(Zip_Code, 1, 3)", TOP20_REGIONS))
def q_region_genre_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-07 + O-02 + G-06: genre shares in the 20 most active zip regions."""
    df = clean(spark, sf_dir).withColumn("zip_region", zip_region("Zip_Code"))
    top = top_groups(group_sizes(df, "zip_region", "rating_count"),
                     [F.col("rating_count").desc(), F.col("zip_region").asc()], 20)
    return user_genre_matrix(semi_join_values(df, top, "zip_region"), STANDIN_GENRES, "zip_region")


def _dominant_sql() -> str:
    cols = ", ".join(f'"{g}"' for g in STANDIN_GENRES)
    arms = " ".join(f"WHEN \"{g}\" = greatest({cols}) THEN '{g}'" for g in STANDIN_GENRES)
    return f"CASE {arms} END"


def _dominant_body(select: str) -> str:
    share_cells = ", ".join(f"avg(CAST(coalesce({_ind_sql(g)}, 0) AS DOUBLE)) AS \"{g}\"" for g in STANDIN_GENRES)
    return with_ctes(select, "clean", extra={
        "shares": f"SELECT UserID, {share_cells} FROM clean GROUP BY UserID",
        "dom": f"SELECT UserID, {_dominant_sql()} AS Dominant_Genre FROM shares"})


@register("dominant_genre", _dominant_body("SELECT UserID, Dominant_Genre FROM dom"))
def q_dominant_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-08: each user's dominant genre (ties: first genre in list order)."""
    m = user_genre_matrix(clean(spark, sf_dir), STANDIN_GENRES, "UserID")
    return dominant_genre(m, STANDIN_GENRES).select("UserID", "Dominant_Genre")


@register("dominant_genre_counts", _dominant_body(
    "SELECT Dominant_Genre, count(*) AS user_count FROM dom GROUP BY 1 ORDER BY user_count DESC, Dominant_Genre"))
def q_dominant_genre_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-09: users per dominant genre, largest first."""
    return dominant_genre_counts(q_dominant_genre(spark, sf_dir))


@register("top_genres_per_occupation", with_ctes("""
SELECT Occupation_Name, genre, avg_rating, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY Occupation_Name ORDER BY avg_rating DESC, genre) AS rank
  FROM (SELECT Occupation_Name, genre, avg(UserRating) AS avg_rating FROM long GROUP BY 1, 2))
WHERE rank <= 3""", "clean", extra={"long": LONG}))
def q_top_genres_per_occupation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-04: the 3 best-rated genres of each occupation."""
    avgs = avg_rating_by(explode_genres(clean(spark, sf_dir)), "Occupation_Name", "genre")
    return top_k_per_group(avgs, "Occupation_Name", [F.col("avg_rating").desc(), F.col("genre").asc()], 3)


@register("watched_items", with_ctes("""
SELECT UserID, MovieID, date_time, UserRating, Title, Genres, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY UserID ORDER BY date_time DESC, MovieID, UserRating DESC) AS rank
  FROM clean) WHERE rank <= 20""", "clean"))
def q_watched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-07: each user's 20 most recent rated items with title and genres."""
    df = clean(spark, sf_dir).select("UserID", "MovieID", "date_time", "UserRating", "Title", "Genres")
    return top_k_per_group(df, "UserID", [F.col("date_time").desc(), F.col("MovieID").asc(),
                                          F.col("UserRating").desc()], 20)
