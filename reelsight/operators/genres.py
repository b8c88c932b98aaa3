"""Genre family: indicators, long form, shares, dominant genre (X-05, X-06, G-06, G-08, G-09).

``Genres`` is a '|'-joined multi-value string.  The genre vocabulary is a
parameter (the matrices of the reference use a fixed 17-name list; other
names are ignored there, so they are here).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsight.functions.scalars import genre_array, genre_indicator
from reelsight.operators.aggregates import genre_share_by


def indicator_name(genre: str) -> str:
    """Column name of a genre's 0/1 indicator (the genre itself)."""
    return genre


def genre_indicators(df: DataFrame, genres: Sequence[str], col: str = "Genres") -> DataFrame:
    """X-05 + O-08: one 0/1 column per genre appended to the same rows."""
    return df.withColumns({indicator_name(g): genre_indicator(col, g) for g in genres})


def explode_genres(df: DataFrame, col: str = "Genres", out: str = "genre") -> DataFrame:
    """X-06: long form, one row per (rating, listed genre); NULL genres give no row."""
    return df.withColumn(out, F.explode(genre_array(col)))


def user_genre_matrix(df: DataFrame, genres: Sequence[str], by: str | Sequence[str] = "UserID") -> DataFrame:
    """G-06 by user (or any key): share of the group's ratings that carry each genre."""
    return genre_share_by(genre_indicators(df, genres), by, [indicator_name(g) for g in genres])


def dominant_genre(matrix: DataFrame, genres: Sequence[str], out: str = "Dominant_Genre") -> DataFrame:
    """G-08: per row, the genre with the largest share; ties go to the first genre in list order.

    ``greatest`` + an ordered ``coalesce(when(...))``: pure expressions, no
    sort or explode.
    """
    cols = [F.col(indicator_name(g)) for g in genres]
    top = F.greatest(*cols)
    pick = F.coalesce(*[F.when(c == top, F.lit(g)) for c, g in zip(cols, genres)])
    return matrix.withColumn(out, pick)


def dominant_genre_counts(dominant: DataFrame, col: str = "Dominant_Genre") -> DataFrame:
    """G-09: users per dominant genre, largest first (genre name breaks ties)."""
    return (dominant.groupBy(col).agg(F.count(F.lit(1)).alias("user_count"))
            .orderBy(F.col("user_count").desc(), F.col(col).asc()))
