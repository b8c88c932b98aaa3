"""Equi joins of the ingest and scoring steps (J-01 .. J-11).

No join here forces a broadcast of a side that grows with the data: titles,
users and metadata grow with the catalogue, so the planner (and adaptive
execution, from measured sizes) decides.  Sides with a structural bound
(top-n groups, a fixed-size grid) are broadcast explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsight.functions.scalars import epoch_to_timestamp


def join_titles(ratings: DataFrame, titles: DataFrame, how: str = "inner") -> DataFrame:
    """J-01: ratings with title and genres, on MovieID."""
    return titles.join(ratings, "MovieID", how)


def join_users(ratings: DataFrame, users: DataFrame, how: str = "inner") -> DataFrame:
    """J-02: ratings with user attributes, on UserID."""
    return ratings.join(users, "UserID", how)


def dedupe_metadata(meta: DataFrame, key: str = "Title", order: str = "imdbId") -> DataFrame:
    """One metadata row per title: the one with the smallest ``order`` value.

    ``min(struct(order, rest))`` per title is a partial aggregate, so a title
    repeated millions of times does not gather in one task.
    """
    rest = [c for c in meta.columns if c not in (key, order)]
    m = meta.groupBy(key).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_m"))
    return m.select(key, *[F.col(f"_m.{c}").alias(c) for c in [order] + rest])


def join_metadata(ratings: DataFrame, meta: DataFrame, dedupe: bool = True) -> DataFrame:
    """J-03: metadata on title text (``title`` renamed to ``Title``).

    Duplicate titles would multiply rating rows; by default they are first
    reduced to one row per title (``dedupe=False`` keeps the raw behaviour).
    """
    m = meta.withColumnRenamed("title", "Title")
    if dedupe:
        m = dedupe_metadata(m)
    return ratings.join(m, "Title", "inner")


def unmatched_titles(titles: DataFrame, meta: DataFrame) -> DataFrame:
    """J-03: the titles without a metadata row, which the inner join drops."""
    return titles.join(meta.select(F.col("title").alias("Title")), "Title", "left_anti")


def join_enrichment(ratings: DataFrame, details: DataFrame, how: str = "inner",
                    left_key: str = "imdbId", right_key: str = "imdbID") -> DataFrame:
    """J-04: details on the external id; int-like on the left, zero-padded text on the right.

    Both sides go through ``try_cast`` to BIGINT, so 'N/A' ids match nothing
    instead of failing the job.
    """
    left = ratings.withColumn("_ext_id", F.col(left_key).cast("string").try_cast("bigint"))
    right = details.withColumn("_ext_id", F.col(right_key).try_cast("bigint")).drop(right_key)
    return left.join(right, "_ext_id", how).drop("_ext_id")


def build_wide_ratings(ratings: DataFrame, titles: DataFrame, users: DataFrame,
                       meta: DataFrame, details: DataFrame, how_details: str = "inner",
                       dedupe: bool = True) -> DataFrame:
    """J-05: the wide ratings table: titles, metadata and details, users, ratings.

    Titles meet metadata and details first, so the ratings (the large side)
    are shuffled on UserID and on MovieID only, never on title text; the titles'
    texts, the widest columns, join last and are not shuffled with the ratings.
    Adds ``date_time`` from the epoch ``Timestamp`` (X-02).  ``dedupe=False``
    keeps every metadata match (J-03).
    """
    items = join_enrichment(join_metadata(titles, meta, dedupe), details, how=how_details)
    wide = join_titles(join_users(ratings, users), items).withColumn("date_time", epoch_to_timestamp("Timestamp"))
    keys = ["UserID", "MovieID"]
    return wide.select(*dict.fromkeys(keys + items.columns + ratings.columns + ["date_time"] + users.columns))


def keep_top_groups(df: DataFrame, top: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J-06: inner join with a top-n group list (n is a parameter, so broadcast is bounded)."""
    return df.join(F.broadcast(top.select(*keys)), list(keys), "inner")


def semi_join_values(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """J-07: keep rows whose key is in ``values`` (``isin`` without a driver list)."""
    return df.join(values.select(key), key, "left_semi")


def exclude_seen(candidates: DataFrame, seen: DataFrame, keys: Sequence[str] = ("UserID", "MovieID")) -> DataFrame:
    """J-08: candidates minus every (user, item) the user rated (the full history)."""
    return candidates.join(seen.select(*keys), list(keys), "left_anti")


def annotate_items(recs: DataFrame, items: DataFrame, cols: Sequence[str] = ("Title", "Genres"),
                   key: str = "MovieID") -> DataFrame:
    """J-09: left join of item details, one row per item (dropDuplicates on the key)."""
    details = items.select(key, *cols).dropDuplicates([key])
    return recs.join(details, key, "left")


def combine_predictions(als: DataFrame, lr: DataFrame, keys: Sequence[str] = ("UserID", "MovieID"),
                        label: str = "NormUserRating") -> DataFrame:
    """J-10: both models' predictions on the same pairs, both labels kept.

    Each input must be unique on ``keys`` (use O-07 first), otherwise the
    join multiplies rows.
    """
    a = als.alias("p")
    b = lr.alias("lr")
    return a.join(b, list(keys), "inner").select(
        *[F.col(k) for k in keys],
        F.col("p.als_prediction").alias("als_prediction"),
        F.col(f"p.{label}").alias(f"{label}_als"),
        F.col("lr.lr_prediction").alias("lr_prediction"),
        F.col(f"lr.{label}").alias(f"{label}_lr"),
    )


def known_pairs(requests: DataFrame, ratings: DataFrame, keys: Sequence[str] = ("UserID", "MovieID"),
                flag: str = "pair_known") -> DataFrame:
    """J-11: flag each request whose (user, item) pair has a rating row.

    A left join against the distinct rated pairs (distinct is a partial
    aggregate), so each request is kept exactly once.
    """
    seen = ratings.select(*keys).distinct().withColumn(flag, F.lit(True))
    out = requests.join(seen, list(keys), "left")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
