"""Projection, cleaning and predicates (C-01 .. C-13)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsight.functions.scalars import first_number, occupation_name, safe_int, sentinel_null

KEY_COLUMNS = ("UserID", "MovieID", "UserRating")


def clean_ratings(df: DataFrame) -> DataFrame:
    """C-01: the cleaning step of the wide ratings table.

    ``Rating`` becomes ``UserRating``; ratings and ``rating_imdb`` are parsed
    to int by truncation with bad text as NULL (C-02); ``runtimes`` keeps the
    first number of a list; ``director`` and ``avgRating`` are dropped;
    ``Occupation_Name`` is added (X-04); rows without a key are dropped (C-03).
    """
    if "Rating" in df.columns and "UserRating" not in df.columns:
        df = df.withColumnRenamed("Rating", "UserRating")
    df = parse_numbers(df.withColumn("UserRating", safe_int("UserRating")))
    if "Occupation" in df.columns:
        df = df.withColumn("Occupation_Name", occupation_name("Occupation"))
    df = df.drop("director", "avgRating")
    return drop_missing_keys(df, [c for c in KEY_COLUMNS if c in df.columns])


def parse_numbers(df: DataFrame) -> DataFrame:
    """C-02 + C-04 for the title's numbers: ``rating_imdb`` and ``runtimes`` text to int, sentinels NULL."""
    changes: dict[str, Column] = {}
    if "rating_imdb" in df.columns:
        changes["rating_imdb"] = safe_int(sentinel_null("rating_imdb"))
    if "runtimes" in df.columns:
        changes["runtimes"] = first_number(sentinel_null("runtimes")).try_cast("int")
    return df.withColumns(changes) if changes else df


def drop_missing_keys(df: DataFrame, cols: Iterable[str] = KEY_COLUMNS) -> DataFrame:
    """C-03: drop rows with a NULL user, item or rating."""
    return df.dropna(subset=list(cols))


def sentinel_to_null(df: DataFrame, spec: Mapping[str, Iterable[str]]) -> DataFrame:
    """C-04: per column, the listed sentinel texts ('N/A', '', '0.0') become NULL."""
    return df.withColumns({c: sentinel_null(c, tuple(v)) for c, v in spec.items()})


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """C-05: constant fill of NULLs per column (e.g. plot text -> '')."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in values.items()})


def fill_mean(df: DataFrame, cols: Iterable[str], stats_from: DataFrame | None = None) -> DataFrame:
    """C-06: NULL -> column mean.  An int column gets the truncated mean.

    The means come from one aggregate over ``stats_from`` (default ``df``,
    pass the training split to avoid leakage), run once as a scalar subquery.
    """
    cols = list(cols)
    src = stats_from if stats_from is not None else df
    means = src.select(F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).alias("m"))
    out = df.withColumn("_means", means.scalar())
    fills = {}
    for c in cols:
        dtype = df.schema[c].dataType
        fills[c] = F.coalesce(F.col(c), F.col(f"_means.{c}").try_cast(dtype))
    return out.withColumns(fills).drop("_means")


def null_profile(df: DataFrame) -> DataFrame:
    """C-07: NULL count per column, one row, one aggregation pass."""
    return df.select([F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def select_pairs(df: DataFrame, pairs: DataFrame, keys=("UserID", "MovieID")) -> DataFrame:
    """C-08: rows of the given (user, item) pairs, for a whole set of pairs at once."""
    return df.join(pairs.select(*keys).dropDuplicates(list(keys)), list(keys), "left_semi")


def select_pair(df: DataFrame, user_id: int, item_id: int) -> DataFrame:
    """C-08 for one pair (a pushed-down predicate)."""
    return df.filter((F.col("UserID") == user_id) & (F.col("MovieID") == item_id))


def between_inclusive(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """C-09: closed-range predicate."""
    return df.filter(F.col(col).between(lo, hi))


def project_prediction(df: DataFrame, mapping: Mapping[str, str], alias: str | None = None) -> DataFrame:
    """C-11: fixed output projection with (optionally table-qualified) renamed columns."""
    src = df.alias(alias) if alias else df
    return src.select([F.col(f"{alias}.{c}" if alias else c).alias(new) for c, new in mapping.items()])


def constant_column(df: DataFrame, name: str, value) -> DataFrame:
    """C-12: literal column."""
    return df.withColumn(name, F.lit(value))


def optional_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """C-13: the subset of ``names`` present in ``df`` (decided at plan time)."""
    present = set(df.columns)
    return [n for n in names if n in present]
