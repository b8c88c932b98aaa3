"""Column expressions (X-01 .. X-14, C-02).

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen.  Dirty text never goes through a plain ``cast``: under ANSI mode a
bad value would fail the job, so parsing goes through ``try_cast``.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsight.functions.lookups import (OCCUPATION_NAMES, RATING_MAX, RATING_MIN,
                                         UNKNOWN_OCCUPATION)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- parsing

def split_fields(value: Column | str, sep: str, n: int) -> list[Column]:
    """X-01: split text on a literal (possibly multi-char) separator; field i or NULL.

    ``get`` returns NULL past the end instead of failing, so short lines
    yield NULL fields which callers can flag as corrupt.
    """
    parts = F.split(_c(value), re.escape(sep))
    return [F.get(parts, i) for i in range(n)]


def safe_double(col: Column | str) -> Column:
    """Text or number to double; non-numeric text becomes NULL."""
    return F.trim(_c(col).cast("string")).try_cast("double")


def safe_int(col: Column | str) -> Column:
    """C-02: text number to int by truncation ('7.8' -> 7); non-numeric -> NULL."""
    return safe_double(col).try_cast("int")


def first_number(col: Column | str) -> Column:
    """First entry of a ', '-joined list of numbers ('90, 100' -> 90.0)."""
    return safe_double(F.get(F.split(_c(col), ","), 0))


def sentinel_null(col: Column | str, sentinels=("N/A", "", "0.0")) -> Column:
    """C-04 for one column: sentinel text means missing."""
    c = _c(col)
    return F.when(F.trim(c).isin(list(sentinels)), F.lit(None)).otherwise(c)


def join_list(col: Column | str, sep: str = ", ") -> Column:
    """X-14: list of strings to one ', '-joined string."""
    return F.array_join(_c(col), sep)


# ---------------------------------------------------------------- time

def epoch_to_timestamp(col: Column | str, tz: str | None = "UTC") -> Column:
    """X-02: epoch seconds to a wall-clock ``timestamp_ntz`` in ``tz`` (default UTC).

    The result does not depend on the session time zone, so calendar parts
    are the same on every cluster.  ``tz=None`` gives a session-zone
    TIMESTAMP instead.
    """
    secs = _c(col).try_cast("bigint")
    if tz is None:
        return F.timestamp_seconds(secs)
    utc = F.timestamp_add("SECOND", secs, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def epoch_seconds(col: Column | str) -> Column:
    """X-02 backwards: seconds of a wall-clock ``timestamp_ntz`` since 1970, read as UTC in any session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            _c(col).cast("timestamp_ntz"))


def calendar_parts(df: DataFrame, ts: str = "date_time") -> DataFrame:
    """X-03: Year, Month, Day (of month), DayOfWeek (1 = Sunday) of the rating event."""
    t = F.col(ts)
    return df.withColumns({
        "Year": F.year(t),
        "Month": F.month(t),
        "Day": F.dayofmonth(t),
        "DayOfWeek": F.dayofweek(t),
    })


# ---------------------------------------------------------------- lookups

def _occupation_map() -> Column:
    return F.create_map(*chain.from_iterable(
        (F.lit(code), F.lit(name)) for code, name in sorted(OCCUPATION_NAMES.items())))


def occupation_name(code: Column | str) -> Column:
    """X-04: occupation code (int or numeric text) to its name, else 'Unknown'."""
    return F.coalesce(F.try_element_at(_occupation_map(), safe_int(code)),
                      F.lit(UNKNOWN_OCCUPATION))


def zip_region(col: Column | str) -> Column:
    """X-07: first three characters of the zip code, as text."""
    return F.substring(_c(col).cast("string"), 1, 3)


# ---------------------------------------------------------------- genres

def genre_array(col: Column | str, sep: str = "|") -> Column:
    """'A|B|C' -> ['A', 'B', 'C']; NULL stays NULL."""
    return F.split(_c(col), re.escape(sep))


def genre_indicator(col: Column | str, genre: str, sep: str = "|") -> Column:
    """X-05 for one genre: 1 if the genre is listed, else 0 (also for NULL genres)."""
    return F.coalesce(F.array_contains(genre_array(col, sep), genre).cast("int"), F.lit(0))


# ---------------------------------------------------------------- scaling

def minmax(col: Column | str, lo: Column, hi: Column) -> Column:
    """X-08 core: (x - lo) / (hi - lo); a constant column maps to 0."""
    c = _c(col).cast("double")
    return F.when(hi == lo, F.lit(0.0)).otherwise((c - lo) / (hi - lo))


def normalize_rating(col: Column | str, method: str = "minmax",
                     lo: float = RATING_MIN, hi: float = RATING_MAX,
                     mean: Column | None = None, std: Column | None = None) -> Column:
    """X-10: 'identity', 'minmax' onto [0, 1] with fixed bounds, or 'zscore'."""
    c = _c(col).cast("double")
    if method == "identity":
        return c
    if method == "minmax":
        return (c - F.lit(lo)) / F.lit(hi - lo)
    if method == "zscore":
        return (c - mean) / std
    raise ValueError(f"unknown normalisation {method!r}")


def denormalize_rating(col: Column | str, method: str = "minmax",
                       lo: float = RATING_MIN, hi: float = RATING_MAX,
                       mean: Column | None = None, std: Column | None = None) -> Column:
    """X-11: exact inverse of ``normalize_rating`` (minmax: p * 4 + 1 on 1..5)."""
    c = _c(col).cast("double")
    if method == "identity":
        return c
    if method == "minmax":
        return c * F.lit(hi - lo) + F.lit(lo)
    if method == "zscore":
        return c * std + mean
    raise ValueError(f"unknown normalisation {method!r}")


def blend(als: Column | str, lr: Column | str, w_als: float | Column, w_lr: float | Column) -> Column:
    """X-12: weighted sum of the two model scores."""
    wa = w_als if isinstance(w_als, Column) else F.lit(w_als)
    wl = w_lr if isinstance(w_lr, Column) else F.lit(w_lr)
    return wa * _c(als) + wl * _c(lr)


def mean_label(a: Column | str, b: Column | str) -> Column:
    """X-13: average of the two label columns."""
    return (_c(a) + _c(b)) / F.lit(2.0)
