"""Aggregations, pivots and statistics (G-01 .. G-13, X-08, X-09).

Every aggregate here is a ``groupBy().agg()`` (partial aggregation before the
shuffle, so a hot group costs one row per map task, not its row count) or a
global aggregate bound once into the plan as a scalar subquery.  Nothing is
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsight.functions.scalars import minmax


def _cols(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def rating_summary(df: DataFrame, by: str | Sequence[str], rating: str = "UserRating",
                   user: str = "UserID") -> DataFrame:
    """G-01: mean rating, rating rows and distinct users per group."""
    return df.groupBy(*_cols(by)).agg(
        F.avg(rating).alias("avg_rating"),
        F.count(F.lit(1)).alias("rating_count"),
        F.count_distinct(user).alias("user_count"),
    )


def user_sketches(df: DataFrame, by: str | Sequence[str], time_slice: Column, user: str = "UserID", size: int = 12) -> DataFrame:
    """G-01 in slices: ``(by, slice, rating_count, rating_sum, users)`` with ``users`` a HyperLogLog sketch.

    Rows of a slice can be stored and merged later, in any order, without the
    ratings.  A sketch takes at most 2^size bytes whatever it has seen.
    """
    return df.groupBy(*_cols(by), time_slice.alias("slice")).agg(
        F.count(F.lit(1)).alias("rating_count"), F.sum(F.col("UserRating").cast("long")).alias("rating_sum"),
        F.hll_sketch_agg(user, size).alias("users"))


def merge_sketches(sketches: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """G-01 over the slices of ``user_sketches``: mean and count exact, distinct users estimated.

    The standard error is about 1.04 / 2^(size / 2): 1.6 % for the default size.
    """
    return sketches.groupBy(*_cols(by)).agg(
        (F.sum("rating_sum") / F.sum("rating_count")).alias("avg_rating"), F.sum("rating_count").alias("rating_count"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("user_estimate"))


def group_sizes(df: DataFrame, by: str | Sequence[str], name: str = "count") -> DataFrame:
    """G-02: row count per group."""
    return df.groupBy(*_cols(by)).agg(F.count(F.lit(1)).alias(name))


def avg_rating_by(df: DataFrame, a: str, b: str, rating: str = "UserRating") -> DataFrame:
    """G-03: mean rating per (a, b) pair."""
    return df.groupBy(a, b).agg(F.avg(rating).alias("avg_rating"))


def pivot_first(df: DataFrame, row: str, column: str, value: str,
                values: Sequence[str] | None = None) -> DataFrame:
    """G-04: a matrix, one row per ``row`` key and one column per ``column`` value.

    Cells are unique after a per-pair aggregate, so ``max`` (deterministic)
    stands in for ``first``.  Pass ``values`` to skip the extra distinct job.
    """
    g = df.groupBy(row)
    p = g.pivot(column, list(values)) if values is not None else g.pivot(column)
    return p.agg(F.max(value))


def transpose_matrix(df: DataFrame, key: str, name_col: str = "name",
                     values: Sequence[str] | None = None) -> DataFrame:
    """G-05: rows become columns, for the small display matrices of G-04.

    With ``values`` (the row keys, e.g. the top-n groups or a fixed
    category list) it is an unpivot followed by a pivot on known values: no
    job runs to discover columns.  Without, ``DataFrame.transpose`` reads
    the key values first (bounded by ``spark.sql.transposeMaxValues``).
    """
    if values is None:
        return df.transpose(F.col(key)).withColumnRenamed("key", name_col)
    cells = [c for c in df.columns if c != key]
    long = df.unpivot([key], cells, name_col, "_v")
    return long.groupBy(name_col).pivot(key, list(values)).agg(F.max("_v"))


def genre_share_by(df: DataFrame, by: str | Sequence[str], indicator_cols: Iterable[str]) -> DataFrame:
    """G-06: mean of 0/1 genre indicators per group (share of ratings carrying the genre)."""
    return df.groupBy(*_cols(by)).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in indicator_cols])


def global_stats(df: DataFrame, col: str) -> DataFrame:
    """G-07: one row with mean and sample standard deviation."""
    return df.select(F.avg(col).alias("mean"), F.stddev_samp(col).alias("stddev"),
                     F.count(col).alias("n"))


def zone_stats(df: DataFrame, col: str) -> DataFrame:
    """min, max, mean, sample stddev and count of one column, as a one-struct row."""
    c = F.col(col).cast("double")
    return df.select(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(c).alias("mean"),
                              F.stddev_samp(c).alias("std"), F.count(c).alias("n")).alias("s"))


def minmax_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """X-08: (x - min) / (max - min) per column; min/max from one scalar aggregate."""
    stats = df.select(F.struct(*[F.struct(F.min(F.col(c).cast("double")).alias("lo"),
                                          F.max(F.col(c).cast("double")).alias("hi")).alias(c)
                                 for c in cols]).alias("s"))
    out = df.withColumn("_mm", stats.scalar())
    out = out.withColumns({f"{c}{suffix}": minmax(c, F.col(f"_mm.{c}.lo"), F.col(f"_mm.{c}.hi"))
                           for c in cols})
    return out.drop("_mm")


def zscore(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """X-09: (x - mean) / sample stddev."""
    out = df.withColumn("_z", zone_stats(df, col).scalar())
    out = out.withColumn(name or f"{col}_z", (F.col(col) - F.col("_z.mean")) / F.col("_z.std"))
    return out.drop("_z")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """G-11: equal-width bins from min to max; the last bin is closed on the right.

    Output: bin, lo, hi, count, one row per bin (empty bins included).  A
    constant column puts every value in bin 0.  Two passes, of one partial
    aggregate each: the range, then the counts, so that a task passes on at most
    ``bins`` rows whether the column holds five values or as many as rows.
    """
    c = F.col(col).cast("double")
    stats = df.select(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("s"))
    counted = (df.select(c.alias("x")).filter(F.col("x").isNotNull())
               .withColumn("_s", stats.scalar())
               .withColumn("_w", (F.col("_s.hi") - F.col("_s.lo")) / bins)
               .withColumn("bin", F.when(F.col("_w") == 0, F.lit(0)).otherwise(
                   F.least(F.floor((F.col("x") - F.col("_s.lo")) / F.col("_w")), F.lit(bins - 1))
               ).cast("int"))
               .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    spark = df.sparkSession
    grid = (spark.range(bins).select(F.col("id").cast("int").alias("bin"))
            .withColumn("_s", stats.scalar())
            .withColumn("_w", (F.col("_s.hi") - F.col("_s.lo")) / bins)
            .select("bin",
                    (F.col("_s.lo") + F.col("bin") * F.col("_w")).alias("lo"),
                    F.when(F.col("bin") == bins - 1, F.col("_s.hi"))
                    .otherwise(F.col("_s.lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi")))
    return (grid.join(F.broadcast(counted), "bin", "left")
            .select("bin", "lo", "hi", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


#: Width of a fine bin of ``density``, as a share of the bandwidth.
FINE_BIN = 1 / 64


def density(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0, scale: str | None = None,
            fine: float | None = None) -> DataFrame:
    """G-12: Gaussian kernel density estimate of one column on an even grid.

    Scott's rule: bandwidth = n^(-1/5) * sample stddev; the grid runs from
    min - cut*bw to max + cut*bw in ``grid`` points (the plotting library's
    defaults).  Two passes of one partial aggregate each: count, range, mean and
    deviation; then number and mean of the values in fine bins of ``fine``
    bandwidths.  Each fine bin spreads its weight, from its mean, over the grid
    points with a bounded ``posexplode``.  Without ``fine`` each distinct value is a
    bin of its own, which is exact, but as many bins as distinct values; with it the
    number of bins follows the range over the bandwidth.  Where the values of a fine
    bin are equal, as ratings are, it is exact too; otherwise the density is off by
    at most 0.05 * fine^2 / bandwidth (0.000012 / bandwidth for ``FINE_BIN``), as the
    first-order terms cancel about the mean.  Nothing is stored in between.
    ``scale="minmax"`` estimates the density of the min-max scaled column (X-08).
    A column without two different values has no bandwidth and gives no rows.
    Output: point (0..grid-1), x, density.
    """
    c = F.col(col).cast("double")
    stats = df.select(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"),
                               F.stddev_samp(c).alias("std")).alias("s"))
    rows = df.select(c.alias("v")).filter(F.col("v").isNotNull()).withColumn("_s", stats.scalar()).filter("_s.hi > _s.lo")
    width = F.col("_s.hi") - F.col("_s.lo")
    if scale == "minmax":
        value, low, high, std = (F.col("v") - F.col("_s.lo")) / width, F.lit(0.0), F.lit(1.0), F.col("_s.std") / width
    elif scale is None:
        value, low, high, std = F.col("v"), F.col("_s.lo"), F.col("_s.hi"), F.col("_s.std")
    else:
        raise ValueError(f"unknown scale {scale!r}")
    n = F.col("_s.n")
    bw = F.pow(n.cast("double"), F.lit(-0.2)) * std
    binned = (rows.select(value.alias("v"), F.struct(low.alias("lo"), high.alias("hi"), n.alias("n"), bw.alias("bw")).alias("k"))
              .groupBy(F.col("v").alias("bin") if fine is None else
                       F.floor((F.col("v") - F.col("k.lo")) / (F.col("k.bw") * fine)).alias("bin"), "k")
              .agg(F.count(F.lit(1)).alias("w"), F.avg("v").alias("v")))
    g0 = F.col("k.lo") - F.lit(cut) * F.col("k.bw")
    step = (F.col("k.hi") + F.lit(cut) * F.col("k.bw") - g0) / (grid - 1)
    spread = (binned.select("v", "w", F.col("k.n").alias("n"), F.col("k.bw").alias("bw"), g0.alias("g0"), step.alias("step"),
                            F.posexplode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point", "_i"))
              .withColumn("x", F.col("g0") + F.col("point") * F.col("step"))
              .withColumn("k", F.col("w") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("bw"), 2))
                          / (F.col("bw") * F.lit((2 * 3.141592653589793) ** 0.5) * F.col("n"))))
    return spread.groupBy("point").agg(F.first("x").alias("x"), F.sum("k").alias("density"))


def rmse(df: DataFrame, label: str, prediction: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """G-13: root mean square error, overall or per group."""
    err = F.sqrt(F.avg(F.pow(F.col(label) - F.col(prediction), 2))).alias("rmse")
    n = F.count(F.lit(1)).alias("n")
    if by is None:
        return df.select(err, n)
    return df.groupBy(*_cols(by)).agg(err, n)
