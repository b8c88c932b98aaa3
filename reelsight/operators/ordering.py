"""Sort, limit, top-k, distinct and latest-per-key (O-01 .. O-08).

Global top-n is ``orderBy().limit()``, planned as TakeOrderedAndProject: each
task keeps n rows, the driver merges n x tasks.  Top-k per group is
``row_number() <= k`` over a window, which Spark plans with a partial
WindowGroupLimit before the shuffle, so a hot group ships at most k rows
per map task.  Every order ends in a unique tie-break so results are stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsight.session import checkpoint_dir


def _order(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_groups(df: DataFrame, order: Sequence[Column | str], n: int = 10) -> DataFrame:
    """O-01 / O-02 / O-03: order by the given keys (last one a tie-break), keep n rows."""
    return df.orderBy(*_order(order)).limit(n)


def limit_rows(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """O-03: the reference's unordered limits (10 pairs, 20 watched) made deterministic."""
    return top_groups(df, order, n)


def top_k_per_group(df: DataFrame, by: str | Sequence[str], order: Sequence[Column | str], k: int,
                    rank_col: str | None = "rank") -> DataFrame:
    """O-04: the first k rows of each group under ``order`` (row_number semantics)."""
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(*_order(order))
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col)
    return out.drop("_rn")


def rank_recommendations(df: DataFrame, score: str, n: int, item: str = "MovieID") -> DataFrame:
    """O-05: highest score first, item id as tie-break, n rows."""
    return df.orderBy(F.col(score).desc(), F.col(item).asc()).limit(n)


def distinct_items(df: DataFrame, cols: Sequence[str] = ("MovieID",)) -> DataFrame:
    """O-06: distinct rows over the given columns (hash aggregate, partial before shuffle)."""
    return df.select(*cols).distinct()


def latest_rating_per_pair(df: DataFrame, keys: Sequence[str] = ("UserID", "MovieID"),
                           ts: str = "date_time", rating: str = "UserRating") -> DataFrame:
    """O-07: one row per (user, item): the latest one, higher rating on a tie.

    Written as ``max(struct(ts, rating, rest))`` per key, an aggregate with
    a partial step, so a pair with millions of rows never lands whole in one
    task, unlike a window over the pair.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in (ts, rating)]
    packed = F.max(F.struct(F.col(ts), F.col(rating), *[F.col(c) for c in rest])).alias("_m")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in [ts, rating] + rest]).select(*df.columns)


def append_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """O-08: column-wise concat of computed columns on the same rows (no join)."""
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def global_positions(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Positions 0, 1, 2, ... of the rows under ``order``, without a single-partition sort.

    The rows are range-sorted and numbered within their partition; a
    reliable checkpoint fixes those numbers (so this runs a job).  The
    partitions' row counts, one row each, give the offsets.
    """
    checkpoint_dir(df.sparkSession)
    mark = F.monotonically_increasing_id()   # partition number * 2^33 + row within it
    placed = df.orderBy(*order).withColumn("_mark", mark).checkpoint()
    part = F.shiftright("_mark", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(offsets, "_part") \
        .withColumn(out, F.col("_offset") + within).drop("_mark", "_part", "_offset")
