"""F-01 and F-02 by joins: category indices as a table, also with a cut-off by frequency.

``StringIndexer`` keeps every label of a column on the driver and in each task.
Here the index of a value is a row of a distributed table, and encoding is a join;
it is done on the title and user tables, so rating rows only meet their ids.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsight.operators.features import CATEGORICAL, category_index_table


def frequent_values(df: DataFrame, col: str, min_share: float) -> DataFrame:
    """``(value, n)`` of the values that make up at least ``min_share`` of the non-NULL rows; exact.

    One pass fills a sketch of a size given by ``min_share`` alone and names at most
    ``2 / min_share`` candidates, among them every such value; a second counts those.
    """
    value = df.select(F.col(col).cast("string").alias("value")).where("value is not null")
    # A sketch of m items is off by 3.5 / m of the rows at most: here by an eighth of the share.
    tracked = math.ceil(28 / min_share)
    top = value.agg(F.expr(f"approx_top_k(value, {math.ceil(2 / min_share)}, {tracked})").alias("top"))
    candidates = top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("value"))
    total = value.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = value.join(F.broadcast(candidates), "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_share * total)


def category_slots(df: DataFrame, cols: Sequence[str] = CATEGORICAL, min_share: float | None = None) -> DataFrame:
    """``(column, value, slot)``: slots 0, 1, ... by falling frequency, ties alphabetical.

    With ``min_share`` (at least 0.00003) only values with that share of their
    column's rows have a slot, so there are at most ``1 / min_share`` of them; all
    others are treated like values never seen.
    """
    if min_share is None:
        return category_index_table(df, cols).select("column", "value", F.col("index").cast("int").alias("slot"))
    if not 3e-5 <= min_share <= 1:
        raise ValueError("min_share must lie between 0.00003 and 1")
    out = None
    for c in cols:
        # At most 1 / min_share values, so one task may number them.
        listed = frequent_values(df, c, min_share).agg(F.array_sort(F.collect_list(F.struct(-F.col("n"), "value"))).alias("v"))
        one = listed.select(F.lit(c).alias("column"), F.posexplode("v").alias("slot", "_v")).select(
            "column", F.col("_v.value").alias("value"), "slot")
        out = one if out is None else out.unionAll(one)
    return out


def encode_slots(df: DataFrame, slots: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with the slot of each category column ``names[column]``; NULL for a value without one."""
    for c, name in names.items():
        own = slots.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("slot").alias(name))
        df = df.join(own, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
    return df


def slot_counts(slots: DataFrame, cols: Sequence[str] = CATEGORICAL) -> dict[str, int]:
    """Number of slots of each column (one small aggregate)."""
    found = {r["column"]: r.n for r in slots.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(c, 0) for c in cols}
