"""Shuffled shards by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit in memory, by a
seeded hash of their place in the input.  Pass two permutes each bucket with a
Fisher-Yates shuffle and writes it.  Buckets follow one another in a global
order that is cut into shards whose counts differ by at most one (the law
``rows``), so a bucket writes to one or two shards and slots are gapless.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelsight.llm.common import materialise, parts, scratch, text_bytes

BUCKET_BYTES = 16 << 20
LAW = "rows"


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of ``range(n)`` by Fisher-Yates swaps."""
    draw = np.random.default_rng(seed)
    order = np.arange(n)
    picks = draw.integers(0, np.arange(n, 0, -1)) if n else order
    for i, p in enumerate(picks.tolist()):
        order[i], order[i + p] = order[i + p], order[i]
    return order


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 11, text_col: str = "text",
                 bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write ``docs``, shuffled, as Parquet under ``path/shard=<n>``, with a column ``slot``.

    All columns stay (columns named ``shard``, ``slot``, ``__key`` or
    ``__bucket`` are refused).  Null texts, repeated rows and very long texts
    need nothing special: rows are drawn by their place in the input, so a hot
    group spreads over all buckets.  ``docs`` must give the same rows in the same
    order when read again, as a file scan does; a bucket that does not hold the
    rows counted for it is an error.  An empty table writes no shard.
    """
    taken = {"__bucket", "__key", "shard", "slot"} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"columns would clash: {sorted(taken)}")
    n = parts(text_bytes(docs, text_col), bucket_bytes)
    keyed = docs.withColumn("__key", F.xxhash64(F.lit(seed), F.spark_partition_id(), F.monotonically_increasing_id())) \
        .withColumn("__bucket", F.expr(f"cast(pmod(shiftright(__key, 7), {n}) as int)"))
    # One row per bucket: the number of records before it, of its own and of all.
    sizes = keyed.groupBy("__bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sizes.select("__bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
                                      F.sum("n").over(Window.partitionBy()).alias("total")), "buckets")
    schema = docs.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).schema

    def permute(table: pa.Table, place: pa.Table) -> pa.Table:
        bucket, rows, start, total = (place.column(c)[0].as_py() for c in ("__bucket", "n", "start", "total"))
        if rows != table.num_rows:
            raise ValueError(f"bucket {bucket}: {table.num_rows} rows where {rows} were counted")
        # Arrival order may differ between attempts: begin from a fixed order.
        table = table.sort_by("__key").drop_columns(["__key", "__bucket"]).take(
            pa.array(fisher_yates(rows, [seed, bucket])))
        at = np.arange(start, start + rows)
        each, more = divmod(total, shards)          # the first ``more`` shards hold one record more
        edge = more * (each + 1)
        shard = np.where(at < edge, at // (each + 1), more + (at - edge) // max(each, 1))
        slot = at - np.where(shard < more, shard * (each + 1), edge + (shard - more) * each)
        return table.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    keyed.groupBy("__bucket").cogroup(starts.groupBy("__bucket")).applyInArrow(permute, schema) \
        .write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The written records with ``shard`` and ``slot``; ``schema`` is that of the input."""
    fields = spark.createDataFrame([], schema).withColumns({"slot": F.lit(0).cast("long"), "shard": F.lit(0)}).schema
    return spark.read.schema(fields).parquet(path)


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 11) -> DataFrame:
    """Write shards of ``docs`` (doc_id, text) to the shared folder and describe each record read back."""
    path = scratch(docs.sparkSession, "shards")
    write_shards(docs, path, shards, seed)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return read_shards(docs.sparkSession, path, docs.schema).select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
