"""Delimited text source (S-01).

Lines like ``1::Title (1995)::Drama|War`` are split on a literal
multi-character separator and typed at once to a declared schema.  Lines
with too few fields or a bad key are kept with ``_corrupt = true`` (no row
is silently lost); empty lines are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsight.functions.scalars import split_fields


def parse_delimited(lines: DataFrame, schema: T.StructType, sep: str = "::", value: str = "value",
                    keep: list[str] | None = None, skip_empty: bool = True) -> DataFrame:
    """S-01 on a frame of text lines: positional fields typed by ``schema``; ``keep``: columns that stay beside them."""
    n = len(schema.fields)
    non_empty = lines.filter(F.length(F.trim(F.col(value))) > 0) if skip_empty else lines
    fields = split_fields(value, sep, n)
    typed = []
    for f, raw in zip(schema.fields, fields):
        v = F.trim(raw)
        if isinstance(f.dataType, T.StringType):
            typed.append(v.alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType)):
            typed.append(v.try_cast("double").try_cast(f.dataType).alias(f.name))
        else:
            typed.append(v.try_cast(f.dataType).alias(f.name))
    out = non_empty.select(*typed, *(keep or []), F.size(F.split(F.col(value), _regex(sep))).alias("_n"))
    required = [f.name for f in schema.fields if not f.nullable]
    bad = F.col("_n") < n
    for r in required:
        bad = bad | F.col(r).isNull()
    return out.withColumn("_corrupt", bad).drop("_n")


def _regex(sep: str) -> str:
    import re
    return re.escape(sep)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "::") -> DataFrame:
    """S-01: read ``::``-separated text files (ratings, titles, users)."""
    return parse_delimited(spark.read.text(path), schema, sep)


def land_delimited(spark: SparkSession, source: str, schema: T.StructType, target: str, sep: str = "::") -> dict[str, int]:
    """S-01 as a job: text files to typed Parquet, with bad lines set aside and everything counted, in one scan.

    ``target`` gets one folder of rows and one of rejected lines (``landed_rows``,
    ``rejected_lines``).  Returns the counts taken in the same pass: ``lines``,
    ``empty``, ``short`` (too few fields), ``bad_key`` (a required field that does
    not parse) and ``loaded``; they add up.
    """
    raw = spark.read.text(source)
    n = len(schema.fields)
    required = [f.name for f in schema.fields if not f.nullable]
    missing = F.lit(False)
    for r in required:
        missing = missing | F.col(r).isNull()
    parsed = parse_delimited(raw.withColumn("_line", F.col("value")), schema, sep, keep=["_line"], skip_empty=False)
    reason = (F.when(F.length(F.trim("_line")) == 0, "empty").when(F.size(F.split("_line", _regex(sep))) < n, "short")
              .when(missing, "bad_key"))
    watch = Observation()
    counts = [F.count_if(F.col("_reason") == x).alias(x) for x in ("empty", "short", "bad_key")]
    told = parsed.drop("_corrupt").withColumn("_reason", reason).observe(
        watch, F.count(F.lit(1)).alias("lines"), *counts, F.count_if(F.col("_reason").isNull()).alias("loaded"))
    kept = F.col("_reason").isNull()
    # An empty line is counted, but there is nothing to set aside.
    told.where(kept | (F.col("_reason") != "empty")).withColumn("_line", F.when(~kept, F.col("_line"))).withColumn(
        "_set", F.when(kept, "rows").otherwise("rejected")).write.mode("overwrite").partitionBy("_set").parquet(target)
    return {k: int(v or 0) for k, v in watch.get.items()}


def _landed(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("_line", T.StringType()), T.StructField("_reason", T.StringType()),
                         T.StructField("_set", T.StringType())])
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in full.fields])).parquet(target)


def landed_rows(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The typed rows of ``land_delimited``."""
    return _landed(spark, target, schema).where("_set = 'rows'").select(*[f.name for f in schema.fields])


def rejected_lines(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """``(line, reason)`` of the lines that ``land_delimited`` set aside."""
    return _landed(spark, target, schema).where("_set = 'rejected'").select(
        F.col("_line").alias("line"), F.col("_reason").alias("reason"))
