"""File sources and sinks (S-02 .. S-07, S-11).

Readers always take a declared schema (no inference pass over the data);
writers write in parallel, one file per task, never through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """S-02: header CSV with a declared schema; malformed values become NULL."""
    return (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
            .csv(path))


def read_title_metadata(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S-03: JSON-lines title metadata with a declared schema."""
    return spark.read.schema(schema).json(path)


def read_ratings(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """S-04: the wide ratings table (or preprocessed features) from Parquet.

    Selecting ``columns`` here lets the scan read only those columns.
    """
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """S-05: overwrite CSV with header, one part file per task (no coalesce(1))."""
    df.write.mode("overwrite").option("header", header).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] | None = None, **options: str) -> None:
    """S-06: overwrite Parquet, optionally partitioned by low-cardinality columns; ``options`` go to the writer."""
    w = df.write.mode("overwrite").options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def rows_with_schema(spark: SparkSession, rows: Sequence, schema: T.StructType,
                     rename: dict[str, str] | None = None) -> DataFrame:
    """S-07: a small in-memory record set (a request, a test fixture) as a typed table.

    ``rename`` maps incoming field names positionally renamed by the schema
    (e.g. ``rating`` -> ``rating_imdb``) for records given as dicts.
    """
    if rows and isinstance(rows[0], dict):
        rename = rename or {}
        names = [f.name for f in schema.fields]
        src_names = [next((k for k, v in rename.items() if v == n), n) for n in names]
        rows = [tuple(r.get(s) for s in src_names) for r in rows]
    return spark.createDataFrame(list(rows), schema=schema)


def profile_shape(df: DataFrame) -> DataFrame:
    """S-11: one row with the row count and the column count."""
    return df.select(F.count(F.lit(1)).alias("row_count"),
                     F.lit(len(df.columns)).cast("int").alias("column_count"))


def schema_table(df: DataFrame) -> list[tuple[str, str, bool]]:
    """S-11: the schema as (name, type, nullable) - plan metadata, no job runs."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
