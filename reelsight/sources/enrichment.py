"""Title-detail enrichment as data jobs (S-08, S-09).

Fetching from a web service is outside Spark; what remains are two table
jobs: the list of ids still to fetch (S-09), and reading the landed fetch
results back into a typed, de-duplicated details table (S-08).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsight.functions.scalars import join_list
from reelsight.schemas import DETAILS_RAW_JSON
from reelsight.sources.versions import VersionedFolder


def read_enrichment(spark: SparkSession, path: str) -> DataFrame:
    """S-08: landed detail records (JSON lines) -> the details table.

    List fields (``runtimes``, ``director``) are joined with ', ', the
    ``rating`` field becomes ``rating_imdb``, failed records (no id) are
    dropped, and the latest record per id wins (a partial aggregate, so
    an id fetched many times never gathers in one task).
    """
    raw = spark.read.schema(DETAILS_RAW_JSON).json(path)
    return landed_details(raw)


def landed_details(raw: DataFrame) -> DataFrame:
    """S-08 on an already-read frame of raw detail records."""
    return latest_details(shaped_details(raw)).select(*DETAIL_COLUMNS, "imdbID")


#: The details of a title, without its id.
DETAIL_COLUMNS = ["localized_title", "runtimes", "rating_imdb", "plot_outline", "director"]


def shaped_details(raw: DataFrame) -> DataFrame:
    """``(imdbID, _at, details)`` of the raw records that have an id; ``_at`` is the fetch time."""
    ok = raw.filter(F.col("imdbID").isNotNull() & (F.trim(F.col("imdbID")) != ""))
    return ok.select(
        F.col("imdbID"),
        F.coalesce(F.col("fetched_at"), F.lit(0).cast("timestamp")).alias("_at"),
        F.col("localized_title"),
        join_list("runtimes").alias("runtimes"),
        F.col("rating").alias("rating_imdb"),
        F.col("plot_outline"),
        join_list("director").alias("director"),
    )


def latest_details(shaped: DataFrame, *place: str) -> DataFrame:
    """The latest of the shaped records of each id.  Latest of latest is latest, so results can be merged.

    ``place``: columns that follow from the id; rows partitioned by them are not moved.
    """
    return shaped.groupBy(*place, "imdbID").agg(F.max(F.struct("_at", *DETAIL_COLUMNS)).alias("_r")).select(
        "imdbID", F.col("_r._at").alias("_at"), *[F.col(f"_r.{c}").alias(c) for c in DETAIL_COLUMNS], *place)


class DetailsTable:
    """S-08 and S-09 as a table that grows by landings.

    Details are kept by buckets of their id, and the manifest names the folder of
    each bucket.  A landing reads and rewrites only the buckets that its ids fall
    into, and becomes visible as a whole when the next manifest is published.  Buckets
    in which it changes no record, as in a replay, stay as they are.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, VersionedFolder(spark, path), buckets

    def _read(self, folders: list[str]) -> DataFrame:
        shape = "imdbID string, _at timestamp, " + ", ".join(f"{c} string" for c in DETAIL_COLUMNS)
        if not folders:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*folders)

    def table(self) -> DataFrame:
        """The details table, as ``read_enrichment`` over everything landed would give it."""
        return self._read(list(self.folder.content().get("folders", {}).values())).select(*DETAIL_COLUMNS, "imdbID")

    def high_water(self):
        """The latest fetch time landed so far; None before the first landing."""
        folders = list(self.folder.content().get("folders", {}).values())
        return self._read(folders).agg(F.max("_at")).first()[0] if folders else None

    def _changes(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """``(bucket, imdbID)`` of the new records that are not in ``old`` and no older there; texts are compared by digest."""
        digest = F.sha2(F.to_json(F.struct(*DETAIL_COLUMNS)), 256)
        known = old.select("imdbID", F.col("_at").alias("_known_at"), digest.alias("_known"))
        both = new.select("bucket", "imdbID", "_at", digest.alias("_digest")).join(known, "imdbID", "left")
        same_time = (F.col("_at") == F.col("_known_at")) & (F.col("_digest") != F.col("_known"))
        return both.where(F.col("_known").isNull() | (F.col("_at") > F.col("_known_at")) | same_time).select("bucket", "imdbID")

    def land(self, raw: DataFrame) -> int:
        """Merge raw records into the table; returns how many buckets were rewritten.

        Records may repeat earlier ones or be older than them: the latest of each id
        stays, so landings can be replayed and come in any order.
        """
        version, content = self.folder.version(), self.folder.content()
        buckets = content.get("buckets", self.buckets)      # those of the first landing hold for good
        folders = content.get("folders", {})
        place = {"bucket": F.pmod(F.xxhash64("imdbID"), F.lit(buckets)), "_part": F.pmod(F.xxhash64("imdbID", F.lit(1)), F.lit(8))}
        new = latest_details(shaped_details(raw)).withColumns(place)
        part = self.folder.new_folder("landing")
        new.write.parquet(f"{part}/new", compression="zstd")
        new = self.spark.read.parquet(f"{part}/new")
        hit = [str(r.bucket) for r in new.select("bucket").distinct().collect()]         # at most ``buckets``
        old = self._read([folders[b] for b in hit if b in folders])
        touched = [str(r.bucket) for r in self._changes(new, old).select("bucket").distinct().collect()]
        if not touched:
            return 0
        new = new.where(F.col("bucket").isin([int(b) for b in touched]))
        old = self._read([folders[b] for b in touched if b in folders])
        # Both sides hold an id once, so they meet without a partial step, in the partitions that are written.
        merged = latest_details(old.withColumns(place).unionByName(new).repartition("bucket", "_part"), "bucket", "_part")
        merged.drop("_part").write.partitionBy("bucket").parquet(f"{part}/merged", compression="zstd")
        self.folder.publish({"buckets": buckets, "folders": folders | {
            b: f"{part}/merged/bucket={b}" for b in touched}}, after=version)
        return len(touched)


def pending_enrichment_ids(ratings: DataFrame, details: DataFrame, left_key: str = "imdbId",
                           right_key: str = "imdbID") -> DataFrame:
    """S-09: distinct external ids referenced by ``ratings`` with no complete detail record.

    A record is complete when it has both a plot and a runtime.  Ids are
    compared as numbers (zero-padded text on the details side).
    """
    ids = ratings.select(F.col(left_key)).distinct().withColumn(
        "_k", F.col(left_key).cast("string").try_cast("bigint"))
    done = (details.filter(F.col("plot_outline").isNotNull() & F.col("runtimes").isNotNull())
            .select(F.col(right_key).try_cast("bigint").alias("_k")))
    return ids.join(done, "_k", "left_anti").select(left_key)
