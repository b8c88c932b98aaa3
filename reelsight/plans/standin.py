"""Ratings-shaped inputs derived from the driver's tables.

The library's operators consume rating, user, title, metadata, detail and
request tables.  The driver ships TPC-H-like tables instead, so this module
derives those inputs from them with ordinary joins and expressions: one
rating per ``lineitem`` row, the customer as the user, the part as the title.
The mapping is the one written down in FIXTURES.md section 2; all of it is
lazy DataFrame code, so column pruning and filter push-down reach the scans.

Joins are left to the planner: ``lineitem`` and ``orders`` are both large
and meet in a sort-merge join on the order key; ``customer`` and ``part``
grow with the scale factor too, so whether they are broadcast is decided by
adaptive execution from their measured size, not forced here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsight.functions.scalars import epoch_seconds, occupation_name
from reelsight.operators.clean import parse_numbers
from reelsight.schemas import REQUEST_SCHEMA


_READERS: dict = {}


def session_key(spark: SparkSession) -> tuple:
    """Identifies a live session: a new application after a restart never matches an old one."""
    try:
        return (spark.sparkContext.applicationId, id(spark))
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        return ("session", id(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet).  The reader (schema from the footers) is built once per session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (session_key(spark), path)
    if key not in _READERS:
        _READERS[key] = spark.read.parquet(path)
    return _READERS[key]


# ------------------------------------------------------------ user attributes

def gender_of(custkey: Column) -> Column:
    return F.when(custkey % 2 == 0, F.lit("M")).otherwise(F.lit("F"))


def occupation_of(nationkey: Column) -> Column:
    return (nationkey % 21).cast("int")


def age_of(acctbal: Column) -> Column:
    return (F.when(acctbal < 0, 1).when(acctbal < 1500, 18).when(acctbal < 3500, 25)
            .when(acctbal < 5500, 35).when(acctbal < 7000, 45).when(acctbal < 8500, 50)
            .otherwise(56)).cast("int")


def zip_of(custkey: Column) -> Column:
    return F.concat(F.lpad((custkey % 40).cast("string"), 3, "0"), F.lit("00"))


def rating_of(quantity: Column, custkey: Column, partkey: Column) -> Column:
    """1..5 with a planted signal: the title's rating_imdb, the user's gender and a user
    habit move the rating, the line's quantity is the noise."""
    points = (quantity - 1) * 4 + (partkey % 10) * 20 + (custkey % 2) * 64 + (custkey % 5) * 12
    return (F.lit(1) + F.floor(points / 98)).cast("int")


# ------------------------------------------------------------ title attributes

def title_of(partkey: Column, name: Column) -> Column:
    """Unique by its key, except every 50th title, which shares its text with one other."""
    return (F.when(partkey % 50 == 0, F.concat(F.lit("special "), F.floor(partkey / 100).cast("string")))
            .otherwise(F.concat(name, F.lit(" "), partkey.cast("string"))))


def rating_imdb_of(partkey: Column) -> Column:
    return (F.when(partkey % 17 == 0, F.lit("N/A"))
            .otherwise(F.concat((partkey % 10).cast("string"), F.lit(".5"))))


def runtimes_of(partkey: Column, size: Column) -> Column:
    return (F.when(partkey % 23 == 0, F.lit("90, 100"))
            .when(partkey % 29 == 0, F.lit(None).cast("string"))
            .otherwise((F.lit(60) + size).cast("string")))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("UserID"),
        gender_of(F.col("c_custkey")).alias("Gender"),
        age_of(F.col("c_acctbal")).alias("Age"),
        occupation_of(F.col("c_nationkey")).alias("Occupation"),
        zip_of(F.col("c_custkey")).alias("Zip_Code"),
    )


def _plots(spark: SparkSession, sf_dir: str, of_text: Callable[[Column], Column] | None = None) -> DataFrame:
    """Plot texts: all documents, keyed by doc_id (the documents key).

    ``of_text``: what a reader needs of a text, taken before any join.
    """
    text = of_text(F.col("text")) if of_text else F.col("text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_plot_doc"), text.alias("_plot_text"))


def _plot_doc(spark: SparkSession, sf_dir: str) -> Column:
    """A title's document: its key modulo the number of documents."""
    n_docs = table(spark, sf_dir, "documents").select(F.count(F.lit(1)).alias("n")).scalar()
    return (F.col("p_partkey") % n_docs).alias("_plot_doc")


def _there(text: Column) -> Column:
    """TRUE where there is a text, else NULL."""
    return F.when(text.isNotNull(), F.lit(True))


def _titles_wide(spark: SparkSession, sf_dir: str, with_plot: bool, plot_flag: bool = False) -> DataFrame:
    p = table(spark, sf_dir, "part")
    t = p.select(
        F.col("p_partkey").alias("MovieID"),
        title_of(F.col("p_partkey"), F.col("p_name")).alias("Title"),
        F.regexp_replace(F.col("p_name"), " ", "|").alias("Genres"),
        F.col("p_brand").alias("directedBy"),
        F.col("p_type").alias("starring"),
        rating_imdb_of(F.col("p_partkey")).alias("rating_imdb"),
        runtimes_of(F.col("p_partkey"), F.col("p_size")).alias("runtimes"),
        _plot_doc(spark, sf_dir),
        F.col("p_partkey").alias("_partkey"),
    )
    if with_plot:
        t = (t.join(_plots(spark, sf_dir, _there if plot_flag else None), "_plot_doc", "left")
             .withColumn("plot_outline", F.when(F.col("_partkey") % 31 == 0, F.lit(None))
                         .otherwise(F.col("_plot_text"))))
        t = t.drop("_plot_text")
    return t.drop("_plot_doc", "_partkey")


def ratings_standin(spark: SparkSession, sf_dir: str, with_plot: bool = False) -> DataFrame:
    """The wide ratings table (one row per lineitem), FIXTURES.md section 2.

    ``with_plot`` adds ``plot_outline`` as a flag (TRUE or NULL): rating rows
    never carry the text itself.  Users meet the orders, of which there are fewer
    than lines, and what follows from the user's id is taken after the last join.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("UserID"))
    o = o.join(_users(spark, sf_dir).select("UserID", "Age", "Occupation"), "UserID")
    r = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        "UserID",
        F.col("l_partkey").alias("MovieID"),
        rating_of(F.col("l_quantity"), F.col("UserID"), F.col("l_partkey")).alias("UserRating"),
        F.col("l_shipdate").alias("date_time"),
        "Age", "Occupation",
    )
    wide = r.join(_titles_wide(spark, sf_dir, with_plot, plot_flag=True), "MovieID").withColumns(
        {"Gender": gender_of(F.col("UserID")), "Zip_Code": zip_of(F.col("UserID"))})
    cols = ["UserID", "MovieID", "UserRating", "date_time", "Gender", "Occupation", "Age", "Zip_Code",
            "Title", "Genres", "directedBy", "starring", "rating_imdb", "runtimes"]
    if with_plot:
        cols.append("plot_outline")
    return wide.select(*cols)


def items_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per title with its plot text: MovieID, plot_outline."""
    return _titles_wide(spark, sf_dir, with_plot=True).select("MovieID", "plot_outline")


def serving_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user table as scoring reads it: UserID, Gender, Occupation_Name, Age."""
    return _users(spark, sf_dir).select("UserID", "Gender", occupation_name("Occupation").alias("Occupation_Name"),
                                        "Age")


def serving_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title table as scoring reads it, numbers cleaned as in the wide table (C-02, C-04)."""
    return parse_numbers(_titles_wide(spark, sf_dir, with_plot=False)).select(
        "MovieID", "Genres", "directedBy", "starring", "rating_imdb", "runtimes")


# ------------------------------------------------------------ raw inputs of the ingest joins

def raw_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as ingested: UserID, MovieID, Rating, Timestamp (epoch seconds)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("UserID"),
        F.col("l_partkey").alias("MovieID"),
        rating_of(F.col("l_quantity"), F.col("o_custkey"), F.col("l_partkey")).alias("Rating"),
        epoch_seconds(F.col("l_shipdate")).alias("Timestamp"),
    )


def raw_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as ingested: MovieID, Title, Genres ('|'-joined)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("MovieID"), title_of(F.col("p_partkey"), F.col("p_name")).alias("Title"),
                    F.regexp_replace(F.col("p_name"), " ", "|").alias("Genres"))


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as ingested: UserID, Gender, Age, Occupation, Zip_Code."""
    return _users(spark, sf_dir)


def raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title metadata as ingested from JSON lines: title, directedBy, starring, avgRating, imdbId.

    Every 50th title repeats, the case the title join must dedupe; every 37th
    title (key mod 37 = 5) has no metadata.
    """
    p = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 37 != 5)
    return p.select(
        title_of(F.col("p_partkey"), F.col("p_name")).alias("title"),
        F.col("p_brand").alias("directedBy"),
        F.col("p_type").alias("starring"),
        (F.col("p_retailprice") / 400).alias("avgRating"),
        F.col("p_partkey").alias("imdbId"),
    )


def raw_details(spark: SparkSession, sf_dir: str, of_plot: Callable[[Column], Column] | None = None) -> DataFrame:
    """Landed title details (all strings), keyed by a zero-padded text id ``imdbID``.

    With ``of_plot``, ``plot_outline`` holds that of the text, and no join carries the text itself.
    """
    p = table(spark, sf_dir, "part")
    t = p.select(
        title_of(F.col("p_partkey"), F.col("p_name")).alias("localized_title"),
        runtimes_of(F.col("p_partkey"), F.col("p_size")).alias("runtimes"),
        rating_imdb_of(F.col("p_partkey")).alias("rating_imdb"),
        _plot_doc(spark, sf_dir),
        F.col("p_brand").alias("director"),
        F.lpad(F.col("p_partkey").cast("string"), 19, "0").alias("imdbID"),
        F.col("p_partkey").alias("_partkey"),
    )
    t = t.join(_plots(spark, sf_dir, of_plot), "_plot_doc", "left").withColumn(
        "plot_outline", F.when(F.col("_partkey") % 31 == 0, F.lit(None)).otherwise(F.col("_plot_text")))
    return t.select("localized_title", "runtimes", "rating_imdb", "plot_outline", "director", "imdbID")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests, one per ``events`` row.

    user = ``user_id`` (negative for every tenth event, an unknown user at
    any scale); item = ``event_id mod (n + n div 2)`` with n = number of parts, so
    about a third of the items are unknown.  Optional request fields are
    NULL; scoring fills them from the dimension tables.
    """
    e = table(spark, sf_dir, "events")
    n_items = table(spark, sf_dir, "part").select(F.count(F.lit(1)).alias("n")).scalar()
    e = e.withColumn("_n", n_items)
    modulus = F.col("_n") + F.floor(F.col("_n") / 2).cast("bigint")
    base = e.select(
        F.col("event_id").alias("RequestID"),
        F.when(F.col("event_id") % 10 == 0, -1 - F.col("user_id"))
        .otherwise(F.col("user_id")).alias("UserID"),
        (F.col("event_id") % modulus).alias("MovieID"),
    )
    typed = [F.col(f.name) if f.name in base.columns else F.lit(None).cast(f.dataType).alias(f.name)
             for f in REQUEST_SCHEMA.fields]
    return base.select(*typed)
