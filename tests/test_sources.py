"""Readers and writers: text, CSV, JSON, Parquet, landed details, model save/load."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from reelsight.schemas import METADATA_JSON, RATINGS_TEXT, TITLES_TEXT, USERS_TEXT
from reelsight.sources.enrichment import pending_enrichment_ids, read_enrichment
from reelsight.sources.files import (profile_shape, read_csv, read_ratings, read_title_metadata, rows_with_schema,
                                     schema_table, write_csv, write_parquet)
from reelsight.sources.text import read_delimited


def test_read_delimited_flags_short_lines(spark, tmp_out):
    p = os.path.join(tmp_out, "movies.dat")
    with open(p, "w") as fh:
        fh.write("1::A (1995)::Drama|War\n2::B only\n\nx::C::Comedy\n")
    df = read_delimited(spark, p, TITLES_TEXT).orderBy("Title").collect()
    assert len(df) == 3                                   # empty line skipped
    good = [r for r in df if not r._corrupt]
    assert [(r.MovieID, r.Title, r.Genres) for r in good] == [(1, "A (1995)", "Drama|War")]
    assert sum(r._corrupt for r in df) == 2               # short line, bad id


def test_ratings_and_users_text(spark, tmp_out):
    p = os.path.join(tmp_out, "r.dat")
    with open(p, "w") as fh:
        fh.write("1::10::5::978300760\n2::11::3::978302109\n")
    r = read_delimited(spark, p, RATINGS_TEXT).collect()
    assert [(x.UserID, x.MovieID, x.Rating, x.Timestamp) for x in r] == [(1, 10, 5, 978300760), (2, 11, 3, 978302109)]
    u = os.path.join(tmp_out, "u.dat")
    with open(u, "w") as fh:
        fh.write("1::F::1::10::01234\n")
    row = read_delimited(spark, u, USERS_TEXT).collect()[0]
    assert row.Zip_Code == "01234" and row.Occupation == 10


def test_csv_and_parquet_round_trip(spark, tmp_out):
    df = spark.createDataFrame([(1, "a|b", "01234"), (2, None, "98107")], "MovieID int, Genres string, Zip_Code string")
    write_csv(df, os.path.join(tmp_out, "csv"))
    back = read_csv(spark, os.path.join(tmp_out, "csv"), df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    write_parquet(df, os.path.join(tmp_out, "pq"), partition_by=["MovieID"])
    pq = read_ratings(spark, os.path.join(tmp_out, "pq"), ["MovieID", "Zip_Code"])
    assert sorted((r.MovieID, r.Zip_Code) for r in pq.collect()) == [(1, "01234"), (2, "98107")]


def test_metadata_json(spark, tmp_out):
    p = os.path.join(tmp_out, "meta.json")
    with open(p, "w") as fh:
        fh.write(json.dumps({"title": "A", "directedBy": "X", "starring": "Y", "avgRating": 3.5, "imdbId": "0114709"}) + "\n")
    r = read_title_metadata(spark, p, METADATA_JSON).collect()[0]
    assert (r.title, r.imdbId, r.avgRating) == ("A", "0114709", 3.5)


def test_rows_with_schema_renames(spark):
    from reelsight.schemas import DETAILS
    df = rows_with_schema(spark, [{"localized_title": "A", "runtimes": "90", "rating": "7.5", "plot_outline": "p",
                                   "director": "d", "imdbID": "1"}], DETAILS, rename={"rating": "rating_imdb"})
    assert df.collect()[0].rating_imdb == "7.5"


def test_landed_details_latest_wins(spark, tmp_out):
    p = os.path.join(tmp_out, "details.json")
    recs = [
        {"imdbID": "0000001", "localized_title": "Old", "runtimes": ["90"], "rating": "6.0", "plot_outline": "a",
         "director": ["X"], "fetched_at": "2024-01-01T00:00:00"},
        {"imdbID": "0000001", "localized_title": "New", "runtimes": ["90", "100"], "rating": "7.0",
         "plot_outline": "b", "director": ["X", "Y"], "fetched_at": "2024-02-01T00:00:00"},
        {"imdbID": None, "localized_title": "failed"},
    ]
    with open(p, "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in recs) + "\n")
    out = read_enrichment(spark, p).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.localized_title, r.runtimes, r.rating_imdb, r.director) == ("New", "90, 100", "7.0", "X, Y")


def test_pending_ids(spark):
    ratings = spark.createDataFrame([(1,), (2,), (3,), (3,)], "imdbId int")
    details = spark.createDataFrame([("0000001", "p", "90"), ("0000002", None, "90")],
                                    "imdbID string, plot_outline string, runtimes string")
    assert sorted(r.imdbId for r in pending_enrichment_ids(ratings, details).collect()) == [2, 3]


def test_profile_shape(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "a int, b string")
    r = profile_shape(df).collect()[0]
    assert (r.row_count, r.column_count) == (2, 2)
    assert schema_table(df) == [("a", "int", True), ("b", "string", True)]


def test_landing_counts_every_line_once(spark, tmp_out):
    from reelsight.schemas import RATINGS_TEXT
    from reelsight.sources.text import land_delimited, landed_rows, rejected_lines
    lines = ["1::2::5::978300760", "", "  ", "1::2", "x::2::5::978300760", "3::4::1::978300761", "3::4::1::978300761"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_out}/in")
    counts = land_delimited(spark, f"{tmp_out}/in", RATINGS_TEXT, f"{tmp_out}/out")
    assert counts == {"lines": 7, "empty": 2, "short": 1, "bad_key": 1, "loaded": 3}
    assert sorted(r.UserID for r in landed_rows(spark, f"{tmp_out}/out", RATINGS_TEXT).collect()) == [1, 3, 3]
    assert sorted(map(tuple, rejected_lines(spark, f"{tmp_out}/out", RATINGS_TEXT).collect())) == [
        ("1::2", "short"), ("x::2::5::978300760", "bad_key")]
    spark.createDataFrame([], "value string").write.text(f"{tmp_out}/none")
    assert set(land_delimited(spark, f"{tmp_out}/none", RATINGS_TEXT, f"{tmp_out}/out").values()) == {0}


def test_landings_equal_one_rebuild_and_touch_only_their_buckets(spark, tmp_out):
    from reelsight.schemas import DETAILS_RAW_JSON
    from reelsight.sources.enrichment import DetailsTable, landed_details
    def records(rows):  # noqa: E306
        df = spark.createDataFrame([(i, t, at) for i, t, at in rows], "imdbID string, localized_title string, at string")
        return df.select("imdbID", "localized_title", F.array(F.lit("90")).alias("runtimes"), F.lit("7").alias("rating"),
                         F.lit(None).cast("string").alias("plot_outline"), F.array(F.lit("d")).alias("director"),
                         F.col("at").cast("timestamp").alias("fetched_at")).select(*DETAILS_RAW_JSON.names)
    first = records([(f"{i:03d}", f"t{i}", "2024-01-01") for i in range(200)] + [(None, "failed", "2024-01-01"), ("", "no id", None)])
    second = records([("007", "newer", "2024-02-01"), ("007", "older", "2023-01-01"), ("500", "added", None), ("008", "late", "2023-06-01")])
    table = DetailsTable(spark, f"{tmp_out}/details", buckets=16)
    assert table.table().count() == 0 and table.high_water() is None
    assert table.land(first) == 16
    before = table.folder.content()["folders"]
    second.write.parquet(table.folder.new_folder("landing"))        # what a broken landing leaves
    assert 1 <= table.land(second) <= 3
    after = DetailsTable(spark, f"{tmp_out}/details", buckets=99).folder.content()["folders"]
    assert sum(before[b] != after[b] for b in before) <= 3
    want = sorted(map(tuple, landed_details(first.unionByName(second)).collect()), key=str)
    assert sorted(map(tuple, table.table().collect()), key=str) == want and len(want) == 201
    assert table.land(second) == 0 and table.folder.content()["folders"] == after      # a replay rewrites nothing
    assert sorted(map(tuple, table.table().collect()), key=str) == want
    same_time = records([("007", "newest", "2024-02-01"), ("008", "a", "2024-01-01")])    # the larger one wins
    assert table.land(same_time) <= 2
    want = sorted(map(tuple, landed_details(first.unionByName(second).unionByName(same_time)).collect()), key=str)
    assert sorted(map(tuple, table.table().collect()), key=str) == want
    assert str(table.high_water()) == "2024-02-01 00:00:00" and table.land(records([])) == 0
