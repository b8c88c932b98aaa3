"""Stored factors and coefficients, the layout by pair, and requests answered once."""

import pytest
from pyspark.sql import functions as F

from reelsight.operators.joins import exclude_seen, known_pairs
from reelsight.operators.ordering import latest_rating_per_pair
from reelsight.operators.serving_tables import COEFFICIENTS, INTERCEPT, FactorTables, score_content, score_pairs
from reelsight.schemas import REQUEST_SCHEMA
from reelsight.sources.layout import user_slice, write_layout
from reelsight.streaming.once import score_once
from reelsight.streaming.requests import read_scored


def test_factor_scores_equal_plain_products(spark, tmp_out):
    users = spark.createDataFrame([(1, [0.5, 2.0]), (1 << 40, [1.0, -1.0])], "id long, features array<float>")
    items = spark.createDataFrame([(7, [2.0, 0.25]), (8, [0.0, 0.0])], "id long, features array<float>")
    FactorTables(users, items).save(f"{tmp_out}/f")
    pairs = spark.createDataFrame([(1, 7), (1, 7), (1 << 40, 7), (1, 8), (2, 7), (1, 9), (None, 7)], "UserID long, MovieID long")
    got = score_pairs(pairs, FactorTables.load(spark, f"{tmp_out}/f")).collect()
    assert sorted(((r.UserID, r.MovieID, r.als_prediction) for r in got), key=str) == sorted(
        [(1, 7, 1.5), (1, 7, 1.5), (1 << 40, 7, 1.75), (1, 8, 0.0), (2, 7, None), (1, 9, None), (None, 7, None)], key=str)


def test_content_scores_by_joins(spark):
    weights = spark.createDataFrame([("g", "x", 0.5, None), ("g", "y", -0.25, None), ("h", "x", 2.0, None),
                                     ("age", None, 0.1, 30.0), (INTERCEPT, None, 3.0, None)], COEFFICIENTS)
    rows = spark.createDataFrame([(1, "x", "x", 10), (2, "y", None, None), (3, "new", "new", 20), (4, None, "x", 0)],
                                 "id int, g string, h string, age int")
    got = {r.id: r.s for r in score_content(rows, weights, ["g", "h"], ["age"], "s").collect()}
    assert got == pytest.approx({1: 6.5, 2: 5.75, 3: 5.0, 4: 5.0})
    none = score_content(rows, weights.where("false"), ["g", "h"], ["age"], "s")
    assert {r.s for r in none.collect()} == {0.0}


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    # user 3 has a third of all rows; pairs repeat
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 3).otherwise(F.col("id") % 40).cast("long").alias("UserID"),
        (F.col("id") % 97).alias("MovieID"), F.timestamp_seconds("id").alias("date_time"), (F.col("id") % 5).cast("int").alias("UserRating"))
    return rows, write_layout(rows, str(tmp_path_factory.mktemp("layout") / "t"), buckets=4)


def _lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_ratings_do_not_move(spark, layout):
    rows, table = layout
    asked = spark.range(200).selectExpr("id % 50 AS UserID", "id % 97 AS MovieID")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        latest = latest_rating_per_pair(table.table(spark))
        assert not any("Exchange" in x for x in _lines(latest))
        for job in (exclude_seen, known_pairs):
            moved = [x for x in _lines(job(asked, table.table(spark))) if "Exchange hash" in x]
            assert len(moved) == 1          # the requests'
            plain = [x for x in _lines(job(asked, rows)) if "Exchange hash" in x]
            assert len(plain) == 2
            assert sorted(job(asked, table.table(spark)).collect()) == sorted(job(asked, rows).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(latest.collect()) == sorted(latest_rating_per_pair(rows).collect())
    assert table.table(spark).count() == 6000


def test_one_user_reads_one_folder(spark, layout):
    rows, table = layout
    for user in (3, 11):
        got = table.of_user(spark, user)
        assert sorted(got.collect()) == sorted(rows.where(F.col("UserID") == user).select(*got.columns).collect())
        slice_ = spark.range(1).select(user_slice(F.lit(user)).alias("s")).first().s
        read = {r.f for r in got.select(F.input_file_name().alias("f")).distinct().collect()}
        assert read and all(f"user_slice={slice_}/" in f for f in read)
        assert any("PartitionFilters: [" in x and "user_slice" in x.split("PartitionFilters:")[1].split("]")[0] for x in _lines(got))


def _requests(spark, rows):
    typed = [F.col(f.name) if f.name in ("RequestID", "UserID", "MovieID") else F.lit(None).cast(f.dataType).alias(f.name)
             for f in REQUEST_SCHEMA.fields]
    return spark.createDataFrame(rows, "RequestID long, UserID long, MovieID long").select(*typed)


def test_replayed_and_repeated_requests_are_answered_once(spark, tmp_out):
    users = spark.createDataFrame([(1,)], "UserID long")
    titles = lambda: spark.read.schema("MovieID long").parquet(f"{tmp_out}/titles")
    crash = []

    def score(batch, u, i):
        if crash:
            raise RuntimeError(crash.pop())
        return batch.select("RequestID", "UserID", "MovieID").join(i.withColumn("known", F.lit(True)), "MovieID", "left")

    def run():
        score_once(spark, f"{tmp_out}/in", score, lambda: users, titles, f"{tmp_out}/out", f"{tmp_out}/ckpt").awaitTermination()

    def land(rows):
        _requests(spark, rows).write.mode("append").json(f"{tmp_out}/in")

    def answers():
        return sorted(((r.RequestID, r.MovieID, r.known) for r in read_scored(spark, f"{tmp_out}/out").collect()), key=str)

    spark.createDataFrame([(10,)], "MovieID long").write.mode("append").parquet(f"{tmp_out}/titles")
    land([(1, 1, 10), (2, 1, 11), (2, 1, 11), (None, 1, 10), (None, 1, 11), (None, 1, 10)])
    run()
    first = [(1, 10, True), (2, 11, None), (None, 10, True), (None, 11, None)]
    assert answers() == sorted(first, key=str)
    spark.createDataFrame([(11,)], "MovieID long").write.mode("append").parquet(f"{tmp_out}/titles")
    land([(1, 1, 10), (2, 1, 11), (3, 1, 11), (None, 1, 10)])
    crash.append("lost")
    with pytest.raises(Exception, match="lost"):
        run()
    run()                                   # the failed batch is scored again, with the title that landed meanwhile
    assert answers() == sorted(first + [(3, 11, True)], key=str)
    run()
    assert answers() == sorted(first + [(3, 11, True)], key=str)
