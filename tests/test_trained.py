"""Fitted models on rows built here: made on demand, and no content vector per rating row is stored."""

import datetime

import pytest

from reelsight.plans import model_queries as mq


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("rows"))
    day = datetime.datetime(1995, 1, 1)
    tables = {
        "customer": ([(c, c % 5, 500.0 * c) for c in range(12)], "c_custkey long, c_nationkey int, c_acctbal double"),
        "part": ([(p, f"{'red' if p % 2 else 'blue'} rod", f"b{p % 3}", f"t{p % 2}", p) for p in range(20)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "orders": ([(o, o % 12) for o in range(60)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(i % 60, (i * 7) % 20, float(i % 50 + 1), day + datetime.timedelta(days=97 * (i % 30)))
                      for i in range(400)],
                     "l_orderkey long, l_partkey long, l_quantity double, l_shipdate timestamp_ntz"),
        "documents": ([(d, f"Word{d} other word{d % 3} plain") for d in range(7)], "doc_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{base}/{name}.parquet")
    return f"file://{base}"


def test_a_query_pays_for_the_parts_it_reads(spark, sf):
    t = mq.trained(spark, sf)
    assert mq.q_als_holdout_pairs(spark, sf).count() > 0
    assert "als" in t and not any(x in t for x in ("feature_model", "features", "lr"))
    assert mq.q_one_hot_slots(spark, sf).count() == 400
    assert "feature_model" in t and "lr" not in t


def test_no_rating_row_is_stored_for_the_models(spark, sf):
    t = mq.trained(spark, sf)
    mq.q_content_features(spark, sf).count()
    mq.q_linear_holdout(spark, sf).collect()
    assert "lr" in t
    assert not t["df"].is_cached and not t["features"].is_cached
    plan = t["features"]._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "InMemoryRelation" in x]
    assert all("plot_tfidf" in x for x in scans)     # only the titles' texts


def test_text_stages_run_on_titles_alone(spark, sf):
    t = mq.trained(spark, sf)
    plan = t["features"]._jdf.queryExecution().optimizedPlan().toString()
    top = plan[:plan.index("Join")]
    assert "plot_tfidf" not in top and "movie_features#" not in top
    whole = t["feature_model"].row_model.transform(
        t["df"].join(t["feature_model"].item_text, "MovieID"))      # every stage on every row
    keys = ["UserID", "MovieID", "date_time", "UserRating"]

    def vectors(df):
        return sorted((*[r[k] for k in keys], tuple(r.content_features.toArray().round(12))) for r in
                      df.select(*keys, "content_features").collect())
    from reelsight.operators.features import feature_input
    assert vectors(feature_input(t["features"])) == vectors(whole)


def test_shares_are_computed_once_for_fit_and_projection(spark, sf):
    from reelsight.operators.recommend import genre_coordinates
    from reelsight.plans.eda_queries import clean
    c = genre_coordinates(clean(spark, sf), ["red", "blue", "rod"], 2)
    assert c.count() == 12
    assert "Aggregate" not in c._jdf.queryExecution().optimizedPlan().toString()


def test_details_land_compressed(spark, sf):
    from reelsight.plans.source_queries import q_landed_details
    details = q_landed_details(spark, sf)
    assert details.count() == 20
    files = details.inputFiles()
    assert files and all(f.endswith(".json.gz") for f in files)


def _joined(plan):
    """The schemas, as JSON, of what the plan's joins read."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [c.schema().json() for c in children] if plan.nodeName() == "Join" else []
    return own + [x for c in children for x in _joined(c)]


def test_scores_meet_a_title_s_text_as_one_number(spark, sf):
    from pyspark.sql import functions as F

    from reelsight.operators.hybrid import score_requests
    from reelsight.operators.models import predict_linear
    from reelsight.plans.standin import serving_items, serving_users
    from reelsight.schemas import REQUEST_SCHEMA
    t = mq.trained(spark, sf)
    df = t["df"].unionByName(t["df"].limit(1).withColumn("MovieID", F.lit(999).cast("long")))
    keys = ["UserID", "MovieID", "date_time", "UserRating"]

    def scores(scored):
        return sorted((*[r[k] for k in keys], r.lr_prediction) for r in scored.select(*keys, "lr_prediction").collect())
    want = scores(predict_linear(t["lr"], t["feature_model"].transform(df)))
    got = scores(predict_linear(t["lr"], df, features=t["feature_model"]))
    assert len(got) == 401 and [x[:-1] for x in got] == [x[:-1] for x in want]
    assert max(abs(a[-1] - b[-1]) for a, b in zip(got, want)) < 1e-12
    assert t["feature_model"].text_scores(t["lr"]).where("_text_score <> 0").count() > 0

    asked = spark.createDataFrame([(i, i % 14, i, *[None] * 7) for i in range(25)], REQUEST_SCHEMA)
    scored = score_requests(asked, t["als"], t["lr"], t["feature_model"], serving_users(spark, sf), serving_items(spark, sf),
                            method=t["method"])
    assert {r.RequestID for r in scored.collect()} == set(range(25))
    for result in (scored, mq.model_predictions(spark, sf)):
        met = _joined(result._jdf.queryExecution().optimizedPlan())
        assert met and not any("VectorUDT" in x for x in met)
