"""Physical-plan properties that matter at scale, checked on the executed plans."""

import re

import pytest

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    import __spark_entry__ as e
    return e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def _sql_names():
    import __spark_entry__ as e
    return sorted(e.oracle_sql())


@pytest.mark.parametrize("name", _sql_names())
def test_no_all_pairs_joins_or_python_rows(spark, name):
    plan = _plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


@pytest.mark.parametrize("name", ["content_features", "score_requests", "recommend_all", "recommend_user",
                                  "hybrid_sweep", "wide_ratings"])
def test_no_all_pairs_joins_without_broadcast(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_wide_table_never_shuffles_on_text(spark):
    """Ratings are exchanged on MovieID and UserID; title text and external ids move titles only."""
    from reelsight.operators.joins import build_wide_ratings
    from reelsight.plans.standin import raw_details, raw_metadata, raw_titles, raw_users
    ratings = spark.range(10).selectExpr("id AS UserID", "id AS MovieID", "1 AS Rating", "id AS Timestamp")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = build_wide_ratings(ratings, raw_titles(spark, SF), raw_users(spark, SF), raw_metadata(spark, SF),
                                  raw_details(spark, SF))
        lines = wide._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = [len(re.match(r"[\s:|+-]*", x)[0]) for x in lines]
    at = next(i for i, x in enumerate(lines) if "Range (" in x)
    above, limit = [], depth[at]
    for i in range(at, -1, -1):           # the operators from the ratings scan up to the root
        if depth[i] < limit or i == at:
            above.append(lines[i])
            limit = depth[i]
    keys = [re.search(r"hashpartitioning\((\w+)#", x)[1] for x in above if "hashpartitioning" in x]
    assert sorted(keys) == ["MovieID", "UserID"]


def _above(plan: str, mark: str) -> list[str]:
    """The lines of ``plan`` from the first with ``mark`` up to the root."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[\s:|+-]*", x)[0]) for x in lines]
    at = next(i for i, x in enumerate(lines) if mark in x)
    above, limit = [lines[at]], depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < limit:
            above.append(lines[i])
            limit = depth[i]
    return above


def test_titles_join_the_wide_table_last(spark):
    """Ratings meet their users first, so no title text is shuffled with them, and no join carries a plot."""
    import __spark_entry__ as e
    plan = e.queries()["wide_ratings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    scan = next(x for x in plan.splitlines() if "Relation" in x and "l_orderkey" in x)
    joins = [re.search(r"Join Inner, .*?\((\w+)#", x)[1] for x in _above(plan, scan) if "Join" in x]
    assert joins == ["l_orderkey", "UserID", "MovieID"]
    texts = _above(plan, "length(text")
    assert not any("Join" in x for x in texts[:1]) and "Join" in "".join(texts[1:])


def test_wide_table_joins_users_to_orders(spark):
    from reelsight.plans.standin import ratings_standin
    plan = ratings_standin(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    scan = next(x for x in plan.splitlines() if "Relation" in x and "c_custkey" in x)
    joins = [re.search(r"Join Inner, .*?\((\w+)#", x)[1] for x in _above(plan, scan) if "Join" in x]
    assert joins == ["UserID", "l_orderkey", "MovieID"]


def test_labelled_rows_do_not_build_the_wide_table(spark):
    from reelsight.plans import eda_queries, model_queries
    sf = f"{SF}/."      # a path of its own, as tables are kept per path
    model_queries.q_weight_sweep(spark, sf).collect()
    assert not [k for k in eda_queries._WIDE if k[1] == sf]
    written = [k for k in model_queries._LABELLED if k[1] == sf]
    assert len(written) == 1
    got = model_queries._LABELLED[written[0]]
    want = model_queries.rated(spark, SF).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_landed_requests_are_compressed(spark):
    import glob
    from reelsight.plans.serving_queries import q_answered_once
    from reelsight.session import checkpoint_dir
    where = f"{checkpoint_dir(spark).removeprefix('file:')}/answered-once-*/source/*.json*"
    before = set(glob.glob(where))
    q_answered_once(spark, SF)
    landed = set(glob.glob(where)) - before
    assert landed and all(f.endswith(".gz") for f in landed)


def test_ids_beyond_an_int(spark):
    from reelsight.operators.joins import join_titles
    from reelsight.plans.standin import raw_ratings, requests
    from reelsight.schemas import RATINGS_TEXT, TITLES_TEXT
    big = 2 ** 31 + 5
    r = spark.createDataFrame([(big, big, 3, 0)], RATINGS_TEXT)
    t = spark.createDataFrame([(big, "a", "b")], TITLES_TEXT)
    assert join_titles(r, t).first().MovieID == big
    for df in (raw_ratings(spark, SF), requests(spark, SF)):
        assert dict(df.dtypes)["UserID"] == dict(df.dtypes)["MovieID"] == "bigint"


def test_dates_do_not_depend_on_the_session_zone(spark):
    import __spark_entry__ as e
    q = e.queries()["calendar_parts"]
    want = sorted(map(tuple, q(spark, SF).collect()))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert sorted(map(tuple, q(spark, SF).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_content_model_learns_the_planted_signal(spark):
    from reelsight.plans.model_queries import q_linear_holdout, q_score_requests, trained
    t = trained(spark, SF)
    assert (t["lr"].coefficients.toArray() != 0).sum() > 0
    mean = t["train"].agg({"UserRating": "avg"}).first()[0]
    spread = t["test"].selectExpr(f"sqrt(avg(pow(UserRating - {mean}, 2)))").first()[0]
    assert q_linear_holdout(spark, SF).first().rmse < 0.95 * spread
    assert q_score_requests(spark, SF).select("lr_prediction").distinct().count() > 10


@pytest.mark.parametrize("name", ["watched_items", "top_genres_per_occupation"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    plan = _plan(spark, name)
    partial = plan.find("WindowGroupLimit")
    assert "Partial" in plan and partial >= 0
    # the partial limit sits below (after, in the text) the exchange that feeds the final window
    final_idx = plan.find("Final")
    assert plan.find("Exchange", final_idx) < plan.rfind("Partial")


def test_latest_per_pair_is_an_aggregate_not_a_window(spark):
    plan = _plan(spark, "latest_pairs")
    assert "Window" not in plan and "Aggregate" in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(spark, "top_occupations")          # reads the prebuilt wide table
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("Title" not in s and "Genres" not in s for s in schemas)
    plan = _plan(spark, "join_titles")              # reads the driver's tables
    li = [s for s in re.findall(r"ReadSchema: (struct<[^>]*>)", plan) if "l_orderkey" in s]
    assert li and all("l_extendedprice" not in s and "l_returnflag" not in s for s in li)


def test_global_statistics_are_scalar_subqueries(spark):
    plan = _plan(spark, "minmax_ratings")
    assert "Subquery" in plan or "subquery" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_plot_text_is_used(spark):
    """The distinct plots grow with the documents: no fixed number of texts."""
    from reelsight.plans.standin import items_standin
    for sf in ("sf0.001", "sf0.01"):
        sf_dir = f"/root/testdata/{sf}"
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        keys = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
            f"p_partkey % {docs.count()} AS doc_id").where("p_partkey % 31 <> 0").distinct()
        want = docs.join(keys, "doc_id").select("text").distinct().count()
        assert items_standin(spark, sf_dir).select("plot_outline").dropna().distinct().count() == want
    assert want > 200
