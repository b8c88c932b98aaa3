"""Category slots by joins, and the content model over un-joined tables."""

import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from reelsight.operators.category_slots import category_slots, encode_slots, frequent_values
from reelsight.operators.factorised import elastic_net, train_factorised
from reelsight.operators.features import CATEGORICAL, VECTOR_NAMES, prepare_features
from tests.test_models import _feature_rows


def test_slots_are_those_of_the_string_indexer(spark):
    df, _ = _feature_rows(spark)
    df = df.withColumn("directedBy", F.when(F.col("MovieID") != 4, F.col("directedBy")))
    _, fm = prepare_features(df, with_text=False)
    labels = next(s for s in fm.row_model.stages if isinstance(s, StringIndexerModel)).labelsArray
    got = {}
    for r in category_slots(df).collect():
        got.setdefault(r["column"], {})[r.value] = r.slot
    assert got == {c: {v: i for i, v in enumerate(own)} for c, own in zip(CATEGORICAL, labels)}


def test_frequent_values_are_exact_and_bounded(spark):
    rng = np.random.default_rng(3)
    values = ["hot"] * 3000 + [f"v{k}" for k in rng.zipf(1.3, 6000) % 4000] + [f"once{k}" for k in range(4000)]
    df = spark.createDataFrame([(v,) for v in rng.permutation(values).tolist()] + [(None,)], "x string").repartition(6)
    unique, n = np.unique(values, return_counts=True)
    for share in (0.2, 0.01, 0.001):
        want = {v: int(c) for v, c in zip(unique, n) if c >= share * len(values)}
        assert {r.value: r.n for r in frequent_values(df, "x", share).collect()} == want
        slots = category_slots(df, ["x"], share).orderBy("slot").collect()
        assert [r.value for r in slots] == sorted(want, key=lambda v: (-want[v], v))
        assert [r.slot for r in slots] == list(range(len(want)))
    coded = encode_slots(df, category_slots(df, ["x"], 0.2), {"x": "at"}).groupBy("at").count().collect()
    assert {r["at"]: r["count"] for r in coded} == {0: 3000, None: len(values) - 3000 + 1}
    assert category_slots(df.where("false"), ["x"], 0.1).count() == 0


def _materialised(spark, with_text):
    df, items = _feature_rows(spark)
    df = df.withColumns({
        "date_time": (F.lit("2018-01-01").cast("timestamp_ntz") + F.make_ym_interval(F.col("UserID") % 4, F.lit(0))),
        "Gender": F.when(F.col("UserID") != 5, F.col("Gender")),
        "NormUserRating": F.col("NormUserRating") + F.when(F.col("Gender") == "F", 0.3).otherwise(0.0) + 0.1 * (F.col("MovieID") % 3)})
    df = df.unionByName(df.where("UserID = 2"))
    train = df.where("(UserID + 2 * MovieID) % 5 <> 0")
    feats, fm = prepare_features(df, train=train, items=items if with_text else None, with_text=with_text)
    return df, train, feats, fm


@pytest.mark.parametrize("with_text", [True, False])
@pytest.mark.parametrize("reg, elastic", [(0.1, 0.8), (0.01, 0.5), (0.003, 0.0)])
def test_equals_linear_regression_on_vectors(spark, with_text, reg, elastic):
    df, train, feats, fm = _materialised(spark, with_text)
    want = LinearRegression(featuresCol="content_features", labelCol="NormUserRating", regParam=reg, elasticNetParam=elastic,
                            maxIter=5000, tol=1e-14, solver="normal").fit(feats.where("(UserID + 2 * MovieID) % 5 <> 0"))
    titles = df.select("MovieID", "Genres", "directedBy", "starring", "rating_imdb", "runtimes").dropDuplicates(["MovieID"])
    users = df.select("UserID", "Gender", "Occupation_Name", "Age").dropDuplicates(["UserID"])
    model = train_factorised(train, titles, users, fm.item_text, reg=reg, elastic=elastic)
    assert model.dims.layout.size == len(want.coefficients)
    predicted = {}
    for r in want.transform(feats).collect():
        predicted[r.UserID, r.MovieID] = r.prediction
    got = {(r.UserID, r.MovieID): r.lr_prediction for r in model.predict(df).collect()}
    assert got.keys() == predicted.keys()
    assert max(abs(got[k] - predicted[k]) for k in got) < 1e-6
    if reg == 0.1:      # of nearly constant features coefficients are large, so errors are relative; weaker penalties
        coef = want.coefficients.toArray()      # leave directions in which they hardly matter
        assert np.abs(model.coefficients - coef).max() < 1e-6 * max(1, np.abs(coef).max())
        assert ((model.coefficients != 0) == (coef != 0)).all()


def test_no_vector_per_rating_row(spark):
    from reelsight.operators.factorised import encode_dimensions, grouped
    df, train, _, fm = _materialised(spark, True)
    titles = df.select("MovieID", "Genres", "directedBy", "starring", "rating_imdb", "runtimes").dropDuplicates(["MovieID"])
    users = df.select("UserID", "Gender", "Occupation_Name", "Age").dropDuplicates(["UserID"])
    dims = encode_dimensions(train, titles, users, fm.item_text)
    per_title, per_user = grouped(train, dims, "NormUserRating")
    assert per_title.count() == train.select("MovieID", F.year("date_time")).distinct().count()
    assert per_title.agg(F.sum("n")).first()[0] == train.count() == per_user.agg(F.sum("n")).first()[0]
    plan = per_title._jdf.queryExecution().optimizedPlan().toString()
    assert "text_value" not in plan and "plot_tfidf" not in plan and "content_features" not in plan


def test_empty_and_constant_input(spark):
    df, train, _, _ = _materialised(spark, False)
    titles = df.select("MovieID", "Genres", "directedBy", "starring", "rating_imdb", "runtimes").dropDuplicates(["MovieID"])
    users = df.select("UserID", "Gender", "Occupation_Name", "Age").dropDuplicates(["UserID"])
    none = train_factorised(train.where("false"), titles, users)
    assert [r.lr_prediction for r in none.predict(df.limit(3)).collect()] == [0.0] * 3
    flat = train_factorised(train.withColumn("NormUserRating", F.lit(0.25)), titles, users)
    assert all(abs(r.lr_prediction - 0.25) < 1e-12 for r in flat.predict(df.limit(3)).collect())
    unknown = spark.createDataFrame([(1, 99)], "UserID int, MovieID int").withColumn("date_time", F.lit(None).cast("timestamp_ntz"))
    assert flat.predict(unknown).first().lr_prediction is None


def test_elastic_net_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 12)) * rng.uniform(0.1, 5, 12) + rng.normal(size=12)
    x[:, 3] = 2.0                                   # a constant feature
    x[:, 5] = x[:, 4]                               # and two equal ones
    y = x[:, 0] - 2 * x[:, 1] + rng.normal(size=300)
    coef, intercept = elastic_net(x.T @ x, x.T @ y, x.sum(0), 300, y.sum(), y @ y, 0.2, 0.7)
    dev, s = x.std(0), y.std()
    rest = y - x @ coef - intercept
    assert abs(rest.mean()) < 1e-9 and coef[3] == 0
    for j in range(12):
        if dev[j]:
            slope = (x[:, j] - x[:, j].mean()) @ rest / 300 / dev[j] - 0.2 * 0.3 / s * coef[j] * dev[j]
            assert abs(slope - 0.2 * 0.7 * np.sign(coef[j])) < 1e-8 if coef[j] else abs(slope) <= 0.2 * 0.7 + 1e-8


def test_a_title_with_several_years_meets_its_text_once():
    """The products of a task equal those of plain feature rows, whichever years the title has."""
    import pyarrow as pa
    from reelsight.operators.factorised import Layout, _products
    counts = {"Genres": 2, "directedBy": 1, "starring": 1, "Gender": 2, "Occupation_Name": 1, "Age": 1}
    layout = Layout(counts, True)
    at, text = layout.begin["Gender"], layout.begin["text"]
    titles = [{"groups": [{"year": 1995.0, "n": 2.0, "y": 7.0, "users": [{"slot": at, "w": 1.5}]},
                          {"year": 1996.0, "n": 1.0, "y": 3.0, "users": [{"slot": at + 1, "w": 0.5}, {"slot": at + 3, "w": 0.5}]}],
               "index": [1, layout.begin["runtimes"]], "value": [1.0, 90.0], "squares": 8101.0,
               "text_index": [text + 2, text + 9], "text_value": [0.6, 0.8]},
              {"groups": [{"year": 0.0, "n": 3.0, "y": 6.0, "users": []}], "index": [], "value": [], "squares": 0.0,
               "text_index": [], "text_value": []}]
    shape = pa.schema([("groups", pa.list_(pa.struct([("year", pa.float64()), ("n", pa.float64()), ("y", pa.float64()), (
        "users", pa.list_(pa.struct([("slot", pa.int32()), ("w", pa.float64())])))]))), ("index", pa.list_(pa.int32())),
        ("value", pa.list_(pa.float64())), ("squares", pa.float64()), ("text_index", pa.list_(pa.int32())),
        ("text_value", pa.list_(pa.float64()))])
    batch = pa.RecordBatch.from_pylist(titles[1:] + titles, schema=shape).slice(1)
    want = np.zeros((layout.size, layout.size + 2))
    for t in titles:
        for g in t["groups"]:
            x, u = np.zeros(layout.size), np.zeros(layout.size)
            scale = np.sqrt(t["squares"] + g["year"] ** 2) or 1.0
            x[t["index"]] = np.array(t["value"]) / scale
            x[layout.begin["Year"]] = g["year"] / scale
            x[t["text_index"]] = t["text_value"]
            u[[s["slot"] for s in g["users"]]] = [s["w"] for s in g["users"]]
            want[:, :-2] += g["n"] * np.outer(x, x) + np.outer(x, u) + np.outer(u, x)
            want[:, -2] += g["y"] * x
            want[:, -1] += g["n"] * x
    got = np.zeros_like(want)
    for out in _products(layout)([batch]):
        for i, row in zip(out.column("feature").to_pylist(), out.column("row").to_pylist()):
            got[i] = np.frombuffer(row)
    assert np.allclose(got, want)


def test_a_text_s_length_is_taken_once_not_for_each_of_its_numbers(spark, monkeypatch):
    """No function over a text vector's numbers sums up the vector again, or holds the stages that make it."""
    from pyspark.sql.classic.dataframe import DataFrame

    from reelsight.operators.factorised import encode_dimensions
    from reelsight.operators.features import fit_text_model, item_text_features
    df, train, _, _ = _materialised(spark, False)
    items = spark.createDataFrame([(m, f"Word{m} other word{m % 3} plain") for m in range(5)] + [(7, None)], "MovieID int, plot_outline string")
    text = item_text_features(fit_text_model(items), items)
    written, checkpoint = [], DataFrame.checkpoint

    def seen(self, *args):
        written.append(self._jdf.queryExecution().optimizedPlan().toString())
        return checkpoint(self, *args)
    monkeypatch.setattr(DataFrame, "checkpoint", seen)
    titles = df.select("MovieID", "Genres", "directedBy", "starring", "rating_imdb", "runtimes").dropDuplicates(["MovieID"])
    users = df.select("UserID", "Gender", "Occupation_Name", "Age").dropDuplicates(["UserID"])
    dims = encode_dimensions(train, titles, users, text)
    plans = [*written, dims.texts._jdf.queryExecution().optimizedPlan().toString()]
    assert any("plot_tfidf" in x for x in plans)
    made = [line for x in plans for line in x.splitlines() if "AS text_value" in line]
    assert made and not any("UDF(" in line or " / SQRT(" in line.upper() for line in made)
    want = {r.MovieID: r.plot_tfidf for r in text.collect()}
    for r in dims.texts.collect():
        v = want.pop(r.MovieID)
        assert [i - dims.layout.begin["text"] for i in r.text_index] == v.indices.tolist()
        length = float(v.norm(2)) or 1.0
        assert r.text_value == pytest.approx([x / length for x in v.values])
    assert not want
