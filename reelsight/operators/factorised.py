"""L-06 and F-11 over the un-joined tables: no feature vector per rating row.

A rating row's features are those of its title (with the rating's year), of its
user and of the title's text, each scaled to length one.  So the sums the elastic
net needs come from groups:

* per (title, year): number of ratings, sum of labels, and sum of the users' vectors,
  which have a few dozen columns;
* per user profile: number and sum of labels.

The title's vector is built once per title and joined to its groups, all in one
row, where the products are taken: those of the text once per title, not per year.  Rating rows carry ids, year, label and the user's slots.  The
driver receives the matrix of products (features x features, bounded by
``MAX_FEATURES`` like Spark's normal solver) and solves the same problem as
``LinearRegression`` does, to the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsight.functions.lookups import LR_ELASTIC_NET, LR_REG, TF_FEATURES
from reelsight.operators.category_slots import category_slots, encode_slots, slot_counts
from reelsight.operators.features import CATEGORICAL, VECTOR_NAMES
from reelsight.session import checkpoint_dir

MAX_FEATURES = 4096
TITLES_PER_TASK = 2048
_TITLES_AT_ONCE = 256
_TITLE, _USER = ["Genres", "directedBy", "starring"], ["Gender", "Occupation_Name", "Age"]


@dataclass
class Layout:
    """Where each group of features begins; the order of ``content_features``."""
    counts: dict[str, int]
    with_text: bool

    def __post_init__(self):
        n, at, self.begin = self.counts, 0, {}
        for name, size in (("Genres", n["Genres"]), ("Year", 1), ("rating_imdb", 1), ("runtimes", 1),
                           ("directedBy", n["directedBy"]), ("starring", n["starring"]), ("Gender", n["Gender"]),
                           ("Occupation_Name", n["Occupation_Name"]), ("Age", n["Age"]),
                           ("text", TF_FEATURES if self.with_text else 0)):
            self.begin[name] = at
            at += size
        self.size = at


@dataclass
class Dimensions:
    """Titles and users, encoded once each.

    titles: MovieID, index, value (of all but the year, not scaled), squares;
    texts: MovieID, text_index, text_value (scaled), or None;
    users: UserID, index (the slots), weight (of each of them).
    """
    layout: Layout
    titles: DataFrame
    texts: DataFrame | None
    users: DataFrame
    year_mean: float

    def with_texts(self, df: DataFrame) -> DataFrame:
        """``df`` with the text vector of its title; empty where there is none."""
        none = {"text_index": F.array().cast("array<int>"), "text_value": F.array().cast("array<double>")}
        if self.texts is None:
            return df.withColumns(none)
        return df.join(self.texts, "MovieID", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})


def _positions(layout: Layout, cols: list[str]) -> Column:
    slots = [F.col(VECTOR_NAMES[c]) + layout.begin[c] for c in cols]
    return F.filter(F.array(*slots), lambda x: x.isNotNull())


def encode_dimensions(train: DataFrame, titles: DataFrame, users: DataFrame, item_text: DataFrame | None = None,
                      min_share: float | None = None) -> Dimensions:
    """Encode ``titles`` (MovieID, Genres, directedBy, starring, rating_imdb, runtimes) and ``users`` (UserID, Gender,
    Occupation_Name, Age), one row per id.

    Slots and means are those of the rating rows ``train``, as the feature stages fit
    them; missing numbers get the truncated mean.  ``item_text``: (MovieID,
    plot_tfidf).  ``min_share``: see ``category_slots``.
    """
    slots = category_slots(train, CATEGORICAL, min_share).checkpoint()
    layout = Layout(slot_counts(slots), item_text is not None)
    means = train.agg(F.avg(F.year("date_time").cast("double")), F.avg("rating_imdb"), F.avg("runtimes")).first()
    t = encode_slots(titles, slots, {c: VECTOR_NAMES[c] for c in _TITLE})
    numbers = [F.floor(F.coalesce(F.col(c).cast("double"), F.lit(float(int(m or 0))))).cast("double")
               for c, m in (("rating_imdb", means[1]), ("runtimes", means[2]))]
    index = F.concat(_positions(layout, _TITLE), F.array(F.lit(layout.begin["rating_imdb"]), F.lit(layout.begin["runtimes"])))
    value = F.concat(F.transform(_positions(layout, _TITLE), lambda _: F.lit(1.0)), F.array(*numbers))
    t = t.select("MovieID", index.alias("index"), value.alias("value"))
    t = t.withColumn("squares", F.aggregate("value", F.lit(0.0), lambda a, x: a + x * x))
    texts = None
    if item_text is not None:
        # The vector is written first and its length bound once: a function over its numbers would compute both for each.
        v = F.unwrap_udt("plot_tfidf")
        length = F.sqrt(F.aggregate(v["values"], F.lit(0.0), lambda a, x: a + x * x))
        scaled = F.transform(F.array(length), lambda n: F.transform(v["values"], lambda x: F.when(n > 0, x / n).otherwise(x)))
        texts = item_text.select("MovieID", "plot_tfidf").checkpoint().select(
            "MovieID", F.transform(v["indices"], lambda i: i + layout.begin["text"]).alias("text_index"),
            F.get(scaled, F.lit(0)).alias("text_value"))
    u = encode_slots(users, slots, {c: VECTOR_NAMES[c] for c in _USER}).select(
        "UserID", F.array_sort(_positions(layout, _USER)).alias("index"))
    u = u.withColumn("weight", F.when(F.size("index") > 0, 1 / F.sqrt(F.size("index").cast("double"))).otherwise(0.0))
    # one row per title and per user, read by the training and by every prediction
    return Dimensions(layout, t.checkpoint(), texts, u.checkpoint(), float(means[0] or 0.0))


def grouped(ratings: DataFrame, dims: Dimensions, label: str) -> tuple[DataFrame, DataFrame]:
    """The sums per (title, year) and per user profile; rows without title or user in ``dims`` are left out."""
    rows = ratings.select("UserID", "MovieID", F.coalesce(F.year("date_time").cast("double"), F.lit(dims.year_mean)).alias("year"),
                          F.col(label).cast("double").alias("y")).where("y is not null")
    rows = rows.join(dims.titles.select("MovieID"), "MovieID", "left_semi").join(
        dims.users.select("UserID", "index", "weight"), "UserID")
    per_user = rows.groupBy("index", "weight").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"),
                                                   F.sum(F.col("y") * F.col("y")).alias("yy"))
    # Slot -1 counts the rows and their labels.  Two steps: at most a few dozen slots for each (title, year).
    parts = F.concat(F.array(F.lit(-1)), F.col("index"))
    slots = rows.select("MovieID", "year", "y", "weight", F.explode(parts).alias("slot"))
    sums = slots.groupBy("MovieID", "year", "slot").agg(
        F.sum(F.when(F.col("slot") < 0, 1.0).otherwise(F.col("weight"))).alias("w"), F.sum("y").alias("y"))
    per_title = sums.groupBy("MovieID", "year").agg(
        F.max(F.when(F.col("slot") < 0, F.col("w"))).alias("n"), F.max(F.when(F.col("slot") < 0, F.struct("y"))).alias("y"),
        F.sort_array(F.collect_list(F.when(F.col("slot") >= 0, F.struct("slot", "w")))).alias("users"))
    return per_title.withColumn("y", F.col("y.y")), per_user


def _dense(lists: pa.ListArray, values: pa.ListArray, width: int, begin: int = 0) -> np.ndarray:
    """One dense row per list: ``values`` at the positions ``lists`` less ``begin``."""
    out = np.zeros((len(lists), width))
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    out[rows, lists.flatten().to_numpy() - begin] = values.flatten().to_numpy()
    return out


def _sums(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of each of ``n`` titles; ``of``: a row's title, ascending, none left out."""
    return np.add.reduceat(rows, np.searchsorted(of, np.arange(n)), axis=0)


def _products(layout: Layout):
    """Sums of products of features over the task's titles, one row per feature.

    A title's text is the same in all its years: it meets itself once per title,
    and the sums over the years of all other features.  The last two columns of a
    row are the products with the label and with 1.
    """
    year_at, size = layout.begin["Year"], layout.size
    at, end = layout.begin["Gender"], layout.begin["text"]
    title, user, text = slice(0, at), slice(at, end), slice(end, size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 2))

        def add(a: slice, b: slice, products: np.ndarray) -> None:
            total[a, b] += products
            if a != b:
                total[b, a] += products.T

        for batch in batches:
            for begin in range(0, batch.num_rows, _TITLES_AT_ONCE):
                # copied to offsets that begin at 0
                col = batch.slice(begin, _TITLES_AT_ONCE).take(pa.array(range(min(_TITLES_AT_ONCE, batch.num_rows - begin))))
                groups, k = col.column("groups"), col.num_rows
                of = np.repeat(np.arange(k), np.diff(groups.offsets.to_numpy()))
                year, n, y, users = (groups.flatten().field(c) for c in ("year", "n", "y", "users"))
                year, n, y = (x.to_numpy() for x in (year, n, y))
                scale = np.sqrt(col.column("squares").to_numpy()[of] + year**2)
                scale[scale == 0] = 1.0
                own = _dense(col.column("index"), col.column("value"), at)[of]
                own[:, year_at] = year
                own /= scale[:, None]
                pairs = users.flatten()
                who = np.zeros((len(of), end - at))
                who[np.repeat(np.arange(len(of)), np.diff(users.offsets.to_numpy())), pairs.field("slot").to_numpy() - at] = \
                    pairs.field("w").to_numpy()
                words = _dense(col.column("text_index"), col.column("text_value"), size - end, end)
                weighted, rows = own * n[:, None], _sums(n[:, None], of, k)
                add(title, title, own.T @ weighted)
                add(title, user, own.T @ who)
                add(title, text, _sums(weighted, of, k).T @ words)
                add(user, text, _sums(who, of, k).T @ words)
                add(text, text, words.T @ (words * rows))
                total[title, size] += y @ own
                total[title, size + 1] += n @ own
                total[text, size] += _sums(y[:, None], of, k)[:, 0] @ words
                total[text, size + 1] += rows[:, 0] @ words
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([total[i].tobytes() for i in some], pa.binary())],
                                         names=["feature", "row"])
    return run


def _add_rows(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py()) for x in table.column("row")], axis=0)
    return pa.table({"feature": table.column("feature").slice(0, 1), "row": pa.array([total.tobytes()], pa.binary())})


def elastic_net(gram: np.ndarray, xy: np.ndarray, x: np.ndarray, n: float, y: float, yy: float, reg: float, elastic: float,
                tolerance: float = 1e-13, sweeps: int = 20_000) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise Spark's objective, from sums of products.

    Features and label are scaled by their deviation; coordinate descent, first over
    all features, then over the active ones until they stand still, and again.
    """
    mean, y_mean = x / n, y / n
    dev = np.sqrt(np.maximum(np.diag(gram) / n - mean**2, 0))
    y_dev = np.sqrt(max(yy / n - y_mean**2, 0.0))
    coef = np.zeros(len(x))
    live = np.flatnonzero(dev > 1e-12)
    if not len(live) or y_dev == 0:
        return coef, y_mean
    a = (gram[np.ix_(live, live)] / n - np.outer(mean[live], mean[live])) / np.outer(dev[live], dev[live])
    rest = (xy[live] / n - mean[live] * y_mean) / (dev[live] * y_dev)       # the gradient at zero
    l1, l2, b = reg / y_dev * elastic, reg / y_dev * (1 - elastic), np.zeros(len(live))
    every = np.arange(len(live))

    def sweep(some: np.ndarray) -> float:
        most = 0.0
        for j in some.tolist():
            z = rest[j] + a[j, j] * b[j]
            new = np.sign(z) * max(abs(z) - l1, 0.0) / (a[j, j] + l2)
            if new != b[j]:
                np.subtract(rest, a[j] * (new - b[j]), out=rest)
                most = max(most, abs(new - b[j]))
                b[j] = new
        return most

    for _ in range(sweeps):
        if sweep(every) <= tolerance:
            break
        active = np.flatnonzero(b)
        for _ in range(sweeps):
            if sweep(active) <= tolerance:
                break
    coef[live] = b * y_dev / dev[live]
    return coef, float(y_mean - coef @ mean)


@dataclass
class FactorisedModel:
    """A linear model over the tables of ``dims``."""
    dims: Dimensions
    coefficients: np.ndarray
    intercept: float

    def predict(self, ratings: DataFrame, out: str = "lr_prediction") -> DataFrame:
        """L-07: ``ratings`` with the prediction: one number per title, per text and per user, joined by id.

        Rows whose title or user is in neither table keep a NULL prediction.
        """
        spark, dims = ratings.sparkSession, self.dims
        weights = spark.createDataFrame([(self.coefficients.tolist(),)], "w array<double>").select("w").scalar()

        def product(index: str, value: Column) -> Column:
            return F.aggregate(F.zip_with(F.col(index), value, lambda i, v: F.get(F.col("_w"), i) * v), F.lit(0.0),
                               lambda a, x: a + x)

        t = dims.with_texts(dims.titles).withColumn("_w", weights).select(
            "MovieID", product("index", F.col("value")).alias("_title"), F.col("squares").alias("_squares"),
            product("text_index", F.col("text_value")).alias("_text"))
        u = dims.users.withColumn("_w", weights).select("UserID", product(
            "index", F.transform("index", lambda _: F.col("weight"))).alias("_user"))
        year = F.coalesce(F.year("date_time").cast("double"), F.lit(dims.year_mean))
        at = float(self.coefficients[dims.layout.begin["Year"]])
        length = F.sqrt(F.col("_squares") + year * year)
        title = F.when(length > 0, (F.col("_title") + at * year) / length).otherwise(0.0)
        return ratings.join(t, "MovieID", "left").join(u, "UserID", "left").withColumn(
            out, title + F.col("_text") + F.col("_user") + self.intercept).select(*ratings.columns, out)


def train_factorised(train: DataFrame, titles: DataFrame, users: DataFrame, item_text: DataFrame | None = None,
                     label: str = "NormUserRating", reg: float = LR_REG, elastic: float = LR_ELASTIC_NET,
                     min_share: float | None = None) -> FactorisedModel:
    """L-06: the elastic net on ``content_features`` without making them.

    Arguments as for ``encode_dimensions``.  More than ``MAX_FEATURES`` features
    are refused; ``min_share`` bounds them.  An empty ``train`` predicts 0.
    """
    checkpoint_dir(train.sparkSession)
    dims = encode_dimensions(train, titles, users, item_text, min_share)
    size = dims.layout.size
    if size > MAX_FEATURES:
        raise ValueError(f"{size} features; the matrix of products is kept to {MAX_FEATURES}: raise min_share")
    per_title, per_user = grouped(train, dims, label)
    per_title = per_title.groupBy("MovieID").agg(F.collect_list(F.struct("year", "n", "y", "users")).alias("groups")).checkpoint()
    # A task sends one matrix, however many titles it had: as many tasks as run at once, but no more than its work is worth.
    tasks = min(max(1, -(-per_title.count() // TITLES_PER_TASK)), train.sparkSession.sparkContext.defaultParallelism)
    met = dims.with_texts(per_title.repartition(tasks, "MovieID").join(dims.titles, "MovieID"))
    rows = met.mapInArrow(_products(dims.layout), "feature int, row binary").groupBy(
        "feature").applyInArrow(_add_rows, "feature int, row binary").collect()         # at most MAX_FEATURES rows
    total = np.zeros((size, size + 2))
    for r in rows:
        total[r.feature] = np.frombuffer(r.row)
    n = y = yy = 0.0
    for r in per_user.collect():            # one row per user profile: gender x occupation x age
        n, y, yy = n + r.n, y + r.y, yy + r.yy
        at = np.array(r["index"], np.int64)
        total[np.ix_(at, at)] += r.n * r.weight**2
        total[at, size] += r.y * r.weight
        total[at, size + 1] += r.n * r.weight
    if not n:
        return FactorisedModel(dims, np.zeros(size), 0.0)
    return FactorisedModel(dims, *elastic_net(total[:, :size], total[:, size], total[:, size + 1], n, y, yy, reg, elastic))
