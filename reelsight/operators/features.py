"""Content features with Spark ML (F-01 .. F-11).

The whole feature path is one ``Pipeline`` so that the fitted
``PipelineModel`` can be saved and requests pass through exactly the same
stages as training rows (mean fills, category indices, text weights,
assembly, normalisation).  Fitting runs on the training split only.

Stage order:
  SQLTransformer  rating year, plot text with NULL -> ''      (X-03, C-05)
  Imputer         NULL -> training mean, int columns truncated (C-06)
  StringIndexer   frequency-desc index, unseen -> extra index (F-01)
  OneHotEncoder   sparse one-hot, last slot dropped           (F-02)
  Tokenizer, StopWordsRemover, HashingTF(1500), IDF           (F-03 .. F-06)
  VectorAssembler x3  item / user / text groups               (F-09)
  Normalizer x3 + VectorAssembler  content_features           (F-10)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (IDF, HashingTF, Imputer, Normalizer, OneHotEncoder, SQLTransformer,
                                StopWordsRemover, StringIndexer, Tokenizer, VectorAssembler)
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsight.functions.lookups import TF_FEATURES
from reelsight.operators.ordering import global_positions

# Feature column names.
CATEGORICAL = ["Genres", "Occupation_Name", "Gender", "directedBy", "starring", "Age"]
INDEX_NAMES = {"Genres": "GenresIndex", "Occupation_Name": "OccupationIndex", "Gender": "GenderIndex",
               "directedBy": "DirectorIndex", "starring": "StarringIndex", "Age": "AgeIndex"}
VECTOR_NAMES = {"Genres": "GenresVec", "Occupation_Name": "OccupationVec", "Gender": "GenderVec",
                "directedBy": "DirectorVec", "starring": "StarringVec", "Age": "AgeVec"}
NUMERIC = ["Year", "rating_imdb", "runtimes"]


def index_categories(cols: Sequence[str] = CATEGORICAL) -> StringIndexer:
    """F-01: frequency-descending indices (ties alphabetical); unseen/NULL -> index n."""
    cols = list(cols)
    return StringIndexer(inputCols=cols, outputCols=[INDEX_NAMES.get(c, f"{c}Index") for c in cols],
                         handleInvalid="keep", stringOrderType="frequencyDesc")


def one_hot(cols: Sequence[str] = CATEGORICAL) -> OneHotEncoder:
    """F-02: index -> sparse one-hot vector, the extra 'unseen' slot dropped (all zeros)."""
    cols = list(cols)
    return OneHotEncoder(inputCols=[INDEX_NAMES.get(c, f"{c}Index") for c in cols],
                         outputCols=[VECTOR_NAMES.get(c, f"{c}Vec") for c in cols], dropLast=True)


def text_stages(text_col: str = "plot_text", num_features: int = TF_FEATURES) -> list:
    """F-03 .. F-06: tokens (lower-case, single-whitespace split), stop words out, hashed TF, IDF.

    A NULL plot becomes '' first (C-05): the tokenizer fails on NULL.
    """
    return [
        SQLTransformer(statement=f"SELECT *, coalesce(plot_outline, '') AS {text_col} FROM __THIS__"),
        Tokenizer(inputCol=text_col, outputCol="plot_tokens"),
        StopWordsRemover(inputCol="plot_tokens", outputCol="plot_filtered"),
        HashingTF(inputCol="plot_filtered", outputCol="plot_tf", numFeatures=num_features),
        IDF(inputCol="plot_tf", outputCol="plot_tfidf"),
    ]


PREPARE_SQL = """
SELECT *, CAST(year(date_time) AS DOUBLE) AS Year_d,
       CAST(rating_imdb AS DOUBLE) AS rating_imdb_d, CAST(runtimes AS DOUBLE) AS runtimes_d
FROM __THIS__
"""


# Columns the feature stages read, with their types; missing ones are added as NULL.
FEATURE_INPUTS = {"date_time": "timestamp_ntz", "rating_imdb": "int",
                  "runtimes": "int", "Genres": "string", "Occupation_Name": "string", "Gender": "string",
                  "directedBy": "string", "starring": "string", "Age": "int"}


def feature_input(df: DataFrame) -> DataFrame:
    """Add any feature input column the frame lacks (as NULL), e.g. ``date_time`` on
    requests, so one fitted model serves both.  The year feature is the year of the
    rating; a request has none and gets the training mean (its ``Year`` is the title's)."""
    missing = {c: F.lit(None).cast(t) for c, t in FEATURE_INPUTS.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def assemble_groups(include_item_id: bool = False, categorical: Sequence[str] = CATEGORICAL,
                    with_text: bool = True) -> list:
    """F-09: item, user and text vectors (rows with invalid values are skipped)."""
    item = (["MovieID"] if include_item_id else []) + [VECTOR_NAMES["Genres"], "Year_f", "rating_imdb_f",
                                                       "runtimes_f"]
    item += [VECTOR_NAMES[c] for c in ("directedBy", "starring") if c in categorical]
    user = [VECTOR_NAMES[c] for c in ("Gender", "Occupation_Name", "Age") if c in categorical]
    stages = [VectorAssembler(inputCols=item, outputCol="movie_features", handleInvalid="skip"),
              VectorAssembler(inputCols=user, outputCol="user_features", handleInvalid="skip")]
    if with_text:
        stages.append(VectorAssembler(inputCols=["plot_tfidf"], outputCol="text_features", handleInvalid="skip"))
    return stages


def normalize_and_combine(with_text: bool = True) -> list:
    """F-10: L2-normalise each group (a zero vector stays zero), concatenate to content_features."""
    groups = ["movie_features", "user_features"] + (["text_features"] if with_text else [])
    stages = [Normalizer(inputCol=g, outputCol=f"{g}_norm", p=2.0) for g in groups]
    stages.append(VectorAssembler(inputCols=[f"{g}_norm" for g in groups], outputCol="content_features",
                                  handleInvalid="skip"))
    return stages


def build_feature_stages(include_item_id: bool = False, with_text: bool = True,
                         categorical: Sequence[str] = CATEGORICAL) -> Pipeline:
    """F-08: the row-level feature stages as one unfitted ``Pipeline``.

    With ``with_text`` the rows must already carry ``plot_tfidf`` (see
    ``FeatureModel``: text weights are fitted per item, not per rating row).
    """
    stages: list = [SQLTransformer(statement=PREPARE_SQL),
                    Imputer(inputCols=["Year_d", "rating_imdb_d", "runtimes_d"],
                            outputCols=["Year_f", "rating_imdb_f0", "runtimes_f0"], strategy="mean"),
                    # the reference fills an int column with the truncated mean
                    SQLTransformer(statement="SELECT *, CAST(CAST(rating_imdb_f0 AS INT) AS DOUBLE) AS rating_imdb_f, "
                                             "CAST(CAST(runtimes_f0 AS INT) AS DOUBLE) AS runtimes_f "
                                             "FROM __THIS__"),
                    index_categories(categorical), one_hot(categorical)]
    stages += assemble_groups(include_item_id, categorical, with_text)
    stages += normalize_and_combine(with_text)
    return Pipeline(stages=stages)


def fit_text_model(items: DataFrame) -> PipelineModel:
    """F-03 .. F-06 fitted on one row per item (MovieID, plot_outline).

    Each title's plot is one document, so the IDF counts titles, and the
    plot text is tokenised once per title instead of once per rating row.
    """
    return Pipeline(stages=text_stages()).fit(items)


def item_text_features(text_model: PipelineModel, items: DataFrame) -> DataFrame:
    """(MovieID, plot_tfidf) for the given items."""
    return text_model.transform(items).select("MovieID", "plot_tfidf")


def with_zero_text(df: DataFrame, out: str = "_zero_text") -> DataFrame:
    """Add a sparse all-zero text vector (size ``TF_FEATURES``) as column ``out``.

    Built JVM-side by hashing an empty token list, so a title without text
    costs a few bytes, not a dense 1500-element vector.
    """
    empty = df.withColumn("_no_tokens", F.array().cast("array<string>"))
    return HashingTF(inputCol="_no_tokens", outputCol=out, numFeatures=TF_FEATURES).transform(empty) \
        .drop("_no_tokens")


#: Outputs of the row stages that read the title's text alone.
_TEXT_OUTPUTS = {"text_features", "text_features_norm"}


class FeatureModel:
    """F-11's fitted model: per-item text weights + the row-level ``PipelineModel``.

    ``transform`` runs the row stages and joins the item text vectors (unknown
    item or no plot -> zero vector), for training rows and requests alike.  ``save``/``load`` keep both parts (S-10).
    """

    def __init__(self, text_model: PipelineModel | None, row_model: PipelineModel, item_text: DataFrame | None):
        self.text_model = text_model
        self.row_model = row_model
        self.item_text = item_text
        self._text_scores: dict[tuple, DataFrame] = {}

    def transform(self, df: DataFrame) -> DataFrame:
        if self.item_text is None:
            return self.row_model.transform(feature_input(df))
        rows, titles, combine = self._before_the_last_stage(df)
        texts = [c for c in titles.columns if c != "MovieID"]
        rows = rows.join(titles, "MovieID", "left").withColumns({
            c: F.coalesce(F.col(c), F.col("_zero_text")).alias(c, metadata=titles.schema[c].metadata) for c in texts})
        return combine.transform(rows.drop("_zero_text"))

    def predict(self, lr: LinearRegressionModel, df: DataFrame) -> DataFrame:
        """The rows of ``transform`` with ``lr``'s prediction, though no row meets its title's text vector.

        The prediction is a sum over the groups of features: ``lr`` predicts each row with an
        empty text, and the text's share, one number per title, is joined and added.
        """
        if self.item_text is None:
            return lr.transform(self.transform(df))
        rows, titles, combine = self._before_the_last_stage(df)
        size = titles.schema["text_features_norm"].metadata
        rows = rows.withColumn("text_features_norm", F.col("_zero_text").alias("text_features_norm", metadata=size))
        out, name = lr.transform(combine.transform(rows.drop("_zero_text"))), lr.getPredictionCol()
        share = F.coalesce(F.col("_text_score"), F.lit(0.0))
        return out.join(self.text_scores(lr), "MovieID", "left").withColumn(name, F.col(name) + share).drop("_text_score")

    def text_scores(self, lr: LinearRegressionModel) -> DataFrame:
        """(MovieID, _text_score): what each title's text adds to ``lr``'s prediction; kept for all batches."""
        weights = lr.coefficients.toArray()[-TF_FEATURES:]
        key = (lr.uid, weights.tobytes())
        if key not in self._text_scores:
            titles = self._texts()
            own = titles.sparkSession.createDataFrame([(weights.tolist(),)], "w array<double>").select("w").scalar()
            v = F.unwrap_udt("text_features_norm")      # type 0 sparse (size, indices, values), 1 dense (values)
            places = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
            products = F.zip_with(places, v["values"], lambda i, x: F.get(F.col("_w"), i) * x)
            self._text_scores[key] = titles.withColumn("_w", own).select(
                "MovieID", F.aggregate(products, F.lit(0.0), lambda a, x: a + x).alias("_text_score")).persist()
        return self._text_scores[key]

    def _texts(self) -> DataFrame:
        """The titles after the row stages that read their text alone."""
        size = with_zero_text(self.item_text).schema["_zero_text"].metadata
        titles = self.item_text.withColumn("plot_tfidf", F.col("plot_tfidf").alias("plot_tfidf", metadata=size))
        for stage in self.row_model.stages:
            if isinstance(stage, (VectorAssembler, Normalizer)) and stage.getOutputCol() in _TEXT_OUTPUTS:
                titles = stage.transform(titles)
        return titles

    def _before_the_last_stage(self, df: DataFrame) -> tuple[DataFrame, DataFrame, VectorAssembler]:
        """Rows with an empty ``_zero_text``, titles with their texts, and the stage that puts them together."""
        # The text stages run once per title.  A row meets its title's text at the last stage only, so
        # no other stage copies it, and with the sizes on record none runs a job to learn one from a first row.
        rows = with_zero_text(feature_input(df).drop("plot_tfidf"))
        *stages, combine = self.row_model.stages
        for stage in stages:
            if not (isinstance(stage, (VectorAssembler, Normalizer)) and stage.getOutputCol() in _TEXT_OUTPUTS):
                rows = stage.transform(rows)
        return rows, self._texts(), combine

    def save(self, path: str) -> None:
        SparkSession.active().createDataFrame([(self.text_model is not None,)], "has_text boolean").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/parts")
        self.row_model.write().overwrite().save(f"{path}/rows")
        if self.text_model is not None:
            self.text_model.write().overwrite().save(f"{path}/text")
            self.item_text.write.mode("overwrite").parquet(f"{path}/item_text")

    @classmethod
    def load(cls, spark, path: str) -> "FeatureModel":
        row = PipelineModel.load(f"{path}/rows")
        has_text = spark.read.parquet(f"{path}/parts").first().has_text
        text = PipelineModel.load(f"{path}/text") if has_text else None
        item_text = spark.read.parquet(f"{path}/item_text") if text is not None else None
        return cls(text, row, item_text)


def fit_features(train: DataFrame, items: DataFrame | None, include_item_id: bool = False) -> FeatureModel:
    """F-11, first half: the feature stages fitted on ``train``; text from ``items``, none without them."""
    text_model = item_text = None
    if items is not None:
        text_model = fit_text_model(items.join(train.select("MovieID").distinct(), "MovieID", "left_semi"))
        # one vector per title, read by training rows and by every request batch
        item_text = item_text_features(text_model, items).persist()
    # The estimators (Imputer, StringIndexer, OneHotEncoder) read only their own
    # columns: fit them on these alone, of the plain rows.  The text vector is joined per item
    # at transform time; here it is a placeholder that no fitting job ever computes.
    fit_input = feature_input(train).select(*FEATURE_INPUTS).persist()
    try:
        staged = with_zero_text(fit_input, "plot_tfidf") if items is not None else fit_input
        row_model = build_feature_stages(include_item_id, items is not None).fit(staged)
    finally:
        fit_input.unpersist()
    return FeatureModel(text_model, row_model, item_text)


def prepare_features(df: DataFrame, train: DataFrame | None = None, items: DataFrame | None = None,
                     include_item_id: bool = False, with_text: bool = True, save_path: str | None = None,
                     model_path: str | None = None) -> tuple[DataFrame, FeatureModel]:
    """F-11: fit the feature stages on ``train`` (default: ``df``), transform ``df``.

    Text comes from ``items`` (MovieID, plot_outline), one row per title, so
    rating rows never carry long texts; without ``items`` the plots are
    taken from ``df`` (one per MovieID).  Returns the
    feature table and the fitted ``FeatureModel`` (saved to ``model_path``
    when given, so serving uses the same stages); features are written to
    ``save_path`` when given (S-06).
    """
    fit_rows = train if train is not None else df
    if with_text and items is None:
        items = df.select("MovieID", "plot_outline").dropDuplicates(["MovieID"])
    fm = fit_features(fit_rows, items if with_text else None, include_item_id)
    out = fm.transform(df.drop("plot_outline"))
    if model_path:
        fm.save(model_path)
    if save_path:
        keep = [c for c in ("UserID", "MovieID", "NormUserRating", "UserRating", "content_features")
                if c in out.columns]
        out.select(*keep).write.mode("overwrite").parquet(save_path)
    return out, fm


def category_index_table(df: DataFrame, cols: Sequence[str] = CATEGORICAL) -> DataFrame:
    """F-01 as a table: (column, value, index) for every distinct value of each column.

    Index 0 is the most frequent value, ties alphabetical, as the indexer
    counts.  One pass unpivots and counts the values; positions come from a
    distributed sort, so no label list reaches the driver or one task.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in cols]))
    counts = df.select(pairs.alias("p")).select("p.column", "p.value").filter(F.col("value").isNotNull()) \
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    placed = global_positions(counts, [F.col("column").asc(), F.col("_n").desc(), F.col("value").asc()], "_pos")
    first = placed.groupBy("column").agg(F.min("_pos").alias("_first"))
    return placed.join(first, "column").select("column", "value",
                                               (F.col("_pos") - F.col("_first")).cast("double").alias("index"))


def default_stop_words(language: str = "english") -> list[str]:
    """Spark ML's default stop-word list, read from the installed Spark ML jar.

    Same list ``StopWordsRemover.loadDefaultStopWords`` returns, but usable
    before a SparkContext exists (the oracle SQL is built without one).
    """
    import glob
    import os
    import zipfile

    import pyspark
    for jar in glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            name = f"org/apache/spark/ml/feature/stopwords/{language}.txt"
            if name in z.namelist():
                return z.read(name).decode("utf-8").split()
    return list(StopWordsRemover.loadDefaultStopWords(language))


# Whitespace characters a token never contains (Java's \\s class).
WHITESPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
# Bytes of text whose terms one task counts; a counted term takes up to about twenty times its text in memory.
TASK_TEXT_BYTES = 8 << 20


def term_weights(docs: DataFrame, doc_col: str = "MovieID", text_col: str = "plot_outline",
                 stop_words: Sequence[str] | None = None) -> DataFrame:
    """F-07: explainable TF-IDF in long form: (doc, term, tf, df, weight).

    Tokens are the lower-cased text split on whitespace runs, empty tokens
    and stop words (Spark's default English list) removed; weight =
    tf * ln((N + 1) / (df + 1)), the IDF formula of F-06, without hashing.
    ``docs`` has one row per document.  The texts are dealt by document, about
    ``TASK_TEXT_BYTES`` to a task, and their terms counted there, so a task's
    memory stays the same however many there are; the join of tf with df is
    on the term.
    """
    if stop_words is None:
        stop_words = default_stop_words("english")
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    dealt = docs.select(doc_col, text_col).repartition(max(1, -(-size // TASK_TEXT_BYTES)), doc_col)
    toks = dealt.select(F.col(doc_col), F.explode(F.split(F.lower(F.col(text_col)), WHITESPACE_RUN)).alias("term"))
    toks = toks.filter((F.col("term") != "") & ~F.col("term").isin(list(stop_words)))
    tf = toks.groupBy(doc_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    # documents in which the term occurs, counted from tf itself: the tf sub-plan
    # then stays identical on both branches (count(*) would let the optimizer prune
    # it) and the shuffle of the texts is reused
    dfreq = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    n_docs = docs.select(F.count(F.lit(1)).alias("n")).scalar()
    out = tf.join(dfreq, "term").withColumn("_n", n_docs)
    idf = F.log((F.col("_n") + F.lit(1.0)) / (F.col("df") + F.lit(1.0)))
    return out.select(doc_col, "term", "tf", "df", (F.col("tf") * idf).alias("weight"))
