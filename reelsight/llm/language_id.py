"""Language identification by word-first backoff.

A known word scores its per-language log frequency; an unseen word falls back
to the character n-grams it holds, from the longest order that knows one of
them to the shortest.  The tables are counted by Spark over a bounded sample of
the labelled rows and hold a bounded number of entries per language; every
text is scored whole.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelsight.llm.common import in_small_batches, materialise, per_process

COUNT_TOKENS = 100_000          # tokens counted before a task passes them on
MEMO_TOKENS = 150_000           # tokens whose scores a task holds
NEW_TOKENS = 8_192              # new tokens rated together
SAMPLE_ROWS = 5_000             # labelled documents counted of each language, at most about this many
WORDS_PER_LANGUAGE = 20_000
GRAMS_PER_LANGUAGE = 5_000      # of each order
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
UNKNOWN = "und"
COMMON_SHARE = 5e-6             # a 3-gram is evidence of a language if it has this share of its 3-grams,
COMMON_COUNT = 4                # and was seen so often
LIMIT_LEAST = 20                # with fewer no limit is set
MARGIN = 0.25                   # the limit lies at least so far below the median
BENEFIT = 1                     # tokens of median evidence that every text gets, as short ones vary
_LETTERS = regex.compile(r"\p{L}+")


def words_of(token: str) -> list[str]:
    if token.isascii() and token.isalpha():
        return [token.lower()]
    return _LETTERS.findall(unicodedata.normalize("NFC", token).lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, gram, n) of the task's texts; order 0 are words.  Flushes when large."""
    seen: dict[str, Counter] = per_process(("language counts",), lambda: defaultdict(Counter))
    seen.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, tokens in seen.items():
            tables = {0: Counter()} | {n: Counter() for n in ORDERS}
            for token, c in tokens.items():
                for word in words_of(token):
                    tables[0][word] += c
            for word, c in tables[0].items():
                for n in ORDERS:
                    for gram in grams_of(word, n):
                        tables[n][gram] += c
            for n, table in tables.items():
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(table), pa.string()), "ord": pa.array([n] * len(table), pa.int32()),
                    "gram": pa.array(list(table), pa.string()), "n": pa.array(list(table.values()), pa.int64())})
        seen.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen[lang].update((text.as_py() or "").split())
            if sum(map(len, seen.values())) > COUNT_TOKENS:
                yield from flush()
    yield from flush()


class LanguageModel:
    """Log frequencies per language of words (order 0) and n-grams: an index and a matrix for each order."""

    def __init__(self, langs: list[str], tables: dict[int, dict[str, np.ndarray]]):
        self.langs = langs
        self.index = {n: {x: i for i, x in enumerate(t)} for n, t in tables.items()}
        self.rows = {n: np.array(list(t.values())) for n, t in tables.items()}

    @property
    def tables(self) -> dict[int, dict[str, np.ndarray]]:
        return {n: {x: self.rows[n][i] for x, i in t.items()} for n, t in self.index.items()}

    def packed(self) -> tuple:
        """Plain values to broadcast."""
        return self.langs, {n: list(t) for n, t in self.index.items()}, self.rows

    @classmethod
    def unpacked(cls, packed: tuple) -> LanguageModel:
        model = cls(packed[0], {})
        model.index = {n: {x: i for i, x in enumerate(t)} for n, t in packed[1].items()}
        model.rows = packed[2]
        return model

    def found(self, word: str) -> tuple[int, list[int]] | None:
        """The order that knows the word, by backoff, and its rows there; None if no order knows any of it."""
        known = self.index.get(0, {}).get(word)
        if known is not None:
            return 0, [known]
        for n in ORDERS:
            if index := self.index.get(n):
                found = [index[g] for g in grams_of(word, n) if g in index]
                if found:
                    return n, found
        return None

    def word(self, word: str) -> np.ndarray | None:
        """Log frequencies of a word: the mean of its rows; None if no order knows any of it."""
        got = self.found(word)
        return None if got is None else self.rows[got[0]][got[1]].sum(axis=0) / len(got[1])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from the rows of ``labelled`` with a language and a text (a sample of ``sample_rows`` for each language).

    Every language with such a row is learned, however rare.  Without any the model knows no language.
    """
    rows = in_small_batches(labelled).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                           F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw")).where(
        "lang is not null and text is not null")
    # One number per language reaches the driver; the share is taken as a limit on the hash, so a rare language stays whole.
    shares = rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), sample_rows / F.col("count")).alias("share"))
    limits = {r.lang: round(r.share * 1_000_000_000) for r in shares.collect()}
    limit = F.element_at(F.create_map(*(F.lit(x) for item in limits.items() for x in item)), F.col("lang")) if limits else F.lit(0)
    counts = rows.where(F.pmod("draw", F.lit(1_000_000_000)) < limit).select("lang", "text") \
        .mapInArrow(_count, "lang string, ord int, gram string, n long").groupBy("lang", "ord", "gram").agg(
        F.sum("n").alias("n"))
    counts = materialise(counts, "gram-counts")
    totals = {(r.lang, r.ord): (r.n, r.kinds) for r in counts.groupBy("lang", "ord").agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang", "ord").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("ord") == 0, WORDS_PER_LANGUAGE)
                                                .otherwise(GRAMS_PER_LANGUAGE))
    langs = sorted({lang for lang, _ in totals})
    column = {lang: i for i, lang in enumerate(langs)}
    tables: dict[int, dict[str, np.ndarray]] = {}
    # Additive smoothing over all entries of an order, so small languages don't gain from rare words.
    kinds = {n: sum(k for (_, o), (_, k) in totals.items() if o == n) for n in (0, *ORDERS)}

    def log_share(lang: str, n: int, count: int) -> float:
        return math.log((count + SMOOTHING) / (totals.get((lang, n), (0, 0))[0] + SMOOTHING * kinds[n]))

    floor = {n: np.array([log_share(x, n, 0) for x in langs]) for n in (0, *ORDERS) if kinds[n]}
    # At most (words + 4 * n-grams) per language reach the driver.
    for r in top.select("lang", "ord", "gram", "n").collect():
        row = tables.setdefault(r.ord, {}).get(r.gram)
        if row is None:
            row = tables[r.ord][r.gram] = floor[r.ord].copy()
        row[column[r.lang]] = log_share(r.lang, r.ord, r.n)
    return LanguageModel(langs, tables)


class _Scorer(dict):
    """Token to a row of sums: log frequencies, words with evidence, words.

    The new tokens of a text are rated together, by a few sums over all of them.
    """

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.width = model, len(model.langs)
        self.rows = np.zeros((1024, self.width + 2))

    def rated(self, tokens: list[str]) -> np.ndarray:
        """One row per token."""
        out = np.zeros((len(tokens), self.width + 2))
        # By order: the token of each word, where its rows begin, and its rows.
        by_order: dict[int, tuple[list[int], list[int], list[int]]] = {n: ([], [], []) for n in (0, *ORDERS)}
        words = []
        found = self.model.found
        for i, token in enumerate(tokens):
            some = words_of(token)
            words.append(len(some))
            for word in some:
                got = found(word)
                if got is not None:
                    of, begins, places = by_order[got[0]]
                    of.append(i)
                    begins.append(len(places))
                    places += got[1]
        out[:, -1] = words
        for n, (of, begins, places) in by_order.items():
            if of:
                sums = np.add.reduceat(self.model.rows[n][places], begins, axis=0)
                sums /= np.diff(begins, append=len(places))[:, None]
                np.add.at(out, of, np.concatenate([sums, np.ones((len(of), 1)), np.zeros((len(of), 1))], axis=1))
        return out

    def learn(self, tokens: list[str]) -> None:
        at, rows = len(self), self.rated(tokens)
        while at + len(tokens) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at:at + len(tokens)] = rows
        self.update(zip(tokens, range(at, at + len(tokens))))

    def places(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if len(self) > MEMO_TOKENS:
            self.clear()
        new = [t for t in dict.fromkeys(tokens) if t not in self]
        for i in range(0, len(new), NEW_TOKENS):
            self.learn(new[i:i + NEW_TOKENS])
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def score(self, text: str | None) -> tuple[str, float, float]:
        return self.judge(self.places(text))

    def judge(self, at: np.ndarray) -> tuple[str, float, float]:
        sums = self.rows[at].sum(axis=0) if len(at) else np.zeros(self.width + 2)
        if not sums[-1] or not self.width:
            return UNKNOWN, 0.0, 0.0
        best = int(np.argmax(sums[:-2]))
        odds = np.exp(sums[:-2] - sums[best])
        return self.model.langs[best], float(1 / odds.sum()), float(sums[-2] / sums[-1])


class _Evidence(_Scorer):
    """Token to the largest share of its 3-grams that one language has as common ones, and 1 if it has a letter.

    A 3-gram is common where it makes up ``COMMON_SHARE`` of all, and was seen
    ``COMMON_COUNT`` times, so a text cannot vouch for itself by being learned.
    """

    def __init__(self, model: LanguageModel):
        super().__init__(model)
        self.index3 = model.index.get(3, {})
        rows = model.rows.get(3, np.zeros((0, self.width)))
        # The least entry of a language is that of a 3-gram it lacks.
        least = rows.min(axis=0, initial=0.0) + math.log((COMMON_COUNT + SMOOTHING) / SMOOTHING)
        self.common = (rows >= math.log(COMMON_SHARE)) & (rows >= least - 1e-9)
        self.rows = np.zeros((1024, 2))

    def rated(self, tokens: list[str]) -> np.ndarray:
        index, kinds, begins, places, of = self.index3, [], [], [], []
        for i, token in enumerate(tokens):
            n = 0
            begin = len(places)
            for word in words_of(token):
                grams = grams_of(word, 3)
                n += len(grams)
                places += [index[g] for g in grams if g in index]
            kinds.append(n)
            if len(places) > begin:
                begins.append(begin)
                of.append(i)
        kinds = np.array(kinds)
        out = np.zeros((len(tokens), 2))
        out[:, 1] = kinds > 0
        if of:
            most = np.add.reduceat(self.common[places], begins, axis=0, dtype=np.int64).max(axis=1, initial=0)
            out[of, 0] = most / kinds[of]
        return out

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Sum over the tokens with a letter, and how many there are."""
        at = self.places(text)
        share, tokens = self.rows[at].sum(axis=0)
        return float(share), float(tokens)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, known)`` per row.

    score: the posterior of the predicted language under equal priors; known:
    the share of words for which a table has evidence.  A null text, one without
    a letter, and any text under a model without languages: ``und``, 0, 0.  Ties
    go to the first language in order.  Other columns are not looked at.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model.packed()), uuid.uuid4().hex
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_process(("language", name), lambda: _Scorer(LanguageModel.unpacked(shared.value)))
        for batch in batches:
            got = [scorer.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())],
                names=["id", "lang_pred", "score", "known"])

    return in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {id_type}, lang_pred string, score double, known double")


def held_out(id_col: str = "doc_id"):
    """Rows kept out of training: crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out; predict every row."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "known")


def evidence_limit(docs: DataFrame, model: LanguageModel, scorer) -> tuple[float, float]:
    """``(limit, median)`` of the evidence of all held-out rows in a learned language; 0, 0 if they are too few.

    Set by the quartile and the median, so that texts with a wrong label, up to
    a quarter of the rows, don't move it far.
    """
    rows = in_small_batches(docs).where(held_out() & F.col("lang").cast("string").isin(model.langs) & F.col("text").isNotNull())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scorer().evidence(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"evidence": pa.array([e / n for e, n in got if n], pa.float64())})

    # millionths: the quantiles are exact in these, and their counts fit one task whatever the number of rows
    n, at = rows.select(F.col("text").cast("string")).mapInArrow(run, "evidence double").agg(
        F.count("*"), F.expr("percentile(round(evidence, 6), array(0.25, 0.5))")).first()
    if n < LIMIT_LEAST:
        return 0.0, 0.0
    return at[1] - max(MARGIN, 4 * (at[1] - at[0])), at[1]


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a learned language; all columns stay.

    Decided by the share of a token's 3-grams that are common in a learned
    language, as a mean over the text's tokens; its limit comes from the held-out
    rows (``evidence_limit``).  Rejected: texts below it, such as random letters,
    encoded bytes and prose in a language that was never learned, and texts that
    are null or have no letter.  With fewer than ``LIMIT_LEAST`` held-out rows
    only texts without any known n-gram go, and where no language could be
    learned only those without a letter.  The rows go through a scan, without a shuffle.
    """
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    shared, name = docs.sparkSession.sparkContext.broadcast(model.packed()), uuid.uuid4().hex
    place = docs.columns.index("text")

    def scorer(kind: type = _Evidence) -> _Scorer:
        return per_process((kind.__name__, name), lambda: kind(LanguageModel.unpacked(shared.value)))

    known = bool(model.langs)
    limit, median = evidence_limit(docs, model, scorer) if known else (0.0, 0.0)

    def kept(text: str | None) -> bool:
        if limit <= 0:
            return scorer(_Scorer).score(text)[2] > 0
        evidence, tokens = scorer().evidence(text)
        return tokens > 0 and evidence + median * BENEFIT >= limit * (tokens + BENEFIT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch.column(place))
            keep = [kept(t) if known else bool(_LETTERS.search(t or "")) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
