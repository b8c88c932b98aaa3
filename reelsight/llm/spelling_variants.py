"""Spelling variant grouping by bidirectional FM-index search schemes.

Two words are near when one inserted, deleted or replaced code point turns one
into the other.  Cut a word into halves: one of them stands unchanged in every
near word, as its beginning or as its end.

1. The vocabulary is counted in one pass over the texts.
2. Words are dealt to shards by their halves: a word searches in two shards, that
   of its first and that of its second half, and is indexed under the halves that
   words of its own or a neighbouring length would have.
3. A shard holds one direction of the FM-index over its delimited words: of the
   words, to extend from the second half to the left, or of the reversed words, to
   extend from the first half to the right.  A search matches the half exactly,
   then takes one error anywhere in the other half, all as suffix-rank intervals,
   for all words of the shard at once.
4. The most frequent near word becomes a word's form, and pointer jumping follows
   the forms to the root.

A half that is shared by more words than a shard holds is cut into blocks of
indexed words and blocks of searching words; every pair of blocks is searched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsight.llm.common import in_small_batches, materialise, parts, per_process

MIN_LENGTH, MIN_COUNT = 7, 2
FORM_FACTOR = 10                 # a form is at least so many times as frequent
SLIP = 31                        # one run in so many loses a code point
COUNT_WORDS = 300_000            # words counted before a task passes them on
SHARD_WORDS = 100_000            # words indexed, and words searching, in one shard, about
SEARCH_WORDS = 1 << 15           # words that search at once

#: Runs are found in the Latin-1 image of a text, where a code point is a byte and
#: all others become a separator; lower-casing bytes changes A-Z alone.
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % MIN_LENGTH)


def slipped(doc_id: int | None, run: str) -> str:
    """A lower-cased run, without one of its code points where its checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the task's texts; flushes when large."""
    seen: Counter[bytes] = per_process(("spelling",), Counter)
    seen.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        words = list(seen)
        for at in range(0, len(words), 50_000):
            some = words[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in some], pa.string()),
                                              pa.array([seen[w] for w in some], pa.int64())], names=["word", "n"])
        seen.clear()

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            runs = _RUN.findall((text.as_py() or "").encode("latin-1", "replace").lower())
            begun = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for run, n in Counter(runs).items():
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
                if h % SLIP == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < MIN_LENGTH:
                        continue
                seen[run] += n
        if len(seen) > COUNT_WORDS:
            yield from flush()
    yield from flush()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the words with at least ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased,
    after ``slipped``.  A null text holds none; a null id counts as an empty one;
    repeated rows count each.
    """
    texts = in_small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                         F.col(text_col).cast("string").alias("text")))
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= MIN_COUNT)


class FmIndex:
    """Backward search over delimited words, for many patterns at once.

    The words (bytes) are sorted, so the row of the delimiter before a word is the
    word's number.  ``keys`` holds, by symbol and row, where a symbol stands in the
    transform: the place of (symbol, row) there is the next border of an interval.
    """

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        order = self._sorted_suffixes(text)
        self.rows = len(text)
        self.bwt = text[order - 1]
        row = np.arange(self.rows, dtype=np.int64)
        row[0] = self.rows                      # what precedes the text matches nothing
        self.keys = np.sort(self.bwt.astype(np.int64) * (self.rows + 1) + row)

    @staticmethod
    def _sorted_suffixes(text: np.ndarray) -> np.ndarray:
        """Suffixes in order, each up to its first delimiter, then by place, by doubling the sorted length."""
        n, ends = len(text), text == 0
        rank = text.astype(np.int64) + n
        rank[ends] = np.arange(ends.sum())
        step = 1
        while True:
            key = rank * (2 * n + 300)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            place = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank[order] = place
            if place[-1] == n - 1:
                return order
            step *= 2

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol before them."""
        at = symbol.astype(np.int64) * (self.rows + 1)
        return np.searchsorted(self.keys, at + low), np.searchsorted(self.keys, at + high)

    def before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of interval, symbol) for the letters that precede the patterns of disjoint intervals."""
        size = high - low
        of = np.repeat(np.arange(len(low)), size)
        row = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        pair = np.unique(of * 256 + self.bwt[row])
        pair = pair[pair % 256 > 0]
        return pair // 256, (pair % 256).astype(np.uint8)


def one_error(index: FmIndex, words: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """(searching, indexed) numbers of the words that differ by one error before their last ``exact`` symbols.

    ``words``: a matrix of symbols, one word per row.
    """
    n, length = words.shape
    alive = np.arange(n)
    low, high = np.zeros(n, np.int64), np.full(n, int((index.bwt == 0).sum()), np.int64)     # all delimiters
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def finish(who: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: int) -> None:
        """Match the ``left`` symbols that remain and the delimiter."""
        for j in range(left - 1, -2, -1):
            some = lo < hi
            who, lo, hi = who[some], lo[some], hi[some]
            if not len(who):
                return
            lo, hi = index.extend(words[who, j] if j >= 0 else np.zeros(len(who), np.uint8), lo, hi)
        some = lo < hi
        found.append((who[some], lo[some]))

    for i in range(length - 1, -2, -1):
        if i < length - exact:
            # Here is the error: before the symbols matched so far stands another letter than word[i].
            pair, which = np.unique(low * (index.rows + 1) + high, return_inverse=True)
            of, letter = index.before(pair // (index.rows + 1), pair % (index.rows + 1))
            first, count = np.searchsorted(of, which), np.bincount(of, minlength=len(pair))[which]
            who = np.repeat(np.arange(len(alive)), count)
            child = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            if i >= 0:
                other = letter[child] != words[alive[who], i]
                who, child = who[other], child[other]
            lo, hi = index.extend(letter[child], low[who], high[who])
            finish(alive[who], lo, hi, i + 1)                   # inserted
            if i >= 0:
                finish(alive[who], lo, hi, i)                   # replaced
                # Deleted; of a run of equal symbols the first.
                some = words[alive, i - 1] != words[alive, i] if i else np.ones(len(alive), bool)
                finish(alive[some], low[some], high[some], i)
        if i < 0:
            break
        low, high = index.extend(words[alive, i], low, high)
        some = low < high
        alive, low, high = alive[some], low[some], high[some]
        if not len(alive):
            break
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_words(indexed: list[str], searching: list[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``searching``, number in ``indexed``) of the near words that share a half.

    With ``first_half`` the first one, where the second is not shared, else the
    second; so the two together have every pair once.
    """
    def turned(word: str) -> bytes:
        return word.encode("latin-1")[::-1 if first_half else 1]

    order = sorted(range(len(indexed)), key=lambda k: turned(indexed[k]))
    own = [turned(indexed[k]) for k in order]
    index = FmIndex(own)
    by_length: dict[int, list[int]] = {}
    for k, word in enumerate(searching):
        by_length.setdefault(len(word), []).append(k)
    out = []
    for length, every in by_length.items():
        exact = length // 2 if first_half else length - length // 2
        for at in range(0, len(every), max(1, SEARCH_WORDS * 32 // (length + 32))):
            some = every[at:at + max(1, SEARCH_WORDS * 32 // (length + 32))]
            words = np.frombuffer(b"".join(turned(searching[k]) for k in some), np.uint8).reshape(-1, length)
            who, what = one_error(index, words, exact)
            if first_half:
                rest = [words[k, :length - exact].tobytes() for k in range(len(some))]
                once = np.fromiter((not own[w].startswith(rest[k]) for k, w in zip(who.tolist(), what.tolist())), bool, len(who))
                who, what = who[once], what[once]
            out.append((np.array(some)[who], np.array(order)[what]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


_BEST = "word string, n_near long, best_n long, best string"
_BEST_ARROW = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _search(table: pa.Table) -> pa.Table:
    """One shard: how many near words each searching word has here, and the most frequent."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy(zero_copy_only=False)
    unique = dict(zip((words[k] for k in np.flatnonzero(~asks)), n[~asks].tolist()))
    indexed, searching = sorted(unique), [words[k] for k in np.flatnonzero(asks)]
    if not indexed or not searching:
        return _BEST_ARROW.empty_table()
    who, what = near_words(indexed, searching, table.column("first_half")[0].as_py())
    count = np.array([unique[w] for w in indexed])
    order = np.lexsort((what, -count[what], who))               # indexed words are sorted, so ties go to the smaller
    who, what = who[order], what[order]
    start = np.flatnonzero(np.diff(who, prepend=-1))
    return pa.Table.from_arrays([
        pa.array([searching[k] for k in who[start].tolist()], pa.string()), pa.array(np.diff(np.append(start, len(who)))),
        pa.array(count[what[start]]), pa.array([indexed[k] for k in what[start].tolist()], pa.string())], schema=_BEST_ARROW)


def _halves(word: Column, length: Column) -> list[Column]:
    """(first_half, half) of a word as if it had ``length`` code points."""
    first = F.floor(length / 2).cast("int")
    return [F.struct(F.lit(True).alias("first_half"), F.left(word, first).alias("half")),
            F.struct(F.lit(False).alias("first_half"), F.right(word, length - first).alias("half"))]


def best_near(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the rows of ``words`` (word, n; each word once) with a near word.

    best: the most frequent near word; ties go to the smallest in code-point order.
    """
    length = F.char_length("word")
    asks = words.select("word", "n", F.explode(F.array(*_halves(F.col("word"), length))).alias("at"))
    holds = words.select("word", "n", F.explode(F.array_distinct(F.array(*(
        h for d in (-1, 0, 1) for h in _halves(F.col("word"), length + d))))).alias("at"))
    rows = materialise(holds.select("word", "n", "at.*", F.lit(False).alias("asks")).unionAll(
        asks.select("word", "n", "at.*", F.lit(True).alias("asks"))), "halves")
    sizes = rows.groupBy("first_half", "half").agg(
        F.count_if(~F.col("asks")).alias("holds"), F.count_if("asks").alias("asked"))
    heavy = materialise(sizes.where((F.col("holds") > shard_words) | (F.col("asked") > shard_words)).select(
        "first_half", "half", F.ceil(F.col("holds") / shard_words).alias("of_holds"),
        F.ceil(F.col("asked") / shard_words).alias("of_asked")), "heavy-halves")
    shards = parts(rows.where("not asks").count(), shard_words)
    light = rows.join(heavy, ["first_half", "half"], "left_anti").withColumn(
        "shard", F.concat_ws("/", F.pmod(F.xxhash64("first_half", "half"), F.lit(shards)).cast("string"),
                             F.col("first_half").cast("string")))
    # Of a heavy half each block of indexed words meets each block of searching words.
    own = F.pmod(F.xxhash64("word"), F.when(F.col("asks"), F.col("of_asked")).otherwise(F.col("of_holds")))
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("of_holds")).otherwise(F.col("of_asked")) - 1))
    cut = rows.join(heavy, ["first_half", "half"]).withColumn("own", own).withColumn("other", others).withColumn(
        "shard", F.concat_ws("/", "half", F.col("first_half").cast("string"), F.when(F.col("asks"), F.concat_ws(
            "/", "own", "other")).otherwise(F.concat_ws("/", "other", "own"))))
    kept = ["shard", "word", "n", "first_half", "asks"]
    found = light.select(kept).unionAll(cut.select(kept)).groupBy("shard").applyInArrow(_search, _BEST)
    best = F.min(F.struct((-F.col("best_n")).alias("key"), F.col("best"), F.col("best_n"))).alias("most")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", "most.best_n", "most.best")


def roots_of(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms`` (word, form): forms followed to the last, by pointer jumping.

    A form is ten times as frequent as its word, so the ways are short and have no
    circles.
    """
    hops = materialise(forms.select("word", F.col("form").alias("root")), "hops")
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = materialise(hops.join(on, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "hops")
        hops = now.select("word", "root")
        if now.where("moved").isEmpty():
            return hops


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per word of the vocabulary of ``docs``.

    form: the near word with the largest count (ties: the smallest), where it has at
    least ``FORM_FACTOR`` times the word's count, else null; root: the last word
    that forms lead to, or the word itself.  Nulls, repeated rows and clashing
    columns: see ``vocabulary``; an empty table gives no rows.
    """
    words = materialise(vocabulary(docs, id_col, text_col), "vocabulary")
    known = words.join(best_near(words), "word", "left")
    fits = F.col("best_n") >= FORM_FACTOR * F.col("n")
    known = materialise(known.select("word", F.when(fits, F.col("best")).alias("form"), "n",
                                     F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                     F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    roots = roots_of(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
