"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's terms are counted over all documents.
2. A randomised SVD of the TF-IDF passage matrix (every passage of every document
   and every benchmark item) gives a latent space.  The pass that counts stores the
   passages as numbers of terms; the products with them are computed and summed by
   Spark; the driver only factors matrices of benchmark terms x rank.
3. Every passage of every document, at two scales, is projected; passages whose
   cosine to an item reaches a threshold are candidates.
4. A candidate is verified in the document's words: the longest common
   subsequence with the item, and that the item's answer (its last sentence) is
   there too, which also holds for paraphrases that change some words.

The benchmark is the stated query set; it is processed in blocks of items, each
against all documents, so vocabulary and projection stay bounded.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsight.llm.common import in_small_batches, materialise, per_process

ITEMS_PER_BLOCK = 2_000
RANK, OVERSAMPLE, POWER_ROUNDS = 96, 16, 2
LEAST_VALUE = 1e-6               # squared singular values below this share of the largest are none
STEP = 8                         # words between passage starts
SCALES = (3, 7)                  # passage lengths, in steps
COSINE = 0.5
IDF_POWER = 2                    # rare terms tell passages apart; common words barely count
MIN_LCS, SURE_LCS, MIN_ANSWER = 0.6, 0.8, 0.5
_ROWS = 2_048                    # passages compared with all items at once
_PRODUCTS, _TERMS = 512, 64      # words whose products are summed at once; terms whose sums travel in one row

_ASCII_WORD = re.compile(rb"[a-z0-9_\x80-\xff]+")
_BLANKED = bytes(b if _ASCII_WORD.match(bytes([b])) else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of letters, digits, underscores and non-ASCII characters."""
    return _ASCII_WORD.findall((text or "").lower().encode("utf-8", "replace"))


def answer_of(text: str) -> str:
    """The last sentence (or line) of an item."""
    said = [x for x in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if words_of(x)]
    return said[-1] if said else ""


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Items:
    """A block of benchmark items: words, answers, vocabulary."""

    def __init__(self, rows: list[tuple[int, str]]):
        kept = [(i, words_of(t), words_of(answer_of(t))) for i, t in rows if t is not None]
        kept = [x for x in kept if x[1]]
        self.ids, self.words, self.answers = [x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept]
        self.term = {w: i + 1 for i, w in enumerate(sorted({w for x in self.words for w in x}))}
        self.own = [self.places(x) for x in self.words]
        self._all_own = np.concatenate([*self.own, np.zeros(0, np.int32)])
        self._sizes = np.fromiter(map(len, self.own), np.int64, len(self.own))
        self._begins = np.cumsum(self._sizes) - self._sizes
        self._vocabulary = pa.array(list(self.term), pa.string())
        self._marks = np.zeros(len(self.term) + 1, bool)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words; 0 for words of no item."""
        return np.fromiter(map(self.term.get, words, repeat(0)), np.int32, len(words))

    def places_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``places`` of the words of some texts, side by side, and where each text's begin, with the last's end."""
        blanked = [(x.as_py() or "").lower().encode("utf-8", "replace").translate(_BLANKED) for x in texts]
        split = pc.ascii_split_whitespace(pa.array(blanked, pa.string()))
        words = split.flatten()
        there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)      # blanks at the ends of a text leave none
        at = pc.add(pc.fill_null(pc.index_in(words, self._vocabulary), -1), 1).to_numpy()[there]
        return at, np.concatenate([[0], np.cumsum(there)])[split.offsets.to_numpy()]

    def able(self, at: np.ndarray) -> np.ndarray:
        """Which items a text with words at these places may hold: one whose words it lacks is in no part of it."""
        there = np.zeros(len(self.term) + 1, bool)
        there[at] = True
        found = np.add.reduceat(there[self._all_own], self._begins, dtype=np.int64)
        return found >= MIN_LCS * self._sizes

    def is_own(self, item: int, at: np.ndarray) -> np.ndarray:
        """Whether the term at each place is one of the item's."""
        own = self.own[item]
        self._marks[own] = True
        got = self._marks[at]
        self._marks[own] = False
        return got

    def verify(self, item: int, words: list[bytes], start: int, stop: int) -> tuple[float, float] | None:
        """(LCS share, answer share) if the words around a passage hold the item."""
        own, answer = self.words[item], self.answers[item]
        part = words[max(0, start - len(own)):stop + len(own)]
        there = set(part)
        if sum(w in there for w in own) < MIN_LCS * len(own):       # bounds the subsequence
            return None
        share = lcs(own, part) / len(own)
        if share < MIN_LCS:
            return None
        said = lcs(answer, part) / len(answer) if answer else 1.0
        return (share, said) if share >= SURE_LCS or said >= MIN_ANSWER else None


def _passages(at: np.ndarray, borders: np.ndarray, terms: int) -> pa.Array:
    """Terms of the passages of some texts, at the larger scale, each in rising order; passages without any are left out."""
    width, sizes = STEP * SCALES[-1], np.diff(borders)
    per_text = -(-sizes // width)
    firsts = np.cumsum(per_text) - per_text
    passage = (np.arange(len(at)) - np.repeat(borders[:-1], sizes)) // width + np.repeat(firsts, sizes)
    placed = np.sort((passage * terms + at)[at > 0])
    held = np.bincount(placed // terms)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held[held > 0])]), pa.int32()),
                                    pa.array((placed % terms).astype(np.int32)))


_COUNTED = "term int, n long, terms array<int>"


def _frequencies(items: Items, with_passages: bool = False):
    """How many of the task's texts hold each term, and under 0 their number; ``with_passages`` also their passages."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_process(("benchmark",), dict)
        terms = len(items.term) + 1
        count, docs = np.zeros(terms, np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            at, borders = items.places_of(batch.column(0))
            once = np.unique((np.repeat(np.arange(batch.num_rows), np.diff(borders)) * terms + at)[at > 0])
            count += np.bincount(once % terms, minlength=terms)
            if with_passages:
                lists = _passages(at, borders, terms)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(lists), pa.int32()), pa.nulls(len(lists), pa.int64()), lists],
                                                 names=["term", "n", "terms"])
        count[0] = docs
        at = np.flatnonzero(count)
        columns = {"term": pa.array(at.astype(np.int32)), "n": pa.array(count[at])}
        if with_passages:
            columns["terms"] = pa.nulls(len(at), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict(columns)
    return run


def _row_sums(rows: np.ndarray, at: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The sums of ``rows[at]`` over the parts of ``at`` that begin at ``begins``; none is empty."""
    sizes = np.diff(np.append(begins, len(at)))
    out, room = np.empty((len(begins), rows.shape[1])), np.empty((_PRODUCTS, rows.shape[1]))
    for first in range(0, len(begins), _PRODUCTS):
        # the k-th rows of all parts that have so many, longest parts first
        order = np.argsort(-sizes[first:first + _PRODUCTS], kind="stable") + first
        starts, lengths, total = begins[order], -sizes[order], np.zeros((len(order), rows.shape[1]))
        for k in range(-lengths[0]):
            n = np.searchsorted(lengths, -k)
            total[:n] += rows.take(at[starts[:n] + k], 0, room[:n], "clip")
        out[order] = total
    return out


def _product(idf: np.ndarray, right: np.ndarray):
    """A^T (A right) over the task's passages, in blocks of terms."""
    # numbers of 16 bits are sorted by radix
    number = np.uint16 if len(idf) <= 1 << 16 else np.int32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weighted = np.zeros_like(right), right * idf[:, None]
        room = np.empty((_PRODUCTS, right.shape[1]))
        for batch in batches:
            lists = batch.column(0)
            at, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            at, sizes = at.astype(np.int64), sizes[sizes > 0]
            if not len(at):
                continue
            begins = np.cumsum(sizes) - sizes
            # A term's words stand side by side in a passage; its weight there is their number times its IDF.
            new = np.append(True, at[1:] != at[:-1])
            new[begins] = True
            runs = np.flatnonzero(new)
            weights = np.diff(np.append(runs, len(at))) * idf[at[runs]]
            squares = np.add.reduceat(weights**2, np.searchsorted(runs, begins))
            got = _row_sums(weighted, at, begins)
            got /= np.where(squares > 0, squares, 1.0)[:, None]
            # A word adds its passage's row to its term's.
            order = np.argsort(at.astype(number), kind="stable")
            term, passage = at[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            for first in range(0, len(term), _PRODUCTS):
                some = term[first:first + _PRODUCTS]
                starts = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
                rows = got.take(passage[first:first + _PRODUCTS], 0, room[:len(some)], "clip")
                total[some[starts]] += np.add.reduceat(rows, starts, axis=0)
        total *= idf[:, None]
        blocks = [i for i in range(0, len(total), _TERMS) if total[i:i + _TERMS].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([total[i:i + _TERMS].tobytes() for i in blocks], pa.binary())],
            names=["term", "rows"])
    return run


def _sum_rows(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("rows"))
    return pa.table({"term": table.column("term").slice(0, 1), "rows": pa.array([total.tobytes()], pa.binary())})


def fit_space(texts: DataFrame, items: Items) -> np.ndarray:
    """``texts``: (doc_id, text).  Projection (benchmark terms + 1, rank) float32: IDF weight times the right singular
    vectors, each over its singular value, so frequent topics don't outweigh the others.  Fitted on all passages of the texts.

    Row 0, for all other words, is zero.
    """
    terms = len(items.term) + 1
    own = texts.sparkSession.createDataFrame([(None, None, np.sort(items.places(w)).tolist()) for w in items.words], _COUNTED)
    stored = materialise(texts.select("text").mapInArrow(_frequencies(items, True), _COUNTED).unionAll(own), "passages")
    counted = {r.term: r.n for r in stored.where("term is not null").groupBy("term").agg(
        F.sum("n").alias("n")).collect()}          # at most one number per benchmark term
    docs = counted.get(0, 0)
    idf = np.zeros(terms)
    idf[1:] = [math.log(1 + (docs + 1) / (counted.get(t, 0) + 1)) ** IDF_POWER for t in range(1, terms)]
    passages = stored.where("term is null").select("terms")
    width = min(RANK + OVERSAMPLE, terms)
    basis = np.random.default_rng(3).standard_normal((terms, width))
    for _ in range(POWER_ROUNDS + 1):
        basis, _ = np.linalg.qr(basis)
        got = np.zeros((terms, width))
        for r in passages.mapInArrow(_product(idf, basis), "term int, rows binary").groupBy("term").applyInArrow(
                _sum_rows, "term int, rows binary").collect():      # benchmark terms x rank
            got[r.term:r.term + _TERMS] = np.frombuffer(r.rows, np.float64).reshape(-1, width)
        last, basis = basis, got
    # basis = (A^T A) last: the small symmetric problem gives the singular vectors.
    values, vectors = np.linalg.eigh(last.T @ basis)
    best = np.argsort(-values)[:min(RANK, width)]
    # No passage of a small table lies in the rest, which rounding alone would fill.
    best = best[values[best] > LEAST_VALUE * values.max()]
    space = (last @ vectors[:, best]) * idf[:, None] / np.sqrt(values[best])
    space[0] = 0
    return space.astype(np.float32)


def latent(items: Items, space: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the items, one per column."""
    v = np.stack([space[items.places(w)].sum(axis=0) for w in items.words])
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T.astype(np.float32)


def near_passages(at: np.ndarray, space: np.ndarray, targets: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(items, starts, stops, cosines) of the passages of one text that come near an item."""
    n = len(at)
    blocks, most = max(1, -(-n // STEP)), max(SCALES)
    padded = np.zeros(blocks * STEP, np.int32)
    padded[:n] = at
    for first in range(0, blocks, _ROWS):
        # Sums of the steps that start here and of those the last passages reach into.
        some = padded[first * STEP:(first + _ROWS + most - 1) * STEP].reshape(-1, STEP)
        steps = space[some[:, 0]]
        for j in range(1, STEP):
            steps += space[some[:, j]]
        for scale in SCALES:
            # One passage that reaches the end is enough.
            last = min(_ROWS, max(1, len(steps) - scale + 1))
            v = steps[:last].copy()
            for j in range(1, min(scale, len(steps))):
                v += steps[j:j + last]
            length = np.sqrt(np.maximum(np.einsum("ij,ij->i", v, v), 1e-20))
            close = v @ targets
            row, item = np.nonzero(close >= cosine * length[:, None])
            if len(row):
                start = (first + row) * STEP
                yield item, start, np.minimum(n, start + scale * STEP), close[row, item] / length[row]


def first_leak(items: Items, item: int, words: list[bytes], at: np.ndarray, start: np.ndarray, stop: np.ndarray,
               cosine: np.ndarray) -> tuple[float, float, float] | None:
    """``(cosine, LCS share, answer share)`` of the nearest passage that holds the item, or None.

    The passages (nearest first) are the item's candidates in one text.  All
    of them are decided: by too few places with a word of the item, which
    bounds the subsequence; by a window that contains theirs and has failed, as
    a part of it holds no more; else by ``verify``.
    """
    reach = len(items.words[item])
    lo, hi = np.maximum(0, start - reach), np.minimum(len(words), stop + reach)
    first = int(lo.min())
    seen = np.zeros(int(hi.max()) - first + 1, np.int32)
    np.cumsum(items.is_own(item, at[first:first + len(seen) - 1]), out=seen[1:])
    enough = seen[hi - first] - seen[lo - first] >= MIN_LCS * reach
    failed: list[tuple[int, int]] = []
    for i in np.flatnonzero(enough).tolist():
        if any(x <= lo[i] and hi[i] <= y for x, y in failed):
            continue
        if got := items.verify(item, words, int(start[i]), int(stop[i])):
            return float(cosine[i]), *got
        failed.append((int(lo[i]), int(hi[i])))
    return None


def leaks_of(items: Items, text: str, at: np.ndarray, space: np.ndarray, targets: np.ndarray) -> Iterator[tuple[int, tuple[float, float, float]]]:
    """(item, what ``first_leak`` found) of the items that a text, with words at the places ``at``, holds."""
    able = items.able(at)
    near = list(near_passages(at, space, targets, COSINE)) if able.any() else []
    if not near:
        return
    item, start, stop, cosine = (np.concatenate(x) for x in zip(*near))
    kept = np.flatnonzero(able[item])
    if not len(kept):
        return
    words, order = words_of(text), kept[np.lexsort((stop[kept], start[kept], -cosine[kept], item[kept]))]
    for some in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
        k = int(item[some[0]])
        if got := first_leak(items, k, words, at, start[some], stop[some], cosine[some]):
            yield k, got


def _search(items: Items, model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_process(("benchmark",), dict)
        space, targets = model.value
        for batch in batches:
            out = []
            at, borders = items.places_of(batch.column(1))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                text = batch.column(1)[i]
                key = None
                for item, got in leaks_of(items, text.as_py(), at[borders[i]:borders[i + 1]], space, targets):
                    key = key or hashlib.md5(text.as_buffer()).hexdigest()
                    out.append((doc_id, items.ids[item], *got, key))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                     *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.string())],
                    names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "text_md5"])
    return run


_FOUND = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, text_md5 string"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, cosine, lcs_share, answer_share, text_md5)``, one row per row of ``docs`` and item it holds.

    ``benchmark``: (item_id, text); items without words are left out.  A null or
    blank text holds nothing; repeated rows are reported each; a null id is
    reported as null.  Other columns are ignored.  An empty side gives no rows.
    """
    spark = docs.sparkSession
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], _FOUND)
    block: list[tuple[int, str]] = []

    def search(some: list[tuple[int, str]]) -> None:
        nonlocal out
        items = Items(some)
        if items.ids:
            space = fit_space(rows, items)
            model = spark.sparkContext.broadcast((space, latent(items, space)))
            out = out.unionAll(rows.mapInArrow(_search(items, model), _FOUND))

    # The stated query set, one block at a time: the driver holds one block.
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEMS_PER_BLOCK:
            search(block)
            block = []
    search(block)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay.

    Decided per row, by its id and text: a clean row stays though its id is
    repeated by a contaminated one, and a contaminated row with a null id goes.
    """
    found = materialise(contaminated(docs, benchmark, id_col, text_col).select(
        F.col("doc_id").alias("__leak"), F.col("text_md5").alias("__leak_md5")).distinct(), "leaks")
    same = docs[id_col].cast("long").eqNullSafe(found["__leak"])
    return docs.join(found, same & (F.md5(docs[text_col].cast("string").cast("binary")) == found["__leak_md5"]), "left_anti")
