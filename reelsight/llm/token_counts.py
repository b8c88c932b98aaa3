"""Token counts that follow edits.

Each document keeps a segment tree over its pre-token chunks: the leaves hold a
chunk's tokens and characters, inner nodes the sums.  An edit finds the touched
leaves by descending the character sums, re-encodes them and the boundary
context (the rest of the first and the last chunk), and updates the sums above.

A chunk is a run of white space and the text up to the next white space.  The
byte-level pre-tokenizer never joins a non-blank with the blank after it and
looks ahead only within blanks, so chunks encode independently of each other.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np

from reelsight.llm.common import MEMO_ENTRIES, MEMO_WORD_BYTES, in_small_batches, per_process

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Python counts the separators 0x1c to 0x1f as white space, the pattern does not.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


class Counter(dict):
    """Tokens of a chunk, each distinct one encoded once."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> int:
        n = len(self.encode(chunk))
        if len(chunk) <= MEMO_WORD_BYTES:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


class SegmentTree:
    """Sums of (tokens, characters) over the chunks of one text, in numpy levels.

    ``levels[0]`` holds the leaves; each level above sums pairs.
    """

    def __init__(self, tokens: np.ndarray, chars: np.ndarray):
        self.levels = [np.stack([tokens, chars], axis=1).astype(np.int64).reshape(-1, 2)]
        self._grow()

    @classmethod
    def of(cls, text: str, counter: Counter) -> SegmentTree:
        chunks = _CHUNK.findall(text)
        return cls(np.fromiter(map(counter.__getitem__, chunks), np.int64, len(chunks)),
                   np.fromiter(map(len, chunks), np.int64, len(chunks)))

    def _grow(self) -> None:
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            if len(below) % 2:
                below = np.concatenate([below, np.zeros((1, 2), np.int64)])
            self.levels.append(below[0::2] + below[1::2])

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][:, 0].sum())

    @property
    def chars(self) -> int:
        return int(self.levels[-1][:, 1].sum())

    @property
    def leaves(self) -> int:
        return len(self.levels[0])

    def find(self, offset: int) -> tuple[int, int]:
        """Leaf that holds character ``offset`` and where that leaf starts; the end has no leaf."""
        if offset >= self.chars:
            return self.leaves, self.chars
        at, start = 0, 0
        for level in reversed(self.levels[:-1]):
            at *= 2
            if offset - start >= level[at, 1]:
                start += int(level[at, 1])
                at += 1
        return at, start

    def replace(self, first: int, last: int, tokens: np.ndarray, chars: np.ndarray) -> None:
        """Put new leaves in place of ``first`` to ``last`` (exclusive).

        As many leaves as before update only the sums above them; otherwise the
        leaves after them move, and the sums from there on are added anew.
        """
        new = np.stack([tokens, chars], axis=1).astype(np.int64).reshape(-1, 2)
        if len(new) == last - first and len(new):
            self.levels[0][first:last] = new
            lo, hi = first, last - 1
            for below, level in zip(self.levels, self.levels[1:]):
                lo, hi = lo // 2, hi // 2
                left, right = below[2 * lo:2 * hi + 2:2], below[2 * lo + 1:2 * hi + 2:2]
                level[lo:hi + 1] = left
                level[lo:lo + len(right)] += right
            return
        leaves = np.concatenate([self.levels[0][:first], new, self.levels[0][last:]])
        self.levels = [leaves]
        self._grow()


def apply_edit(text: str, tree: SegmentTree, start: int, length: int, insert: str, counter: Counter) -> tuple[str, int]:
    """Replace ``length`` characters at ``start`` by ``insert``; (new text, chunks re-encoded).

    Start and length are cut to the text.  The region is the touched chunks and
    one more on either side: white space moved to an edge can join a neighbour.
    """
    start = min(max(0, start), len(text))
    stop = min(len(text), start + max(0, length))
    first, _ = tree.find(start)
    last = tree.find(max(start, stop - 1))[0] + 1
    first, last = max(0, first - 1), min(tree.leaves, last + 1)
    before = text[:start] + insert + text[stop:]
    begin = _leaf_start(tree, first)
    end = _leaf_start(tree, last) + len(insert) - (stop - start)
    chunks = _CHUNK.findall(before[begin:end])
    tree.replace(first, last, np.fromiter(map(counter.__getitem__, chunks), np.int64, len(chunks)),
                 np.fromiter(map(len, chunks), np.int64, len(chunks)))
    return before, len(chunks)


def _leaf_start(tree: SegmentTree, leaf: int) -> int:
    """Characters before a leaf: sums of the left siblings on its way to the root."""
    if leaf >= tree.leaves:
        return tree.chars
    total, at = 0, leaf
    for level in tree.levels:
        if at % 2:
            total += int(level[at - 1, 1])
        at //= 2
    return total


_OUT = ("doc_id long, n_tokens long, n_chunks long, edited_tokens long, edited_chars long, reencoded_chunks long")


def count_with_edits(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text",
                     edits_col: str = "edits") -> DataFrame:
    """Token counts of each text before and after its edits.

    ``edits``: array of (start, length, insert), code points, applied in order,
    each to the text that the one before left; null or empty: none, and an edit
    with a null in it is skipped.  Returns doc_id, n_tokens, n_chunks,
    edited_tokens, edited_chars, reencoded_chunks.  A null text is empty;
    repeated rows are counted each; other columns are ignored.
    """
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(edits_col).cast("array<struct<start:bigint,length:bigint,insert:string>>").alias("edits"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(("tokens", ranks), lambda: Counter(ranks))
        for batch in batches:
            out = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                text = batch.column(1)[i].as_py() or ""
                tree = SegmentTree.of(text, counter)
                tokens, chunks, again = tree.tokens, tree.leaves, 0
                for edit in batch.column(2)[i].as_py() or ():
                    if edit is None or None in edit.values():
                        continue
                    text, n = apply_edit(text, tree, edit["start"], edit["length"], edit["insert"], counter)
                    again += n
                out.append((doc_id, tokens, chunks, tree.tokens, len(text), again))
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=[x.split()[0] for x in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)


def with_probe_edits(docs: DataFrame) -> DataFrame:
    """Two edits per document: its middle 24 code points become its first 40, and its first word's
    surroundings (8 code points from the second) become a blank and its last 12."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.char_length(text)
    edit = lambda start, length, insert: F.struct(
        start.cast("long").alias("start"), length.cast("long").alias("length"), insert.alias("insert"))
    return docs.select("doc_id", "text", F.array(
        edit(F.floor(n / 2), F.lit(24), F.substring(text, 1, 40)),
        edit(F.lit(1), F.lit(8), F.concat(F.lit(" "), F.right(text, F.lit(12))))).alias("edits"))
