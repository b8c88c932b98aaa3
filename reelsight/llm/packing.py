"""Packing token sequences: first-fit decreasing with a tournament tree of bin
capacities, run independently in randomised groups of documents.

A document's full-length pieces are sequences by themselves and are numbered
where they are made; only its remainder, shorter than a sequence, enters a
group.  Groups are drawn at random per piece, so a hot source or a group of
copies spreads over all of them, and each is packed by one task call, which
joins the ids of its pieces to sequences.  All sequences stand in the shared
folder; lengths, offsets and checksums of pieces are taken from there.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsight.llm.common import MEMO_WORD_BYTES, in_small_batches, materialise, parts, per_process

MAX_TOKENS = 4096
END_ID = 2
SLICE_BYTES = 1 << 20           # texts whose new words are encoded together
MEMO_WORDS = 300_000            # encoded words a task holds, and as many older ones
GROUP_PIECES = 32_768           # remainders packed together
GROUP_BYTES = 48 << 20          # ids packed together
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"

_WIDE = re.compile(r"[^\x00-\xff]")
#: Words of these letters alone are one pre-token, which the tokenizer's normalizer leaves as it is.
_LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
#: A step of 2 between two bytes of a text is a letter and a mark behind it, which are pre-tokens of their own.
_STEPS = np.zeros(256, np.uint8)
_STEPS[ord("a"):ord("z") + 1] = 1
_STEPS[list(b".,!?;:")] = 3


def _parted(text: bytes) -> bytes:
    """The text with a space between each letter (a to z) and the mark behind it."""
    held = np.frombuffer(text, np.uint8)
    steps = _STEPS[held]
    at = np.flatnonzero(steps[1:] - steps[:-1] == 2)
    return np.insert(held, at + 1, ord(" ")).tobytes() if len(at) else text


def _joined(held: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of ``held`` that begin there and have those sizes, side by side."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return held[np.repeat(begin - (ends - size), size) + np.arange(total)]


class WordTable(dict):
    """Numbers of words, in the order in which they are first asked for, and the ids of each number."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []              # numbered, but without ids as yet
        self.numbers = 0
        self.ids, self.begin, self.size = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.numbers
        self.numbers += 1
        self.new.append(word)
        return number

    def learn(self, ids: np.ndarray, size: np.ndarray) -> None:
        """The ids of the new words, side by side, and how many each has."""
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        for w in self.new:
            if len(w) > MEMO_WORD_BYTES:
                del self[w]
        self.new = []


class WordTokenizer:
    """Ids of whole texts, word by word; each distinct word is encoded once while it is held.

    A text can be cut at ASCII white space without changing its ids: the
    tokenizer drops white space and no token crosses it.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.memo_words = memo_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, before = self.tokenizer.model, self.tokenizer.pre_tokenizer
        letters = filter(_LETTERS.match, map(chr, range(256)))
        self.alphabet = {ord(c): before.pre_tokenize_str(c)[0][0] for c in letters}
        self.memo = WordTable()
        self.older = WordTable()                # the memo before; words still in use move over

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, side by side, and how many each has: they are encoded as one text and told apart by offsets."""
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        offsets = np.fromiter(chain.from_iterable(got.offsets), np.int64)[::2]
        at = np.searchsorted(offsets, np.concatenate([[0], np.cumsum(size)]))
        return np.array(got.ids, "<u4"), np.diff(at)

    def encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that are one pre-token each (``_LETTERS``), which go straight to the tokenizer's model."""
        tokenize, alphabet = self.model.tokenize, self.alphabet
        ids = [[t.id for t in tokenize(w.translate(alphabet))] for w in words]
        return np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids))

    def words(self, text: str) -> list[bytes]:
        # Up to U+00FF nothing composes and lower case goes letter by letter, as in the tokenizer;
        # its special tokens hold "<|" and keep their case.
        if "<|" not in text and (text.isascii() or not _WIDE.search(text)):
            return _parted(text.lower().encode()).split()
        return text.encode().split()

    def learn(self) -> None:
        """Find the ids of the words that are new in the memo, in the older one or by encoding them."""
        new, older = self.memo.new, self.older
        number = np.fromiter((older.get(w, -1) for w in new), np.int64, len(new))
        plain, others = [], []
        for i in np.flatnonzero(number < 0).tolist():
            word = new[i].decode()
            (plain if _LETTERS.fullmatch(word) else others).append((i, word))
        unseen = [i for i, _ in plain + others]
        some = [[w for _, w in others[i:i + 4096]] for i in range(0, len(others), 4096)]
        ids, size = map(np.concatenate, zip((older.ids, older.size), self.encode_letters([w for _, w in plain]),
                                            *map(self.encode, some)))
        number[unseen] = len(older.size) + np.arange(len(unseen))
        self.memo.learn(_joined(ids, (np.cumsum(size) - size)[number], size[number]), size[number])

    def all_ids(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text; words that are new in any of them are encoded together."""
        memo = self.memo
        if memo.numbers >= self.memo_words or len(memo.ids) >= 8 * self.memo_words:
            self.older, self.memo = memo, WordTable()
            memo = self.memo
        number = memo.__getitem__
        numbers = [np.fromiter(map(number, words), np.int32, len(words)) for words in map(self.words, texts)]
        if memo.new:
            self.learn()
        for some in numbers:
            yield _joined(memo.ids, memo.begin[some], memo.size[some])

    def ids(self, text: str) -> np.ndarray:
        return next(self.all_ids([text]))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``SLICE_BYTES`` of texts (the second column), or one longer text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
    borders = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SLICE_BYTES)) + 1
    for first, last in zip([0, *borders.tolist()], [*borders.tolist(), batch.num_rows]):
        yield batch.slice(first, last - first)


_PIECE = "doc_id long, start long, doc_tokens long, ids binary, sequence_id long, draw long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()),
                          ("ids", pa.binary()), ("sequence_id", pa.int64()), ("draw", pa.int64())])


def _pieces(path: str, max_tokens: int, end_id: int, seed: int, memo_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = per_process(("words", path, memo_words), lambda: WordTokenizer(path, memo_words))
        part, made = TaskContext.get().partitionId(), 0
        draw = random.Random(f"{seed}/{part}")
        end = np.array([end_id], "<u4")
        for batch in (some for whole in batches for some in _slices(whole)):
            rows: list[tuple] = []
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.all_ids(texts)):
                ids = np.concatenate([ids, end])
                for start in range(0, len(ids), max_tokens):
                    piece = ids[start:start + max_tokens]
                    full = len(piece) == max_tokens
                    made += full
                    rows.append((doc_id, start, len(ids), piece.tobytes(),
                                 (1 << 62) + (part << 38) + made if full else None, draw.getrandbits(62)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_PIECE_ARROW), _PIECE_ARROW.types)],
                schema=_PIECE_ARROW)
    return run


class CapacityTree:
    """Tournament tree over bins: each inner node holds the largest room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room; (bin, room that it had)."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] = had - size
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return leaf, had


def first_fit_decreasing(lengths: np.ndarray, max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces are taken by falling length, ties in order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree = CapacityTree(len(lengths), max_tokens)
    for i in order.tolist():
        size = int(lengths[i])
        bins[i], had = tree.place(size)
        offsets[i] = max_tokens - had
    return bins, offsets


_SEQUENCE = "sequence_id long, ids binary, doc_ids array<long>, starts array<long>, offsets array<long>, doc_tokens array<long>"
_SEQUENCE_ARROW = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary())] + [
    (c, pa.list_(pa.int64())) for c in ("doc_ids", "starts", "offsets", "doc_tokens")])


def _assemble(max_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        """The sequences of one group: the ids of its pieces, joined."""
        per_process(("sequences",), dict)       # gives back the memory of the memo of words
        # The order of arrival may differ between attempts of a task; the packing must not.
        order = pc.sort_indices(table.select(["draw", "doc_id", "start"]), sort_keys=[
            ("draw", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]).to_numpy()
        pieces = table.column("ids").combine_chunks()
        lengths = pc.binary_length(pieces).to_numpy(zero_copy_only=False)[order] // 4
        bins, offsets = first_fit_decreasing(lengths, max_tokens)
        place = np.lexsort((offsets, bins))
        pieces = pieces.take(pa.array(order[place]))
        # Pieces now lie side by side, so a sequence is the bytes between two of their borders.
        first = np.flatnonzero(np.diff(bins[place], prepend=-1))
        borders = np.concatenate([first, [len(place)]]).astype(np.int32)
        _, ends, data = pieces.buffers()
        ids = pa.Array.from_buffers(pa.binary(), len(first), [
            None, pa.py_buffer(np.frombuffer(ends, np.int32)[pieces.offset + borders].tobytes()), data])

        def listed(column: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(borders), column)

        doc_ids, starts, doc_tokens = (table.column(c).combine_chunks().take(pa.array(order[place]))
                                       for c in ("doc_id", "start", "doc_tokens"))
        group = table.column("group")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array(bins[place][first] + (group << 24)), ids, listed(doc_ids), listed(starts),
             listed(pa.array(offsets[place])), listed(doc_tokens)], schema=_SEQUENCE_ARROW)
    return run


def pack_sequences(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
                   max_tokens: int = MAX_TOKENS, end_id: int = END_ID, group_pieces: int = GROUP_PIECES,
                   seed: int = 7, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Pack all documents into sequences of at most ``max_tokens`` ids, stored in the shared folder.

    One row per sequence: sequence_id, ids (little-endian unsigned 32-bit) and,
    for each piece in order, doc_ids, starts (in the document), offsets (in the
    sequence) and doc_tokens.  A piece ends where the next one, or else the
    sequence, does.  A document is its ids and ``end_id``; a null or empty text is
    ``end_id`` alone; a longer document is cut every ``max_tokens`` ids.  At most
    about ``group_pieces`` remainders, and ``GROUP_BYTES`` of ids, are packed
    together.  ``memo_words``, and the words of ``SLICE_BYTES`` of texts, bound a
    worker's memory of encoded words and change no result.  Repeated rows are packed once each; null ids stay null.
    Other columns are ignored; an empty table gives an empty result.
    """
    texts = in_small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                         F.col(text_col).cast("string").alias("text")))
    made = materialise(texts.mapInArrow(_pieces(tokenizer, max_tokens, end_id, seed, memo_words), _PIECE),
                       "token-pieces", compression="zstd")
    # A full piece is a sequence, and stands in the shared folder already.
    full = made.where("sequence_id is not null").select("sequence_id", "ids", *(
        F.array(c).alias(name) for c, name in (("doc_id", "doc_ids"), ("start", "starts"),
                                               (F.lit(0).cast("long"), "offsets"), ("doc_tokens", "doc_tokens"))))
    rest = made.where("sequence_id is null")
    pieces, tokens = rest.agg(F.count("*"), F.sum(F.col("doc_tokens") - F.col("start"))).first()
    groups = max(parts(pieces, group_pieces), parts(4 * (tokens or 0), GROUP_BYTES))
    packed = rest.drop("sequence_id").withColumn("group", F.expr(f"pmod(draw, {groups})")).groupBy("group").applyInArrow(
        _assemble(max_tokens), _SEQUENCE)
    return full.unionAll(materialise(packed, "sequences", compression="zstd"))


def _read_back(keep_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, (sequence, doc_ids, starts, offsets, doc_tokens) in enumerate(
                    zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)))):
                ids = batch.column(1)[i].as_py()
                for doc_id, start, at, end, whole in zip(
                        doc_ids, starts, offsets, [*offsets[1:], len(ids) // 4], doc_tokens):
                    piece = ids[4 * at:4 * end]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), whole, piece if keep_ids else None,
                                 sequence, at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_PACKED_ARROW), _PACKED_ARROW.types)],
                schema=_PACKED_ARROW)
    return run


_PACKED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, "
           "sequence_id long, offset long")
_PACKED_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [
    ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pieces_of(sequences: DataFrame, keep_ids: bool = True) -> DataFrame:
    """One row per piece of ``sequences``, cut out of the sequence's ids.

    doc_id, start, length, ids_crc32, doc_tokens, ids (null without
    ``keep_ids``), sequence_id, offset (gapless from 0 within the sequence).
    """
    return in_small_batches(sequences).mapInArrow(_read_back(keep_ids), _PACKED)


def pack_documents(docs: DataFrame, *args, keep_ids: bool = True, **options) -> DataFrame:
    """The pieces (``pieces_of``) of the documents, packed and stored by ``pack_sequences``."""
    return pieces_of(pack_sequences(docs, *args, **options), keep_ids)


def assemble_sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)`` of packed pieces that carry their ids."""
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.expr("aggregate(array_sort(collect_list(struct(offset, ids))), binary(''), (s, p) -> s || p.ids)").alias("ids"))
