"""N-gram Jaccard join of documents by signature trees.

Two documents link when the Jaccard similarity of their sets of 5-word
shingles reaches 75 percent.  All links count, not a sample:

1. One pass over the texts makes the shingle sets.  Documents travel in batches;
   a batch sends its distinct shingles, packed, to the bucket that owns them.
2. A bucket finds the shingles that occur in more than one set and how often,
   and returns only those.  A shingle in a single set can link nothing, so a
   set's size and its shared shingles decide every similarity exactly.
3. Equal sets become one class.  Sets that can link share a shingle among the
   first ``n - ceil(0.75 n) + 1`` of each, rarest first; classes that meet
   there, directly or over others, form a candidate component.
4. Each candidate component is joined by signature trees (``setjoin``), and the
   links are closed by distributed union-find.

A hot shingle costs one entry per batch, not one per document; a component that
outgrows a task is cut into chunk pairs.  Shingles are compared by the bucket, which
the top of their 64-bit hash gives, and the low 48 bits.  Entries travel as steps
between sorted hashes, and a shared shingle returns as a number within its bucket;
numbers are laid out byte by byte, so that their empty bytes compress to nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsight.llm.common import (connected_components, in_small_batches, materialise, parts, per_process, text_bytes,
                                  word_hashes, word_shingles)
from reelsight.llm.setjoin import linked

BATCH_SHINGLES = 250_000     # entries gathered before a batch is sent
BATCH_CLASSES = 1 << 16        # its sets are numbered by 16 bits
BUCKET_TEXT_BYTES = 4 << 20   # text whose shingles one bucket owns

_SENT = ("bucket int, batch string, single binary, shared binary, counts binary, "
         "doc_ids array<long>, doc_class array<int>, class_key array<binary>, class_size array<int>, "
         "shared_at array<int>, shared_class array<int>")
_SENT_ARROW = pa.schema([
    ("bucket", pa.int32()), ("batch", pa.string()), ("single", pa.binary()), ("shared", pa.binary()),
    ("counts", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_class", pa.list_(pa.int32())),
    ("class_key", pa.list_(pa.binary())), ("class_size", pa.list_(pa.int32())),
    ("shared_at", pa.list_(pa.int32())), ("shared_class", pa.list_(pa.int32()))])
_LOW48 = np.uint64((1 << 48) - 1)
_BITS16, _BITS24 = np.uint64(16), np.uint64(24)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as bytes: the lowest byte of all, then the next one."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _steps(entries: np.ndarray) -> bytes:
    """Entries (48 bits of a hash and 16 bits) with each hash as the step from the one before, modulo 2^48.

    They come sorted by the whole hash; steps are small where a bucket owns less than 2^48 hashes.
    """
    hashes = entries >> _BITS16
    return planes(np.diff(hashes, prepend=np.uint64(0)) << _BITS16 | entries & np.uint64(0xFFFF))


def _from_steps(data: bytes) -> np.ndarray:
    entries = from_planes(data, np.uint64)
    return np.cumsum(entries >> _BITS16, dtype=np.uint64) << _BITS16 | entries & np.uint64(0xFFFF)


def _rarity(sets: np.ndarray) -> np.ndarray:
    """How many sets hold a shingle, on a scale of 8 steps to a doubling that fits a byte."""
    return np.minimum(8 * np.log2(sets), 255).astype(np.uint64)


class _Batch:
    """Documents on their way to the buckets."""

    def __init__(self, name: str, buckets: int):
        self.name, self.buckets = name, buckets
        self.doc_ids, self.doc_class, self.sets, self.keys, self.by_key, self.entries = [], [], [], [], {}, 0

    def add(self, doc_id, shingles: np.ndarray) -> None:
        at = -1
        if len(shingles):
            key = xxhash.xxh3_128_digest(shingles.tobytes())
            at = self.by_key.get(key)
            if at is None:
                at = self.by_key[key] = len(self.sets)
                self.sets.append(shingles)
                self.keys.append(key)
                self.entries += len(shingles)
        self.doc_ids.append(doc_id)
        self.doc_class.append(at)

    def full(self) -> bool:
        return self.entries >= BATCH_SHINGLES or len(self.sets) >= BATCH_CLASSES - 1 or len(self.doc_ids) >= 1 << 18

    def rows(self) -> Iterator[dict]:
        """The shingles by bucket, then one row that keeps the batch's documents.

        An entry holds 48 bits of the hash and, in 16 bits, the class; a
        shingle of several classes of the batch is sent once with its count,
        and its classes wait in the batch's own row, in order of the hash.
        """
        info = {"bucket": xxhash.xxh32_intdigest(self.name) % self.buckets, "batch": self.name,
                "doc_ids": self.doc_ids, "doc_class": self.doc_class, "class_key": self.keys,
                "class_size": [len(s) for s in self.sets], "shared_at": [0], "shared_class": []}
        if self.sets:
            every = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets), dtype=np.uint64), [len(s) for s in self.sets])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            count = np.diff(np.append(start, len(every)))
            values, alone = every[start], count == 1
            bucket = ((values >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
            word = (values & _LOW48) << np.uint64(16)
            single, single_bucket = word[alone] | owner[start[alone]], bucket[alone]
            shared, shared_bucket, counts = word[~alone], bucket[~alone], count[~alone].astype(np.uint32)
            info["shared_class"] = owner[np.repeat(~alone, count)].astype(np.int32)
            info["shared_at"] = np.concatenate([[0], np.cumsum(count[~alone])]).astype(np.int32)
            for b in np.unique(bucket):
                s0, s1 = np.searchsorted(single_bucket, [b, b + np.uint64(1)])
                m0, m1 = np.searchsorted(shared_bucket, [b, b + np.uint64(1)])
                # A shared entry names its place among the batch's shared shingles through the offset.
                yield {"bucket": int(b), "batch": self.name, "single": _steps(single[s0:s1]),
                       "shared": _steps(shared[m0:m1]), "counts": planes(counts[m0:m1]),
                       "shared_at": [int(m0)]}
        yield info


def _send(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, n = per_process(("words",), word_hashes), TaskContext.get().partitionId(), 0
        held = _Batch(f"{part}-{n}", buckets)

        def out() -> Iterator[pa.RecordBatch]:
            for row in held.rows():
                yield pa.RecordBatch.from_pylist([row], schema=_SENT_ARROW)

        for batch in batches:
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                held.add(doc_id, word_shingles(texts[i].as_py() or b"", memo, 5))
                if held.full():
                    yield from out()
                    n += 1
                    held = _Batch(f"{part}-{n}", buckets)
        if held.doc_ids:
            yield from out()
    return run


_BACK = ("batch string, bucket int, refs binary, ids binary, shared_ids binary, shared_first int, "
         "doc_ids array<long>, doc_class array<int>, class_key array<binary>, class_size array<int>, "
         "shared_at array<int>, shared_class array<int>")
_BACK_ARROW = pa.schema([("batch", pa.string()), ("bucket", pa.int32())] + [
    (c, pa.binary()) for c in ("refs", "ids", "shared_ids")] + [("shared_first", pa.int32())] + [
    _SENT_ARROW.field(c) for c in ("doc_ids", "doc_class", "class_key", "class_size", "shared_at", "shared_class")])
_INFO = ["doc_ids", "doc_class", "class_key", "class_size", "shared_at", "shared_class"]


def _frequencies(table: pa.Table) -> pa.Table:
    """In one bucket: how many sets hold each shingle; rows back to the batches for those in several.

    Such a shingle returns as 8 bits of rarity over 24 bits that number it in its bucket.
    """
    bucket, out = table.column("bucket")[0].as_py(), []
    words, weights, sources, names, shared_from = [], [], [], [], []
    kept = []
    for row in range(table.num_rows):
        if table.column("doc_ids")[row].as_py() is not None:
            kept.append({c: table.column(c)[row].as_py() for c in ["batch", *_INFO]})
            continue
        single = _from_steps(table.column("single")[row].as_py())
        shared = _from_steps(table.column("shared")[row].as_py())
        count = from_planes(table.column("counts")[row].as_py(), np.uint32)
        words += [single, shared]
        weights += [np.ones(len(single), np.int64), count.astype(np.int64)]
        sources += [np.full(len(single) + len(shared), len(names), np.int64)]
        names.append(table.column("batch")[row].as_py())
        shared_from.append((len(single), table.column("shared_at")[row].as_py()[0]))
    if words:
        word, weight, source = np.concatenate(words), np.concatenate(weights), np.concatenate(sources)
        del words, weights, sources
        low = word >> _BITS16
        order = np.argsort(low)
        new = np.ones(len(low), bool)
        new[1:] = np.diff(low[order]) != 0
        total = np.add.reduceat(weight[order], np.flatnonzero(new))
        several = total > 1
        number = np.cumsum(several) - 1
        if several.sum() > 1 << 24:
            raise ValueError("a bucket numbers its shared shingles by 24 bits: lower BUCKET_TEXT_BYTES")
        code = np.where(several, (_rarity(total) << _BITS24) | number.astype(np.uint64), np.uint64(0)).astype(np.uint32)
        at = np.cumsum(new) - 1
        back, often = np.empty(len(low), np.uint32), np.empty(len(low), bool)
        back[order], often[order] = code[at], several[at]
        del order, new, weight, at, low
        begin = np.searchsorted(source, np.arange(len(names) + 1))
        for k, name in enumerate(names):
            lo, hi = begin[k], begin[k + 1]
            mid = lo + shared_from[k][0]
            pick = lo + np.flatnonzero(often[lo:mid])
            out.append({"batch": name, "bucket": bucket,
                        "refs": planes((word[pick] & np.uint64(0xFFFF)).astype(np.uint16)), "ids": planes(back[pick]),
                        "shared_ids": planes(back[mid:hi]), "shared_first": shared_from[k][1]})
    return pa.Table.from_pylist(out + kept, schema=_BACK_ARROW)


_PROFILE = "key binary, size int, tokens binary, doc_ids array<long>"
_PROFILE_ARROW = pa.schema([("key", pa.binary()), ("size", pa.int32()), ("tokens", pa.binary()),
                            ("doc_ids", pa.list_(pa.int64()))])


def _numbered(codes: np.ndarray, bucket: int) -> np.ndarray:
    """64 bits for a shingle: its rarity, so that the rarest sort first, its bucket and its number there."""
    codes = codes.astype(np.uint64)
    return (codes >> _BITS24) << np.uint64(56) | np.uint64(bucket) << _BITS24 | codes & np.uint64((1 << 24) - 1)


def _profiles(table: pa.Table) -> pa.Table:
    """In one batch: each set's shared shingles, rarest first, with its documents."""
    ref, ids = [], []
    rows = table.to_pylist()
    info = next(r for r in rows if r["doc_ids"] is not None)
    at, of = np.array(info["shared_at"], np.int64), np.array(info["shared_class"], np.int64)
    for r in rows:
        if r["doc_ids"] is not None:
            continue
        ref.append(from_planes(r["refs"], np.uint16).astype(np.int64))
        ids.append(_numbered(from_planes(r["ids"], np.uint32), r["bucket"]))
        shared, first = from_planes(r["shared_ids"], np.uint32), r["shared_first"]
        if len(shared):
            size = np.diff(at[first:first + len(shared) + 1])
            ref.append(of[at[first]:at[first + len(shared)]])
            ids.append(np.repeat(_numbered(shared, r["bucket"]), size))
    classes = len(info["class_key"])
    docs: list = [[] for _ in range(classes)]
    bare = []
    for doc_id, c in zip(info["doc_ids"], info["doc_class"]):
        (docs[c] if c >= 0 else bare).append(doc_id)
    tokens = [b""] * classes
    if ref and classes:
        ref_, ids_ = np.concatenate(ref), np.concatenate(ids)
        order = np.lexsort((ids_, ref_))
        cut = np.searchsorted(ref_[order], np.arange(classes + 1))
        ids_ = ids_[order]
        tokens = [planes(ids_[cut[i]:cut[i + 1]]) for i in range(classes)]
    out = [{"key": info["class_key"][i], "size": info["class_size"][i], "tokens": tokens[i], "doc_ids": docs[i]}
           for i in range(classes)]
    if bare:
        out.append({"key": None, "size": 0, "tokens": b"", "doc_ids": bare})
    return pa.Table.from_pylist(out, schema=_PROFILE_ARROW)


def _prefix(percent: int):
    """Per class: its rarest shared shingles, as many as a link cannot avoid."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, node = [], []
            for key, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = from_planes(blob, np.int64)
                # The size - len(ids) unshared shingles come first in the order.
                take = n - -(-percent * n // 100) + 1 - (n - len(ids))
                if take > 0:
                    token.append(ids[:take])
                    node += [key] * len(ids[:take])
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(node, pa.binary())],
                                                 names=["token", "node"])
    return run


def _elements(payload: bytes) -> np.ndarray:
    return from_planes(payload, np.uint64)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row.

    A-Z are lower-cased and words are runs without ASCII white space; a text of
    one to four words is one shingle, a text without words (or null) has none
    and links with nothing, so its component is its own id.  Repeated rows and
    equal texts link; the component is the smallest id reachable.  Null ids take
    part, but never name a component: a component with null ids only is null.
    Other columns of ``docs`` are ignored.  An empty table gives an empty result.
    """
    texts = in_small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                         F.col(text_col).cast("binary").alias("text")))
    buckets = parts(text_bytes(docs, text_col), BUCKET_TEXT_BYTES)
    sent = texts.mapInArrow(_send(buckets), _SENT)
    back = sent.groupBy("bucket").applyInArrow(_frequencies, _BACK)
    profiles = materialise(back.groupBy("batch").applyInArrow(_profiles, _PROFILE), "profiles", compression="zstd")

    classes = materialise(profiles.where("key is not null").select(
        "key", "size", "tokens", F.array_min("doc_ids").alias("first")).groupBy("key").agg(
        F.max("size").alias("size"), F.max("tokens").alias("tokens"), F.min("first").alias("first")), "classes", compression="zstd")
    entries = materialise(classes.select("key", "size", "tokens").mapInArrow(
        _prefix(percent), "token long, node binary"), "prefixes", compression="zstd")
    meet = entries.groupBy("token").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    edges = entries.join(meet.select("token", "a"), "token").where("node != a").select("a", F.col("node").alias("b"))
    candidates = connected_components(edges)

    members = classes.join(candidates, classes["key"] == candidates["node"]).select(
        "node", "component", "size", F.col("tokens").alias("payload"))
    labels = connected_components(linked(materialise(members, "members", compression="zstd"), _elements, percent))

    named = classes.select("key", "first").join(labels, classes["key"] == labels["node"], "left").select(
        "key", "first", F.coalesce("component", "key").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").select(F.col("key").alias("class"), "component_id")
    rows = profiles.select("key", "size", F.explode("doc_ids").alias("doc_id"))
    return rows.join(named, rows["key"] == named["class"], "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           percent: int = 75) -> DataFrame:
    """The rows of ``docs``, one for each component: that with the smallest id.

    All columns stay.  Every row is a document of its own, also where rows repeat an
    id: of rows with one id and texts that don't link, each stays, and rows without
    words link with nothing and stay.  Rows with a null id stay too.
    """
    named = docs.where(F.col(id_col).isNotNull())
    alone = docs.where(F.col(id_col).isNull())
    if named.groupBy(id_col).count().where("count > 1").isEmpty():
        found = ngram_components(docs, id_col, text_col, percent)
        keep = materialise(found.where("doc_id = component_id").select(F.col("doc_id").alias("__keep")), "keep")
        return docs.join(keep, docs[id_col] == keep["__keep"], "left_semi").unionByName(alone)
    # Ids don't tell the rows apart, so the rows are numbered, once and for all, in a stored table.
    row = next(name for name in ("__row", "__row_number", "__number_of_row") if name not in docs.columns)
    rows = materialise(named.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = ngram_components(rows, row, text_col, percent).select(F.col("doc_id").alias("__at"), "component_id")
    first = found.join(rows.select(F.col(row).alias("__at"), F.col(id_col).alias("__id")), "__at").groupBy(
        "component_id").agg(F.min(F.struct("__id", "__at")).alias("__first"))
    keep = materialise(first.select(F.col("__first.__at").alias("__keep")), "keep")
    return rows.join(keep, rows[row] == keep["__keep"], "left_semi").drop(row).unionByName(alone)
