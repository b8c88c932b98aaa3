"""Helpers shared by the operators: tables in the shared folder, word hashes,
a distributed Bloom filter and distributed union-find."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsight.session import checkpoint_dir

#: Entries a task-local memo may hold before it starts anew (bounds worker memory).
MEMO_ENTRIES = 400_000
#: Words longer than this are computed each time and not kept in a memo.
MEMO_WORD_BYTES = 64


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def in_small_batches(df: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """``df``, with the session's Arrow batches bounded by bytes, as texts differ widely in length.

    A worker then holds a few MB of texts at a time, whatever their number.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(key, str(batch_bytes))
    return df


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage like a reliable checkpoint: a lost executor costs a
    reread, not a recomputation, and row-order dependent values stay fixed.
    ``options`` go to the writer.
    """
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total UTF-8 bytes of a text column (one partial aggregate)."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)


def parts(total_bytes: int, each: int) -> int:
    """How many parts of about ``each`` bytes hold ``total_bytes``."""
    return max(1, -(-total_bytes // each))


class Memo(dict):
    """``memo[word]`` computes a missing word once; bounded, forgets all when full."""

    def __init__(self, compute: Callable[[bytes], object], limit: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= MEMO_WORD_BYTES:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def per_process(key: tuple, make: Callable[[], object]):
    """``make()`` once per Python worker; later tasks of the worker find it again.

    A worker holds one such thing: another key drops what was held and gives
    its memory back.
    """
    held = sys.modules.setdefault("_reelsight_llm_held", types.ModuleType("_reelsight_llm_held"))
    if key not in held.__dict__:
        held.__dict__.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):      # a libc without it keeps the memory
            ctypes.CDLL(None).malloc_trim(0)
        held.__dict__[key] = make()
    return held.__dict__[key]


def word_hashes() -> Memo:
    """Memo of 64-bit hashes of words; a miss is cheap, so it is small."""
    return Memo(xxhash.xxh3_64_intdigest, 150_000)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer over uint64."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a word-hash sequence.

    A shorter, non-empty sequence is one shingle; an empty one has none.
    """
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i:i + n]) * _ODD[i % len(_ODD)]
        out ^= out >> np.uint64(31)
    return np.unique(mix64(out))


def word_shingles(text: bytes, memo: Memo, k: int) -> np.ndarray:
    """Shingle hashes of a text: A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split()
    return shingle_hashes(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), k)


# ---------------------------------------------------------------- Bloom filter

BLOOM_BITS = 1 << 26          # 8 MB whatever the input; fuller filters only let more rows through
_PAGE = 1 << 16


def _bloom_positions(keys: np.ndarray) -> np.ndarray:
    k = keys.astype(np.uint64, copy=False)
    first, second = mix64(k), mix64(k ^ _ODD[5])
    return np.concatenate([first, second, first + second, first + second + second]) & np.uint64(BLOOM_BITS - 1)


def build_bloom(keys: DataFrame) -> np.ndarray:
    """Bloom filter of the single long column of ``keys``, as a bit array of 8 MB.

    Every task fills its own bits; pages of 64 kB are OR-ed by page number, so
    the driver receives at most ``BLOOM_BITS`` bits.
    """
    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            at = _bloom_positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64),
                             np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        pages = bits.reshape(-1, _PAGE)
        for i in np.flatnonzero(pages.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"page": pa.array([i], pa.int32()),
                                              "bits": pa.array([pages[i].tobytes()], pa.binary())})

    def either(table: pa.Table) -> pa.Table:
        bits = np.zeros(_PAGE, np.uint8)
        for b in table.column("bits"):
            bits |= np.frombuffer(b.as_py(), np.uint8)
        return pa.table({"page": table.column("page").slice(0, 1),
                         "bits": pa.array([bits.tobytes()], pa.binary())})

    schema = "page int, bits binary"
    merged = keys.mapInArrow(fill, schema).groupBy("page").applyInArrow(either, schema)
    out = np.zeros((BLOOM_BITS // 8 // _PAGE, _PAGE), np.uint8)
    for row in merged.collect():
        out[row.page] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys may be in the filter (never misses a member)."""
    at = _bloom_positions(keys)
    hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return hit.reshape(4, -1).all(axis=0)


# ---------------------------------------------------------------- union-find

class Forest:
    """Union-find over hashable, ordered nodes; roots are the smallest members."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of one partition by a spanning star forest."""
    forest, kind = Forest(), None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    nodes = [x for x in forest.parent if forest.find(x) != x]
    for i in range(0, len(nodes), 50_000):
        some = nodes[i:i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([forest.find(x) for x in some], kind)],
                                         names=["a", "b"])


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, component = the smallest node reachable.

    Distributed union-find: each partition first contracts its own edges to
    stars, then large-star and small-star rounds run until nothing changes.
    Every step is an aggregate with a partial side and a join whose sides are
    stored tables, so adaptive execution can split a hub.  Nodes without an
    edge to another node do not appear.  Null ends are ignored.
    """
    kind = edges.select("a").schema[0].dataType.simpleString()
    schema = f"a {kind}, b {kind}"
    e = materialise(edges.select("a", "b").where("a != b").mapInArrow(_contract, schema), "edges")
    stamp = _stamp(e)
    while stamp[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m"))
                          .select("a", F.least("a", "m").alias("m")), "low")
        large = materialise(both.join(low, "a").where("b > a")
                            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        e = materialise(large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _stamp(e)
        if now == stamp:
            break
        stamp = now
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, wherever ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blank(text: Column) -> Column:
    """Text with null as empty."""
    return F.coalesce(text, F.lit(""))
