"""Centroid clustering: dimension-sharded Lloyd rounds in whole numbers.

The vectors are cut twice: into chunks of rows and, within a chunk, into blocks
of columns.  A block never meets the other columns of its vectors:

1. A block task sees its columns and the same slice of every centroid, and
   computes exact partial distances.
2. The partial distances of a chunk are added over its blocks by key, and each
   vector takes the nearest centroid.
3. A block task sums its columns by the labels of its chunk; the sums are added
   by (cluster, column), and each slice is replaced by its own means.

The blocks are stored once, bucketed by chunk, so that a round moves partial
distances, labels and sums, but not the vectors.  Labels of each round are stored
in the shared folder.  The driver holds the centroids (clusters x dimensions).
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsight.llm.common import in_small_batches, materialise, parts, scratch

DIMENSIONS, CLUSTERS, ROUNDS = 64, 8, 10
SCALE, SEED = 1024, 3
BLOCK_COLUMNS = 16
CHUNK_ROWS = 4096
BUCKET_CHUNKS = 32               # chunks stored in one bucket, about
_NARROW = 1 << 27                # below this, squared distances over some dozens of columns fit 64 bits


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 dimensions: int = DIMENSIONS) -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows with exactly ``dimensions`` finite components."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") == dimensions) & fine)


def whole(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * v) as int64; beyond 64 bits an OverflowError."""
    out = np.floor(scale * v)
    if out.size and np.abs(out).max() >= 2.0**63:
        raise OverflowError("a component does not fit 64 bits")
    return out.astype(np.int64)


_BLOCK = "chunk string, block int, ids array<long>, data binary"
_BLOCK_ARROW = pa.schema([("chunk", pa.string()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())),
                          ("data", pa.binary())])


def _cut(dimensions: int, width: int, scale: int):
    """Chunks of vectors, one row per block of columns; block 0 also keeps the ids."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                some = batch.slice(at, CHUNK_ROWS)
                x = whole(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions), scale)
                ids = some.column(0).to_pylist()
                rows = [{"chunk": f"{part}-{n}", "block": b, "ids": ids if b == 0 else None,
                         "data": np.ascontiguousarray(x[:, lo:lo + width]).tobytes()}
                        for b, lo in enumerate(range(0, dimensions, width))]
                n += 1
                yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK_ARROW)
    return run


def _exact(x: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The arrays, as Python integers where 64 bits might not do."""
    wide = any(a.size and max(-int(a.min()), int(a.max())) >= _NARROW for a in (x, *others))
    return [a.astype(object) if wide else a for a in (x, *others)]


def _columns(block: int, data: bytes, width: int, dimensions: int) -> tuple[slice, np.ndarray]:
    at = slice(block * width, min(dimensions, (block + 1) * width))
    return at, np.frombuffer(data, np.int64).reshape(-1, at.stop - at.start)


def _partial(centroids: np.ndarray, width: int):
    """Squared distances of each vector's columns in a block to the centroids' slices."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "block", "data"))):
                at, x = _columns(block, data, width, centroids.shape[1])
                x, c = _exact(x, centroids[:, at])
                d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "part": pa.array([d.astype(np.int64).tobytes()], pa.binary())})
    return run


def _nearest(k: int):
    """Add the partial distances of a chunk; label and distance of each vector (ties: smaller number)."""
    def run(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("part"):
            got = np.frombuffer(x.as_py(), np.int64).reshape(-1, k)
            total = got.copy() if total is None else total + got
            if (total < 0).any():
                raise OverflowError("a squared distance does not fit 64 bits")
        label = total.argmin(axis=1)
        return pa.table({"chunk": table.column("chunk").slice(0, 1),
                         "labels": pa.array([label.astype(np.int32).tobytes()], pa.binary()),
                         "distances": pa.array([total[np.arange(len(label)), label].tobytes()], pa.binary())})
    return run


_ASSIGNED = "chunk string, labels binary, distances binary"


def _sums(width: int, dimensions: int):
    """Sums of the task's vectors by (cluster, column), one row each; the number of vectors with column 0."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = defaultdict(int)
        counts: dict[int, int] = defaultdict(int)
        for batch in batches:
            for block, data, labels in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "labels"))):
                at, x = _columns(block, data, width, dimensions)
                label = np.frombuffer(labels, np.int32)
                x, = _exact(x)
                for c in np.unique(label).tolist():
                    own = x[label == c]
                    for j, s in enumerate(own.sum(axis=0).tolist(), at.start):
                        sums[c, j] += s
                    if block == 0:
                        counts[c] += len(own)
        rows = [{"cluster": c, "col": j, "total": str(s), "n": counts[c] if j == 0 else 0} for (c, j), s in sums.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("cluster", pa.int32()), ("col", pa.int32()), ("total", pa.string()), ("n", pa.int64())]))
    return run


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED, scale: int = SCALE) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:id``, in that order; ties by the components.

    Vectors without an id are never among them.
    """
    drawn = kept.where("vec_id is not null").withColumn(
        "draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = drawn.orderBy("draw", "v").limit(clusters).select("v").collect()     # one vector per cluster
    return np.stack([whole(np.array(r.v), scale) for r in rows]) if rows else np.zeros((0, 0), np.int64)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
                    scale: int = SCALE, block_columns: int = BLOCK_COLUMNS) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` per kept vector, and the centroids, after ``rounds`` rounds.

    A vector with a null or non-finite component, of another length, or null
    itself, is left out; components count as floor(scale * x).  With fewer kept
    vectors than ``clusters`` there are as many centroids as vectors with an id,
    and with none no row is returned.  Repeated rows count once each, a null id
    stays null, ties go to the smaller cluster number, and an empty cluster keeps
    its centroid.  Numbers that don't fit 64 bits are an error.  Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vector_col, dimensions)
    centroids = first_centroids(kept, clusters, seed, scale)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    cut = materialise(kept.mapInArrow(_cut(dimensions, block_columns, scale), _BLOCK), "vector-blocks")
    chunks = cut.where("block = 0").count()
    buckets, name = parts(chunks, BUCKET_CHUNKS), f"vector_blocks_{uuid.uuid4().hex}"
    cut.select("chunk", "block", "data").repartition(buckets, "chunk").write.bucketBy(buckets, "chunk").option(
        "path", scratch(spark, "vector-buckets")).saveAsTable(name)
    blocks = in_small_batches(spark.table(name))

    def assign() -> DataFrame:
        parted = blocks.mapInArrow(_partial(centroids, block_columns), "chunk string, part binary")
        return materialise(parted.groupBy("chunk").applyInArrow(_nearest(k), _ASSIGNED), "labels")

    for _ in range(rounds):
        labels = assign().select("chunk", "labels")
        summed = blocks.join(labels, "chunk").select("block", "data", "labels").mapInArrow(
            _sums(block_columns, dimensions), "cluster int, col int, total string, n long").groupBy("cluster", "col").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()   # clusters x dimensions
        members = {r.cluster: r.n for r in summed if r.col == 0}
        centroids = centroids.copy()
        for r in summed:
            centroids[r.cluster, r.col] = int(r.total) // members[r.cluster]
    found = assign()
    spark.sql(f"DROP TABLE {name}")

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (labels, distances) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, pa.array(np.frombuffer(labels, np.int32)),
                     pa.array(np.frombuffer(distances, np.int64))], names=["vec_id", "cluster", "distance"])

    rows = cut.where("block = 0").select("chunk", "ids").join(found, "chunk").select("ids", "labels", "distances")
    return rows.mapInArrow(explode, "vec_id long, cluster int, distance long"), centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """``cluster_vectors`` with, per row, ``cluster_inertia``, ``inertia`` (sums of the distances) and
    ``centroid_sha256`` (of the final components, joined by commas)."""
    found, centroids = cluster_vectors(vectors, **options)
    found = materialise(found, "clusters")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}     # one row per cluster
    rows = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c, s in sums.items()]
    about = vectors.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
