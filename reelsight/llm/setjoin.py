"""Exact set-similarity join inside candidate groups, by signature trees.

A group is a candidate component: sets that may be linked, found without loss
by the caller.  Groups too large for one task are cut into chunks by size band
and hash; every pair of chunks that may hold a link becomes a group of its own,
so nothing is capped.  Inside a group a signature tree is traversed against
itself (or another chunk's tree); node pairs are pruned by their size ranges,
by the largest overlap their OR-ed bitmaps allow, and when all their sets are
linked already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsight.llm.common import Forest, parts

LEAF, FAN_OUT = 8, 8


class Node:
    """Tree node: size range, OR of the bitmaps, largest excess of elements over bits."""

    __slots__ = ("lo", "hi", "bits", "excess", "kids", "rows", "count", "same")

    def __init__(self, kids=None, rows=None, sets=None):
        self.kids, self.rows, self.same = kids, rows, None
        if rows is not None:
            self.lo = min(sets.size[i] for i in rows)
            self.hi = max(sets.size[i] for i in rows)
            self.bits, self.excess, self.count = 0, max(sets.excess[i] for i in rows), len(rows)
            for i in rows:
                self.bits |= sets.bits[i]
        else:
            self.lo, self.hi = min(k.lo for k in kids), max(k.hi for k in kids)
            self.bits, self.excess = 0, max(k.excess for k in kids)
            self.count = sum(k.count for k in kids)
            for k in kids:
                self.bits |= k.bits

    def uniform(self, forest: Forest):
        """The common root of all sets below, or None while they differ."""
        if self.same is not None:
            return forest.find(self.same)
        if self.rows is not None:
            roots = {forest.find(i) for i in self.rows}
        else:
            roots = {k.uniform(forest) for k in self.kids}
        if len(roots) == 1 and None not in roots:
            self.same = roots.pop()
            return self.same
        return None


class Sets:
    """Sorted element arrays with total sizes (elements left out are in no other set)."""

    def __init__(self, size, elements):
        self.size, self.elements = size, elements
        width = 256
        while width < 2 * max(map(len, elements)) and width < 1 << 15:
            width *= 2
        self.bits, self.excess = [], []
        for e in elements:
            flags = np.zeros(width, bool)
            flags[(e & np.uint64(width - 1)).astype(np.int64)] = True
            self.bits.append(int.from_bytes(np.packbits(flags).tobytes(), "big"))
            self.excess.append(len(e) - int(flags.sum()))

    def tree(self, rows: list[int]) -> Node:
        """Neighbours in the tree have like sizes and like smallest elements."""
        order = sorted(rows, key=lambda i: (int(self.size[i]).bit_length(), self.elements[i][:2].tolist(), self.size[i]))
        level = [Node(rows=order[i:i + LEAF], sets=self) for i in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [Node(kids=level[i:i + FAN_OUT]) for i in range(0, len(level), FAN_OUT)]
        return level[0]


def spanning_links(sets: Sets, left: list[int], right: list[int] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links (100 * overlap >= percent * union) that connect all linked sets.

    ``right`` None: among ``left``; else only between the two sides.
    """
    forest = Forest()

    def far(x: Node, y: Node) -> bool:
        if 100 * x.hi < percent * y.lo or 100 * y.hi < percent * x.lo:
            return True
        most = min((x.bits & y.bits).bit_count() + min(x.excess, y.excess), x.hi, y.hi)
        return most * (100 + percent) < percent * (x.lo + y.lo)

    top = sets.tree(left)
    stack = [(top, top if right is None else sets.tree(right))]
    while stack:
        x, y = stack.pop()
        if far(x, y):
            continue
        root = x.uniform(forest)
        if root is not None and root == y.uniform(forest):
            continue
        if x.rows is not None and y.rows is not None:
            for at, i in enumerate(x.rows):
                for j in x.rows[:at] if x is y else y.rows:
                    a, b = sets.size[i], sets.size[j]
                    if 100 * min(a, b) < percent * max(a, b) or forest.find(i) == forest.find(j):
                        continue
                    most = (sets.bits[i] & sets.bits[j]).bit_count() + min(sets.excess[i], sets.excess[j])
                    if most * (100 + percent) < percent * (a + b):
                        continue
                    both = len(np.intersect1d(sets.elements[i], sets.elements[j], assume_unique=True))
                    if 100 * both >= percent * (a + b - both):
                        forest.join(i, j)
                        yield i, j
        elif x is y:
            stack.extend((a, b) for at, a in enumerate(x.kids) for b in x.kids[:at])
            stack.extend((a, a) for a in x.kids)
        elif x.rows is None and (y.rows is not None or x.count >= y.count):
            stack.extend((a, y) for a in x.kids)
        else:
            stack.extend((x, b) for b in y.kids)


def linked(members: DataFrame, elements, percent: int, chunk_bytes: int = 8 << 20,
           task_bytes: int = 24 << 20) -> DataFrame:
    """Verified links ``(a binary, b binary)`` between members of the same group.

    ``members``: node binary, component, size int (of the whole set), payload
    binary; one row per node.  ``elements(payload)`` gives the sorted distinct
    uint64 elements.  The links span every linked component of a group; links
    between sets that others connect already are left out.
    """
    m = members.select("node", "component", F.col("size").cast("long").alias("size"), "payload").withColumns({
        "band": F.floor(F.log(F.greatest("size", F.lit(1))) / float(np.log(100 / percent))).cast("int"),
        "bytes": F.octet_length("payload") + 64})
    totals = m.groupBy("component", "band").agg(F.sum("bytes").alias("bytes"))
    whole = totals.groupBy("component").agg(F.sum("bytes").alias("all"))
    # Components that fit one task stay whole; others are cut into chunks within their size bands.
    cuts = totals.join(whole, "component").select(
        "component", "band", F.when(F.col("all") <= chunk_bytes, F.lit(0))
        .otherwise(F.ceil(F.col("bytes") / chunk_bytes).cast("int")).alias("cuts"))
    chunks = cuts.where("cuts > 0").select("component", "band", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
                                           .alias("chunk"))
    x, y = chunks.alias("x"), chunks.alias("y")
    pairs = x.join(y, (F.col("x.component") == F.col("y.component"))
                   & (F.col("y.band") - F.col("x.band")).isin(0, 1)
                   & ((F.col("x.band") < F.col("y.band")) | (F.col("x.chunk") <= F.col("y.chunk")))) \
        .select(F.col("x.component").alias("component"), F.struct("x.band", "x.chunk").alias("l"),
                F.struct("y.band", "y.chunk").alias("r"))
    sides = pairs.select("component", F.col("l").alias("own"), "l", "r").unionAll(
        pairs.where("l != r").select("component", F.col("r").alias("own"), "l", "r"))
    placed = m.join(cuts, ["component", "band"])
    small = placed.where("cuts = 0").select(
        "node", "size", "payload", "component", F.lit(True).alias("left"), F.lit("").alias("part"))
    large = placed.where("cuts > 0").withColumn(
        "own", F.struct("band", F.expr("cast(pmod(xxhash64(node), cuts) as int)").alias("chunk"))) \
        .join(sides, ["component", "own"]).select(
        "node", "size", "payload", "component", (F.col("own") == F.col("l")).alias("left"),
        F.concat(F.to_json("l"), F.to_json("r")).alias("part"))
    tasks = parts(int(totals.agg(F.sum("bytes")).first()[0] or 0), task_bytes)
    placed = small.unionAll(large).withColumn("task", F.expr(f"pmod(xxhash64(component, part), {tasks})"))

    def join(table: pa.Table) -> pa.Table:
        groups: dict = {}
        for i, key in enumerate(zip(table.column("component").to_pylist(), table.column("part").to_pylist())):
            groups.setdefault(key, []).append(i)
        nodes, left = table.column("node").to_pylist(), table.column("left").to_pylist()
        size, payload = table.column("size").to_pylist(), table.column("payload")
        a, b = [], []
        for rows in groups.values():
            if len(rows) < 2:
                continue
            rows.sort(key=lambda i: nodes[i])
            sets = Sets([size[i] for i in rows], [elements(payload[i].as_py()) for i in rows])
            sides = [k for k, i in enumerate(rows) if left[i]], [k for k, i in enumerate(rows) if not left[i]]
            for i, j in spanning_links(sets, sides[0], sides[1] or None, percent) if sides[0] else ():
                a.append(nodes[rows[i]])
                b.append(nodes[rows[j]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return placed.groupBy("task").applyInArrow(join, "a binary, b binary")
