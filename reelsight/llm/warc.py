"""WARC archives: writing pages as response and revisit records, and reading
archives back by boundary-chain verification.

Reading: archives are split at every ``\\nWARC/1.``, so large files are read by
many tasks.  A task emits, for each candidate record, the offset of its
successor (header + Content-Length + 4).  Magic inside a payload makes
candidates too; pointer jumping from the start of each file over the successor
offsets keeps only the candidates that the chain of records reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelsight.llm.common import build_bloom, in_bloom, in_small_batches, materialise, scratch

#: Fixed values of the format.
MAGIC = "\nWARC/1."
END = "\r\n\r\n"
ID_PREFIX = "<urn:x-page:"

WARC_DATE = "2024-01-01T00:00:00Z"


# ------------------------------------------------------------------ writing

def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload digest per row (SHA-1, and its first 8 bytes for the filter)."""
    for batch in batches:
        sums = [hashlib.sha1(x or b"").digest() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sums, pa.binary()),
             pa.array([int.from_bytes(x[:8], "little", signed=True) for x in sums], pa.int64())],
            names=["id", "sha1", "short"])


def _flag(bits):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [hashlib.sha1(x or b"").digest() for x in batch.column(2).to_pylist()]
            short = np.array([int.from_bytes(x[:8], "little") for x in sums], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sums, pa.binary()),
                 pa.array([base64.b32encode(x).decode() for x in sums], pa.string()),
                 pa.array(in_bloom(bits, short))],
                names=["id", "url", "payload", "sha1", "digest", "again"])
    return run


def _records(pages: DataFrame) -> DataFrame:
    """One string column with the record of each row, without its closing blank lines."""
    page = F.coalesce(F.col("id").cast("string"), F.lit(""))
    is_revisit = F.col("first").isNotNull()
    uri = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(END))
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    return pages.select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        line("WARC-Record-ID", F.concat(F.lit(ID_PREFIX), page, F.lit(">"))),
        line("WARC-Date", F.lit(WARC_DATE)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", uri)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.concat(F.lit(ID_PREFIX), F.col("first").cast("string"), F.lit(">")))))
        .otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block).alias("value"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write one WARC/1.1 record per row of ``pages`` under ``path``.

    The payload is the column's bytes (a string as UTF-8, null as empty).  Of
    rows with equal payloads of at least ``min_revisit_bytes`` bytes the one
    with the smallest id is a response and the others are revisits of it; rows
    that repeat that smallest id are responses too, and rows with a null id
    come last (all are responses where no row of the group has an id).  A null
    url leaves its header out; CR and LF in a url are written as %0D and %0A.
    Other columns are ignored; an empty table gives an archive without records.

    Payloads move between executors only if their digest may occur twice (a
    Bloom filter of bounded size tells); the others are written where they
    were read.
    """
    rows = in_small_batches(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    sums = materialise(rows.where(F.octet_length("payload") >= min_revisit_bytes).select("id", "payload")
                       .mapInArrow(_digests, "id long, sha1 binary, short long"), "digests")
    first = sums.groupBy("sha1", "short").agg(F.min("id").alias("first"), F.count("*").alias("n")) \
        .where("n > 1 and first is not null")
    first = materialise(first.select(F.col("sha1").alias("of"), "first", "short"), "repeats")
    bits = pages.sparkSession.sparkContext.broadcast(build_bloom(first.select("short")))
    shape = "id long, url string, payload binary, sha1 binary, digest string, again boolean"
    marked = rows.mapInArrow(lambda batches: _flag(bits.value)(batches), shape)
    alone = marked.where("not again").withColumn("first", F.lit(None).cast("long"))
    again = marked.where("again").join(first.drop("short"), F.col("sha1") == F.col("of"), "left").withColumn(
        "first", F.when((F.octet_length("payload") >= min_revisit_bytes)
                        & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")))
    cols = ["id", "url", "payload", "digest", "first"]
    _records(alone.select(*cols).unionAll(again.select(*cols))).write.option("lineSep", END).text(path)


# ------------------------------------------------------------------ reading

_HEADER = re.compile(rb"^([A-Za-z0-9_-]+):[ \t]*(.*?)[ \t]*$", re.M)
_FIELDS = ("file string, block long, at int, first boolean, offset long, bytes long, succ long, exit long, "
           "complete boolean, type string, id string, uri string, refers string, digest string, "
           "payload_bytes long, payload_digest string, payload binary")
_FIELDS_ARROW = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("at", pa.int32()), ("first", pa.bool_()), ("offset", pa.int64()),
    ("bytes", pa.int64()), ("succ", pa.int64()), ("exit", pa.int64()), ("complete", pa.bool_()),
    ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("refers", pa.string()), ("digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _headers(block: bytes) -> dict[str, str]:
    return {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in
            _HEADER.findall(block.replace(b"\r\n", b"\n"))}


def _parse(data: bytes, keep_payload: bool) -> dict:
    """A candidate that starts with its magic: header fields and, if whole in ``data``, its payload."""
    out = {"complete": False}
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        return out
    fields = _headers(head)
    if not fields.get("content-length", "").isdigit():
        return out
    length = int(fields["content-length"])
    out |= {"size": len(head) + 4 + length + 4, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"),
            "uri": fields.get("warc-target-uri"), "refers": fields.get("warc-refers-to"),
            "digest": fields.get("warc-payload-digest")}
    if len(rest) < length:
        return out
    block = rest[:length]
    out["complete"] = True
    payload, http = block, {}
    if fields.get("content-type", "").startswith("application/http"):
        start, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(start)
    if out["type"] == "revisit":     # the payload is that of the record it refers to
        size = http.get("content-length", "")
        out["payload_bytes"] = int(size) if size.isdigit() else None
        out["payload_digest"] = (out["digest"] or "").removeprefix("sha1:") or None
    else:
        out["payload_bytes"] = len(payload)
        out["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if keep_payload:
            out["payload"] = payload
    return out


def _candidates(keep_payload: bool):
    """Rows of the split text to candidate records, with offsets inside their block of the file."""
    def flush(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        # Successors that stay in the block are followed here: exit is the first offset beyond it.
        known = {r["offset"]: r for r in rows}
        end = rows[-1]["offset"] - (0 if rows[-1]["first"] else 1) + rows[-1]["bytes"]
        for r in reversed(rows):
            to = r.pop("size", None)
            r["succ"] = r["exit"] = None if to is None else r["offset"] + to
            if to is not None and r["succ"] < end:
                r["exit"] = known[r["succ"]]["exit"] if r["succ"] in known else None
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pylist(rows[i:i + 256], schema=_FIELDS_ARROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, offset = None, [], 0
        for batch in batches:
            files, blocks, values = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                own = files[i].as_py(), blocks[i].as_py()
                if own != key:
                    if rows:
                        yield from flush(rows)
                    key, rows, offset = own, [], 0
                value = values[i].as_py()
                first = not rows and own[1] == 0
                if first:
                    row = {"offset": 0, "bytes": len(value)}
                    if re.match(rb"WARC/1\.\d\r\n", value):
                        row |= _parse(value, keep_payload)
                else:
                    row = {"offset": offset + 1, "bytes": len(value) + len(MAGIC)} | \
                        _parse(MAGIC[1:].encode() + value, keep_payload)
                rows.append({"complete": False} | row | {"file": own[0], "block": own[1], "at": len(rows), "first": first})
                offset += row["bytes"]
        if rows:
            yield from flush(rows)
    return run


def _reachable(pointers: DataFrame) -> DataFrame:
    """``pointers(file, off, next)`` to the ``(file, off)`` that the chain from offset 0 reaches.

    Pointer jumping: in round k every pointer spans 2^k hops, and the reached
    set takes one such hop, so the rounds grow with the logarithm of the chain.
    """
    # A pointer that no candidate answers ends its chain.
    jump = materialise(pointers.where("next is not null").join(
        pointers.select("file", F.col("off").alias("next")), ["file", "next"]).select("file", "off", "next"), "jump")
    reached = materialise(pointers.where("off = 0").select("file", "off"), "reached")
    n = reached.count()
    while True:
        more = reached.join(jump, ["file", "off"]).select("file", F.col("next").alias("off"))
        reached = materialise(reached.unionAll(more).distinct(), "reached")
        now = reached.count()
        if now == n:
            return reached
        n = now
        far = jump.select("file", F.col("off").alias("next"), F.col("next").alias("to"))
        jump = materialise(jump.join(far, ["file", "next"]).select("file", "off", F.col("to").alias("next")), "jump")


def _walk(table: pa.Table) -> pa.Table:
    """In one block: the records on the chain from its entry."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    known, at = {r["offset"]: i for i, r in enumerate(rows)}, rows[0]["entry"]
    out: dict[str, list] = {"file": [], "block": [], "at": []}
    while at in known:
        r = rows[known[at]]
        if r["succ"] is None:
            break
        for c in out:
            out[c].append(r[c])
        at = r["succ"]
    return pa.table(out, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int32())]))


def _pieces(wanted):
    """Raw rows that may be wanted, by a filter over (file, block, at)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for batch in batches:
            for f, b, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                key, at = ((f, b), 0) if (f, b) != key else (key, at + 1)
                if in_bloom(wanted, np.array([_place(f, b, at)], np.uint64))[0]:
                    data = value if at == 0 and b == 0 else MAGIC.encode() + value
                    yield pa.RecordBatch.from_pydict({"file": [f], "block": pa.array([b], pa.int64()),
                                                      "at": pa.array([at], pa.int32()), "data": pa.array([data], pa.binary())})
    return run


def _place(file: str, block: int, at: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{file}\0{block}\0{at}".encode(), digest_size=8).digest(), "little")


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_place(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(3)))]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))], names=["place"])


def _assemble(keep_payload: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["offset"])
        data = b"".join(r["data"] for r in rows)
        got = _parse(data[0 if rows[0]["first"] else 1:], keep_payload)
        got.pop("size", None)
        keep = {c: rows[0][c] for c in ("file", "block", "at", "first", "offset", "bytes")}
        return pa.Table.from_pylist([keep | got], schema=_FIELDS_ARROW)
    return run


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the uncompressed archives under ``path``.

    Columns: file, offset (of the record in its file), record_type, record_id,
    target_uri, refers_to, declared_digest, payload_bytes, payload_digest (bare
    base32 SHA-1, computed for all but revisits) and, if ``payload``, payload
    (null for revisits).  Only records on the chain from a file's start appear;
    magic inside payloads, whole archives inside payloads included, does not.
    Bytes after a broken record, and a file that does not start with a record,
    give nothing.  An empty folder or archive gives an empty table.
    """
    lines = in_small_batches(spark.read.option("lineSep", MAGIC).schema("value string").text(path)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))
    found = materialise(lines.mapInArrow(_candidates(payload), _FIELDS), "candidates")

    # A block's base offset is the sum of the blocks before it.
    sizes = found.groupBy("file", "block").agg(F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    index = materialise(found.select("file", "block", "at", "first", "offset", "bytes", "succ", "exit", "complete")
                        .join(bases, ["file", "block"]).withColumns({
                            c: F.col(c) + F.col("base") for c in ("offset", "succ", "exit")}), "index")
    reached = _reachable(index.select("file", F.col("offset").alias("off"), F.col("exit").alias("next")))
    # Pointers lead from block to block, so a block has at most one reached entry.
    entries = reached.join(index.select("file", "block", F.col("offset").alias("off")), ["file", "off"]) \
        .select("file", "block", F.col("off").alias("entry"))
    chain = materialise(index.select("file", "block", "at", "offset", "succ").join(entries, ["file", "block"])
                        .groupBy("file", "block").applyInArrow(_walk, "file string, block long, at int"), "chain")
    place = ["file", "block", "at"]
    known = found.drop("offset").join(index.select(*place, "offset").join(chain, place), place)
    records = known.where("complete")
    # Each candidate lies in the last chain record that starts at or before it.
    so_far = Window.partitionBy("file").orderBy("offset")
    owned = index.join(chain.withColumn("on", F.lit(True)), place, "left").select(
        *place, "first", "offset", "bytes",
        F.last(F.when(F.col("on"), F.struct(F.col("offset").alias("start"), F.col("succ").alias("stop"), "complete")),
               ignorenulls=True).over(so_far).alias("own"))
    # Records whose payload holds the magic: their pieces.
    of = materialise(owned.where("not own.complete and offset < own.stop").select(
        *place, "first", "offset", "bytes", F.col("own.start").alias("start")), "pieces")
    if not of.isEmpty():
        wanted = spark.sparkContext.broadcast(build_bloom(of.select(*place).mapInArrow(_places, "place long")))
        raw = lines.mapInArrow(lambda batches: _pieces(wanted.value)(batches),
                               "file string, block long, at int, data binary")
        whole = of.join(raw, place).groupBy("file", "start").applyInArrow(_assemble(payload), _FIELDS)
        records = records.select(*whole.columns).unionAll(whole.where("complete"))
    out = records.select(
        "file", "offset", F.col("type").alias("record_type"), F.col("id").alias("record_id"),
        F.col("uri").alias("target_uri"), F.col("refers").alias("refers_to"),
        F.regexp_replace("digest", "^sha1:", "").alias("declared_digest"), "payload_bytes", "payload_digest", "payload")
    return out if payload else out.drop("payload")


def page_archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder and read them back.

    Per page: page_id, payload_bytes, payload_digest, record_type, refers_to
    (the page_id of the response for revisits, else null).
    """
    path = scratch(pages.sparkSession, "warc")
    write_warc(pages, path)
    number = lambda c: F.regexp_extract(c, "<urn:x-page:(-?[0-9]+)>", 1)
    as_id = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return read_warc(pages.sparkSession, path, payload=False).select(
        as_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        as_id(F.col("refers_to")).alias("refers_to"))
