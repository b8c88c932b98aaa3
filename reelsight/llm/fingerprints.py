"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest 48-bit hashes of a text's
distinct 5-word shingles.  Sketches of parts merge into that of the whole; two
sketches estimate resemblance (Jaccard), containment and distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsight.llm.common import blank, let, parts, text_bytes

K = 256
SHINGLE_WORDS = 5
HASH_BITS = 48
CELLS = 1 << 16                  # bound of the broadcast table of id ranges
BUCKET_BYTES = 16 << 20
_SPACE = " \t\n\x0b\f\r"


def sketch(text: Column, k: int = K, words: int = SHINGLE_WORDS) -> Column:
    """Bottom-k sketch of a text: lower-cased, words between white space.

    A text of one to four words is one shingle; null and blank texts have none.
    """
    trimmed = F.btrim(F.lower(blank(text)), F.lit(_SPACE))
    tokens = F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")

    def smallest(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, words)), 64 - HASH_BITS))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(let(tokens, smallest))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, exact while both sketches are whole; two empty sketches: 1."""
    both = F.array_intersect(a, b)
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(both, u)) / F.size(u)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(
        (k - 1) / (F.element_at(a, -1) / float(1 << HASH_BITS)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has (1 for an empty a)."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def to_text(a: Column) -> Column:
    """A sketch as a string: 12 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), HASH_BITS // 4, "0")), "")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, sketch, next_text, next_sketch)``: each document with the next by falling id.

    After the last comes the first.  Rows with equal ids follow one another by
    a hash of their texts; null ids come last.  Ids are cut into ranges of
    about equal bytes through a table of at most ``CELLS`` id cells; each range
    is sorted alone, and also receives the first document of the range after
    it, so one shuffle of the texts suffices and no task sees all rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), blank(F.col(text_col)).alias("text")).withColumn(
        "tie", F.xxhash64("text"))
    ends = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = (ends.lo or 0), (ends.hi or 0)
    width = max(1, -(-(hi - lo + 1) // CELLS))
    # Cells are numbered by falling id; null ids share a cell after all others.
    below = F.lit(hi) - F.col("doc_id")
    if hi - lo >= 1 << 63:                      # a distance that does not fit 64 bits
        below = F.lit(hi).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)")
    cell = F.coalesce(F.floor(below / F.lit(width)), F.lit(CELLS)).cast("int")
    each = parts(text_bytes(docs, text_col), BUCKET_BYTES)
    weights = rows.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
    upto = F.sum("bytes").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = weights.select("cell", F.floor((upto - F.col("bytes")) * each / F.sum("bytes").over(Window.partitionBy()))
                            .cast("int").alias("range"))
    placed = rows.withColumn("cell", cell).join(F.broadcast(ranges), "cell").drop("cell")
    first = placed.groupBy("range").agg(F.max(F.struct("doc_id", "tie")).alias("first"))
    order = Window.orderBy("range")
    before = first.select(F.col("range").alias("from"), "first", F.coalesce(
        F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("to"))
    guests = placed.join(F.broadcast(before), (F.col("range") == F.col("from"))
                         & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")),
                         "left")
    seats = F.when(F.col("to").isNull(), F.array(F.struct("range", F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct("range", F.lit(0).alias("guest")), F.struct(F.col("to").alias("range"), F.lit(1).alias("guest"))))
    seated = guests.select("doc_id", "tie", "text", F.explode(seats).alias("seat")).select(
        "doc_id", "tie", "text", "seat.range", "seat.guest").repartition("range")
    follow = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return seated.withColumn("sketch", sketch(F.col("text"))).withColumn(
        "next", F.lead(F.struct("text", "sketch")).over(follow)).where("guest = 0").select(
        "doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, with their likeness.

    The edit replaces the last floor(n_chars / 3) code points by the first as
    many (or all) of the next document by falling id.  Null texts are empty;
    equal texts have equal fingerprints; a document alone follows itself.  Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = with_next(docs)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        to_text(F.col("sketch")).alias("fingerprint"), to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles_estimate"))
