"""Document fingerprints: bottom-k sketches of shingle hashes.

Native: DataFrame functions only.  A sketch is the ascending list of the k
least distinct 64-bit hashes of a text's word shingles (a text of fewer words
than a shingle is one shingle; one without words has an empty sketch).
Sketches of parts merge into the sketch of the whole.  From two sketches come
estimates of resemblance and containment, from one the number of distinct
shingles.  Two empty sketches resemble each other fully, an empty and another
not at all.

Words are separated by blanks and ASCII line and page breaks; case matters.
Null texts count as empty, a text of any length is one row.  Equal texts have
equal sketches; hashes that tie are one hash.  Only the id and the text column
are read, so other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

K, SHINGLE = 128, 5
#: Documents of 2 ** BUCKET_BITS neighbouring ids meet in one task: small buckets spread evenly, whatever their number.
BUCKET_BITS = 7
#: Buckets that one task may order.
FEW = 128
#: Most buckets whose first ids are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_BUCKETS = 500_000


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<bigint>: the k least distinct shingle hashes, ascending."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return sketch_of_words(words, k, shingle)


def sketch_of_words(words: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    hashes = F.transform(words, lambda x: F.xxhash64(x))

    def build(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - shingle + 1, F.lit(1)))
        own = F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, shingle)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.array_sort(F.array_distinct(own)), 1, k))

    # the hashes are bound once by a one-element array
    return F.element_at(F.transform(F.array(hashes), build), 1)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two texts' shingles."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's k least hashes that both sketches have."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th least hash as a share of the range."""
    last = (F.element_at(a, -1).cast("double") + F.lit(2.0**63) + 1) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    r = resemblance(a, b, k)
    common = r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def merge_groups(frame: DataFrame, by: str, sketch_col: str, k: int = K, salts: int = 64) -> DataFrame:
    """Sketch of every group, merged in two steps; hashes are combined map-side, so a hot group costs one task its distinct least hashes only."""
    each = frame.select(F.col(by), F.explode(sketch_col).alias("h")).withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts))).distinct()
    first = each.withColumn("r", F.row_number().over(Window.partitionBy(by, "salt").orderBy("h"))).where(F.col("r") <= k)
    return first.groupBy(by).agg(F.slice(F.array_sort(F.collect_list("h")), 1, k).alias(sketch_col))


def text_form(a: Column) -> Column:
    """Printable fingerprint: 16 hex digits per hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _successor(level: DataFrame, bits: int) -> DataFrame:
    """``k, first, next`` of a table ``k, first``: the first value of the next key in order; null for the last.

    Keys meet in buckets of 2 ** bits, and buckets of buckets are looked at in the same way until ``FEW`` are left, so no task orders all of them.
    """
    if level.limit(FEW + 1).count() <= FEW:
        return level.withColumn("next", F.lead("first").over(Window.orderBy("k")))
    up = cut(level.groupBy(F.shiftright("k", bits).alias("u")).agg(F.min(F.struct("k", "first"))["first"].alias("first")))
    above = _successor(up.withColumnRenamed("u", "k"), bits)
    own = level.withColumn("u", F.shiftright("k", bits)).withColumn("next", F.lead("first").over(Window.partitionBy("u").orderBy("k")))
    own = own.join(above.select(F.col("k").alias("u"), F.col("next").alias("above")), "u", "left")
    return own.select("k", "first", F.coalesce("next", "above").alias("next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE, bits: int = BUCKET_BITS) -> DataFrame:
    """Sketch of each document, of the document with its second half replaced by the start of the next one, and of the next one.

    ``id, n_chars, edited, sketch, edited_sketch, next_sketch``.  The next document is the one with the next greater integer id (the first, after the
    last).  Documents meet their successors in buckets of ids; only the first document of each bucket is sent to another bucket.  Rows that repeat
    an id follow each other in the order of their texts; rows with a null id come first.
    """
    own = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    low = -(1 << 62)
    own = own.withColumn("o", F.coalesce(F.col("i").cast("long"), F.lit(low))).withColumn("b", F.shiftright("o", bits))
    firsts = cut(_successor(cut(own.groupBy(F.col("b").alias("k")).agg(F.min("o").alias("first"))), bits).withColumnRenamed("k", "b"))
    start = firsts.agg(F.min("first").alias("start")).first()["start"]
    if start is None:
        start = low
    firsts = firsts.select("b", F.coalesce("next", F.lit(start)).alias("next"))
    wanted = cut(firsts.select(F.col("next").alias("o"), F.col("b").alias("to")))
    if wanted.count() <= BROADCAST_BUCKETS:
        wanted = F.broadcast(wanted)
    heads = own.join(wanted, "o").groupBy("to").agg(F.min("t").alias("next_text"))
    w = Window.partitionBy("b").orderBy("o", "t")
    rows = own.repartition("b").sortWithinPartitions("b", "o", "t").withColumn("sketch", sketch(F.col("t"), k, shingle))
    rows = rows.withColumn("nt", F.lead("t").over(w)).withColumn("ns", F.lead("sketch").over(w))
    heads = heads.withColumn("next_sketch", sketch(F.col("next_text"), k, shingle))
    rows = rows.join(heads, (F.col("b") == F.col("to")) & F.col("nt").isNull(), "left")
    half = F.floor(F.length("t") / 2).cast("int")
    following = F.coalesce("nt", "next_text")
    rows = rows.select(F.col("i").alias(id_col), F.length("t").cast("long").alias("n_chars"), F.concat(F.substring(F.col("t"), F.lit(1), F.length("t") - half), F.substring(following, F.lit(1), half)).alias("edited"), "sketch", F.coalesce("ns", "next_sketch").alias("next_sketch"))
    return rows.withColumn("edited_sketch", sketch(F.col("edited"), k, shingle))
