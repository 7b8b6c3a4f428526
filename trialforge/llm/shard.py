"""Weighted rendezvous sharding.

Native: DataFrame functions only.  Every shard draws a number for a record's
key, and the record goes to the shard with the best draw.  A draw is a 60-bit
hash of key and shard; with weight w it counts as ``-w / ln(u)``, so a shard
gets records in proportion to its weight.  A shard added later takes records
only into itself, and about its share of them.

Places within a shard are gapless.  Records are ordered by key hash; a prefix
of that hash cuts each shard into small parts that are numbered on their own,
and the parts' running counts (a skinny table, one row per part) are added.
No task sees a whole shard.

A null key is a key of its own; rows that repeat a key go to the same shard and
take adjoining places.  A null or empty text has no bytes, a text of any length
is one row; ties of a draw go to the shard of the lower number.  Only the key
and the text column are read, so others cannot clash; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part, about.
PART_ROWS = 20_000
_TOP = float(1 << 60)


def draw(key: Column, shard: int) -> Column:
    """Number in (0, 1) of a key for a shard."""
    digest = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("\x00null")), F.lit(str(shard))))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").cast("double") + 0.5) / F.lit(_TOP)


def assign(key: Column, weights: list[float]) -> Column:
    """Shard of a key, 0 to len(weights) - 1; shards of weight 0 get nothing."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be positive or zero, and one positive at least")
    draws = [F.struct((F.lit(-float(w)) / F.log(draw(key, k))).alias("draw"), F.lit(-k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    return (-(F.greatest(*draws) if len(draws) > 1 else draws[0])["shard"]).cast("int")


def shards(docs: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", rows: int | None = None) -> DataFrame:
    """``id, size, text_crc32, shard, slot, grown_shard`` per row; ``grown`` are the weights of a larger set of shards."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    own = docs.select(
        key.alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), assign(key, weights).alias("shard"),
        (assign(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), F.md5(F.coalesce(key.cast("string"), F.lit("\x00null"))).alias("order"),
    )
    rows = docs.count() if rows is None else rows
    digits = 1
    while rows > PART_ROWS * len(weights) * 16**digits and digits < 6:
        digits += 1
    own = own.withColumn("part", F.substring("order", 1, digits))
    counts = own.groupBy("shard", "part").agg(F.count("*").alias("c"))
    before = counts.select("shard", "part", (F.sum("c").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    numbered = own.withColumn("at", F.row_number().over(Window.partitionBy("shard", "part").orderBy("order", id_col, "text_crc32")))
    out = numbered.join(before, ["shard", "part"])
    return out.select(id_col, "size", "text_crc32", "shard", (F.coalesce("before", F.lit(0)) + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")
