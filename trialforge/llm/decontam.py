"""Benchmark decontamination with a broadcast hash set of test n-grams.

Native: DataFrame functions only.  Words are ASCII-lower-cased runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  A window is ``n`` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window.

The scan of a document looks at aligned blocks first: any window of n words
covers one whole block of ``(n + 1) // 2`` words that starts at a multiple of
the block length, so only documents (and places) with a block hash from the
set can hold a window.  Candidate windows are joined with the broadcast window
table on the words themselves, which confirms them.  One row per hit reaches
the only shuffle.

The hash set and the window table are sent out while the benchmark has at most
``SET_LIMIT`` hashes and as many rows of windows and items; a larger benchmark
is joined on exploded blocks by shuffle instead, and Spark then chooses how to
join the windows.

Null and empty texts have no words; items without words are ignored; repeated
items each count by their id; null item ids are left out of the list.  Rows
that repeat a document id are judged each on its own, equal rows alike; a null
id is an id.  A text of any length is one row whose words are an array.  An
empty benchmark hits nothing, empty documents give an empty result.  ``report``
returns its own columns only; ``clean`` returns the columns of the documents,
whatever they are called.  Rows are numbered within the partitions of the
input, so that must be a table or a checkpoint: its rows must come in the same
order when a task runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ID, TEXT, ascii_lower, texts, unused

N = 13
#: Most hashes that travel with the plan.
SET_LIMIT = 200_000
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Normalised words of a text; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _APART), lambda x: x != "")


def windows(bench: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, size, window``: distinct windows of each item, words joined by a blank."""
    w = bench.select(F.col(id_col).alias("item"), tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.size("w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    return w.select("item", "size", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("window")).distinct()


def _words_of(window: Column) -> Column:
    return F.split(window, " ")


def _places(w: Column, size: int, step: int, where: Column) -> Column:
    """Windows of ``size`` words that start at the given places, with their place."""
    return F.transform(where, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.array_join(F.slice(w, i, size), " ").alias("window")))


def hits(docs: DataFrame, bench: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", set_limit: int = SET_LIMIT) -> DataFrame:
    """``uid, _id, th, n_words, at, size, item``: one row per confirmed window and item; one row with null ``at`` for a document with none."""
    grams = windows(bench, n, item_col, bench_text)
    block = (n + 1) // 2
    full = grams.where(F.col("size") == n)
    short = grams.where(F.col("size") < n)
    blocks = full.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(n - block + 1)), lambda i: F.xxhash64(F.array_join(F.slice(_words_of(F.col("window")), i, block), " ")))).alias("h")).distinct()
    heads = short.select(F.element_at(_words_of(F.col("window")), 1).alias("h"), "size").distinct()
    own = texts(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()).withColumn("th", F.xxhash64(TEXT)).withColumn("w", tokens(F.col(TEXT))).drop(TEXT)
    count = F.size("w")
    n_blocks = F.floor(count / block).cast("int")
    hashes = F.when(n_blocks > 0, F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.struct((b * block).alias("b"), F.xxhash64(F.array_join(F.slice("w", b * block + 1, block), " ")).alias("h"))))
    n_hashes, n_heads = blocks.limit(set_limit + 1).count(), heads.limit(set_limit + 1).count()
    small = n_hashes + n_heads <= set_limit and grams.limit(set_limit + 1).count() <= set_limit
    if small:
        known = [r.h for r in blocks.collect()]
        found = F.filter(hashes, lambda x: x["h"].isin(known)) if known else F.array().cast("array<struct<b:int,h:bigint>>")
        own = own.withColumn("found", found)
        first: dict[int, list[str]] = {}
        for r in heads.collect():
            first.setdefault(r["size"], []).append(r.h)
        own = own.withColumn("heads", F.array(*[_heads(size, known_heads) for size, known_heads in sorted(first.items())]) if first else F.array().cast("array<array<struct<at:int,size:int,window:string>>>"))
    else:
        # lists meet their rows by id and text, which no retry can change
        of = [F.col(ID).alias("_of"), F.col("th").alias("_th")]
        each = own.select(*of, F.explode(hashes).alias("x")).join(blocks.withColumnRenamed("h", "k"), F.col("x.h") == F.col("k"), "left_semi").groupBy("_of", "_th").agg(F.collect_set("x").alias("found"))
        starts = own.select(*of, F.posexplode("w").alias("p", "word")).join(heads, F.col("word") == F.col("h")).select("_of", "_th", "p", "size").groupBy("_of", "_th").agg(F.collect_set(F.struct("p", "size")).alias("starts"))
        for lists in (each, starts):
            own = own.join(lists, own[ID].eqNullSafe(lists["_of"]) & (own["th"] == lists["_th"]), "left").drop("_of", "_th")
        own = own.withColumn("heads", F.array(F.transform(F.filter("starts", lambda x: x["p"] + x["size"] <= F.size("w")), lambda x: F.struct((x["p"] + 1).alias("at"), x["size"].alias("size"), F.array_join(F.slice("w", x["p"] + 1, x["size"]), " ").alias("window")))))
    # a block at words b .. b + block - 1 (from 0) lies in the windows that start at b + block - n .. b
    around = F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(F.greatest(x["b"] + 1 + block - n, F.lit(1)), x["b"] + 1))))
    inside = F.filter(around, lambda i: i + (n - 1) <= F.size("w"))
    candidates = F.concat(F.coalesce(_places(F.col("w"), n, 1, inside), F.array()), F.coalesce(F.flatten("heads"), F.array()))
    rows = own.select("uid", ID, "th", count.cast("long").alias("n_words"), F.explode_outer(candidates).alias("c"))
    rows = rows.select("uid", ID, "th", "n_words", F.col("c.at").alias("at"), F.col("c.size").alias("size"), F.col("c.window").alias("window"))
    table = grams.withColumnRenamed("size", "gsize")
    if small:
        table = F.broadcast(table)  # ``set_limit`` rows at most
    joined = rows.join(table.withColumnRenamed("window", "gwindow"), (F.col("window") == F.col("gwindow")) & (F.col("size") == F.col("gsize")), "left")
    return joined.select("uid", ID, "th", "n_words", F.when(F.col("gsize").isNotNull(), F.col("at")).alias("at"), "size", "item")


def _heads(size: int, known: list[str]) -> Column:
    w = F.col("w")
    starts = F.when(F.size(w) >= size, F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.element_at(w, i).isin(known)))
    return F.coalesce(_places(w, size, 1, starts), F.array().cast("array<struct<at:int,size:int,window:string>>"))


def report(docs: DataFrame, bench: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", share: int = 20, set_limit: int = SET_LIMIT) -> DataFrame:
    """``id, n_words, n_hit, n_items, items (sorted strings), contaminated, spans`` per row.

    ``spans`` are the disjoint hit word ranges [low, high); a document is contaminated if ``share`` times its hit words reach its words.
    """
    found = hits(docs, bench, n, id_col, text_col, item_col, bench_text, set_limit)
    out = found.groupBy("uid").agg(
        F.first(ID).alias(ID), F.first("th").alias("text_hash"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi"))))).alias("marks"), F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.col("item").cast("string")))).alias("items")
    )
    merged = F.aggregate(
        "marks", F.array().cast("array<struct<lo:int,hi:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["lo"] <= F.element_at(acc, -1)["hi"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), F.greatest(F.element_at(acc, -1)["hi"], x["hi"]).alias("hi"))))).otherwise(F.concat(acc, F.array(x))),
    )
    out = out.withColumn("spans", F.transform(merged, lambda x: F.struct((x["lo"] - 1).alias("low"), (x["hi"] - 1).alias("high"))))
    out = out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["high"] - x["low"]))
    return out.select("uid", F.col(ID).alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans", "text_hash")


def clean(docs: DataFrame, bench: DataFrame, n: int = N, mode: str = "both", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", share: int = 20) -> DataFrame:
    """The documents without benchmark passages, columns as they came.

    ``documents`` drops contaminated documents, ``spans`` cuts hit words out of the text, ``both`` does both.  Texts without hits stay as they are.
    A cut text loses each hit word and the separators after it.
    """
    if mode not in ("documents", "spans", "both"):
        raise ValueError(f"unknown mode {mode}")
    of, th, bad, spans = unused(docs.columns, "of", "th", "bad", "spans")
    found = report(docs, bench, n, id_col, text_col, item_col, bench_text, share).where("n_hit > 0").select(F.col(id_col).alias(of), F.col("text_hash").alias(th), F.col("contaminated").alias(bad), F.col("spans").alias(spans)).dropDuplicates([of, th])
    out = docs.join(found, docs[id_col].eqNullSafe(F.col(of)) & (F.xxhash64(docs[text_col]) == F.col(th)), "left")
    if mode != "spans":
        out = out.where(~F.coalesce(F.col(bad), F.lit(False)))
    if mode != "documents":
        # words with the separators after them; a leading separator belongs to no word
        word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
        parts = F.regexp_extract_all(F.col(text_col), F.lit(word), F.lit(0))
        lead = F.regexp_extract(F.col(text_col), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
        left = F.filter(parts, lambda x, i: ~F.exists(F.col(spans), lambda s: (s["low"] <= i) & (i < s["high"])))
        out = out.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.concat(lead, F.array_join(left, ""))))
    return out.select(*docs.columns)
