"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

1. One scan turns each document into its set of word shingles, a class key (a
   128-bit digest of the set, so equal sets are one class) and band keys.  Each
   permutation gives two signature values, its minimum and its maximum; bands
   of ``rows`` values are keyed.  The skinny result is written to the shared
   folder; exact copies shrink to one row per class from here on.
2. Band buckets holding two or more classes give candidates.  First each class
   is compared with one bucket centre, the one it shares most buckets with.
   Confirmed links form components.
3. Buckets whose members now lie in one component are done.  In the others
   every pair across components is compared: pair by pair in buckets of at most
   ``SMALL`` classes, and in larger ones block against block.  Blocks hold a
   bounded number of shingles; a task counts all intersections of two blocks
   with matrix products and returns only links that join components.  So every
   candidate pair of the banding is either inside a component or was tested on
   full sets: no link found by banding is lost, and no group emits its pairs.
4. The least document id of a component is its id.

Comparing ships each set once per pair to its centre's group; groups are
salted to ``group`` members, the centre copied to each part.  Texts of compared
classes are picked by a broadcast of their ids while those number at most
``BROADCAST_IDS``, and by a shuffle join beyond.

With 42 bands of 6 a pair of long texts of resemblance 0.8 is a candidate with
probability 1 - 3e-6, of 0.9 with 1 - 2e-14.  Minimum and maximum of one
permutation are not independent: with c common shingles of n both agree with
q = c (c - 1) / (n (n - 1)), and (1 - q ** 3) ** 42 of such pairs are missed:
9e-6 at 8 of 10, 3.6e-5 at 4 of 5, the most at resemblance 0.8 or above.

Null and empty texts and those without words have no shingles and link with
nothing.  Texts with fewer words than ``shingle`` are one shingle.  Rows that
repeat an id are versions of one document: its component is the least reached
by any of them.  A null id keeps its row, with a null component, and is never
compared.  A text of any length is one row and one set.  Ids decide ties: the
least stands for a class and a component, and of equally near bucket centres
the least is taken.  Only the id and the text column are read, so others cannot
clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .graph import components
from .shared import ID, TEXT, cut, partitions, texts, written

BANDS, ROWS, GROUP = 42, 6, 250
#: Buckets of up to so many classes are compared pair by pair.
SMALL = 16
#: Shingles and members of a block, on average.
BLOCK_SHINGLES, BLOCK = 400_000, 250
#: Most ids that are broadcast (about 30 MB).
BROADCAST_IDS = 500_000


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    w = flat.words(column, lower=True)
    h = w.hashes()
    out = h * flat.K1
    for j in range(1, size):
        out[: len(h) - j] = (out[: len(h) - j] ^ (out[: len(h) - j] >> np.uint64(29))) * flat.K2 + h[j:]
    out = flat.mix(out)
    sets = []
    for a, b in zip(w.docs[:-1].tolist(), w.docs[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(out[a : b - size + 1]))
        elif b > a:
            sets.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band keys of non-empty sets."""
    rng = np.random.default_rng(20240229)
    values = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    need = bands * rows
    keys = np.zeros((len(sets), bands), np.uint64)
    for k in range((need + 1) // 2):
        turn, times = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        y = (values ^ turn) * (times | np.uint64(1))
        for j, least in ((2 * k, np.minimum.reduceat(y, first)), (2 * k + 1, np.maximum.reduceat(y, first))):
            if j < need:
                keys[:, j // rows] = flat.mix(keys[:, j // rows] * flat.K1 + least + np.uint64(j // rows + 1))
    return keys


def _scan(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, TEXT):
                sets = shingle_sets(part.column(1), size)
                full = [s for s in sets if len(s)]
                keys = _bands(full, bands, rows) if full else np.zeros((0, bands), np.uint64)
                sizes = np.array([len(s) for s in sets], np.int64)
                offsets = np.concatenate([[0], np.cumsum((sizes > 0) * bands)])
                cls = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(cls, pa.binary()), flat.list_array(keys.view(np.int64).ravel(), offsets)], names=[ID, "n", "cls", "keys"])

    return run


def _full(size: int):
    """Shingle set of each needed document, once for each of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, TEXT):
                sets = shingle_sets(part.column(1), size)
                ids, places = part.column(0).to_pylist(), part.column(2).to_pylist()
                kind = part.column(0).type
                rows = ((p["g"], p["s"], ids[k], p["c"], k) for k in range(len(ids)) for p in places[k])
                while own := list(islice(rows, 1000)):
                    g, s, i, c, k = zip(*own, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g, kind), pa.array(s, pa.int32()), pa.array(i, kind), pa.array(c, kind), pa.array([sets[x].tobytes() for x in k], pa.binary())], names=["g", "s", "i", "c", "set"])

    return run


def _confirm(percent: int):
    """Rows arrive grouped by (g, s), the centre first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple] = []
            for g, s, i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                values = np.frombuffer(b.as_buffer(), np.uint64)
                if i == g:
                    own, centre = (g, s), values.copy()
                    continue
                if own != (g, s):
                    raise RuntimeError("a group came without its centre")
                if 100 * min(len(values), len(centre)) < percent * max(len(values), len(centre)):
                    continue
                both = np.concatenate([values, centre])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(values) + len(centre) - common):
                    out.append((g, i))
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], kind), pa.array([x for _, x in out], kind)], names=["a", "b"])

    return run


def _blocks(percent: int):
    """Rows arrive grouped by (g, s); links across components that join some are returned."""

    def links(ids: list, comps: list, sets: list[np.ndarray]) -> list[tuple]:
        m = len(ids)
        sizes = np.array([len(x) for x in sets], np.int64)
        values, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        first = np.concatenate([[True], values[1:] != values[:-1]])
        column = np.cumsum(first) - 1
        many = np.bincount(column) > 1
        column, owner = (np.cumsum(many) - 1)[column[many[column]]], owner[many[column]]
        common = np.zeros((m, m), np.float32)
        for low in range(0, int(many.sum()), 2048):
            a, b = np.searchsorted(column, [low, low + 2048])
            part = np.zeros((m, 2048), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            common += part @ part.T
        alike = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        root = {c: c for c in comps}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for x, y in zip(*(z.tolist() for z in np.nonzero(np.triu(alike, 1))), strict=True):
            p, q = find(comps[x]), find(comps[y])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((ids[x], ids[y]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, kind = None, [], pa.int64()

        def result() -> pa.RecordBatch:
            found = links(*(list(x) for x in zip(*rows, strict=True))) if len({c for _, c, _ in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], names=["a", "b"])

        for batch in batches:
            kind = batch.column(0).type
            for g, s, i, c, b in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                if at != (g, s):
                    if rows:
                        yield result()
                    at, rows = (g, s), []
                rows.append((i, c, np.frombuffer(b.as_buffer(), np.uint64).copy()))
        if rows:
            yield result()

    return run


def _placed(docs: DataFrame, places: DataFrame, size: int, compare, *order: str, rows: int) -> DataFrame:
    """Ships the sets of ``places`` (i, g, s, c) to their groups (g, s) and compares there; ``rows`` bounds the classes and the links."""
    places = cut(places.groupBy("i").agg(F.collect_list(F.struct("g", "s", "c")).alias("places")), rows)
    if places.count() <= BROADCAST_IDS:
        places = F.broadcast(places)
    kind = docs.schema[ID].dataType
    schema = T.StructType([T.StructField("g", kind), T.StructField("s", T.IntegerType()), T.StructField("i", kind), T.StructField("c", kind), T.StructField("set", T.BinaryType())])
    sets = docs.join(places, docs[ID] == places["i"]).select(ID, TEXT, "places").mapInArrow(_full(size), schema)
    sets = sets.repartition(partitions(docs.sparkSession), "g", "s").withColumn("rest", F.col("i") != F.col("g")).sortWithinPartitions("g", "s", *order).drop("rest")
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return cut(sets.mapInArrow(compare, schema), rows, apart=True)


def _once(table: DataFrame, rows: int) -> DataFrame:
    """A table of one row per group for a join with the groups' rows: broadcast if it is small, else one that Spark can split the join by."""
    table = cut(table, rows)
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int, group: int, rows: int) -> DataFrame:
    """Pairs ``a, b`` (a < b, distinct) whose full sets resemble enough; ``docs`` has internal names and distinct ids."""
    parts = _once(pairs.groupBy("a").agg(F.ceil(F.count("*") / group).cast("int").alias("parts")), rows)
    members = pairs.join(parts, "a").select(F.col("b").alias("i"), F.col("a").alias("g"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("s"))
    centres = parts.select(F.col("a").alias("i"), F.col("a").alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"))
    return _placed(docs, members.union(centres).withColumn("c", F.col("i")), size, _confirm(percent), "rest", rows=rows)


def blockwise(docs: DataFrame, clusters: DataFrame, size: int, percent: int, rows: int) -> DataFrame:
    """Links across components in clusters ``centre, rep, comp, n``, all pairs compared block against block."""
    totals = _once(clusters.groupBy("centre").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK)).cast("int").alias("p")), rows)
    own = clusters.join(totals, "centre").withColumn("k", F.pmod(F.xxhash64("rep"), F.col("p")).cast("int"))
    each = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    s = (F.least("k", "j") * F.col("p") + F.greatest("k", "j")).cast("int")
    return _placed(docs, each.select(F.col("rep").alias("i"), F.col("centre").alias("g"), s.alias("s"), F.col("comp").alias("c")), size, _blocks(percent), rows=rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, group: int = GROUP) -> DataFrame:
    """``id, n_shingles, component_id, kept`` per row; ``kept`` marks the row of the component's least id."""
    spark = docs.sparkSession
    own = texts(docs, id_col, text_col)
    kind = own.schema[ID].dataType
    schema = T.StructType([T.StructField(ID, kind), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    scanned = written(own.mapInArrow(_scan(shingle, bands, rows), schema), "bands")
    # a table of its own: what is joined with it by class can be split where a class has many copies
    classes = written(scanned.where(f"cls is not null and {ID} is not null").groupBy("cls").agg(F.min(ID).alias("rep"), F.count("*").alias("copies")), "classes", scanned.count())
    n = classes.count()  # bounds what has a row per class
    # the representative's own row carries the band keys; nothing wide is aggregated
    at = scanned.alias("x").join(classes.alias("y"), (F.col(f"x.{ID}") == F.col("y.rep")) & (F.col("x.cls") == F.col("y.cls")))
    in_buckets = at.select("rep", "n", F.explode("keys").alias("bucket"))
    shared = in_buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"), F.count("*").alias("many")).where("centre != last")
    members = written(in_buckets.join(shared.drop("last"), "bucket"), "buckets", n * bands)

    # one comparison for each class, with the centre it meets most often
    near = members.where("rep != centre").groupBy("rep", "centre").agg(F.count("*").alias("c"))
    first = cut(near.groupBy("rep").agg(F.max_by("centre", F.struct("c", -F.col("centre"))).alias("a")).select("a", F.col("rep").alias("b")), n)
    one = own.where(F.col(ID).isNotNull())
    links = confirmed(one, first, shingle, percent, group, n)
    comps = components(links, rows=n)

    # what is still open: pairs across components that meet in a bucket
    labelled = members.join(comps, members["rep"] == comps["node"], "left").withColumn("comp", F.coalesce("comp", "rep")).drop("node")
    labelled = cut(labelled, n * bands)
    still = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
    rest = cut(labelled.join(still, "bucket"), n * bands)
    open_rows = rest.count()
    x, y = rest.where(F.col("many") <= SMALL).alias("x"), rest.where(F.col("many") <= SMALL).alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")))
    pairs = cut(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), open_rows * SMALL)
    more = confirmed(one, pairs, shingle, percent, group, open_rows)
    clusters = rest.where(F.col("many") > SMALL).select("centre", "rep", "comp", "n").distinct()
    more = more.union(blockwise(one, clusters, shingle, percent, open_rows))
    # versions of one id tie their classes together
    by_class, full = classes.select("cls", "rep"), scanned.where(f"cls is not null and {ID} is not null").select(ID, "cls")
    repeated = cut(full.groupBy(ID).agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select(F.col(ID).alias("b")), n)
    versions = full.join(repeated, full[ID] == repeated["b"]).select("b", "cls").distinct().join(by_class, "cls").select(F.col("rep").alias("a"), "b")
    comps = components(links.union(more).union(versions))

    # only copies have to look up who stands for their class
    copied = classes.where("copies > 1").select(F.col("cls").alias("of"), "rep")
    out = scanned.select(ID, "n", "cls").join(copied, F.col("cls") == F.col("of"), "left").withColumn("rep", F.when(F.col(ID).isNotNull(), F.coalesce("rep", ID)))
    comps = comps.where("node != comp")
    out = out.join(comps, out["rep"] == comps["node"], "left").select(ID, "n", F.coalesce("comp", "rep").alias("comp"))
    return out.select(F.col(ID).alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), (F.col(ID) == F.col("comp")).alias("kept"))
