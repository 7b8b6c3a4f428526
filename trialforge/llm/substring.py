"""Exact substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words of one document.  Every word covered by
a window whose word sequence also starts elsewhere (same document included) is
removed; windows are judged on the input.

1. A scan hashes m-grams of words and cuts each document into super-k-mers:
   runs of consecutive windows that share their minimiser (the least m-gram
   hash).  Equal windows have equal minimisers, so a minimiser that occurs once
   in the corpus rules its windows out.  Only hashes are counted here, with
   map-side combining.
2. The other super-k-mers travel, each as one packed string, to the bucket of
   their minimiser, where sorting windows counts them; equal hashes are
   confirmed word by word.
3. Word ranges of repeated windows go back to their documents.

Hot minimisers (more than ``hot`` super-k-mers) would fill one bucket.  Their
super-k-mers are split into single windows, spread by window hash.  Windows
that a map batch sees twice are decided there: their texts travel once per
batch, and their places as bare ranges spread by document.  A bucket task
judges a hot window in parts and keeps one row of it, so what it holds does not
grow with the window's copies.

Null and empty texts have no words and are returned with zero counts; a text of
any length is one row, cut into super-k-mers like others.  Rows that share an
id (null is an id too) are versions of one document: a window found twice at
the same id and place counts once, and each row loses the ranges found for the
id.  Other columns cannot clash: only the named ones are read, and carried ones
that are called like a result are replaced by it.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .shared import ID, TEXT, partitions, texts

WIDTH, GRAM, HOT = 35, 12, 512
#: Bytes of packed strings that a bucket task counts at once, beyond one minimiser.
CHUNK = 8 << 20


def _grams(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words from each place, by doubling; the last m - 1 are void."""
    out, have, power = None, 0, h
    size = 1
    while True:
        if m & size:
            out = power if out is None else _join(out, power, have)
            have += size
        if size * 2 > m:
            return flat.mix(out)
        power = _join(power, power, size)
        size *= 2


def _join(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    out = a * flat.K1
    if step < len(b):
        out[:-step] += (b[step:] ^ (b[step:] >> np.uint64(31))) * flat.K2
    return out


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """Least of the w values from each place, by doubling."""
    out, size = g, 1
    while size < w:
        step = min(size, w - size)
        low = out.copy()
        if step < len(out):
            np.minimum(out[:-step], out[step:], out=low[:-step])
        out, size = low, size + step
    return out


def _runs(docs: np.ndarray, h: np.ndarray, width: int, m: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers: first window, number of windows, minimiser, whether a window may repeat inside the slice; and window hashes."""
    n = len(h)
    size = np.diff(docs)
    ends = np.repeat(docs[1:], size)
    valid = np.flatnonzero(np.arange(n) + width <= ends)
    if not len(valid):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    least = _least(_grams(h, m), width - m + 1)[valid]
    whole = _grams(h, width)
    own = whole[valid]
    order = np.argsort(own)
    same = own[order[1:]] == own[order[:-1]]
    twice = np.zeros(len(valid), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    return valid[first], np.diff(np.append(first, len(valid))), least[first], np.logical_or.reduceat(twice, first), whole


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _scan(width: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, TEXT):
                w = flat.words(part.column(1))
                at, count, mini, twice, _ = _runs(w.docs, w.hashes(), width, m)
                row = np.searchsorted(w.docs, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(_signed(mini)), part.column(0).take(pa.array(row)), pa.array((at - w.docs[row]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(1 + twice.astype(np.int64))], names=["mini", ID, "start", "n", "weight"])

    return run


def _pack(width: int, id_type: pa.DataType):
    names = ["bucket", ID, "start", "n", "known", "packed"]

    def rows(bucket, ids, start, n, known, packed) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(ids, id_type), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(known, pa.bool_()), pa.array(packed, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            hot: dict[bytes, list] = {}
            ranges: list[list] = []
            for part in flat.slices(batch, TEXT):
                w = flat.words(part.column(1))
                ids, found = part.column(0).to_pylist(), part.column(2)
                data = flat.binary_array(*_single_spaced(w))
                bounds = np.concatenate([[0], np.cumsum(w.ends - w.starts + 1)])
                data = memoryview(data.buffers()[2])
                whole = None
                for k, own in enumerate(found.to_pylist()):
                    for r in own or ():
                        low, n, to = w.docs[k] + r["start"], r["n"], w.docs[k + 1]
                        if low + n + width - 1 > to:
                            continue
                        if not r["hot"]:
                            for column, x in zip(out, (r["mini"], ids[k], r["start"], n, False, bytes(data[bounds[low] : bounds[low + n + width - 1] - 1])), strict=True):
                                column.append(x)
                            continue
                        whole = _grams(w.hashes(), width) if whole is None else whole
                        told = None  # decided windows in a row are one range
                        for j in range(n):
                            text = bytes(data[bounds[low + j] : bounds[low + j + width] - 1])
                            seen = hot.get(text)
                            if seen is None:
                                hot[text] = [int(_signed(whole[low + j : low + j + 1])[0]), ids[k], r["start"] + j, 1, False, text]
                            elif (seen[1], seen[2]) != (ids[k], r["start"] + j):
                                seen[4] = True
                                if told is None or told[2] + told[3] != r["start"] + j:
                                    told = [0, ids[k], r["start"] + j, 0, True, None]
                                    ranges.append(told)
                                told[3] += 1
                if len(out[0]) > 20_000:
                    yield rows(*out)
                    out = [[] for _ in names]
            for x in ranges:
                x[0] = _signed(np.array([xxhash.xxh3_64_intdigest(f"{x[1]}:{x[2]}")], np.uint64))[0]
            for x in (*hot.values(), *ranges):
                for column, y in zip(out, x, strict=True):
                    column.append(y)
            if out[0]:
                yield rows(*out)

    return run


def _single_spaced(w: flat.Words) -> tuple[np.ndarray, np.ndarray]:
    """All words of a slice, each followed by one blank."""
    sizes = w.ends - w.starts
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(at[-1], 0x20, np.uint8)
    out[flat.spans(at[:-1], sizes)] = w.data[flat.spans(w.starts, sizes)]
    return out, np.array([0, at[-1]])


def _count(width: int):
    """Bucket side: rows arrive sorted by bucket; ranges of repeated windows leave."""
    names = [ID, "low", "high"]

    def ranges(ids: pa.Array, row: np.ndarray, low: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(low.astype(np.int32)), pa.array((low + size).astype(np.int32))], names=names)

    def judge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = t.column(ID).combine_chunks()
        start, n = t.column("start").to_numpy(), t.column("n").to_numpy()
        known, bucket = t.column("known").to_numpy(zero_copy_only=False), t.column("bucket").to_numpy()
        told = np.flatnonzero(t.column("packed").combine_chunks().is_null().to_numpy(zero_copy_only=False))
        if len(told):  # windows that their map batch saw twice
            yield ranges(ids, told, start[told], n[told] + width - 1)
        w = flat.words(t.column("packed").combine_chunks().cast(pa.large_binary()))
        count = np.maximum(np.diff(w.docs) - width + 1, 0)
        if not count.sum():
            return
        place = flat.spans(w.docs[:-1], count)
        row = np.repeat(np.arange(len(count)), count)
        at = start[row] + place - w.docs[row]
        own = _grams(w.hashes(), width)[place] ^ bucket[row].astype(np.uint64)
        which = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()[row].astype(np.int64)
        order = np.lexsort((at, which, own))
        o, key, pos = order, own[order], (which << 32 | at)[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        repeated = (np.maximum.reduceat(pos, first) != np.minimum.reduceat(pos, first)) | np.logical_or.reduceat(known[row][o], first)
        # equal hashes, confirmed word by word with the window before
        pair = np.flatnonzero((group[1:] == group[:-1]) & repeated[group[1:]]) + 1
        wrong = set()
        for low in range(0, len(pair), 50_000):
            p = pair[low : low + 50_000]
            step = np.arange(width)
            differ = (w.codes[place[o[p]][:, None] + step] != w.codes[place[o[p - 1]][:, None] + step]).any(axis=1)
            wrong.update(group[p[differ]].tolist())
        flag = np.zeros(len(place), bool)
        flag[o] = repeated[group]
        for g in wrong:  # windows that only share a hash: count by their words
            members = o[group == g]
            by: dict[bytes, list[int]] = {}
            for j in members.tolist():
                by.setdefault(w.codes[place[j] : place[j] + width].tobytes(), []).append(j)
            for same in by.values():
                flag[same] = len({(which[j], at[j]) for j in same}) > 1 or bool(known[row[same]].any())
        hit = np.flatnonzero(flag)
        if len(hit):
            first = np.flatnonzero(np.concatenate([[True], (row[hit[1:]] != row[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)]))
            size = np.diff(np.append(first, len(hit)))
            yield ranges(ids, row[hit[first]], at[hit[first]], size + width - 1)

    def once(t: pa.Table) -> pa.Table:
        """One row of each text of a judged table of single windows, told if it is repeated."""
        first: dict[bytes, list] = {}
        for k, (own, at, known, text) in enumerate(zip(*(t.column(c).to_pylist() for c in (ID, "start", "known", "packed")), strict=True)):
            if text is not None:
                seen = first.setdefault(text, [k, own, at, known])
                seen[3] = seen[3] or known or (own, at) != (seen[1], seen[2])
        kept = t.take(pa.array([x[0] for x in first.values()], pa.int64()))
        return kept.set_column(kept.column_names.index("known"), "known", pa.array([x[3] for x in first.values()], pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                waiting.append(batch.slice(low, 2000))
                held += waiting[-1].nbytes
                if held < CHUNK:
                    continue
                t = pa.Table.from_batches(waiting)
                bucket = t.column("bucket").to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if cut:
                    yield from judge(t.slice(0, cut))
                t = t.slice(cut)
                if t.nbytes >= CHUNK and pc.max(t.column("n")).as_py() == 1:  # a hot window
                    yield from judge(t)
                    t = once(t)
                waiting = t.combine_chunks().to_batches()
                held = sum(b.nbytes for b in waiting)
                flat.release()
        if waiting:
            yield from judge(pa.Table.from_batches(waiting))

    return run


def _remove(mode: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, TEXT):
                w = flat.words(part.column(1))
                found = part.column(2).to_pylist()
                gone = np.zeros(len(w.starts) + 1, np.int64)
                for k, own in enumerate(found):
                    lo, size = w.docs[k], w.docs[k + 1] - w.docs[k]
                    for r in own or ():
                        if r["low"] < size:
                            gone[lo + r["low"]] += 1
                            gone[lo + min(r["high"], size)] -= 1
                drop = np.cumsum(gone)[:-1] > 0 if len(w.starts) else np.zeros(0, bool)
                total = np.concatenate([[0], np.cumsum(drop)])
                removed = total[w.docs[1:]] - total[w.docs[:-1]]
                raw = w.data.tobytes()
                kept = []
                for k in range(part.num_rows):
                    a, b = w.docs[k], w.docs[k + 1]
                    if mode == "spaced" and not removed[k]:
                        kept.append(raw[w.offsets[k] : w.offsets[k + 1]].decode())
                    elif mode == "spaced":  # cut spans of words with the space after them
                        cut = np.zeros(w.offsets[k + 1] - w.offsets[k], bool)
                        ends = np.append(w.starts[a + 1 : b], w.offsets[k + 1])
                        j = np.flatnonzero(drop[a:b])
                        cut[flat.spans(w.starts[a:b][j] - w.offsets[k], ends[j] - w.starts[a:b][j])] = True
                        kept.append(w.data[w.offsets[k] : w.offsets[k + 1]][~cut].tobytes().decode())
                    else:
                        s, e = w.starts[a:b][~drop[a:b]].tolist(), w.ends[a:b][~drop[a:b]].tolist()
                        kept.append(b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)]).decode())
                columns = [part.column(j) for j in [0, *range(3, part.num_columns)]] + [pa.array(np.diff(w.docs).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Word ranges [low, high) covered by repeated windows: ``_id, low, high``, overlapping ranges possible."""
    if not 1 <= gram <= width:
        raise ValueError("gram must be between 1 and width")
    own = texts(docs, id_col, text_col)
    kind = own.schema[ID].dataType
    schema = T.StructType([T.StructField("mini", T.LongType()), T.StructField(ID, kind), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("weight", T.LongType())])
    runs = own.mapInArrow(_scan(width, gram), schema)
    counts = runs.groupBy("mini").agg(F.sum("weight").alias("c")).filter("c >= 2")
    found = runs.drop("weight").join(counts, "mini").withColumn("hot", F.col("c") > hot)
    found = found.groupBy(ID).agg(F.collect_list(F.struct("start", "n", "mini", "hot")).alias("runs"))
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField(ID, kind), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("known", T.BooleanType()), T.StructField("packed", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_type

    packed = _beside(own, found, "runs").mapInArrow(_pack(width, to_arrow_type(kind)), schema)
    schema = T.StructType([T.StructField(ID, kind), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])
    return packed.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(_count(width), schema)


def _beside(own: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """All documents with their lists (null if none); null ids meet too."""
    lists = lists.withColumnRenamed(ID, "_of")
    return own.join(lists, own[ID].eqNullSafe(lists["_of"]), "left").select(ID, TEXT, name, *[c for c in own.columns if c not in (ID, TEXT)])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT, keep_space: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, n_words, n_removed, kept`` per row, after the columns named in ``carry`` (but those called like a result).

    ``kept`` is the kept words joined by one space, or with ``keep_space`` the text without the removed words and the space after them.
    """
    carry = tuple(c for c in carry if c not in (id_col, "n_words", "n_removed", "kept"))
    spans = repeated_ranges(docs, id_col, text_col, width, gram, hot)
    lists = spans.groupBy(ID).agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    own = texts(docs, id_col, text_col, *[docs[c].alias(f"_c{k}") for k, c in enumerate(carry)])
    fields = [T.StructField(id_col, own.schema[ID].dataType)] + [T.StructField(c, docs.schema[c].dataType) for c in carry] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return _beside(own, lists, "spans").mapInArrow(_remove("spaced" if keep_space else "words", [f.name for f in fields]), T.StructType(fields))
