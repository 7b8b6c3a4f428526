"""Katz backoff language model, trained and applied without moving tokens.

Documents are cut into units of a few megabytes.  A unit keeps its token codes
in one file of the shared folder and asks for what it needs: for each distinct
word its training count, then for each distinct bigram.  An ask carries the
unit's own training counts, so the same rows that ask also count.  Asks are
packed, sorted and compressed per unit and bucket; a bucket sums the counts of
all units and answers each.

* Unigrams: buckets by word hash.  An answer gives the corpus count and a
  global word number (frequent words get small numbers).
* Bigrams: buckets by history, so a bucket sees all words after a history and
  also returns what its backoff weight needs: the history's count, how many of
  its words occurred 1, 2, ... times, and the unigram mass of its words.
  Frequent histories are spread over all buckets by bigram; their parts are
  summed and broadcast.  Their number is bounded by the choice of the
  threshold, at any corpus size.
* Counts up to ``LARGEST`` are discounted by Good-Turing; where the counts of
  counts do not allow that, absolute discounting takes its place.  The freed
  mass of a history is spread over the words not seen after it in proportion
  to their unigram probability, so the probabilities of every history sum to
  one; a history with nothing freed gets one count of free mass.  The freed
  unigram mass is the probability of the unknown word.

A text's score adds log10 P(token | token before) over its words and an end
token; P(w|h) is the discounted bigram share, or the history's backoff weight
times P(w), which again is the discounted share or the unknown word's.

Null and empty texts hold the end token only; a text longer than a unit is a
unit of its own.  Rows that repeat an id are documents of their own, a null id
is returned as it came, a null ``held_out`` trains.  Only the named columns are
read, so others cannot clash; an empty table gives an empty result.  With no training tokens every word is unknown and the
unknown word has probability one.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat, store
from .shared import ID, TEXT, new_path, partitions, texts, written

LARGEST = 5
UNIT_BYTES = 8 << 20
#: A history is frequent from so many tokens, and from this share of all: at most 1 / share of them are broadcast.
FREQUENT, FREQUENT_SHARE = 50_000, 1 / 200_000
_END = b"\n"  # no word
_START = (1 << 32) - 1  # number of the history before the first word
_UNKNOWN = _START - 1  # number of any word without training tokens
_ROWS = "unit string, kind int, bucket int, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, byte planes apart so that equal high bytes compress."""
    parts = [(a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"") for a in arrays]
    return zstandard.compress(pickle.dumps(parts), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, raw in pickle.loads(zstandard.decompress(blob)):
        kind = np.dtype(kind)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind))
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the values."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    u, k, b, x = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.binary())], names=["unit", "kind", "bucket", "blob"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[tuple]]]:
    """Rows of one key after another; rows arrive sorted by it."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            own = row[0] if key == "unit" else row[2]
            if rows and own != at:
                yield at, rows
                rows = []
            at = own
            rows.append(row)
    if rows:
        yield at, rows


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words and ends of each text, the texts' offsets, and the hashes behind the codes."""
    w = flat.words(part.column(1), lower=True)
    import xxhash

    known = np.array([xxhash.xxh3_64_intdigest(x) for x in w.distinct.to_pylist()] + [xxhash.xxh3_64_intdigest(_END)], np.uint64)
    order = np.argsort(known)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    n = np.diff(w.docs)
    docs = np.concatenate([[0], np.cumsum(n + 1)])
    codes = np.full(docs[-1], rank[-1], np.int32)
    codes[flat.spans(docs[:-1], n)] = rank[:-1][w.codes] if len(w.codes) else rank[:0]
    return codes, docs, known[order]


def _scan(folder: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in flat.slices(batch, TEXT, UNIT_BYTES):
                codes, docs, hashes = _tokens(part)
                held = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                unit, k = f"{at}-{k}", k + 1
                store.put(folder, unit, zstandard.compress(pickle.dumps((part.column(0), held, _pack(codes.view(np.uint32), docs.astype(np.uint32)), hashes)), 1))
                train = np.repeat(~held, np.diff(docs))
                counts = np.bincount(codes[train], minlength=len(hashes))
                bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                rows = [(unit, 1, b, _pack(np.diff(hashes[x:y], prepend=np.uint64(0)), _small(counts[x:y]))) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                if rows:
                    yield _batch(rows)

    return run


def _turns(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, ... LARGEST + 1, how many are positive, and their sum."""
    return np.concatenate([np.bincount(np.minimum(counts, LARGEST + 2), minlength=LARGEST + 3)[1 : LARGEST + 2], [np.count_nonzero(counts), counts.sum()]]).astype(np.int64)


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            keys, counts, sizes = [], [], []
            for r in rows:
                step, c = _unpack(r[3])
                keys.append(np.cumsum(step, dtype=np.uint64))
                counts.append(c.astype(np.int64))
                sizes.append(len(c))
            known, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)
            rank = np.empty(len(known), np.int64)
            rank[np.lexsort((known, -total))] = np.arange(len(known))
            at = np.concatenate([[0], np.cumsum(sizes)])
            out = [("", 0, bucket, _pack(_turns(total)))]
            for r, x, y in zip(rows, at[:-1], at[1:], strict=True):
                out.append((r[0], 1, bucket, _pack(_small(total[which[x:y]]), _small(rank[which[x:y]]))))
            for low in range(0, len(out), 500):
                yield _batch(out[low : low + 500])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Factor for counts 0, 1, ... LARGEST; n: how many counts are 1, 2, ... LARGEST + 1."""
    n = np.asarray(n, float)
    out = np.ones(LARGEST + 1)
    spare = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 else 0.5
    cut = (LARGEST + 1) * n[LARGEST] / n[0] if n[0] > 0 else 1.0
    for r in range(1, LARGEST + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if n[r - 1] > 0 and cut < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - min(spare, 0.95)) / r
    return out


class Unigrams:
    """Discounted unigram probabilities from counts."""

    def __init__(self, turns: np.ndarray):
        self.total, self.distinct = int(turns[-1]), int(turns[-2])
        self.cut = discounts(turns[: LARGEST + 1])
        freed = sum((1 - self.cut[r]) * r * float(turns[r - 1]) for r in range(1, LARGEST + 1))
        extra = 0 if freed > 0 else 1
        self.base = max(self.total + extra, 1)
        self.unknown = (freed + extra) / self.base if self.total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        share = np.where(c > LARGEST, 1.0, self.cut[np.minimum(c, LARGEST)]) * c / self.base
        return np.where(c > 0, share, self.unknown)


class Unit:
    """A unit's tokens with the answers about its words."""

    def __init__(self, folder: str, name: str, answers: list[tuple], bits: int):
        self.ids, self.held, packed, hashes = pickle.loads(zstandard.decompress(store.get(folder, name)))
        codes, docs = _unpack(packed)
        self.codes, self.docs = codes.astype(np.int64), docs.astype(np.int64)
        count, number = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        for _, _, b, blob in answers:
            x, y = np.searchsorted(bucket, [b, b + 1])
            c, r = _unpack(blob)
            count[x:y], number[x:y] = c, r.astype(np.int64) << bits | b
        self.c = count[self.codes]  # corpus count of each token
        n = number[self.codes]
        first = np.zeros(len(n), bool)
        first[self.docs[:-1]] = True
        before = np.roll(n, 1)
        before[first] = _START
        self.h, self.w = before, np.where(self.c > 0, n, _UNKNOWN)
        ch = np.roll(self.c, 1)
        ch[first] = 1 << 40  # the start is a frequent history
        self.ch = ch
        self.train = np.repeat(~self.held, np.diff(self.docs))

    def bigrams(self, bits: int, frequent: int) -> tuple[np.ndarray, ...]:
        """Distinct bigrams after known words, in ask order: bucket, history, word, the place of one token, its tokens; and which tokens have one."""
        ask = np.flatnonzero(self.ch > 0)
        key = self.h[ask].astype(np.uint64) << np.uint64(32) | self.w[ask].astype(np.uint64)
        own, place, which = np.unique(key, return_index=True, return_inverse=True)
        token = ask[place]
        h, w = (own >> np.uint64(32)).astype(np.int64), (own & np.uint64(0xFFFFFFFF)).astype(np.int64)
        spread = self.ch[token] >= frequent
        bucket = (flat.mix(np.where(spread, own, h.astype(np.uint64)) * flat.K2 + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return bucket[order], h[order], w[order], token[order], spread[order], ask, back[which]


def _ask_bigrams(folder: str, bits: int, frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _groups(batches, "unit"):
            u = Unit(folder, name, rows, bits)
            bucket, h, w, token, spread, ask, which = u.bigrams(bits, frequent)
            own = np.bincount(which[u.train[ask]], minlength=len(h))
            cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            out = []
            for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if y > x:
                    first = np.flatnonzero(np.concatenate([[True], h[x + 1 : y] != h[x : y - 1]])) + x
                    out.append((name, 2, b, _pack(_small(np.diff(h[first], prepend=0)), _small(np.diff(np.append(first, y))), spread[first], _small(w[x:y]), _small(own[x:y]), _small(u.c[token[x:y]]))))
            for low in range(0, len(out), 200):
                yield _batch(out[low : low + 200])

    return run


def _count_bigrams(words: Unigrams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            keys, counts, cw, heads, wide = [], [], [], [], []
            for r in rows:
                step, many, spread, w, own, c = _unpack(r[3])
                h = np.cumsum(step.astype(np.int64))
                heads.append(h)
                wide.append(h[spread])
                keys.append(np.repeat(h, many).astype(np.uint64) << np.uint64(32) | w.astype(np.uint64))
                counts.append(own.astype(np.int32))
                cw.append(c.astype(np.int64))
            known, place, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            total = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)
            low = words.p(np.concatenate(cw)[place])
            h = (known >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            own = h[first]
            seen = total > 0
            stats = [np.add.reduceat(total, first)] + [np.add.reduceat((total == r).astype(np.int64), first) for r in range(1, LARGEST + 1)]
            mass = np.add.reduceat(np.where(seen, low, 0.0), first)
            out = [("", 0, bucket, _pack(_turns(total)))]
            apart = np.isin(own, np.concatenate(wide))
            if apart.any():  # parts of frequent histories
                out.append(("", 3, bucket, _pack(own[apart], *(s[apart] for s in stats), mass[apart])))
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            for r, x, y, ask in zip(rows, at[:-1], at[1:], heads, strict=True):
                j = np.searchsorted(own, ask)
                rest = ~apart[j]
                out.append((r[0], 2, bucket, _pack(_small(total[which[x:y]]), *(_small(s[j][rest]) for s in stats), mass[j][rest])))
            for low_ in range(0, len(out), 200):
                yield _batch(out[low_ : low_ + 200])

    return run


def _weights(c: np.ndarray, m: list[np.ndarray], mass: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and backoff weight of histories."""
    freed = sum((1 - cut[r]) * r * m[r - 1].astype(float) for r in range(1, LARGEST + 1))
    extra = np.where(freed > 0, 0.0, 1.0)
    base = c + extra
    return base, np.where(c > 0, (freed + extra) / np.maximum(base, 1) / np.maximum(1 - mass, 1e-300), 1.0)


def _score(folder: str, bits: int, frequent: int, words: Unigrams, cut: np.ndarray, wide_table, id_col: str):
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, wide_base, wide_back = wide_table.value
        for name, rows in _groups(batches, "unit"):
            u = Unit(folder, name, [r for r in rows if r[1] == 1], bits)
            bucket, h, w, token, spread, ask, which = u.bigrams(bits, frequent)
            count, base, back = np.zeros(len(h), np.int64), np.ones(len(h)), np.ones(len(h))
            for _, kind, b, blob in rows:
                if kind != 2:
                    continue
                x, y = np.searchsorted(bucket, [b, b + 1])
                got = _unpack(blob)
                count[x:y] = got[0]
                own, weight = _weights(got[1].astype(float), got[2 : 2 + LARGEST], got[2 + LARGEST], cut)
                alone = np.flatnonzero(~spread[x:y]) + x
                part = np.cumsum(np.concatenate([[0], h[alone[1:]] != h[alone[:-1]]])) if len(alone) else alone
                base[alone], back[alone] = own[part], weight[part]
            j = np.flatnonzero(spread)
            if len(j) and len(wide):
                k = np.minimum(np.searchsorted(wide, h[j]), len(wide) - 1)
                there = wide[k] == h[j]
                base[j[there]], back[j[there]] = wide_base[k[there]], wide_back[k[there]]
            low = words.p(u.c)
            p = low.copy()
            share = np.where(count > LARGEST, 1.0, cut[np.minimum(count, LARGEST)]) * count / base
            p[ask] = np.where(count[which] > 0, share[which], back[which] * low[ask])
            total = lambda x: np.add.reduceat(x, u.docs[:-1]) if len(u.docs) > 1 else np.zeros(0)
            n = np.diff(u.docs)
            yield pa.RecordBatch.from_arrays([u.ids, pa.array(u.held), pa.array(n), pa.array(total((u.c > 0).astype(np.int64))), pa.array(np.full(len(n), words.total)), pa.array(total(np.log10((u.c + 1) / (words.total + words.distinct + 1)))), pa.array(total(np.log10(p)))], names=names)

    return run


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the rows where ``held_out`` is not true and scores all: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    n = partitions(spark)
    bits = max(3, math.ceil(math.log2(n))) + 2  # buckets small beside a task's memory, and evenly spread
    folder = new_path(spark, "units")
    store.make_folder(folder)
    own = texts(docs, id_col, text_col, F.coalesce(held_out, F.lit(False)).alias("_held"))
    asks = own.mapInArrow(_scan(folder, bits), _ROWS)
    sort = lambda df, key: df.repartition(n, key).sortWithinPartitions(*([key, "kind", "bucket"] if key == "unit" else [key, "unit"]))
    known = written(sort(asks, "bucket").mapInArrow(_count_words(bits), _ROWS), "words")
    zero = np.zeros(LARGEST + 3, np.int64)
    words = Unigrams(sum((_unpack(r.blob)[0] for r in known.where("kind = 0").select("blob").toLocalIterator()), zero))
    frequent = max(FREQUENT, int(words.total * FREQUENT_SHARE))
    known = known.where("kind = 1")
    counted = written(sort(sort(known, "unit").mapInArrow(_ask_bigrams(folder, bits, frequent), _ROWS), "bucket").mapInArrow(_count_bigrams(words), _ROWS), "bigrams")
    cut = discounts(sum((_unpack(r.blob)[0] for r in counted.where("kind = 0").select("blob").toLocalIterator()), zero)[: LARGEST + 1])
    parts: dict[int, np.ndarray] = {}
    for r in counted.where("kind = 3").select("blob").toLocalIterator():  # at most 1 / FREQUENT_SHARE histories
        got = _unpack(r.blob)
        for k, h in enumerate(got[0].tolist()):
            parts[h] = parts.get(h, 0) + np.array([float(x[k]) for x in got[1:]])
    wide = np.array(sorted(parts), np.int64)
    own_parts = np.array([parts[h] for h in wide.tolist()], float).reshape(len(wide), LARGEST + 2)
    table = spark.sparkContext.broadcast((wide, *_weights(own_parts[:, 0], [own_parts[:, 1 + r] for r in range(LARGEST)], own_parts[:, 1 + LARGEST], cut)))
    schema = T.StructType([T.StructField(id_col, own.schema[ID].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return sort(known.union(counted.where("kind = 2")), "unit").mapInArrow(_score(folder, bits, frequent, words, cut, table, id_col), schema)
