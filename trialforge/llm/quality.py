"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document: bad, good or no vote.
Two questions have their own labellers: is it junk (repetition, capitals,
symbols, navigation bars, few distinct words, shouting, few plain words), and is it toxic (a
fixed list of insults, and words and word beginnings that a bounded sample of
labelled rows shows to be toxic).  Documents count by their pattern of votes,
over the whole table; expectation-maximisation on the pattern counts estimates
each labeller's accuracy and every pattern's posterior.  The posteriors of a
bounded sample of documents train a sparse linear scorer on hashed features
(words, word beginnings and statistics), which then scores every whole
document.  A document is kept if both of its scores are below one half.

Bounds: ``LABELLED`` labelled rows for the word lists, ``TRAINED`` documents for
the scorer (those of least id hash, so the sample does not depend on the order
of rows; ids that tie come in the order of the ids, ids of several rows are left
out) with ``FEATURES`` features together, ``2 ** BITS`` weights.  Without labels the lists stay empty.

Null and empty texts get no votes but those on what they lack and are kept.  A
text of any length is one row.  Rows are scored one by one: repeated rows get
equal scores, null ids are scored too but never sampled.  Carried columns that
are called like a result are replaced by it; others cannot clash.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import flat
from .shared import ID, TEXT, cut, texts

LABELLED, TRAINED, FEATURES, BITS = 20_000, 12_000, 6_000_000, 18
#: Most that a labeller may be estimated to vote bad on good documents.
SLIP = 0.005
#: A listed word occurs in so many toxic labelled rows, and in toxic ones in this share.
LISTED, SHARE = 5, 0.95
#: What the first toxicity labeller looks for; the other two learn from labels.
INSULTS = ["idiot", "moron", "stupid", "loser", "pathetic", "scum", "trash", "worthless", "disgusting", "clown"]
JUNK = ["repeats", "capitals", "symbols", "bars", "variety", "shouting", "plain"]
TOXIC = ["insults", "listed", "beginnings"]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "*#%&$@^~=+<>{}[]\\_!"]] = True
_SPAN = (4, 5)


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _pairs(row: np.ndarray, col: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order; sorted as 32-bit numbers where these hold them."""
    kind = np.uint32 if rows * cols < 1 << 32 else np.uint64
    x = row.astype(kind) * kind(cols) + col.astype(kind)
    x.sort()
    x = x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
    row = x // kind(max(cols, 1))
    return row.astype(np.int64), (x - row * kind(cols)).astype(np.int64)


def _flags(found: pa.Array) -> np.ndarray:
    return pc.fill_null(found, False).to_numpy(zero_copy_only=False)


class Slice:
    """Words, statistics and votes of the texts of a slice."""

    def __init__(self, column: pa.Array):
        w = flat.words(column, lower=True)
        raw, _ = flat.buffers(column)
        self.n = np.diff(w.docs)
        same = np.zeros(len(w.codes), bool)
        same[1:] = w.codes[1:] == w.codes[:-1]
        same[w.docs[:-1][self.n > 0]] = False
        names = w.distinct.cast(pa.large_string())
        self.bare = pc.utf8_trim(names, ".,;:!?\"'()*#%&$|")
        sizes = pc.utf8_length(self.bare)
        self.spans = [pc.if_else(pc.greater(sizes, m), pc.utf8_slice_codeunits(self.bare, 0, m), pa.scalar(None, pa.large_string())) for m in _SPAN]
        # distinct words of each text
        self.row, self.code = _pairs(np.repeat(np.arange(len(self.n), dtype=np.int64), self.n), w.codes, len(self.n), len(names))
        self.kinds = np.bincount(self.row, minlength=len(self.n))
        letters = _sums(_LETTER[raw], w.offsets)
        sizes = np.diff(w.offsets)
        pick = lambda found: _sums(_flags(found)[w.codes] if len(w.codes) else np.zeros(0, bool), w.docs)
        self.stats = {
            "repeats": _ratio(_sums(same, w.docs), self.n), "capitals": _ratio(_sums(_UPPER[raw], w.offsets), letters), "symbols": _ratio(_sums(_SYMBOL[raw], w.offsets), sizes),
            "bars": _ratio(pick(pc.equal(names, "|")), self.n), "variety": np.where(self.n >= 40, self.kinds / np.maximum(np.minimum(self.n, 400), 1), 1.0), "shouting": _ratio(pick(pc.ends_with(names, "!!")), self.n), "plain": _ratio(pick(pc.utf8_is_alnum(pc.utf8_trim(names, ".,;:!?\"'()-"))), self.n),
        }

    def has(self, flags: np.ndarray) -> np.ndarray:
        """Texts with a word that is flagged by its code."""
        return np.bincount(self.row[flags[self.code]], minlength=len(self.n)) > 0 if len(self.code) else np.zeros(len(self.n), bool)

    def votes(self, listed: set[str], beginnings: set[str]) -> np.ndarray:
        """2 bad, 1 good, 0 no vote; one column per labeller, JUNK then TOXIC."""
        limits = {"repeats": (0.25, 0.08), "capitals": (0.35, 0.2), "symbols": (0.06, 0.03), "bars": (0.1, 0.03), "shouting": (0.15, 0.05)}
        out = np.zeros((len(self.n), len(JUNK) + len(TOXIC)), np.int8)
        enough = self.n >= 8
        for k, name in enumerate(JUNK):
            s = self.stats[name]
            bad, good = (s < 0.15, s > 0.35) if name == "variety" else (s < 0.75, s > 0.9) if name == "plain" else (s > limits[name][0], s < limits[name][1])
            out[:, k] = np.where(enough & bad, 2, np.where(enough & good, 1, 0))
        for k, (known, columns) in enumerate(((set(INSULTS), [self.bare]), (listed, [self.bare]), (beginnings, self.spans))):
            if known:
                known = pa.array(sorted(known), pa.large_string())
                out[:, len(JUNK) + k] = np.where(self.has(np.logical_or.reduce([_flags(pc.is_in(c, known)) for c in columns])), 2, 1) * (self.n > 0)
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and hashed feature, each pair once, in order."""
        top = (1 << BITS) - 1
        own = [np.array([xxhash.xxh3_64_intdigest(b"w" + x) & top for x in self.bare.cast(pa.large_binary()).to_pylist()], np.int32)]
        for c in self.spans:
            coded = c.dictionary_encode()
            known = np.array([xxhash.xxh3_64_intdigest("p" + x) & top for x in coded.dictionary.to_pylist()] + [-1], np.int32)
            own.append(known[pc.fill_null(coded.indices, len(known) - 1).to_numpy(zero_copy_only=False)])
        own = np.stack(own, axis=1)[self.code].ravel()
        there = own >= 0
        rows, cols = [np.repeat(self.row, 1 + len(_SPAN))[there]], [own[there]]
        for name, s in self.stats.items():
            step = np.minimum(np.floor(np.sqrt(s) * 20), 20).astype(np.int64)
            known = np.array([xxhash.xxh3_64_intdigest(f"s{name}{j}") & top for j in range(21)], np.int32)
            rows.append(np.arange(len(s), dtype=np.int64))
            cols.append(known[step])
        return _pairs(np.concatenate(rows), np.concatenate(cols), len(self.n), 1 << BITS)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Two-class model of votes (0 none, 1 good, 2 bad): P(bad) of each pattern, prior, P(vote | class) by labeller, class and vote.

    Labellers are built to be precise: the chance of a bad vote for a good document is held at ``SLIP`` at most.  Without that the bad class would
    shrink to the one kind of bad document on which most labellers agree.
    """
    n, k = patterns.shape
    bad, good = (patterns == 2).sum(1), (patterns == 1).sum(1)
    post = np.where(bad > 0, 0.9, np.where(good > 0, 0.1, 0.5))
    hot = np.stack([patterns == v for v in range(3)], axis=2).astype(float)  # pattern, labeller, vote
    prior, emit = 0.5, np.zeros((k, 2, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])  # class, pattern
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        emit = np.einsum("cp,pkv->kcv", weight, hot) + np.array([[0.5, 1.0, 0.1], [0.5, 1.0, 1.0]])[None]
        emit /= emit.sum(axis=2, keepdims=True)
        emit[:, 0, 2] = np.minimum(emit[:, 0, 2], SLIP)
        like = np.einsum("pkv,kcv->pc", hot[:, :, 1:], np.log(emit[:, :, 1:])) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    # patterns without any vote say nothing
    return np.where((bad + good) > 0, post, np.minimum(prior, 0.49)), prior, emit


def fit(rows: np.ndarray, cols: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 0.3, l1: float = 1e-3) -> tuple[np.ndarray, float]:
    """Sparse logistic weights for soft targets, both classes weighing the same: adaptive gradient steps with shrinkage."""
    n, out, b = len(target), np.zeros(1 << BITS), 0.0
    if not n:
        return out, -1.0
    share = min(max(target.mean(), 0.02), 0.98)
    mass = (target / share + (1 - target) / (1 - share)) / 2
    # a feature whose gradient cannot exceed the shrinkage keeps weight zero
    able = (np.bincount(cols, weights=mass[rows], minlength=1 << BITS) / n > l1)[cols]
    rows, cols = rows[able], cols[able]
    if not len(rows):
        return out, float(np.log(share / (1 - share))) if 0 < target.mean() < 1 else -1.0
    # once by row and once by feature, so that sums run over neighbours
    kinds, col = np.unique(cols, return_inverse=True)
    order = np.argsort(col, kind="stable")
    of_col, at_col = rows[order].astype(np.int32), np.searchsorted(col[order], np.arange(len(kinds)))
    present, at_row = np.unique(rows, return_index=True)
    col = col.astype(np.int32)
    w, seen, seen_b, z = np.zeros(len(kinds)), np.zeros(len(kinds)), 0.0, np.zeros(n)
    for _ in range(rounds):
        z[present] = np.add.reduceat(w[col], at_row)
        g = (1 / (1 + np.exp(-np.clip(z + b, -50, 50))) - target) * mass / n
        gw = np.add.reduceat(g[of_col], at_col)
        seen += gw * gw
        seen_b += g.sum() ** 2
        scale = rate / (np.sqrt(seen) + 1e-8)
        w -= scale * gw
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)
        b -= rate * g.sum() / (np.sqrt(seen_b) + 1e-8)
    out[kinds] = w
    return out, b


def _listed(docs: DataFrame, labels: DataFrame, id_col: str, toxic_col: str) -> tuple[set[str], set[str]]:
    """Words and word beginnings that labelled rows show to be toxic."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).select(F.col(id_col).alias("_l"), F.col(toxic_col).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("_l"), "_l").limit(LABELLED)
    both = docs.join(F.broadcast(known), F.col(ID) == F.col("_l")).select("toxic", TEXT)  # LABELLED rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, TEXT):
                s = Slice(part.column(1))
                toxic = part.column(0).to_numpy(zero_copy_only=False)
                spelled: dict[str, int] = {}
                at, own = [0], []
                for x in s.bare.to_pylist():
                    own += [spelled.setdefault(y, len(spelled)) for y in ["w" + x, *("p" + x[:m] for m in _SPAN if len(x) > m)] if len(y) > 2]
                    at.append(len(own))
                pick, sizes = flat.gather(np.array(at, np.int64), s.code)
                pair = np.unique(np.repeat(s.row, np.diff(sizes)) << 32 | np.array(own, np.int64)[pick])
                bad = np.bincount(pair & 0xFFFFFFFF, weights=toxic[pair >> 32], minlength=len(spelled))
                yield pa.RecordBatch.from_arrays([pa.array(list(spelled), pa.string()), pa.array(np.bincount(pair & 0xFFFFFFFF, minlength=len(spelled)).astype(np.int64)), pa.array(bad.astype(np.int64))], names=["x", "n", "bad"])

    found = both.mapInArrow(run, "x string, n long, bad long").groupBy("x").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    found = found.where((F.col("bad") >= LISTED) & (F.col("bad") >= SHARE * F.col("n"))).select("x").collect()  # terms of LABELLED rows
    return {r.x[1:] for r in found if r.x[0] == "w"}, {r.x[1:] for r in found if r.x[0] == "p"}


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", carry: tuple[str, ...] = (), trained: int = TRAINED, posteriors: bool = False) -> DataFrame:
    """``id, *carry, n_words, junk, toxic, kept`` per row: the scores of the trained scorer and the decision; with ``posteriors`` also ``weak_junk, weak_toxic`` of the votes, which every row then casts again."""
    results = ["n_words", *(["weak_junk", "weak_toxic"] if posteriors else []), "junk", "toxic", "kept"]
    carry = tuple(c for c in carry if c not in (id_col, *results))
    own = texts(docs, id_col, text_col)
    listed, beginnings = _listed(own, labels, id_col, toxic_col) if labels is not None else (set(), set())
    signs = lambda s: ["".join(map(str, v)) for v in s.votes(listed, beginnings).tolist()]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, TEXT):
                s = Slice(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signs(s), pa.string()), pa.array((1 + len(_SPAN)) * s.kinds + len(s.stats))], names=[ID, "votes", "most"])

    kind = own.schema[ID].dataType
    voted = cut(own.mapInArrow(vote, T.StructType([T.StructField(ID, kind), T.StructField("votes", T.StringType()), T.StructField("most", T.LongType())])), docs.count(), apart=True)
    counted = voted.groupBy("votes").count().collect()  # 3 ** 10 patterns at most
    patterns = np.array([[int(c) for c in r["votes"]] for r in counted], np.int8).reshape(len(counted), len(JUNK) + len(TOXIC))
    counts = np.array([r["count"] for r in counted], float)
    junk, toxic = em(patterns[:, : len(JUNK)], counts)[0], em(patterns[:, len(JUNK) :], counts)[0]
    weak = {r["votes"]: (float(j), float(t)) for r, j, t in zip(counted, junk, toxic, strict=True)}

    # ``trained`` ids of one row each, with ``FEATURES`` features at most; the row after the last tells whether the last repeats
    drawn = voted.where(F.col(ID).isNotNull()).select(ID, "most").orderBy(F.xxhash64(ID), ID).limit(trained + 1).collect()
    often = Counter(r[ID] for r in drawn)
    drawn = [r for r in drawn[:trained] if often[r[ID]] == 1]
    drawn = [r[ID] for r, total in zip(drawn, np.cumsum([r["most"] for r in drawn]), strict=True) if total <= FEATURES]
    sample = docs.sparkSession.createDataFrame(pa.table({"_s": pa.array(drawn, to_arrow_type(kind))}))
    chosen = own.join(F.broadcast(sample), own[ID] == F.col("_s")).select(F.xxhash64(ID).alias("h"), TEXT)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, TEXT):
                s = Slice(part.column(1))
                rows, cols = s.features()
                at = np.searchsorted(rows, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signs(s), pa.string()), flat.list_array(cols.astype(np.int32), at)], names=["h", "votes", "cols"])

    got = chosen.mapInArrow(features, "h long, votes string, cols array<int>").orderBy("h", "votes").toArrow()
    lists = got.column("cols").combine_chunks()
    cols = lists.flatten().to_numpy() if len(got) else np.zeros(0, np.int32)
    rows = np.repeat(np.arange(len(got), dtype=np.int32), lists.value_lengths().to_numpy()) if len(got) else np.zeros(0, np.int32)
    targets = [np.array([weak[v][k] for v in got.column("votes").to_pylist()], float) for k in (0, 1)]
    (w0, b0), (w1, b1) = fit(rows, cols, targets[0]), fit(rows, cols, targets[1])
    model = docs.sparkSession.sparkContext.broadcast((w0.astype(np.float32), w1.astype(np.float32)))  # 2 ** BITS weights each
    names = [id_col, *carry, *results]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, TEXT):
                s = Slice(part.column(1))
                rows, cols = s.features()
                both = [1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[cols], minlength=len(s.n)) + b, -50, 50))) for w, b in zip(model.value, (b0, b1), strict=True)]
                both = [np.where(s.n > 0, x, 0.0) for x in both]
                told = np.array([weak[v] for v in signs(s)]).reshape(-1, 2).T if posteriors else []
                more = [pa.array(s.n.astype(np.int64)), *map(pa.array, told), *map(pa.array, both), pa.array((both[0] < 0.5) & (both[1] < 0.5))]
                rest = iter(range(2, part.num_columns))
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(1 if c == text_col else next(rest)) for c in carry), *more], names=names)

    fields = [T.StructField(id_col, kind), *(T.StructField(c, docs.schema[c].dataType) for c in carry), T.StructField("n_words", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in results[1:-1]), T.StructField("kept", T.BooleanType())]
    return texts(docs, id_col, text_col, *[docs[c].alias(f"_c{k}") for k, c in enumerate(carry) if c != text_col]).mapInArrow(score, T.StructType(fields))
