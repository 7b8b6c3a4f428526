"""Token counts of a unigram segmentation, computed over a shared trie.

Each pre-token (a run of blanks and the word after it, blanks shown as U+2581)
is segmented into the pieces with the greatest sum of scores; a character of no
piece costs its UTF-8 bytes as byte pieces.  Equal sums prefer the shorter last
piece.  The distinct pre-tokens of a slice form a trie, built level by level in
numpy: the nodes of a level are the distinct prefixes of that length.  The
forward score of a node needs only its ancestors, so every shared prefix is
scored once; the terminal nodes hold the token counts, and a document's count
is the sum over its pre-tokens.

Long pre-tokens share little: where fewer than ``FEW`` words reach a depth, each
goes on alone from the scores that the trie carried there, with the same sums
and the same rule for ties, so a run of a million letters costs a few seconds.

The scores are those of the model file.  Those of a BPE model are the ranks of
its merges: the segmentation is the best sum of them, not that of a tokenizer.

Null and empty texts have no tokens.  Rows are independent: repeated ids or
texts give repeated rows, a null id is returned as it came.  Only the id and the
text column are read, so others cannot clash; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import flat
from .piece_bpe import BLANK, PieceBpe, _fields, default_model
from .shared import ID, TEXT, texts

#: Fewer words than this at one depth beyond the longest piece are scored one by one from there on.
FEW = 48
#: Score of a byte piece: below any run of ordinary pieces it could replace.
BYTE_SCORE = -1e6


class Unigram:
    def __init__(self, model: bytes):
        import struct

        bpe = PieceBpe(model)
        self.prefix, self.alone = bpe.prefix, bpe.alone
        score = {}
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                if own.get(3, 1) == 1:
                    # the model's placeholders for runs of blanks count like the rarest pieces
                    score[own[1].decode()] = max(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], -32_000.0)
        self.pieces = score
        self.longest = max(map(len, score))
        texts = sorted(score)
        keys = np.array([self.key(np.array([ord(c) for c in p], np.uint64)) for p in texts], np.uint64)
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], np.array([score[p] for p in texts])[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")

    @staticmethod
    def key(points: np.ndarray) -> np.uint64:
        """Hash of a piece, from its last character back; a longer piece goes on from the hash of a shorter one."""
        h = np.zeros(1, np.uint64)
        for c in points[::-1]:
            h = flat.mix(h * flat.K1 + (c + np.uint64(1)))
        return h[0]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each distinct pre-token."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64)
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        at = np.concatenate([[0], np.cumsum(size)])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        deepest = int(size.max())
        alive = np.searchsorted(-size[order], -np.arange(1, deepest + 1), side="right")  # words with that many characters
        node = np.zeros(n, np.int64)  # of each word (in order) at the last level
        best = [np.zeros(1)]
        used = [np.zeros(1, np.int64)]
        parents: list[np.ndarray] = [np.zeros(1, np.int64)]
        letters: list[np.ndarray] = [np.zeros(1, np.uint64)]
        out = np.zeros(n, np.int64)
        for depth in range(1, deepest + 1):
            m = int(alive[depth - 1])
            if m < FEW and depth > self.longest:  # nothing left to share: each word goes on by itself
                for j in range(m):
                    k, up = int(order[j]), int(node[j])
                    carried = []
                    for level in range(depth - 1, depth - 1 - self.longest, -1):
                        carried.append((float(best[level][up]), int(used[level][up])))
                        up = int(parents[level][up])
                    out[k] = self._alone(words[k], depth - 1, carried[::-1])
                break
            letter = points[at[:-1][order[:m]] + depth - 1]
            both, which = np.unique(node[:m].astype(np.uint64) << np.uint64(32) | letter, return_inverse=True)
            node = which
            parents.append((both >> np.uint64(32)).astype(np.int64))
            letters.append(both & np.uint64(0xFFFFFFFF))
            width = np.select([letters[-1] < 0x80, letters[-1] < 0x800, letters[-1] < 0x10000], [1, 2, 3], 4)
            top = best[-1][parents[-1]] + BYTE_SCORE * width
            tokens = used[-1][parents[-1]] + width
            up, hash_, level = np.arange(len(both)), np.zeros(len(both), np.uint64), depth
            # the piece of each length that ends here, hashed from its last character back
            for _ in range(min(depth, self.longest)):
                hash_ = flat.mix(hash_ * flat.K1 + (letters[level][up] + np.uint64(1)))
                up = parents[level][up]
                level -= 1
                j = np.minimum(np.searchsorted(self.keys, hash_), len(self.keys) - 1)
                value = np.where(self.keys[j] == hash_, best[level][up] + self.scores[j], -np.inf)
                better = value > top
                top = np.where(better, value, top)
                tokens = np.where(better, used[level][up] + 1, tokens)
            best.append(top)
            used.append(tokens)
            done = int(alive[depth]) if depth < deepest else 0
            out[order[done:m]] = tokens[node[done:m]]
            if depth > self.longest + 1:  # ancestors out of reach
                best[depth - self.longest - 1] = used[depth - self.longest - 1] = parents[depth - self.longest - 1] = letters[depth - self.longest - 1] = None
        return out

    def _alone(self, word: str, done: int, carried: list[tuple[float, int]]) -> int:
        """Tokens of a word whose first ``done`` characters are scored; ``carried`` are the last scores and counts, up to that of ``done``."""
        score, longest, keep = self.pieces, self.longest, len(carried)
        best, used = [b for b, _ in carried], [u for _, u in carried]
        for e in range(done + 1, len(word) + 1):
            c = word[e - 1]
            k = 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            top, tokens = best[-1] + BYTE_SCORE * k, used[-1] + k
            for m in range(1, longest + 1):
                s = score.get(word[e - m : e])
                if s is not None and best[-m] + s > top:
                    top, tokens = best[-m] + s, used[-m] + 1
            best.append(top)
            used.append(tokens)
            if len(best) > 4096:
                del best[:-keep], used[:-keep]
        return used[-1]


@lru_cache(maxsize=4)
def load(path: str) -> Unigram:
    with open(path, "rb") as f:
        return Unigram(f.read())


def _count(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in flat.slices(batch, TEXT):
                text = pc.replace_substring(pc.fill_null(part.column(1).cast(pa.large_string()), ""), BLANK, " ")
                if model.prefix:
                    text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
                data, offsets = flat.buffers(text)
                n = len(data)
                blank, alone = data == 0x20, model.alone[data]
                edge = np.zeros(n, bool)
                edge[1:] = (blank[1:] & ~blank[:-1]) | alone[1:] | alone[:-1]
                edge[offsets[offsets < n]] = True
                cuts = np.append(np.flatnonzero(edge), n)
                coded = flat.binary_array(data, cuts).dictionary_encode()
                tokens = model.counts([x.decode().replace(" ", BLANK) for x in coded.dictionary.to_pylist()])
                each = tokens[coded.indices.to_numpy()] if n else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(each)])
                at = np.searchsorted(cuts, offsets) if n else np.zeros(len(offsets), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(np.diff(total[at]).astype(np.int64))], names=names)

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``id, n_pretokens, n_tokens`` per row."""
    own = texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, own.schema[ID].dataType), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return own.mapInArrow(_count(model or default_model(), [f.name for f in schema]), schema)
