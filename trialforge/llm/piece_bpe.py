"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is parsed here; the library is not called.  Each text gets the
dummy prefix, blanks become U+2581, and the text is cut where no piece can
reach across (before a blank that follows a non-blank, and around characters
that occur in no piece).  Equal segments of a slice are encoded once.  All
segments sit in one flat symbol array; every round finds the best-ranked pair
of each segment (the leftmost of equals), merges it in all segments at once,
compacts the array and drops the segments that have no pair left.  One merge
per segment and round is what makes the result equal to the library's agenda,
where a new pair may outrank the other occurrences of the old one.  Segments
of more than ``LONG`` symbols take the same merges from a heap instead, so a
run of a million letters stays n log n.

Null and empty texts give no ids and decode to an empty text.  Rows are
independent: repeated ids or texts give repeated rows.  Frames carry their
other columns along, except that columns named like the results are replaced.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import flat

#: Segments longer than this are merged with a heap.
LONG = 256
#: Encoded segments that a task remembers.
REMEMBERED = 40_000
BLANK = "▁"
_NONE = np.int64(1) << np.int64(62)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, i = _varint(b, i)
            value, i = b[i : i + size], i + size
        yield key >> 3, value


class PieceBpe:
    """A BPE model with byte fallback and identity normalisation."""

    def __init__(self, model: bytes):
        # The piece types of the model format.
        NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
        pieces, spec, trainer = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("not a BPE model with byte fallback")
        if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only identity normalisation that keeps all blanks, marked before words, is supported")
        if any(kind in (USER, UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if any(BLANK in p.lstrip(BLANK) for p, _, kind in pieces if kind == NORMAL):
            raise ValueError("pieces that hold a blank after another character are not supported")
        self.prefix = bool(spec.get(3, 1))
        self.size = len(pieces)
        self.byte_ids = np.zeros(256, np.int64)
        normal = {}
        shown = []
        for k, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = k
                shown.append(bytes([int(p[3:5], 16)]))
            elif kind == NORMAL:
                normal[p] = k
                shown.append(p.replace(BLANK, " ").encode())
            else:
                shown.append(" ⁇ ".encode() if kind == UNKNOWN else b"")
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.is_control = np.array([kind == CONTROL for _, _, kind in pieces])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(x) for x in shown])]).astype(np.int64)
        letters = {c for p in normal for c in p}
        symbol = dict(normal)
        for c in sorted(letters - symbol.keys()):
            symbol[c] = self.size + len(symbol) - len(normal)
        self.n_symbols = self.size + len(symbol) - len(normal)
        chars = sorted(letters)
        self.points = np.array([ord(c) for c in chars], np.int64)
        self.point_symbols = np.array([symbol[c] for c in chars], np.int64)
        scores = sorted({pieces[k][1] for k in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for p, k in normal.items():
            for cut in range(1, len(p)):
                left, right = symbol.get(p[:cut]), symbol.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * self.n_symbols + right] = (rank[pieces[k][1]], k)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.bits = max(8, int(len(pairs)).bit_length() + 2)
        self.table = np.full(1 << self.bits, -1, np.int64)  # open addressing: place of a pair in keys
        waiting = np.arange(len(self.keys))
        slot = self._slot(self.keys)
        while len(waiting):
            free = self.table[slot] < 0
            self.table[slot[free]] = waiting[free]
            lost = self.table[slot] != waiting
            waiting, slot = waiting[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)
        self.alone = np.zeros(256, dtype=bool)  # ASCII characters of no piece
        self.alone[[c for c in range(128) if chr(c) not in letters and c != 0x20]] = True
        self.memory: dict[bytes, np.ndarray] = {}
        self.older: dict[bytes, np.ndarray] = {}

    # -- encoding -----------------------------------------------------------

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * flat.K1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each pair in keys, -1 if it has none."""
        slot = self._slot(keys)
        out = self.table[slot]
        open_ = np.flatnonzero(out >= 0)
        open_ = open_[self.keys[out[open_]] != keys[open_]]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.table[slot[open_]]
            open_ = open_[out[open_] >= 0]
            open_ = open_[self.keys[out[open_]] != keys[open_]]
        return out

    def _heap(self, symbols: list[int]) -> list[int]:
        """The same merges for one long segment."""
        n, pairs, m = len(symbols), self.pairs, self.n_symbols
        ahead, back, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(i: int) -> None:
            j = ahead[i]
            if j < n and symbols[i] >= 0 and symbols[j] >= 0 and (found := pairs.get(symbols[i] * m + symbols[j])):
                heapq.heappush(agenda, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            push(i)
        gone = bytearray(n)
        while agenda:
            _, i, left, right, to = heapq.heappop(agenda)
            j = ahead[i]
            if gone[i] or j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], gone[j], ahead[i] = to, 1, ahead[j]
            if ahead[j] < n:
                back[ahead[j]] = i
            if back[i] >= 0:
                push(back[i])
            push(i)
        return [s for i, s in enumerate(symbols) if not gone[i]]

    def _rounds(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no segment has a pair; symbols and offsets of all segments."""
        n = len(offsets) - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        owner = np.repeat(np.arange(n), np.diff(offsets))
        while len(symbols):
            where = np.flatnonzero((owner[:-1] == owner[1:]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0))
            at = self._places(symbols[where] * self.n_symbols + symbols[where + 1])
            where, at = where[at >= 0], at[at >= 0]
            if not len(where):
                done.append((symbols, owner))
                break
            own = owner[where]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat(self.ranks[at] << np.int64(32) | np.arange(len(where)), first) & np.int64(0xFFFFFFFF)
            spot = where[best]
            symbols = symbols.copy()
            symbols[spot] = self.merged[at[best]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[spot + 1] = False
            busy = np.zeros(n, dtype=bool)
            busy[own[first]] = True
            active = busy[owner]
            if not active.all():
                rest = ~active
                done.append((symbols[rest], owner[rest]))
                keep &= active
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return symbols, offsets
        symbols, owner = np.concatenate([s for s, _ in done]), np.concatenate([o for _, o in done])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)

    def segments(self, found: list[bytes]) -> list[np.ndarray]:
        """Ids of each segment; a segment is UTF-8 with plain blanks."""
        if not found:
            return []
        texts = [x.decode() for x in found]
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[at] == points, self.point_symbols[at], -1 - points)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        out: list[np.ndarray | None] = [None] * len(found)
        short = np.flatnonzero(sizes <= LONG)
        for k in np.flatnonzero(sizes > LONG).tolist():
            own = np.array(self._heap(symbols[offsets[k] : offsets[k + 1]].tolist()), np.int64)
            out[k] = self._final(own, np.array([0, len(own)]))[0]
        pick, own = flat.gather(offsets, short)
        merged, own = self._final(*self._rounds(symbols[pick], own))
        own = own.tolist()
        for j, k in enumerate(short.tolist()):
            out[k] = merged[own[j] : own[j + 1]]
        return out

    def _final(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols and the segments' new offsets; characters of no piece become their bytes."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if not len(odd):
            return symbols.astype(np.int32), offsets
        kinds, which = np.unique(symbols[odd], return_inverse=True)
        points = {int(s): int(p) for p, s in zip(self.points, self.point_symbols, strict=True) if s >= self.size}
        spelled = [self.byte_ids[list(chr(points[s] if s >= 0 else -1 - s).encode())] for s in kinds.tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[odd] = np.array([len(x) for x in spelled])[which]
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = np.repeat(symbols, sizes)
        own = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
        pick, _ = flat.gather(own, which)
        out[flat.spans(at[odd], sizes[odd])] = np.concatenate(spelled)[pick]
        return out.astype(np.int32), at[offsets]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's offset in them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.replace_substring(texts, BLANK, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        data, offsets = flat.buffers(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        blank, alone = data == 0x20, self.alone[data]
        edge = np.zeros(n, dtype=bool)
        edge[1:] = (blank[1:] & ~blank[:-1]) | alone[1:] | alone[:-1]
        edge[offsets[offsets < n]] = True
        cuts = np.append(np.flatnonzero(edge), n)
        coded = flat.binary_array(data, cuts).dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.memory) > REMEMBERED:
            self.memory, self.older = {}, self.memory
        memory, older = self.memory, self.older
        missing = []
        for x in distinct:
            if x not in memory:
                if x in older:
                    memory[x] = older[x]
                else:
                    missing.append(x)
        memory.update(zip(missing, self.segments(missing), strict=True))
        ids = [memory[x] for x in distinct]
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        pick, own = flat.gather(at, codes)
        return np.concatenate(ids)[pick], own[np.searchsorted(cuts, offsets)]

    # -- decoding -----------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Text of each list of ids; broken byte runs give U+FFFD per broken byte."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("id outside the vocabulary")
        pick, at = flat.gather(self.shown_at, ids)
        data = self.shown[pick].tobytes()
        at = at[offsets].tolist()
        out = []
        for k in range(len(offsets) - 1):
            own = ids[offsets[k] : offsets[k + 1]]
            raw = data[at[k] : at[k + 1]]
            if self.prefix and raw[:1] == b" " and len(own):
                first = own[~self.is_control[own]][:1] if self.is_control[own[0]] else own[:1]
                if len(first) and not self.is_byte[first[0]] and self.shown_at[first[0] + 1] > self.shown_at[first[0]] and self.shown[self.shown_at[first[0]]] == 0x20 and first[0] != 0:
                    raw = raw[1:]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(self._mended(own))
        return out

    def _mended(self, ids: np.ndarray) -> str:
        out, run, start = [], b"", True

        def flush(run: bytes) -> None:
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                run = run[size:]

        for k in ids.tolist():
            piece = self.shown[self.shown_at[k] : self.shown_at[k + 1]].tobytes()
            if self.is_byte[k]:
                run += piece
            else:
                flush(run)
                run = b""
                out.append(piece.decode()[1:] if start and self.prefix and k and piece[:1] == b" " else piece.decode())
            start = start and bool(self.is_control[k])
        flush(run)
        return "".join(out)


@lru_cache(maxsize=4)
def load(path: str) -> PieceBpe:
    with open(path, "rb") as f:
        return PieceBpe(f.read())


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [(f, c) for f, c in zip(batch.schema.names, batch.columns, strict=True) if f not in columns]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), names=[f for f, _ in kept] + list(columns))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, model: str | None = None) -> DataFrame:
    """Adds the ids of every whole text, and with ``decoded_col`` the text decoded from them."""
    path = model or default_model()
    drop = [c for c in docs.columns if c in (ids_col, decoded_col) and c != text_col]
    docs = docs.drop(*drop)
    fields = [f for f in docs.schema.fields if f.name not in (ids_col, decoded_col)] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if decoded_col:
        fields.append(T.StructField(decoded_col, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in flat.slices(batch, text_col, flat.SLICE_BYTES // 2):
                ids, offsets = bpe.encode(part.column(part.schema.get_field_index(text_col)))
                more = {ids_col: flat.list_array(ids, offsets)}
                if decoded_col:
                    more[decoded_col] = pa.array(bpe.decode(ids, offsets), pa.string())
                yield _with(part, **more)
        bpe.memory, bpe.older = {}, {}
        flat.release()

    return docs.mapInArrow(run, T.StructType(fields))


def decode(frame: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str | None = None) -> DataFrame:
    """Adds the text of every list of ids; null counts as an empty list."""
    path = model or default_model()
    frame = frame.drop(*[c for c in frame.columns if c == text_col and c != ids_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            lists = pc.fill_null(batch.column(batch.schema.get_field_index(ids_col)), [])
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            yield _with(batch, **{text_col: pa.array(bpe.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets), pa.string())})

    fields = [f for f in frame.schema.fields if f.name != text_col] + [T.StructField(text_col, T.StringType())]
    return frame.mapInArrow(run, T.StructType(fields))
