"""Trial sets as Zarr stores (format 2) in the layout of annotated matrices.

``X`` and ``layers/*`` are chunked by rows, ``obs`` holds the observation
columns, ``var`` the time axis (column ``t``) and ``uns`` the metadata.  Each
task writes or reads whole chunks, so no task or driver holds more than one
block of rows; the driver handles the small JSON descriptions and the axis.
Observation columns are booleans, integers, floating numbers or strings;
others are a ValueError, to be cast first.  Nulls become masked columns (NaN
for floating numbers).
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.trialset import TrialSet
from ..session import shared_path

_GROUP = json.dumps({"zarr_format": 2})
_KINDS = {"boolean": "|b1", "tinyint": "<i8", "smallint": "<i8", "int": "<i8", "bigint": "<i8", "float": "<f8", "double": "<f8", "string": "|O"}
_MASKED = {"|b1": "nullable-boolean", "<i8": "nullable-integer", "|O": "nullable-string-array"}


def _system(path: str) -> tuple[fs.FileSystem, str]:
    system, at = fs.FileSystem.from_uri(path)
    return system, at.rstrip("/")


# -- bytes of a chunk ------------------------------------------------------------------


def _packed(values: np.ndarray | list, kind: str) -> bytes:
    if kind == "|O":
        words = [str(v).encode() for v in values]
        raw = b"".join([len(words).to_bytes(4, "little"), *(len(w).to_bytes(4, "little") + w for w in words)])
    else:
        raw = np.ascontiguousarray(values, np.dtype(kind)).tobytes()
    return zlib.compress(raw, 1)


def _blosc(raw: bytes) -> bytes:
    """A Blosc frame (version 2): LZ4, zlib or Zstandard blocks, plain or byte-shuffled."""
    flags, size = raw[2], raw[3]
    total, block, _ = np.frombuffer(raw, "<u4", 3, 4).tolist()
    if flags & 2:
        return raw[16 : 16 + total]
    codec = {1: "lz4_raw", 3: "zlib", 4: "zstd"}.get(flags >> 5)
    if codec is None or flags & 4:
        raise ValueError("Blosc chunks must be LZ4, zlib or Zstandard, and not bit-shuffled")
    starts, out = np.frombuffer(raw, "<u4", -(-total // block), 16).tolist(), []
    for k, at in enumerate(starts):
        n = min(block, total - k * block)
        streams = size if not flags & 16 and n == block and 1 < size <= 16 and block // size >= 128 else 1
        parts = []
        for _ in range(streams):
            length = int.from_bytes(raw[at : at + 4], "little")
            body, at = raw[at + 4 : at + 4 + length], at + 4 + length
            parts.append(body if length == n // streams else zlib.decompress(body) if codec == "zlib" else pa.decompress(body, n // streams, codec, asbytes=True))
        own = b"".join(parts)
        if flags & 1 and size > 1:
            whole = n // size * size
            own = np.frombuffer(own[:whole], np.uint8).reshape(size, -1).T.tobytes() + own[whole:]
        out.append(own)
    return b"".join(out)


def _unpacked(raw: bytes, meta: dict) -> np.ndarray:
    codec = (meta.get("compressor") or {}).get("id")
    if codec == "zlib":
        raw = zlib.decompress(raw)
    elif codec == "gzip":
        raw = gzip.decompress(raw)
    elif codec == "blosc":
        raw = _blosc(raw)
    elif codec == "lz4":
        raw = pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), "lz4_raw", asbytes=True)
    elif codec == "zstd":
        with pa.CompressedInputStream(pa.BufferReader(raw), "zstd") as f:
            raw = f.read()
    elif codec is not None:
        raise ValueError(f"unknown compressor {codec}")
    filters = [f["id"] for f in meta.get("filters") or []]
    if filters not in ([], ["vlen-utf8"]):
        raise ValueError(f"unknown filters {filters}")
    if filters:
        out, at = np.empty(int.from_bytes(raw[:4], "little"), object), 4
        for k in range(len(out)):
            n = int.from_bytes(raw[at : at + 4], "little")
            out[k], at = raw[at + 4 : at + 4 + n].decode(), at + 4 + n
    else:
        out = np.frombuffer(raw, np.dtype(meta["dtype"]))
    return out.reshape(meta["chunks"], order=meta.get("order", "C"))


def _array(system: fs.FileSystem, at: str, meta: dict, a: int = 0, b: int | None = None) -> np.ndarray:
    """Rows a to b of an array, from the chunks that hold them; a chunk without a file is the fill value."""
    shape, chunks = meta["shape"], meta["chunks"]
    if not shape:
        return _unpacked(_bytes(system, f"{at}/0"), meta)
    b = shape[0] if b is None else b
    fill = meta.get("fill_value")
    kind = object if (meta.get("filters") or meta["dtype"] == "|O") else np.dtype(meta["dtype"])
    out = np.full([b - a, *shape[1:]], ("" if kind is object else 0) if fill is None or (kind is object and fill == 0) else float(fill) if isinstance(fill, str) and kind is not object else fill, kind)
    if b <= a:
        return out
    grid = [range(a // chunks[0], (b - 1) // chunks[0] + 1), *(range(-(-n // c)) for n, c in zip(shape[1:], chunks[1:], strict=True))]
    for cell in product(*grid):
        raw = _bytes(system, f"{at}/{meta.get('dimension_separator', '.').join(map(str, cell))}")
        if raw is None:
            continue
        part, low = _unpacked(raw, meta), cell[0] * chunks[0]
        first, last = max(a, low), min(b, low + chunks[0])
        rest = [slice(k * c, min((k + 1) * c, n)) for k, c, n in zip(cell[1:], chunks[1:], shape[1:], strict=True)]
        out[(slice(first - a, last - a), *rest)] = part[(slice(first - low, last - low), *(slice(0, s.stop - s.start) for s in rest))]
    return out


def _bytes(system: fs.FileSystem, at: str) -> bytes | None:
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(at) as f:
        return f.read()


# -- writing ---------------------------------------------------------------------------


def _put(system: fs.FileSystem, at: str, data: bytes | str) -> None:
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(data.encode() if isinstance(data, str) else data)


def _group(system: fs.FileSystem, at: str, kind: str, version: str, **more) -> None:
    _put(system, f"{at}/.zgroup", _GROUP)
    _put(system, f"{at}/.zattrs", json.dumps({"encoding-type": kind, "encoding-version": version, **more}))


def _describe(system: fs.FileSystem, at: str, shape: list[int], chunks: list[int], kind: str, encoding: str | None = None) -> None:
    text = kind == "|O"
    meta = {
        "zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": kind, "order": "C", "fill_value": None if text else False if kind == "|b1" else 0,
        "compressor": {"id": "zlib", "level": 1}, "filters": [{"id": "vlen-utf8"}] if text else None,
    }
    _put(system, f"{at}/.zarray", json.dumps(meta))
    _put(system, f"{at}/.zattrs", json.dumps({"encoding-type": encoding or ("string-array" if text else "array"), "encoding-version": "0.2.0"}))


def _whole(system: fs.FileSystem, at: str, values: list, kind: str) -> None:
    _describe(system, at, [len(values)], [max(len(values), 1)], kind)
    if values:
        _put(system, f"{at}/0", _packed(values, kind))


def _metadata(system: fs.FileSystem, at: str, values: dict) -> None:
    """Nested mappings of numbers, strings and lists of these."""
    _group(system, at, "dict", "0.1.0")
    for k, v in values.items():
        if not k or "/" in k or k.startswith("."):
            raise ValueError(f"{k!r} cannot be a name in a store")
        if isinstance(v, dict):
            _metadata(system, f"{at}/{k}", v)
            continue
        one = not isinstance(v, (list, tuple))
        row = [v] if one else list(v)
        for kind, types in (("|b1", bool), ("<i8", int), ("<f8", (int, float)), ("|O", str)):
            if all(isinstance(e, types) for e in row):
                break
        else:
            raise ValueError(f"metadata {k} cannot be stored")
        if one:
            _describe(system, f"{at}/{k}", [], [], kind, "string" if kind == "|O" else "numeric-scalar")
            _put(system, f"{at}/{k}/0", _packed(row, kind))
        else:
            _whole(system, f"{at}/{k}", row, kind)


def _numbered(frame: DataFrame, order: list[str], columns: list[str]) -> tuple[DataFrame, int, dict[str, int]]:
    """Gapless ``_row`` in the order of some columns, the number of rows and the nulls per column; rows are sorted by range, and no task numbers them all."""
    spark = frame.sparkSession
    sorted_ = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    path = shared_path(spark, "zarr")
    sorted_.write.parquet(path)  # fixes the order of ties
    own = spark.read.schema(sorted_.schema).parquet(path)
    parts = own.groupBy("_part").agg(F.count("*").alias("n"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"z{k}") for k, c in enumerate(columns)]).orderBy("_part").collect()
    starts = np.concatenate([[0], np.cumsum([r.n for r in parts])]).astype(int).tolist()
    nulls = {c: sum(r[f"z{k}"] for r in parts) for k, c in enumerate(columns)}
    first = spark.createDataFrame([(r["_part"], s) for r, s in zip(parts, starts)], "_part int, _first long")  # one row per partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return own.withColumn("_at", place).join(F.broadcast(first), "_part").withColumn("_row", F.col("_first") + F.col("_at") - 1), starts[-1], nulls


def write_zarr(of: TrialSet, path: str, order: str, rows: int = 1024) -> None:
    """The set at a new path (a URI that driver and executors share), its trials in the order of a column that tells them apart."""
    _write(of, path, [order], rows)


def _write(of: TrialSet, path: str, order: list[str], rows: int, hidden: tuple[str, ...] = ()) -> None:
    """The same with several columns of order, some of which are not stored."""
    system, base = _system(path)
    if system.get_file_info(base).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    kinds = {c: _KINDS.get(t) for c, t in of.obs.dtypes if c not in hidden}
    bad = [c for c, k in kinds.items() if k is None or "/" in c or c == "_index"]
    if bad:
        raise ValueError(f"columns {bad} cannot be stored")
    of.checked()
    own, n, nulls = _numbered(of.frame, order, list(kinds))
    masked = [c for c, k in kinds.items() if nulls[c] and k != "<f8"]
    _put(system, f"{base}/.zgroup", _GROUP)
    _put(system, f"{base}/.zattrs", json.dumps({"encoding-type": "anndata", "encoding-version": "0.1.0"}))
    for name in ("layers", "obsm", "varm", "obsp", "varp"):
        _group(system, f"{base}/{name}", "dict", "0.1.0")
    _metadata(system, f"{base}/uns", of.metadata)
    _group(system, f"{base}/var", "dataframe", "0.2.0", **{"_index": "_index", "column-order": ["t"]})
    _whole(system, f"{base}/var/_index", [str(k) for k in range(len(of.axis))], "|O")
    _whole(system, f"{base}/var/t", list(of.axis), "<f8")
    _group(system, f"{base}/obs", "dataframe", "0.2.0", **{"_index": "_index", "column-order": list(kinds)})
    arrays = {f"{base}/X": of.x, **{f"{base}/layers/{c}": c for c in of.layers}}
    for at in arrays:
        _describe(system, at, [n, len(of.axis)], [rows, max(len(of.axis), 1)], "<f8")
    columns = {f"{base}/obs/_index": ("_name", "|O")}
    for k, (c, kind) in enumerate(kinds.items()):
        at = f"{base}/obs/{c}"
        if c in masked:
            _group(system, at, _MASKED[kind], "0.1.0")
            columns |= {f"{at}/values": (f"v{k}", kind), f"{at}/mask": (f"z{k}", "|b1")}
        else:
            columns[at] = (f"v{k}", kind)
    for at, (_, kind) in columns.items():
        _describe(system, at, [n], [rows], kind)
    empty = {"|b1": False, "<i8": 0, "<f8": float("nan"), "|O": ""}
    sent = own.select(
        "_row", F.col("_row").cast("string").alias("_name"), *[F.col(c).alias(f"x{k}") for k, c in enumerate(arrays.values())],
        *[F.coalesce(F.col(c), F.lit(empty[kind])).alias(f"v{k}") for k, (c, kind) in enumerate(kinds.items())], *[F.col(c).isNull().alias(f"z{k}") for k, c in enumerate(kinds)],
    )
    places = list(arrays)

    def put(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_row")
        system, _ = _system(path)
        chunk, pad = int(p["_row"].iloc[0]) // rows, rows - len(p)
        for k, at in enumerate(places):
            block = np.array([np.array(v, float) for v in p[f"x{k}"]])
            _put(system, f"{at}/{chunk}.0", _packed(np.pad(block, ((0, pad), (0, 0))), "<f8"))
        for at, (c, kind) in columns.items():
            values = p[c].tolist()
            _put(system, f"{at}/{chunk}", _packed(values + [{"|O": "", "|b1": False}.get(kind, 0)] * pad, kind))
        return pd.DataFrame({"n": [len(p)]})

    done = sent.groupBy((F.col("_row") / rows).cast("long").alias("_chunk")).applyInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0
    if done != n:
        raise OSError(f"{done} of {n} trials were written")


# -- reading ---------------------------------------------------------------------------


def _json(system: fs.FileSystem, at: str) -> dict:
    raw = _bytes(system, at)
    if raw is None:
        raise FileNotFoundError(at)
    return json.loads(raw)


def _names(system: fs.FileSystem, at: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


def _mapping(system: fs.FileSystem, at: str) -> dict:
    out = {}
    for k in _names(system, at):
        if _bytes(system, f"{at}/{k}/.zgroup") is not None:
            out[k] = _mapping(system, f"{at}/{k}")
        else:
            meta = _json(system, f"{at}/{k}/.zarray")
            out[k] = _array(system, f"{at}/{k}", meta).tolist()
    return out


def _column(system: fs.FileSystem, at: str) -> tuple[str, dict[str, dict], str]:
    """Encoding, the descriptions of its arrays and the Spark type of a column."""
    kind = _json(system, f"{at}/.zattrs").get("encoding-type", "array")
    if kind == "categorical":
        parts = {"codes": _json(system, f"{at}/codes/.zarray"), "categories": _json(system, f"{at}/categories/.zarray")}
        value = parts["categories"]
    elif kind in _MASKED.values():
        parts = {k: _json(system, f"{at}/{k}/.zarray") for k in ("values", "mask")}
        value = parts["values"]
    else:
        parts = {"": _json(system, f"{at}/.zarray")}
        value = parts[""]
    code = np.dtype(value["dtype"]).kind
    return kind, parts, {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double"}.get(code, "string")


def _values(system: fs.FileSystem, at: str, kind: str, parts: dict[str, dict], to: str, a: int, b: int) -> pa.Array:
    arrow = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[to]
    if kind == "categorical":
        own = _array(system, f"{at}/categories", parts["categories"]).tolist()
        return pa.array([own[c] if c >= 0 else None for c in _array(system, f"{at}/codes", parts["codes"], a, b).tolist()], arrow)
    if "mask" in parts:
        mask = _array(system, f"{at}/mask", parts["mask"], a, b).tolist()
        return pa.array([None if z else v for v, z in zip(_array(system, f"{at}/values", parts["values"], a, b).tolist(), mask, strict=True)], arrow)
    return pa.array(_array(system, at, parts[""], a, b).tolist(), arrow)


def read_zarr(spark: SparkSession, path: str, x: str = "x") -> TrialSet:
    """The set in a store; one task reads some blocks of rows, one block at a time."""
    system, base = _system(path)
    arrays = {"X": _json(system, f"{base}/X/.zarray")} | {f"layers/{c}": _json(system, f"{base}/layers/{c}/.zarray") for c in _names(system, f"{base}/layers")}
    layers = [c.split("/", 1)[1] for c in list(arrays)[1:]]
    told = _json(system, f"{base}/obs/.zattrs")
    columns = {c: _column(system, f"{base}/obs/{c}") for c in told["column-order"]}
    clash = {x, *layers} & set(columns)
    if clash:
        raise ValueError(f"columns and layers share the names {sorted(clash)}")
    var = _json(system, f"{base}/var/.zattrs")
    time = "t" if "t" in var["column-order"] else var["_index"]
    axis = [float(v) for v in _array(system, f"{base}/var/{time}", _json(system, f"{base}/var/{time}/.zarray"))]
    n, rows = arrays["X"]["shape"][0], max(arrays["X"]["chunks"][0], 1)
    schema = ", ".join([f"`{c}` {t[2]}" for c, t in columns.items()] + [f"`{c}` array<double>" for c in (x, *layers)])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _system(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, b = k * rows, min((k + 1) * rows, n)
                out = [_values(system, f"{base}/obs/{c}", *t, a, b) for c, t in columns.items()]
                for at, meta in arrays.items():
                    block = _array(system, f"{base}/{at}", meta, a, b).astype(float)
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, block.size + 1, max(block.shape[1], 1), dtype=np.int32)[: b - a + 1]), pa.array(block.reshape(-1))))
                yield pa.RecordBatch.from_arrays(out, names=[*columns, x, *layers])

    frame = spark.range(0, -(-n // rows)).mapInArrow(blocks, schema)
    metadata = _mapping(system, f"{base}/uns")
    return TrialSet(frame, tuple(axis), tuple(layers), metadata, x)


def append_zarr(of: TrialSet, path: str, order: str, join: str = "inner", rows: int = 1024) -> None:
    """Adds trials behind those of a store on the same axis, or makes the store; the new one takes its place only when it is complete."""
    system, base = _system(path)
    if system.get_file_info(base).type == fs.FileType.NotFound:
        return write_zarr(of, path, order, rows)
    old = read_zarr(of.frame.sparkSession, path, of.x)
    late = "_late"
    held, new = (o.with_frame(o.frame.withColumn(late, F.lit(k))) for k, o in enumerate((old, of)))
    both = held.combine([new], join)
    if order not in both.frame.columns:
        raise ValueError(f"the store has no column {order}")
    beside = f"{path.rstrip('/')}.new"
    at = _system(beside)[1]
    if system.get_file_info(at).type != fs.FileType.NotFound:
        system.delete_dir(at)  # left by a write that failed
    _write(both, beside, [late, order], rows, (late,))
    system.move(base, f"{base}.old")
    system.move(at, base)
    system.delete_dir(f"{base}.old")
