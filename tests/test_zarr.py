"""Zarr stores of trial sets: round trips, the bytes on disk, foreign chunks and appends."""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialforge.operators import trialset
from trialforge.sources import zarr


def _set(spark, n=23):
    rows = [(k, None if k % 5 == 0 else f"ü{k % 3}", k % 2 == 0, None if k == 7 else 2**60 + k, k / 4, [k + i / 8 for i in range(6)], [float(-k)] * 6) for k in range(n)]
    frame = spark.createDataFrame(rows, "trial_ord long, name string, good boolean, big long, score double, x array<double>, err array<double>")
    return trialset.TrialSet(frame, tuple(i / 10 for i in range(6)), ("err",), {"source": "made", "n": 3, "rate": 2.5, "deep": {"ids": [1, 2], "names": ["a", "b"]}})


def _rows(s):
    return sorted(map(tuple, s.frame.select("trial_ord", "name", "good", "big", "score", "x", "err").collect()))


@pytest.mark.parametrize("rows", [4, 1000])
def test_a_store_comes_back_whole(spark, tmp_path, rows):
    own, path = _set(spark), f"file://{tmp_path}/s.zarr"
    zarr.write_zarr(own, path, "trial_ord", rows)
    got = zarr.read_zarr(spark, path)
    assert (got.axis, got.layers, got.metadata) == (own.axis, own.layers, own.metadata)
    assert _rows(got.checked()) == _rows(own)
    with pytest.raises(FileExistsError):
        zarr.write_zarr(own, path, "trial_ord")


def test_bytes_on_disk(spark, tmp_path):
    own = _set(spark)
    zarr.write_zarr(own.with_frame(own.frame.orderBy(F.desc("trial_ord"))), f"file://{tmp_path}/s.zarr", "trial_ord", 8)
    at = tmp_path / "s.zarr"
    meta = json.loads((at / "X/.zarray").read_text())
    assert (meta["zarr_format"], meta["shape"], meta["chunks"], meta["dtype"], meta["order"]) == (2, [23, 6], [8, 6], "<f8", "C")
    last = np.frombuffer(zlib.decompress((at / "X/2.0").read_bytes()), "<f8").reshape(8, 6)
    assert last[0, 1] == 16.125 and (last[7] == 0).all()  # rows 16 to 22 and padding
    names = zlib.decompress((at / "obs/_index/1").read_bytes())
    assert names[:9] == struct.pack("<ii", 8, 1) + b"8"
    assert json.loads((at / "obs/.zattrs").read_text())["column-order"] == ["trial_ord", "name", "good", "big", "score"]
    assert json.loads((at / "obs/big/.zattrs").read_text())["encoding-type"] == "nullable-integer"
    assert json.loads((at / "var/.zattrs").read_text())["column-order"] == ["t"]


def test_sets_that_cannot_be_stored(spark, tmp_path):
    own = _set(spark)
    with pytest.raises(ValueError):
        zarr.write_zarr(own.with_frame(own.frame.withColumn("when", F.current_timestamp())), f"file://{tmp_path}/a", "trial_ord")
    with pytest.raises(ValueError):
        zarr.write_zarr(own.with_frame(own.frame.withColumn("x", F.slice("x", 1, 3))), f"file://{tmp_path}/b", "trial_ord")
    with pytest.raises(FileNotFoundError):
        zarr.read_zarr(spark, f"file://{tmp_path}/none")
    empty = own.with_frame(own.frame.where("false"))
    zarr.write_zarr(empty, f"file://{tmp_path}/c", "trial_ord")
    assert zarr.read_zarr(spark, f"file://{tmp_path}/c").frame.isEmpty()


def test_appends(spark, tmp_path):
    own, path = _set(spark, 9), f"file://{tmp_path}/s.zarr"
    zarr.append_zarr(own, path, "trial_ord", rows=4)
    more = own.with_frame(own.frame.where("trial_ord < 3").drop("score").withColumn("extra", F.lit(1)))
    zarr.append_zarr(more, path, "trial_ord", rows=4)
    got = zarr.read_zarr(spark, path)
    assert "score" not in got.frame.columns and "extra" not in got.frame.columns and "_late" not in got.frame.columns
    assert [r.trial_ord for r in got.frame.collect()] == [*range(9), 0, 1, 2]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s.zarr"]
    with pytest.raises(ValueError):
        zarr.append_zarr(trialset.TrialSet(own.frame, tuple(range(6)), ("err",)), path, "trial_ord")


def _frame(raw: bytes, size: int, codec: int, block: int, shuffled: bool, split: bool) -> bytes:
    """A Blosc frame built by hand from its description."""
    body, starts = b"", []
    parts = [raw[k : k + block] for k in range(0, len(raw), block)]
    for part in parts:
        starts.append(16 + 4 * len(parts) + len(body))
        if shuffled:
            part = np.frombuffer(part, np.uint8).reshape(-1, size).T.tobytes()
        n = len(part) // size if split and len(part) == block else len(part)
        for k in range(0, len(part), n):
            own = part[k : k + n]
            small = zlib.compress(own) if codec == 3 else pa.compress(own, {1: "lz4_raw", 4: "zstd"}[codec], asbytes=True)
            small = small if len(small) < n else own
            body += len(small).to_bytes(4, "little") + small
    flags = shuffled | (0 if split else 16) | codec << 5
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(raw), block, 16 + 4 * len(parts) + len(body)) + struct.pack(f"<{len(starts)}I", *starts) + body


@pytest.mark.parametrize("codec", [1, 3, 4])
@pytest.mark.parametrize("split", [True, False])
def test_foreign_chunks(spark, tmp_path, codec, split):
    values = np.concatenate([np.arange(700.0) / 8, np.random.default_rng(1).standard_normal(500)])
    frame = _frame(values.tobytes(), 8, codec, 4096, True, split)
    assert zarr._blosc(frame) == values.tobytes()
    if codec == 1 and split:  # a store with such chunks, cut in both directions, an absent chunk and a categorical column
        path = tmp_path / "s.zarr"
        zarr.write_zarr(_set(spark, 5), f"file://{path}", "trial_ord", 4)
        x = np.arange(30.0).reshape(5, 6)
        meta = json.loads((path / "X/.zarray").read_text()) | {"chunks": [3, 4], "fill_value": "NaN", "compressor": {"id": "blosc"}}
        (path / "X/.zarray").write_text(json.dumps(meta))
        padded = np.pad(x, ((0, 1), (0, 2)))
        for i in range(2):
            for j in range(2):
                (path / f"X/{i}.{j}").write_bytes(_frame(padded[3 * i : 3 * i + 3, 4 * j : 4 * j + 4].tobytes(), 8, 1, 96, False, False))
        (path / "X/1.1").unlink()
        x[3:, 4:] = np.nan
        kinds = path / "obs/name"
        for old in [*kinds.glob("*/*"), *kinds.glob("*/.z*"), *kinds.glob(".z*")]:
            old.unlink(missing_ok=True)
        (kinds / ".zattrs").write_text('{"encoding-type": "categorical"}')
        (kinds / ".zgroup").write_text('{"zarr_format": 2}')
        system, at = zarr._system(f"file://{kinds}")
        zarr._whole(system, f"{at}/codes", [0, -1, 1, 1, 0], "<i8")
        zarr._whole(system, f"{at}/categories", ["u", "v"], "|O")
        got = zarr.read_zarr(spark, f"file://{path}").frame.orderBy("trial_ord").collect()
        assert np.array_equal(np.array([r.x for r in got]), x, equal_nan=True) and [r.name for r in got] == ["u", None, "v", "v", "u"]
