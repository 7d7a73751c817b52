"""Access points of gzip files and planes read by them, against whole reads."""

import gzip
import random
import zlib

import numpy as np
import pytest

from gridloom.sources import formats, gzip_ranges
from gridloom.sources.gzip_ranges import access_points, gzip_index, intervals, read_planes, read_range


def noise(n, seed=1):
    r = random.Random(seed)
    return b"".join(r.choice((b"abcabd", b"\0" * 9, r.randbytes(1), r.randbytes(2))) for _ in range(n))


def pieces(raw, size):
    return iter([raw[i : i + size] for i in range(0, len(raw), size)])


@pytest.mark.parametrize("level", [1, 6, 9])
@pytest.mark.parametrize("piece", [1, 777, 1 << 20])
def test_every_point_is_a_start(tmp_path, level, piece):
    data = noise(90_000)
    raw = gzip.compress(data, level)
    path = tmp_path / "x.gz"
    path.write_bytes(raw)
    points = list(access_points(pieces(raw, piece), 5_000))
    assert points[-1][:2] == (len(data), -1) and len(points) > 5 and points[0][4] == data[: gzip_ranges.HEAD]
    assert {p[2] for p in points} - {-1, 0}, "no block that starts within a byte"
    r = random.Random(2)
    for begin, at, bits, history, _ in points[:-1]:
        assert history == data[max(0, begin - gzip_ranges.HISTORY) : begin] or bits < 0
        start = begin + r.randrange(0, 3000)
        size = r.randrange(0, 20_000)
        assert read_range(str(path), begin, at, bits, history, start, size) == data[start : start + size]


def test_members_and_trailing_bytes(tmp_path):
    parts = [noise(4000, k) for k in range(12)] + [b"", b"short"]
    data, raw = b"".join(parts), b"".join(gzip.compress(p) for p in parts)
    path = tmp_path / "m.gz"
    path.write_bytes(raw)
    points = list(access_points(pieces(raw, 1000), 3_000))
    assert points[-1][0] == len(data)
    for begin, at, bits, history, _ in points[:-1]:
        assert read_range(str(path), begin, at, bits, history, begin, len(data)) == data[begin:]


def test_damaged_files():
    raw = gzip.compress(noise(5000))
    with pytest.raises(ValueError, match="early"):
        list(access_points(pieces(raw[:-100], 512)))
    with pytest.raises(ValueError, match="gzip"):
        list(access_points(pieces(b"not a gzip file at all", 512)))
    assert list(access_points(pieces(gzip.compress(b""), 5))) == [(0, 0, -1, b"", b""), (0, -1, 0, b"", b"")]


def written(folder, name, x, volumes=1, version=1, **more):
    raw = formats.write_nifti(x.ravel(), x.shape[::-1][:3], volumes=volumes, version=version, **more)
    (folder / name).write_bytes(gzip.compress(raw, 6))


def whole(folder):
    out = {}
    for f in sorted(folder.glob("*.gz")):
        for v in formats.read_nifti(f.read_bytes()):
            w, h, d = v["shape"]
            for z in range(d):
                out[f.name, v["volume"], z] = v["data"].reshape(d, h * w)[z].tolist()
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r, at = np.random.default_rng(4), tmp_path_factory.mktemp("gz")
    written(at, "a.nii.gz", r.integers(0, 300, (3, 20, 31, 17)), volumes=3, dtype="i2", slope=0.5, inter=-3.0)
    written(at, "b.nii.gz", r.normal(size=(25, 42, 40)), version=2, end=">")
    written(at, "c.nii.gz", r.integers(0, 2, (1, 90, 80)), dtype="u1")
    return at


def planes(df):
    return {(r["path"].rsplit("/", 1)[1], r["volume"], r["z"]): list(r["data"]) for r in df.collect()}


@pytest.mark.parametrize("spacing", [500, 6_000, 1 << 23])
def test_planes_equal_whole_reads(spark, folder, spacing):
    index = gzip_index(spark, f"file://{folder}", spacing).cache()
    assert gzip_ranges.gaps(index).count() == 0
    want = whole(folder)
    rows = read_planes(index).collect()
    assert planes(read_planes(index)) == want and len(rows) == len(want)
    some = planes(read_planes(index, z=(7, 11), volumes=(1, 3)))
    assert some == {k: v for k, v in want.items() if 7 <= k[2] < 11 and 1 <= k[1] < 3} and len(some) == 8
    assert planes(read_planes(index, z=(0, 1))) == {k: v for k, v in want.items() if k[2] == 0}
    first = next(r for r in rows if r["path"].endswith("b.nii.gz"))
    assert first["shape"] == [40, 42] and first["affine"][:1] == [1.0]
    index.unpersist()


def test_only_intervals_with_planes_are_inflated(spark, folder, tmp_path):
    """What lies before the access point isn't read: it may even be destroyed."""
    index = gzip_index(spark, f"file://{folder}", 6_000, glob="b*").cache()
    rows = index.orderBy("begin").collect()
    asked = intervals(index, z=(20, 25)).collect()
    assert 0 < len(asked) < len(rows) / 2
    raw = bytearray((folder / "b.nii.gz").read_bytes())
    begin = min(r["at"] for r in asked)
    raw[100 : begin - 1] = b"\xff" * (begin - 101)
    (tmp_path / "b.nii.gz").write_bytes(raw)
    with pytest.raises(zlib.error):
        gzip.decompress(bytes(raw))
    moved = spark.createDataFrame([(f"file://{tmp_path}/b.nii.gz", *r[1:]) for r in rows], gzip_ranges.INDEX)
    want = {k: v for k, v in whole(folder).items() if k[0] == "b.nii.gz" and k[2] >= 20}
    assert planes(read_planes(moved, z=(20, 25))) == want
    dealt = read_planes(index)
    assert dealt.rdd.getNumPartitions() == min(len(intervals(index).collect()), spark.sparkContext.defaultParallelism)
    index.unpersist()


def test_task_bytes_bound_a_task(spark, folder, monkeypatch):
    index = gzip_index(spark, f"file://{folder}", 500).cache()
    n = intervals(index).count()
    monkeypatch.setattr(gzip_ranges, "TASK_BYTES", 4_000)
    parts = read_planes(index).rdd.getNumPartitions()
    assert spark.sparkContext.defaultParallelism < parts <= n
    index.unpersist()
