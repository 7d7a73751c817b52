"""What counts of a folder of images after appends, overwrites, failures and repeated tasks."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.sources import images
from gridloom.sources.images import SCHEMA, Reader, Writer

KINDS = ["nifti", "nrrd", "mat4", "bmp", "dicom"]
SHAPE = [3, 2, 1]


@pytest.fixture(scope="module")
def known(spark):
    images.register(spark)
    return spark


def rows_of(spark, values):
    made = [(None, f"n{v}", 0, SHAPE, [1.0] * 3, images.EYE, [float(v)] * 6) for v in values]
    return spark.createDataFrame(made, SCHEMA).repartition(2)


def values(spark, kind, path):
    return sorted(int(r["data"][0]) for r in spark.read.format(kind).load(path).collect())


def data_files(path):
    return [f for f in os.listdir(path) if not f.startswith(("_", "."))]


@pytest.mark.parametrize("kind", KINDS)
def test_append_and_overwrite(known, kind, tmp_path):
    path = str(tmp_path / "out")
    rows_of(known, [1]).write.format(kind).mode("append").save(path)
    rows_of(known, [2, 3]).write.format(kind).mode("append").save(path)
    assert values(known, kind, path) == [1, 2, 3]
    rows_of(known, [4]).write.format(kind).mode("overwrite").save(path)
    assert values(known, kind, path) == [4] and len(data_files(path)) == 1
    rows_of(known, [5]).write.format(kind).mode("append").save(path)
    assert values(known, kind, path) == [4, 5]
    rows_of(known, []).write.format(kind).mode("overwrite").save(path)
    assert values(known, kind, path) == [] == data_files(path)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_a_failed_task_changes_nothing(known, kind, mode, tmp_path):
    path = str(tmp_path / "out")
    rows_of(known, [1]).write.format(kind).mode("append").save(path)
    fails = rows_of(known, [2, 3]).withColumn("data", F.when(F.col("name") == "n3", F.raise_error(F.lit("lost"))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        fails.write.format(kind).mode(mode).save(path)
    assert values(known, kind, path) == [1]  # what a killed task left behind, if anything, does not count


def arrow(v):
    return pa.RecordBatch.from_pylist([{"path": None, "name": f"n{v}", "volume": 0, "shape": SHAPE, "vs": [1.0] * 3, "affine": images.EYE, "data": [float(v)] * 6}], images.COLUMNS)


def seen(kind, path):
    r = Reader(kind, path)
    return sorted(int(v[0]) for p in r.partitions() for b in r.read(p) for v in b.column("data").to_pylist())


@pytest.mark.parametrize("kind", KINDS)
def test_repeated_tasks_and_lost_drivers(kind, tmp_path):
    path = str(tmp_path / "out")
    w = Writer(kind, path)
    w.write(iter([arrow(1)]))  # an attempt whose message never arrives
    once = w.write(iter([arrow(1)]))
    assert seen(kind, path) == []
    w.commit([once, None])
    assert seen(kind, path) == [1] and len(data_files(path)) == 1
    late = w.write(iter([arrow(1)]))  # a copy of the task that ends after the job
    assert seen(kind, path) == [1] and late.files
    lost = Writer(kind, path, True)
    lost.write(iter([arrow(2)]))  # the driver goes before it commits
    assert seen(kind, path) == [1]
    Writer(kind, path).abort([once])
    assert seen(kind, path) == [1]
    new = Writer(kind, path, True)
    new.commit([new.write(iter([arrow(3)]))])
    assert seen(kind, path) == [3]


def test_files_put_there_by_hand(tmp_path):
    path = str(tmp_path / "out")
    os.makedirs(f"{path}/inner")
    for name in ("a.bmp", "inner/b.bmp"):
        with open(f"{path}/{name}", "wb") as f:
            f.write(images.encode("bmp", {"data": [7.0] * 6, "shape": SHAPE})[0])
    assert seen("bmp", path) == [7, 7]
    w = Writer("bmp", path)
    w.commit([w.write(iter([arrow(1)]))])
    assert seen("bmp", path) == [1, 7, 7]
    w = Writer("bmp", path, True)
    w.commit([w.write(iter([arrow(2)]))])
    assert seen("bmp", path) == [2]


def test_files_are_dealt_by_bytes(tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    w = Writer("bmp", path)
    w.commit([w.write(iter([arrow(v) for v in range(10)]))])
    assert len(Reader("bmp", path).partitions()) == 1
    monkeypatch.setattr(images, "TASK_BYTES", 9 << 20)
    assert [len(p.paths) for p in Reader("bmp", path).partitions()] == [3, 3, 3, 1]
    assert seen("bmp", path) == list(range(10))
