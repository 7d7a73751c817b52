"""Running samples of a stream of changes, stopped and taken up again, against plain loops."""

import pytest
from pyspark.errors import PySparkException

from gridloom.streaming import samples

SCHEMA = "k string, kind string, value double, old double, n int"


def plain(changes):
    values = {}
    for k, kind, v, old, _ in changes:
        if k is None or v is None or (kind == "replace" and old is None):
            continue
        mine = values.setdefault(k, [])
        if kind in ("pop", "replace"):
            mine.remove(v if kind == "pop" else old)
        if kind in ("push", "replace"):
            mine.append(v)
    out = {}
    for k, x in values.items():
        m = sum(x) / len(x) if x else None
        out[k] = (len(x), m, None if m is None else sum((v - m) ** 2 for v in x) / len(x))
    return out


def close(got, want):
    assert set(got) == set(want)
    for k, (n, mean, variance) in want.items():
        assert got[k][0] == n
        for a, b in ((got[k][1], mean), (got[k][2], variance)):
            assert (a is None and b is None) or abs(a - b) < 1e-9


def test_running_samples_restart(spark, tmp_path):
    first = [("hot", "push", float(i % 17), None, 1) for i in range(400)] + [("a", "push", 2.0, None, 1), ("a", "push", 2.0, None, 1), ("gone", "push", 5.0, None, 1), ("b", "push", None, None, 1), (None, "push", 1.0, None, 1)]
    second = [("hot", "pop", 3.0, None, 2), ("hot", "replace", 9.0, 4.0, 2), ("a", "replace", 7.0, 2.0, 2), ("a", "replace", 7.0, None, 2), ("gone", "pop", 5.0, None, 2), ("new", "push", -1.5, None, 2)]
    third = [("gone", "push", 1.0, None, 3), ("a", "pop", 7.0, None, 3)]
    log, target, state = (str(tmp_path / x) for x in ("log", "rows", "state"))
    before, done = spark.conf.get(samples.PROVIDER, None), []
    for part in (first, second, third):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(log)
        samples.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(log), target, state, "k")
        done += part
        close({r["key"]: (r["n"], r["mean"], r["variance"]) for r in samples.latest(spark, target).collect()}, plain(done))
    assert spark.conf.get(samples.PROVIDER, None) == before
    samples.follow(spark.readStream.schema(SCHEMA).parquet(log), target, state, "k")  # nothing new: nothing changes
    close({r["key"]: (r["n"], r["mean"], r["variance"]) for r in samples.latest(spark, target).collect()}, plain(done))


def test_changes_are_summed_where_they_are_read(spark):
    rows = spark.createDataFrame([("hot", "push", 1.0, None, 0)] * 3000 + [("cold", "push", 1.0, None, 0)], SCHEMA).coalesce(1)
    got = samples.deltas(rows, "k")
    assert got.count() <= 2 and {(r["key"], r["n"]) for r in got.collect()} == {("hot", 3000), ("cold", 1)}
    assert samples.deltas(rows.limit(0), "k").count() == 0
    for kind in ("take", None):
        with pytest.raises(PySparkException, match="kind of a change"):
            samples.deltas(spark.createDataFrame([("a", kind, 1.0, None, 0)], SCHEMA), "k").collect()
