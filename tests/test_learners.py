"""Estimators and models: fits against plain loops, save and load, validation."""

import numpy as np

from gridloom.operators import learners as L
from gridloom.operators import ml


def points(spark, seed=0, n=120):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.normal(i % 3, 0.6, 4)], i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, features array<double>, label int")


def plain_scores(train, f):
    out = {}
    for c in sorted({r[2] for r in train}):
        m = np.mean([r[1] for r in train if r[2] == c], 0)
        out[c] = 1 / (1 + ((np.array(f) - m) ** 2).sum())
    return out


def test_one_vs_rest_save_and_load(spark, tmp_path):
    rows, df = points(spark)
    train = [r for r in rows if r[0] % 4]
    ovr = L.OneVsRest(L.MeanScore(), predictionCol="guess")
    model = ovr.fit(df.where("id % 4 <> 0"))
    got = {r["id"]: r for r in model.transform(df).collect()}
    for i, f, _ in rows:
        s = plain_scores(train, f)
        assert got[i]["guess"] == max(s, key=lambda c: (s[c], -c)) and np.isclose(got[i]["value"], sum(c * v for c, v in s.items()) / sum(s))
    model.write().overwrite().save(str(tmp_path / "model"))
    back = L.OneVsRestModel.load(str(tmp_path / "model"))
    assert back.classes == [0, 1, 2] and back.uid == model.uid and sorted(back.transform(df).collect()) == sorted(model.transform(df).collect())
    ovr.save(str(tmp_path / "estimator"))
    again = L.OneVsRest.load(str(tmp_path / "estimator"))
    assert again.getPredictionCol() == "guess" and sorted(again.fit(df.where("id % 4 <> 0")).transform(df).collect()) == sorted(model.transform(df).collect())
    one = model.models[1]
    one.save(str(tmp_path / "one"))
    assert L.MeanScoreModel.load(str(tmp_path / "one")).getOrDefault("centre") == one.getOrDefault("centre")


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, None], 1), (2, None, 0), (3, [5.0, 5.0], 0), (4, [5.0, 5.0], None), (5, [1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "id long, features array<double>, label int, value string, score double")
    model = L.OneVsRest(L.MeanScore()).fit(df)
    got = {r["id"]: r for r in model.transform(df).collect()}
    assert model.classes == [0, 1] and got[0]["prediction"] == 1 and got[3]["prediction"] == 0 == got[4]["prediction"]
    assert all(got[i]["prediction"] == 0 and got[i]["value"] is None for i in (1, 2, 5)) and got[0]["score"] == 0.5
    empty = L.OneVsRest(L.MeanScore()).fit(df.limit(0))
    assert empty.classes == [] and empty.transform(df).where("prediction IS NULL").count() == 6
    assert L.MeanScore().fit(df.limit(0)).transform(df).where("score IS NULL").count() == 6


def test_validation(spark):
    rows, df = points(spark)
    assert L.repeated_accuracy(df, L.OneVsRest(L.MeanScore()), runs=2) > 0.8
    n = 7
    got = {r["block"]: r["error"] for r in L.leave_n_out(df, n, 4).collect()}
    want = {}
    for b in range(len(rows) // n):
        block, rest = rows[b * n : (b + 1) * n], rows[: b * n] + rows[(b + 1) * n :]
        wrong = 0
        for _, f, c in block:
            s = plain_scores(rest, f)
            wrong += max(s, key=lambda k: (s[k], -k)) != c
        want[b] = wrong / n
    assert set(got) == set(want) and all(np.isclose(got[b], want[b]) for b in want)
    assert sum(want.values()) > 0
    alone = spark.createDataFrame([(0, [0.0], 0), (1, [9.0], 1), (2, [0.5], 0), (3, None, 1)], "id long, features array<double>, label int")
    assert {r["block"]: r["error"] for r in L.leave_n_out(alone, 1, 1).collect()} == {0: 0.0, 1: 1.0, 2: 0.0}
    assert ml.error_rate(alone, "label", "label").first()["error"] == 0
