"""Exact operators on vectors: top-k by the threshold algorithm, whitening by digit-slice products."""

import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from gridloom.llm import top_k, whitening
from gridloom.llm.top_k import OP12_SQL, Block, exact_top_k, op12_exact_top_k

INF, NAN = float("inf"), float("nan")


def top_by_hand(rows, asked, k):
    """rows: (id, whole numbers); asked: indices of the query rows."""
    out = []
    for q in asked:
        i, x = rows[q]
        dot = lambda y: sum(a * b for a, b in zip(x, y, strict=False))
        best = sorted((-dot(y), j is None, j or 0) for n, (j, y) in enumerate(rows) if n != q)[:k]
        out += [(i, r + 1, None if none else j, -s if abs(s) < 1 << 63 else None) for r, (s, none, j) in enumerate(best)]
    return sorted(out, key=str)


def found(spark, rows, k, where="vec_id % 50 = 0", **more):
    df = spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(3)
    return sorted((tuple(r) for r in exact_top_k(df, df.where(where), k, **more).collect()), key=str)


@pytest.mark.parametrize("size", [3, 1000, 1 << 20, 1 << 31, (1 << 63) - 1])
def test_top_k_by_hand(spark, size):
    r = random.Random(size)
    rows = [(i, [r.randint(-size, size) if r.random() < 0.7 else 0 for _ in range(5)]) for i in range(400)]
    rows += [rows[0], rows[50], (50, [1, 2, 3, 4, 5]), (None, rows[7][1]), (None, [size] * 5), (450, []), (500, [0] * 5), (501, [size])]
    asked = [n for n, (i, _) in enumerate(rows) if i is not None and i % 50 == 0]
    assert found(spark, rows, 5) == top_by_hand(rows, asked, 5)


def test_top_k_of_many_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(top_k, "GROUP", 3)
    r = random.Random(2)
    rows = [(i, [r.randint(-9, 9) for _ in range(4)]) for i in range(700)]
    asked = list(range(0, 700, 50))
    for shares in (0, 1, 2, 7):
        assert found(spark, rows, 5, shares=shares) == top_by_hand(rows, asked, 5)


def test_fewer_rows_than_k(spark):
    assert found(spark, [(0, [1, 2]), (1, [1, 1]), (2, [5, 0])], 5) == [(0, 1, 2, 5), (0, 2, 1, 3)]
    assert found(spark, [(0, [1, 2])], 5) == [] == found(spark, [(1, [1, 2])], 5)
    assert found(spark, [(0, [1]), (0, [1])], 2) == [(0, 1, 0, 1), (0, 1, 0, 1)]


def test_lists_are_read_as_far_as_the_bound_asks():
    """With a few large components a query is done after a few rows of the lists, and the answer is the same."""
    r = np.random.default_rng(5)
    x = np.floor(1000 * r.random((8000, 12)) ** 40).astype(np.int64)
    q = np.zeros((20, 12), np.int64)
    q[np.arange(20), np.arange(20) % 12] = 7
    q[:, 3] += 1
    b = Block(x)
    got = b.top(q, 4)
    for i, best in enumerate(got):
        s = x @ q[i]
        assert best == [(int(s[j]), int(j)) for j in np.lexsort((np.arange(len(x)), -s))[:4]]
    assert b.fetched < 0.2 * len(x) * len(q)


def test_start_from_scores_of_earlier_blocks():
    """A start above everything in the block ends after the first round; a start that ties leaves nothing out."""
    x = np.arange(1, 5001, dtype=np.int64)[:, None]
    b = Block(x)
    b.top(np.array([[2]]), 3, [10**6])
    assert b.fetched == top_k.FIRST
    assert b.top(np.array([[2]]), 3, [9996])[0] == [(10000, 4999), (9998, 4998), (9996, 4997)]
    same = Block(np.full((5000, 2), 3, np.int64))
    assert same.top(np.array([[1, 1]]), 3, [6])[0] == [(6, 0), (6, 1), (6, 2)]


def as_embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, label int, x string, h int, score double")


ODD = [(i, [0.1 * i, -0.25, 0.004 * i]) for i in range(120)] + [(200, None), (250, [1.0, None, 2.0]), (300, [NAN, 0.0, 0.0]), (350, [1.0, INF, 0.0]), (400, [-0.0, 0.0, -0.001]), (None, [3.0, 1.0, 0.5]), (100, [1.0, 1.0, 1.0])]


def test_top_k_query(spark, sf, tmp_path):
    got = op12_exact_top_k(spark, sf)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = db.sql(OP12_SQL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    as_embeddings(spark, ODD).write.parquet(f"{tmp_path}/odd/embeddings.parquet")
    as_embeddings(spark, ODD).where("false").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op12_exact_top_k(spark, f"{tmp_path}/none").collect() == []
    rows = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in ODD if v and all(c is not None and np.isfinite(c) for c in v)]
    asked = [n for n, (i, _) in enumerate(rows) if i is not None and i % 50 == 0]
    assert sorted((tuple(r) for r in op12_exact_top_k(spark, f"{tmp_path}/odd").collect()), key=str) == top_by_hand(rows, asked, 5)


# whitening


def whiten_by_hand(rows, components=4):
    """rows: (id, whole numbers of one width): {(id, component): values}, in Fractions but for the eigenvectors."""
    fit = sorted({tuple(x) for _, x in rows})
    n, width = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(width)]
    v = [[float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3)) for j in range(width)] for i in range(width)]
    e, u = np.linalg.eigh(np.array(v))
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in rows:
        d = [n * a - b for a, b in zip(x, s, strict=True)]
        for c in range(min(components, width)):
            w = sum(float(Fraction(a, n)) * b for a, b in zip(d, u[:, c], strict=True)) / np.sqrt(e[c])
            dev = sum(a * a for a in d)
            out.append((i, c + 1, n, dev if dev < 1 << 63 else None, w, e[c] / sum(e)))
    return out


def whitened(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(3)
    return [tuple(r) for r in whitening.whiten(df, **more).collect()]


def same(got, want):
    """Equal up to the sign of each component, which has to be one for all rows."""
    key = lambda r: (str(r[0]), r[1], str(r[3]), abs(r[4]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for c in {w[1] for w in want}:
        a, b = np.array([g[4] for g in got if g[1] == c]), np.array([w[4] for w in want if w[1] == c])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert len({g[6] for g in got}) == 1 and got[0][6] < 1e-6


@pytest.mark.parametrize(("size", "mean"), [(1, 0), (100, 0), (100, 10**6), (10**4, 2**40), (2**61, 0)])
def test_whitening_by_hand(spark, size, mean):
    r = random.Random(size + mean)
    rows = [(i, [mean + (j + 1) * r.randint(-size, size) for j in range(6 if size < 2**60 else 1)]) for i in range(60)]
    rows += [rows[0], (7, rows[3][1]), (None, rows[5][1]), (100, rows[0][1])]
    same(whitened(spark, rows), whiten_by_hand(rows))


def test_products_are_exact():
    r = random.Random(4)
    for top in (1, 2**19, 2**20, 2**41, 2**63 - 1):
        x = np.array([[r.choice((-top, top, r.randint(-top, top), -top - 1)) for _ in range(3)] for _ in range(50)], np.int64)
        rows = x.astype(object)
        assert (whitening.products(x) == rows.T @ rows).all()
    many = np.full((3 * whitening.ROWS + 5, 2), 2**20 - 1, np.int64)
    assert (whitening.products(many) == len(many) * (2**20 - 1) ** 2).all()
    for v in (0, 1, -1, 2**32, -(2**32), 2**200 + 17, -(2**200) - 17):
        d = whitening.digits(v)
        assert sum(a << (32 * k) for k, a in enumerate(d)) == v and all(abs(a) <= 2**32 for a in d)


def test_whitening_of_odd_tables(spark):
    assert whitened(spark, [(1, [3, 4])] * 3) == [(1, c, 1, 0, None, None, None) for c in (1, 2)] * 3
    got = whitened(spark, [(1, [0, 5]), (2, [2, 5]), (3, [4, 5]), (3, [4, 5])])
    assert {r[1]: r[5] for r in got} == {1: 1.0, 2: 0.0} and all(r[4] is None for r in got if r[1] == 2)
    assert sorted(round(abs(r[4]), 9) for r in got if r[1] == 1) == [0.0, *[round(1.5**0.5, 9)] * 3]
    assert whitened(spark, [(1, []), (2, [])]) == []
    ragged = [(1, [1]), (2, [1, 2]), (3, []), (4, [5, 1])]
    full = [(i, x + [0] * (2 - len(x))) for i, x in ragged]
    same(whitened(spark, ragged), whiten_by_hand(full))
    assert spark.createDataFrame([], "vec_id long, x array<long>").count() == 0 == len(whitening.whiten(spark.createDataFrame([], "vec_id long, x array<long>")).collect())


def test_whitening_query(spark, sf, tmp_path):
    rows = [(r["vec_id"], [int(np.floor(256 * c)) for c in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same([tuple(r) for r in whitening.op13_embedding_whitening(spark, sf).collect()], whiten_by_hand(rows))
    as_embeddings(spark, ODD).write.parquet(f"{tmp_path}/odd/embeddings.parquet")
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in ODD if v and all(c is not None and np.isfinite(c) for c in v)]
    same([tuple(r) for r in whitening.op13_embedding_whitening(spark, f"{tmp_path}/odd").collect()], whiten_by_hand(kept))
