"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists of each dimension.

Rows are packed into blocks of a few thousand vectors, on the tasks that read them. A block keeps its rows in the order of
their ids and, for each dimension, their order by that component: one sorted list a dimension, read from its upper end by
queries whose component there is positive and from its lower end by those where it is negative. Queries are packed into
groups; a group meets every block once, through a join on (group, share of the blocks), in which no row of vectors meets
another but only blocks meet groups. Spark sends the groups to all executors where they are small, else it shuffles.

In a block, a batch of queries reads its lists in rounds, each going deeper. Rows met for the first time have their
whole scores taken, once for the batch. After a round, no unseen row can score above the sum over dimensions of the
query's component times the value that its list has come to; a query whose kth score is above that bound is done. A bound
equal to the kth score goes on, as an unseen row with a smaller id may tie with it. The kth score starts from what the
task has found in its earlier blocks, so later blocks end sooner. How far lists are read depends on the data: vectors of
few large components end after a few rows, those without structure (all directions alike) only when all rows are seen.

Scores are exact whatever the size of the numbers: float32 products where all partial sums stay below 2^24, float64 below
2^46, Python integers beyond.

Defined results: vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as
ending in zeros. Ties go to the smaller id, and a null id comes last; it is a candidate but no query. Each query row has
its own answer: rows that repeat an id are candidates for each other, and just one row of a query's id and vector (itself)
is left out. A query with fewer than k candidates gets them all, one without candidates has no rows. A score beyond a long
ranks right and is given as null. An empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, keep, work
from .vectors import largest, matrix, whole_vectors

#: Vectors of a block, queries of a group, queries that read lists together.
BLOCK, GROUP, TOGETHER = 8192, 4096, 64
#: Depth of the first round, and how much deeper each further one goes.
FIRST, FACTOR = 16, 3
#: Answers that a task holds before it sends them on.
HELD = 50_000
NO_ID = np.iinfo(np.int64).max
BLOCK_SCHEMA = "part int, seq int, ids binary, named binary, n int, width int, x binary, lists binary"
GROUP_SCHEMA = "h int, seq int, ids binary, n int, width int, x binary"
FOUND = "h int, seq int, i int, query_id long, named boolean, vec_id long, score long, hi long, mid long, lo long, own boolean"


def _chunks(batches, size: int):
    """Batches of a table, cut and joined to `size` rows each (the last may be shorter)."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            take = b.slice(0, size - n)
            held.append(take)
            n, b = n + take.num_rows, b.slice(take.num_rows)
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _row(schema: str, *values) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, k in zip(values, types, strict=True)], list(names))


def _bytes(x: np.ndarray) -> bytes:
    """x in the narrowest whole numbers that hold it."""
    most = largest(x)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def _vectors(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // max(1, n * width) or 2}").reshape(n, width).astype(np.int64)


def _pack_blocks(batches):
    for seq, t in enumerate(_chunks(batches, BLOCK)):
        named = ~t.column("vec_id").is_null().to_numpy()
        ids = np.where(named, t.column("vec_id").fill_null(NO_ID).to_numpy(), NO_ID)
        order = np.lexsort((~named, ids))
        x = matrix(t.column("x"))[order]
        lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.uint16))
        yield _row(BLOCK_SCHEMA, t.column("part")[0].as_py(), seq, ids[order].tobytes(), named[order].tobytes(), len(x), x.shape[1], _bytes(x), lists.tobytes())


def _pack_groups(batches):
    for seq, t in enumerate(_chunks(batches, GROUP)):
        x = matrix(t.column("x"))
        yield _row(GROUP_SCHEMA, t.column("h")[0].as_py(), seq, t.column("vec_id").to_numpy().astype(np.int64).tobytes(), len(x), x.shape[1], _bytes(x))


class Block:
    """Vectors in the order of their ids, with their order in each dimension."""

    def __init__(self, x: np.ndarray, lists: np.ndarray | None = None):
        self.x, self.n, self.width = x, len(x), x.shape[1]
        self.lists = np.argsort(x, axis=0, kind="stable").T if lists is None else lists
        self.fetched = 0  # rows whose whole score was taken, times the queries that shared it

    def top(self, queries: np.ndarray, k: int, floor: list | None = None) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, row) at least, best first, ties to the smaller row; floor: a score for each query
        (or None) below which rows may be left out."""
        width = max(self.width, queries.shape[1])
        q, x = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (queries, self.x))
        lists = np.vstack([self.lists, np.tile(np.arange(self.n, dtype=self.lists.dtype), (width - self.width, 1))])
        reach = max(1, largest(q)) * max(1, largest(x)) * max(1, width)
        kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 46 else object
        x = x.astype(kind)
        out = []
        for i in range(0, len(q), TOGETHER):
            some = q[i : i + TOGETHER].astype(kind)
            out += self._batch(some, x, lists, k, floor[i : i + TOGETHER] if floor else [None] * len(some))
        return out

    def _batch(self, q, x, lists, k, floor):
        n, seen = self.n, np.zeros(self.n, bool)
        ends = [np.flatnonzero((q > 0).any(0)), np.flatnonzero((q < 0).any(0))]
        up, down = np.where(q > 0, q, 0 * q), np.where(q < 0, q, 0 * q)
        best: list[list[tuple[int, int]]] = [[] for _ in q]
        live, read, depth = np.arange(len(q)), 0, FIRST
        while len(live) and n:
            depth = min(depth, n)
            new = np.zeros(n, bool)
            new[lists[ends[0], n - depth : n - read]] = True
            new[lists[ends[1], read:depth]] = True
            if depth == n:
                new[:] = True  # queries of zeros alone read no list
            rows = np.flatnonzero(new & ~seen)
            seen |= new
            if len(rows):
                self.fetched += len(rows) * len(live)
                self._merge(best, live, q[live] @ x[rows].T, rows, k)
            if depth == n or seen.all():
                break
            dims = np.arange(len(lists))
            bound = up[live] @ x[lists[:, n - depth], dims] + down[live] @ x[lists[:, depth - 1], dims]
            live = np.array([j for j, b in zip(live, bound, strict=True) if not self._done(best[j], k, floor[j], b)], int)
            read, depth = depth, depth * FACTOR
        return best

    @staticmethod
    def _done(best, k, floor, bound) -> bool:
        kth = best[k - 1][0] if len(best) >= k else None
        least = kth if floor is None else floor if kth is None else max(kth, floor)
        return least is not None and int(bound) < least

    @staticmethod
    def _merge(best, live, scores, rows, k):
        if scores.dtype == object:
            for j, s in zip(live, scores, strict=True):
                best[j] = sorted([*best[j], *zip(map(int, s), map(int, rows), strict=True)], key=lambda p: (-p[0], p[1]))[:k]
            return
        key = scores.astype(np.int64) * (1 << 16) - rows  # one number for score and row: |score| < 2^46, row < 2^16
        if key.shape[1] > k:
            key = -np.partition(-key, k - 1, axis=1)[:, :k]
        for j, ks in zip(live, key, strict=True):
            found = [(int(-((-v) >> 16)), int(-v) & 0xFFFF) for v in ks]
            best[j] = sorted(best[j] + found, key=lambda p: (-p[0], p[1]))[:k]


def _answers(held: dict):
    """Rows of FOUND: the best of each query. The parts of a score order it whatever its size."""
    low = (1 << 40) - 1
    for (h, seq), (ids, own, best) in held.items():
        rows = []
        for i, found in enumerate(best):
            for s, named, vec in found:
                rows.append((h, seq, i, int(ids[i]), named, vec, s if abs(s) < 1 << 63 else None, s >> 80, s >> 40 & low, s & low, named and vec == ids[i] and s == own[i]))
        if rows:
            kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
            names, types = zip(*(c.split() for c in FOUND.split(", ")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _meet(k: int):
    """Blocks that meet groups of queries, to the best k of each query that the task has seen."""

    def run(batches):
        held: dict = {}
        for b in batches:
            for r in b.to_pylist():
                q = _vectors(r["qx"], r["qn"], r["qwidth"])
                key = (r["h"], r["gseq"])
                if key not in held:
                    own = (q.astype(object) ** 2).sum(1) if q.size else np.zeros(len(q), object)
                    held[key] = (np.frombuffer(r["qids"], np.int64), [int(v) for v in own], [[] for _ in q])
                ids, named = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["named"], bool)
                block = Block(_vectors(r["x"], r["n"], r["width"]), np.frombuffer(r["lists"], np.uint16).reshape(r["width"], r["n"]))
                best = held[key][2]
                found = block.top(q, k, [p[k - 1][0] if len(p) >= k else None for p in best])
                for p, f in zip(best, found, strict=True):
                    p[:] = sorted([*p, *((s, bool(named[row]), int(ids[row])) for s, row in f)], key=lambda v: (-v[0], not v[1], v[2]))[:k]
                if sum(len(v[2]) for v in held.values()) > HELD:
                    yield from _answers(held)
                    held = {}
        yield from _answers(held)

    return run


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int, shares: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score) for tables (vec_id long, x array<long>): each query's k best rows but itself.

    queries are rows of `rows`. shares: into how many shares the blocks are dealt, each met by a group of queries in one
    task (0: four for each shuffle partition, or one for each block if there are fewer).
    """
    spark = rows.sparkSession
    with work(spark) as put:
        asked = put(queries.where("vec_id IS NOT NULL"), "top-k-queries")
        groups = max(1, -(-asked.count() // GROUP))
        dealt = asked.repartition(groups).select(F.spark_partition_id().alias("h"), "vec_id", "x")
        dealt = put(dealt.mapInArrow(_pack_groups, GROUP_SCHEMA), "top-k-groups")
        blocks = put(rows.select(F.spark_partition_id().alias("part"), "vec_id", "x").mapInArrow(_pack_blocks, BLOCK_SCHEMA), "top-k-blocks")
        parts, n_blocks = blocks.agg(F.coalesce(F.max("part") + 1, F.lit(1)), F.count("*")).first()
        shares = max(1, min(shares or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks))
        left = blocks.withColumn("share", F.pmod(F.col("seq") * parts + F.col("part"), F.lit(shares)))
        left = left.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = dealt.withColumnsRenamed({"seq": "gseq", "ids": "qids", "n": "qn", "width": "qwidth", "x": "qx"})
        right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        with arrow_rows(spark, 4):  # a row is a block of some MB
            found = keep(left.join(right, ["h", "share"]).mapInArrow(_meet(k + 1), FOUND), "top-k")
    one = Window.partitionBy("h", "seq", "i")
    best = one.orderBy(*[F.desc(c) for c in ("hi", "mid", "lo", "named")], "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    selves = F.sum(F.col("own").cast("int")).over(one.orderBy("rank"))  # just one row is the query itself
    top = top.withColumn("selves", selves).where(~(F.col("own") & (F.col("selves") == 1))).withColumn("rank", F.col("rank") - F.least("selves", F.lit(1)).cast("int"))
    return top.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("named"), F.col("vec_id")).alias("vec_id"), "score")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 256)
    return exact_top_k(rows, rows.where("vec_id % 50 = 0"), 5)


OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
    FROM v AS q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
