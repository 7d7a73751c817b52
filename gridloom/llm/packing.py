"""Best-fit packing under conflicts.

Documents are cut into pieces of at most `capacity` tokens and packed into bins of that capacity. A bin takes at most
one document of a duplicate cluster and at most per_source documents of a source. Bins are kept in order of their
residual; each residual has a bitmap of its bins, each cluster one of the bins that hold it, each source one of the bins that
are full of it. For a piece, the search starts at the smallest residual that fits and goes on to successors until one has a
bin that is in neither of the piece's conflict bitmaps; the lowest such bin, the tightest compatible one, takes it. Without
one a new bin is opened. Pieces come in descending order of size, then by id and place.

Documents are dealt into packs by hash of their id and what is known of them, as many packs as the token total asks for,
and each pack is packed on its own: a third of all rows in one cluster or source is spread over all packs, and a pack's
memory is bounded by pack_tokens, whatever the input. Rows without id are dealt by a number among those equal to them, so equal ones
don't meet in one pack. Within a pack the packing is exact best-fit.

pack_tokenized() sizes documents by a tokenizer, so pieces start at token offsets and no bin holds more than its capacity;
its clusters are near-duplicate components: SimHash links (see simhash) and texts that are equal but for case and white
space. pack_documents() is for where no tokenizer is at hand: sizes estimated from bytes, clusters of equal texts alone.

Defined results: a document of 0 tokens is one empty piece and is packed like any other; null or negative sizes count as
0; a null source or cluster conflicts with nothing; a row without id is packed with the others, its bin has it as null;
rows that repeat an id are documents of their own; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, tune
from .components import components
from .simhash import fingerprint_batch, fingerprint_links
from .sstable import encoder

CAPACITY, PER_SOURCE, PACK_TOKENS = 2048, 4, 2_000_000
#: Equal rows without id that one row stands for while they are counted out.
BLOCK = 10_000
SCHEMA = "bin long, place int, doc_id {}, piece int, start long, n_tokens int, fill int"


def token_estimate(text: Column) -> Column:
    """Tokens at four UTF-8 bytes each, rounded up: an estimate, which real counts can exceed."""
    return F.ceil(F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) / 4).cast("long")


class Packer:
    """Exact best-fit of one pack. add() returns the bin that took the piece."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[int] = []  # residuals that some bin has, ascending
        self.at: dict[int, int] = {}  # residual -> bitmap of bins
        self.residual: list[int] = []
        self.of_cluster: dict = {}  # cluster -> bitmap of bins that hold it
        self.of_source: dict = {}  # source -> bitmap of bins that are full of it
        self.count: dict = {}  # (source, bin) -> documents

    def find(self, size: int, taken: int) -> int | None:
        for k in range(bisect.bisect_left(self.order, size), len(self.order)):
            if free := self.at[self.order[k]] & ~taken:
                return (free & -free).bit_length() - 1
        return None

    def _move(self, b: int, old: int | None, new: int) -> None:
        if old is not None:
            self.at[old] &= ~(1 << b)
            if not self.at[old]:
                del self.at[old]
                del self.order[bisect.bisect_left(self.order, old)]
        if new not in self.at:
            bisect.insort(self.order, new)
            self.at[new] = 0
        self.at[new] |= 1 << b

    def add(self, size: int, source=None, cluster=None) -> int:
        taken = 0
        if cluster is not None:
            taken |= self.of_cluster.get(cluster, 0)
        if source is not None:
            taken |= self.of_source.get(source, 0)
        b = self.find(size, taken)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self._move(b, None, self.capacity)
        self._move(b, self.residual[b], self.residual[b] - size)
        self.residual[b] -= size
        if cluster is not None:
            self.of_cluster[cluster] = self.of_cluster.get(cluster, 0) | 1 << b
        if source is not None:
            n = self.count[source, b] = self.count.get((source, b), 0) + 1
            if n >= self.per_source:
                self.of_source[source] = self.of_source.get(source, 0) | 1 << b
        return b


def counted_out(rows: DataFrame) -> DataFrame:
    """Rows without doc_id, told apart by a number from 0 among those that are equal: the same numbers whenever a task runs again."""
    equal = rows.groupBy("doc_id", "n", "source", "cluster").agg(F.count("*").alias("k"))
    blocks = equal.select("*", F.explode(F.expr(f"sequence(0L, (k - 1) div {BLOCK})")).alias("b"))
    return blocks.select("doc_id", "n", "source", "cluster", F.explode(F.expr(f"sequence(b * {BLOCK}, least(k, (b + 1) * {BLOCK}) - 1)")).alias("copy"))


def pack(docs: DataFrame, size: str, id_col: str = "doc_id", source_col: str | None = "source", cluster_col: str | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """(bin, place, doc_id, piece, start, n_tokens, fill) of every piece: place in its bin, start in its document, fill of the bin.

    Whole capacities of a long document are bins of their own; what is left is packed.
    """
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    none = F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), n.alias("n"), (F.col(source_col).cast("string") if source_col else none).alias("source"), (F.col(cluster_col).cast("string") if cluster_col else none).alias("cluster"))
    total = rows.agg(F.sum("n"), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    n_packs = max(1, -(-(total[0] or 0) // pack_tokens), -(-total[1] // 20_000))
    placed = rows.withColumn("copy", F.lit(None).cast("long"))
    if total[2]:
        placed = placed.where("doc_id IS NOT NULL").unionByName(counted_out(rows.where("doc_id IS NULL")))
    rows = placed.withColumn("pack", F.pmod(F.xxhash64("doc_id", "n", "source", "cluster", "copy"), F.lit(n_packs))).drop("copy")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "n", "source", "cluster")])
        whole, rest = np.divmod(group["n"].to_numpy(), capacity)
        source, cluster = group["source"].to_pylist(), group["cluster"].to_pylist()
        packer, out = Packer(capacity, per_source), []  # (bin, row, piece, start, size)
        for k in np.flatnonzero(whole).tolist():
            for j in range(int(whole[k])):
                out.append((packer.add(capacity, source[k], cluster[k]), k, j, j * capacity, capacity))
        for k in np.argsort(-rest, kind="stable").tolist():
            if rest[k] or not whole[k]:
                out.append((packer.add(int(rest[k]), source[k], cluster[k]), k, int(whole[k]), int(whole[k]) * capacity, int(rest[k])))
        b, row, piece, start, size = np.array(sorted(out, key=lambda x: x[0]), np.int64).reshape(-1, 5).T
        fill = capacity - np.array(packer.residual, np.int64)
        place = np.arange(len(b)) - np.searchsorted(b, b)
        first = group["pack"][0].as_py() << 32
        columns = [first + b, place.astype(np.int32), group["doc_id"].take(pa.array(row)), piece.astype(np.int32), start, size.astype(np.int32), fill[b].astype(np.int32)]
        return pa.table(columns, names=["bin", "place", "doc_id", "piece", "start", "n_tokens", "fill"])

    return rows.groupBy("pack").applyInArrow(run, SCHEMA.format(kind))


def copy_cluster(text: Column) -> Column:
    """A name for texts that are equal but for case and white space."""
    plain = F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\s+", " "))
    return F.concat_ws("-", F.hex(F.xxhash64(plain)), F.hex(F.xxhash64(F.lit(1), plain)))


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """pack() of documents (doc_id, text, source) with estimated sizes and clusters of equal texts."""
    rows = docs.select("doc_id", "source", token_estimate(F.col("text")).alias("n"), copy_cluster(F.col("text")).alias("cluster"))
    return pack(rows, "n", cluster_col="cluster", **options)


def measured(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, source, n, fp, same): tokens, SimHash and a name for texts that are equal but for case and white space."""

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            n = e.count(texts)
            fps = fingerprint_batch(texts).view(np.int64)
            same = [xxhash.xxh128_digest(" ".join(t.lower().split()).encode()) for t in texts]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fps), pa.array(same, pa.binary())], ["doc_id", "source", "n", "fp", "same"])

    tune(docs.sparkSession)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, n long, fp long, same binary")


def pack_tokenized(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """pack() of documents (doc_id, text, source) with exact sizes and near-duplicate clusters. vocabulary names a file that every executor has installed."""
    rows = keep(measured(docs, vocabulary), "measured")
    kinds = rows.select("same", "fp").distinct()
    low = kinds.groupBy("same").agg(F.min("fp").alias("low"), F.count("*").alias("k")).where("k > 1")
    equal = kinds.join(low, "same").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    found = components(fingerprint_links(rows.select("fp").distinct()).unionByName(equal)).withColumnRenamed("node", "fp")
    clusters = rows.join(found, "fp", "left").select("doc_id", "source", "n", F.coalesce("root", "fp").alias("cluster"))
    return pack(clusters, "n", cluster_col="cluster", **options)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
