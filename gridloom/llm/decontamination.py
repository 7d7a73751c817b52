"""Benchmark decontamination in DataFrame functions alone: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Texts are lower-cased and cut into words of letters and digits; a shingle is five words (the whole item if it has fewer).
An item of m shingles is compared with windows of m neighbouring shingles of a document (the whole document if it is
shorter) by weighted Jaccard similarity: the sum of the lesser counts over the sum of the greater. A pair is reported from
similarity 0.8 on, with its best window.

1. Anchors. Similarity t needs at least t (m + w) / (1 + t) of a window's w places to hold a shingle of an item of that
   size, and shifting a window right to its first such place loses none. So the windows that begin at such a place
   and hold enough of them are all that can matter; nothing else is dropped.
2. Each of these windows gets its 64-bit SimHash. Fingerprints are cut into RADIUS + 1 blocks: two that differ in at
   most RADIUS bits have a block that is equal, so joining on (size, block, value) finds every item within the radius.
   At similarity 0.8 a bit differs with probability 0.152; more than 23 of 64 do in 1.1e-5 of the pairs by the
   binomial tail; 3.4e-4 where a document of 4 shingles is compared with an item of 5 (0.1875 a bit).
3. Pairs within the radius are checked with exact counts.

Defined results: null or empty texts and items match nothing; a row without doc_id or item_id is left out; rows that
repeat a doc_id are windows of one document, items that repeat an item_id with other texts are each compared and the best
counts; of windows that tie the first counts; empty tables give an empty table. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
SPLIT = r"[^\p{L}\p{N}]+"
#: Rows of benchmark shingles and of candidate documents that may be sent to every executor; above, joins shuffle.
MAX_SHINGLES, MAX_SENT = 1_000_000, 500_000
#: Parts of an index key where its join shuffles.
SALTS = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPLIT), "")


def shingle_hashes(hashed_words: str, k: int) -> Column:
    """Hashes of the k-word shingles of an array of word hashes; empty if there are fewer words."""
    if k == 1:
        return F.transform(hashed_words, lambda x: F.xxhash64(x))
    at = F.sequence(F.lit(0), F.size(hashed_words) - k)
    return F.when(F.size(hashed_words) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(hashed_words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def with_hashes(rows: DataFrame, text: str, *kept: str) -> DataFrame:
    return rows.select(*kept, words(F.col(text)).alias("words")).select(*kept, F.transform("words", lambda w: F.xxhash64(w)).alias("hw"))


def items(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, copy, k, m, h, c): the shingles of each item with their counts; copy tells texts of one item_id apart."""
    rows = benchmark.where("item_id is not null").select("item_id", F.xxhash64("text").alias("copy"), "text").distinct()
    rows = with_hashes(rows, "text", "item_id", "copy").withColumn("k", F.least(F.size("hw"), F.lit(size)))
    rows = keep(rows, "item-words")  # filters on k below would else carry its whole expression into every constraint
    each = reduce(lambda a, b: a.unionByName(b), [rows.where(F.col("k") == k).select("item_id", "copy", "k", shingle_hashes("hw", k).alias("hs")) for k in range(1, size + 1)])
    return each.select("item_id", "copy", "k", F.size("hs").alias("m"), F.explode_outer("hs").alias("h")).where("h is not null").groupBy("item_id", "copy", "k", "m", "h").agg(F.count("*").alias("c"))


def fingerprints(counted: DataFrame, *by: str) -> DataFrame:
    """SimHash (fp) for each group of (h, c) rows: a bit is 1 if set in over half of the hashes, with repeats."""
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) * F.col("c")).alias(f"b{b}") for b in range(64)]
    rows = counted.groupBy(*by).agg(F.sum("c").alias("n"), *sums)
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit((1 << b) - (1 << 64) * (b == 63))).otherwise(F.lit(0)) for b in range(64)]
    return rows.select(*by, reduce(lambda a, b: a.bitwiseOR(b), bits).cast("bigint").alias("fp"))


def blocks(fp: str, radius: int) -> Column:
    """Array of (block, value) for radius + 1 blocks that together are all 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start): start is the best window's first word."""
    listed = keep(items(benchmark, size), "items")
    known = listed.select("k", "m", "h").distinct()
    n_shingles = known.count()
    ks = sorted(r["k"] for r in known.select("k").distinct().collect())  # at most `size` numbers
    sent = (lambda df, n, most: F.broadcast(df) if n <= most else df)
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")

    def places(rows: DataFrame, k: int) -> DataFrame:
        return with_hashes(rows, "text", "doc_id", "row").select("doc_id", "row", F.lit(k).alias("k"), shingle_hashes("hw", k).alias("hs"))

    def anchors(k: int) -> DataFrame:
        at = places(texts, k).select("doc_id", "row", "k", F.size("hs").alias("len"), F.posexplode_outer("hs").alias("pos", "h"))  # the inner form would filter on size(hs) below, with hs computed anew
        return at.join(sent(known.where(F.col("k") == k).drop("k"), n_shingles, MAX_SHINGLES), "h").select("doc_id", "row", "k", "m", "len", "pos")

    width = F.least("m", "len")
    need = F.ceil(F.lit(similarity) * (F.col("m") + F.col("w")) / (1 + similarity) - 1e-9).cast("int")
    found = reduce(lambda a, b: a.unionByName(b), map(anchors, ks)) if ks else texts.select("doc_id", "row", *[F.lit(0).alias(c) for c in ("k", "m", "len", "pos")]).where("false")
    spots = found.groupBy("doc_id", "row", "k", "m", "len").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    spots = spots.withColumn("w", width).withColumn("need", F.greatest(need, F.lit(1))).where(F.size("p") >= F.col("need"))
    begin = F.filter(F.sequence(F.lit(0), F.size("p") - F.col("need")), lambda i: F.get("p", i + F.col("need") - 1) - F.get("p", i) < F.col("w"))
    starts = F.array_distinct(F.transform(begin, lambda i: F.least(F.get("p", i), F.col("len") - F.col("w"))))
    windows = keep(spots.select("doc_id", "row", "k", "m", "w", F.explode_outer(starts).alias("s")).where("s is not null"), "windows")

    chosen = windows.select("doc_id", "row").distinct()
    again = texts.join(sent(chosen, windows.count(), MAX_SENT), ["doc_id", "row"], "left_semi")
    by = ["doc_id", "row", "k", "m", "w", "s"]
    cut = [places(again, k).join(windows.where(F.col("k") == k), ["doc_id", "row", "k"]).select(*by, F.explode_outer(F.slice("hs", F.col("s") + 1, F.col("w"))).alias("h")) for k in ks]
    counted = reduce(lambda a, b: a.unionByName(b), cut) if cut else windows.withColumn("h", F.lit(0).cast("bigint"))
    counted = keep(counted.groupBy(*by, "h").agg(F.count("*").alias("c")), "window-shingles")

    index = fingerprints(listed, "item_id", "copy", "k", "m").select("item_id", "copy", "k", "m", F.col("fp").alias("ifp"), F.explode(blocks("fp", radius)).alias("b")).select("*", "b.block", "b.value").drop("b")
    probe = fingerprints(counted, *by).select(*by, "fp", F.explode(blocks("fp", radius)).alias("b")).select("*", "b.block", "b.value").drop("b")
    salts = 1 if n_shingles <= MAX_SHINGLES else SALTS  # a block has few values, so windows of one size meet in few keys
    index = index.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    probe = probe.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "s"), F.lit(salts)).cast("int"))
    pairs = probe.join(sent(index, n_shingles, MAX_SHINGLES), ["k", "m", "block", "value", "salt"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    pairs = pairs.select(*by, "item_id", "copy").distinct()

    shared = counted.join(pairs, by).join(sent(listed.select("item_id", "copy", "k", "m", "h", F.col("c").alias("ic")), n_shingles, MAX_SHINGLES), ["item_id", "copy", "k", "m", "h"])
    both = shared.groupBy(*by, "item_id", "copy").agg(F.sum(F.least("c", "ic")).alias("common"))
    scored = both.withColumn("similarity", F.col("common") / (F.col("m") + F.col("w") - F.col("common"))).where(F.col("similarity") >= similarity - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("s")).alias("s")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).cast("long").alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a benchmark item in them, with all their columns; rows without doc_id stay."""
    bad = contaminated(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
