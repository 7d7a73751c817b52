"""Line dedup: sharded cuckoo filters in front of an exact reference-count table.

A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least min_chars code points
that at least two documents hold lose all their lines but those in the smallest doc_id.

Keys belong to shards by hash; a shard's filter holds some half a million keys. Small sets of filters go to all executors;
larger ones are joined to the lines by shard, where a shard with many lines is dealt over several tasks.

Defined results: a null or empty text is one empty line; empty and short lines always stay; a row without doc_id
keeps all its lines and counts for no key; rows that repeat a doc_id are one document to the counts, and each row
gets its own result; an empty table gives an empty table. Columns besides the two named ones are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, new_dir
from .cuckoo import CuckooFilter

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that one filter shard holds on average, and lines that one task of the join by shard takes.
SHARD_KEYS, SHARD_LINES = 500_000, 2_000_000
#: Filters go to all executors up to this many bytes; beyond it they are joined by shard.
MAX_FILTER_BYTES = 32 << 20
FILTERS = "shard int, bytes binary"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def key_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key is long enough. row tells rows of one doc_id apart."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.posexplode_outer(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("pos", "line"))  # the inner form would split twice, to filter on size first
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return lines.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def ref_counts(keys: DataFrame) -> DataFrame:
    """The exact table: (h1, h2, n_docs, keeper) of the keys that two or more documents hold.

    Counting is split: Spark adds up map-side first, so a line in a third of all documents costs one row a task.
    """
    once = keys.select("h1", "h2", "doc_id").distinct()
    return once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keeper")).where("n_docs >= 2")


def shard_of(n_shards: int) -> Column:
    return F.pmod(F.shiftright("h2", 20), F.lit(n_shards)).cast("int")


def shard_filters(keys: DataFrame, n_shards: int) -> DataFrame:
    """(shard, bytes): a cuckoo filter over each shard's keys (h1, h2), which must be distinct."""

    def build(group: pa.Table) -> pa.Table:
        f = CuckooFilter.of(group["h1"].to_numpy(), group["h2"].to_numpy())
        return pa.table([pa.array([group["shard"][0].as_py()], pa.int32()), pa.array([f.to_bytes()])], names=["shard", "bytes"])

    return keys.select(shard_of(n_shards).alias("shard"), "h1", "h2").groupBy("shard").applyInArrow(build, FILTERS)


def sent_probe(keys: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """Rows of keys whose shard's filter holds them; the filters go to all executors."""
    sent = keys.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["bytes"]) for r in filters.collect()})

    def probe(batches):
        held = {k: CuckooFilter.from_bytes(raw) for k, raw in sent.value.items()}
        for b in batches:
            h1, h2 = b.column("h1").to_numpy(), b.column("h2").to_numpy()
            shard, hit = (h2 >> 20) % n_shards, np.zeros(len(h1), bool)
            for k in np.unique(shard).tolist():
                if k in held:
                    hit[shard == k] = held[k].contains(h1[shard == k], h2[shard == k])
            yield b.filter(pa.array(hit))

    return keys.mapInArrow(probe, keys.schema)


def joined_probe(keys: DataFrame, filters: DataFrame, n_shards: int, shard_lines: int = SHARD_LINES) -> DataFrame:
    """Rows of keys whose shard's filter holds them; rows meet the filter of their shard in one task of shard_lines rows or so."""
    named = keys.withColumn("shard", shard_of(n_shards))
    parts = keep(named.groupBy("shard").agg(F.ceil(F.count("*") / shard_lines).cast("int").alias("parts")), "line-parts")
    rows = named.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "row", "pos"), F.col("parts")))  # a row a shard
    copies = filters.join(parts, "shard").select("shard", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    names = keys.columns

    def probe(some: pa.Table, held: pa.Table) -> pa.Table:
        rows = some.select(names)
        if not len(rows) or not len(held):
            return rows.slice(0, 0)
        hit = CuckooFilter.from_bytes(held["bytes"][0].as_py()).contains(rows["h1"].to_numpy(), rows["h2"].to_numpy())
        return rows.filter(pa.array(hit))

    return rows.select("shard", "part", *names).groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(probe, keys.schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, max_filter_bytes: int = MAX_FILTER_BYTES, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept, *extra): text as given, kept the text without its repeated lines, extra columns of docs
    (but those named like one of the first five, which stand for themselves).

    The filters keep lines without a partner out of the join with the exact table. Their false positives end in that
    join, so the result never depends on them.
    """
    spark = docs.sparkSession
    keys = keep(key_rows(docs, id_col, text_col, min_chars), "line-keys")  # some 20 bytes a line: texts are split once
    refs = keep(ref_counts(keys), "line-refs")
    n_keys = refs.count()
    n_shards = n_keys // SHARD_KEYS + 1
    filters = keep(shard_filters(refs, n_shards), "line-filters")
    probe = sent_probe if n_keys * 2 * 2.4 <= max_filter_bytes else joined_probe
    maybe = probe(keys, filters, n_shards) if n_keys else keys
    drops = maybe.join(refs.select("h1", "h2", "keeper"), ["h1", "h2"]).where("doc_id <> keeper")
    drops = drops.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))
    names = {c: f"extra_{i}" for i, c in enumerate(extra) if c not in ("doc_id", "text", "n_lines", "n_dropped", "kept")}
    carried, back = [F.col(f"`{c}`").alias(n) for c, n in names.items()], [F.col(n).alias(c) for c, n in names.items()]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"), *carried)
    rows = rows.join(drops.hint("shuffle_hash"), ["doc_id", "row"], "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = rows.select("doc_id", "text", *names.values(), lines.alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    return rows.select("doc_id", "text", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.when(F.size("gone") > 0, F.array_join(stay, "\n")).otherwise(F.coalesce("text", F.lit(""))).alias("kept"), *back)


class LineDedupState:
    """Incremental and reversible line dedup over a folder: insert documents, delete documents, ask what to drop.

    Each change writes a version of its own, never what is there already: postings (a row a key and document that came to
    hold it), gone (documents that went), filters (of the shards that changed), and then a marker that names the version,
    so a lost executor or driver leaves the last whole version. A posting counts if its document hasn't gone since; the
    counts over them are the exact reference counts. A filter holds the keys whose count is over zero: insert() adds
    keys that were new, delete() removes those whose count came to zero, so deletion undoes insertion exactly.
    compact() puts all versions into one.
    """

    POSTINGS, GONE = "doc_id long, h1 long, h2 long", "doc_id long"

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = 10, n_shards: int = 16):
        self.spark, self.path, self.min_chars = spark, path or new_dir(spark, "line-state"), min_chars
        try:
            marks = [json.loads(r["value"]) for r in spark.read.text(f"{self.path}/versions/*").collect()]  # a row a change
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            marks = []
        last = max(marks, key=lambda m: m["version"], default={"version": 0, "first": 1, "n_shards": n_shards})
        self.version, self.first, self.n_shards = last["version"], last["first"], last["n_shards"]

    def _save(self, postings: DataFrame | None, gone: DataFrame | None, filters: DataFrame, first: int | None = None) -> None:
        v = self.version + 1
        for df, what in ((postings, "postings"), (gone, "gone"), (filters, "filters")):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{self.path}/{what}/{v}")
        mark = {"version": v, "first": first or self.first, "n_shards": self.n_shards}
        self.spark.createDataFrame([(json.dumps(mark),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/versions/{v}")
        self.version, self.first = v, mark["first"]

    def _read(self, what: str, schema: str) -> DataFrame:
        """Rows of all versions that count, with theirs as v."""
        out = self.spark.createDataFrame([], f"{schema}, v int")
        for v in range(self.first, self.version + 1):
            path = f"{self.path}/{what}/{v}"
            if self._there(path):
                out = out.unionByName(self.spark.read.schema(schema).parquet(path).withColumn("v", F.lit(v)))
        return out

    def _there(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def postings(self) -> DataFrame:
        """(doc_id, h1, h2) that count."""
        gone = self._read("gone", self.GONE).groupBy("doc_id").agg(F.max("v").alias("went"))
        rows = self._read("postings", self.POSTINGS).join(gone, "doc_id", "left")
        return rows.where(F.col("went").isNull() | (F.col("went") < F.col("v"))).select("doc_id", "h1", "h2")

    def filters(self) -> DataFrame:
        """(shard, bytes): each shard's latest filter."""
        rows = self._read("filters", FILTERS)
        latest = rows.groupBy("shard").agg(F.max("v").alias("v"))
        return rows.join(latest, ["shard", "v"]).select("shard", "bytes")

    def ref_counts(self) -> DataFrame:
        return self.postings().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keeper"))

    def _touched(self, change: DataFrame) -> DataFrame:
        """The filters of the shards that have one of the keys."""
        shards = change.select(shard_of(self.n_shards).alias("shard")).distinct()
        return self.filters().join(shards, "shard", "left_semi")

    def _changed(self, change: DataFrame, gone: bool, every: DataFrame) -> DataFrame:
        """The touched filters after keys came or went; a shard that grew too full is built anew from the exact keys."""
        full = pa.array([b""])

        def step(old: pa.Table, new: pa.Table) -> pa.Table:
            shard = (old if len(old) else new)["shard"].slice(0, 1).combine_chunks()
            h1, h2 = new["h1"].to_numpy(), new["h2"].to_numpy()
            if not len(old):
                f = CuckooFilter.of(h1, h2)
            else:
                f = CuckooFilter.from_bytes(old["bytes"][0].as_py())
                if gone:
                    f.delete(h1, h2)
                elif not f.insert(h1, h2):
                    return pa.table([shard, full], names=["shard", "bytes"])
            return pa.table([shard, pa.array([f.to_bytes()])], names=["shard", "bytes"])

        keys = change.select(shard_of(self.n_shards).alias("shard"), "h1", "h2")
        out = keep(self._touched(change).groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(step, FILTERS), "line-filters")
        over = out.where(F.length("bytes") == 0).select("shard")
        if not over.limit(1).count():
            return out
        held = every.select("h1", "h2").distinct().withColumn("shard", shard_of(self.n_shards)).join(over, "shard", "left_semi")
        return out.where(F.length("bytes") > 0).unionByName(shard_filters(held, self.n_shards))

    def insert(self, docs: DataFrame) -> None:
        """Add documents; a document that is there already gains its new lines."""
        self.insert_keys(key_rows(docs, "doc_id", "text", self.min_chars))

    def insert_keys(self, keys: DataFrame) -> None:
        """Add keys (doc_id, h1, h2)."""
        keys = keep(keys.select(F.col("doc_id").cast("long").alias("doc_id"), "h1", "h2").distinct(), "line-new")
        old = self.postings()
        mine = old.join(keys.select("doc_id").distinct(), "doc_id", "left_semi")
        fresh = keep(keys.join(mine, ["doc_id", "h1", "h2"], "left_anti"), "line-fresh")
        new_keys = keep(self.unseen(fresh.select("h1", "h2").distinct()), "line-unseen")
        self._save(fresh, None, self._changed(new_keys, False, old.unionByName(fresh)))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Those of the keys that the state doesn't hold: the filter settles most, the exact table the rest."""
        names = ["h1", "h2", "maybe"]

        def ask(old: pa.Table, new: pa.Table) -> pa.Table:
            h1, h2 = new["h1"].to_numpy(), new["h2"].to_numpy()
            hit = CuckooFilter.from_bytes(old["bytes"][0].as_py()).contains(h1, h2) if len(old) and len(new) else np.zeros(len(new), bool)
            return pa.table([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(hit)], names=names)

        dealt = keys.select(shard_of(self.n_shards).alias("shard"), "h1", "h2")
        asked = keep(self._touched(keys).groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(ask, "h1 long, h2 long, maybe boolean"), "line-asked")
        sure = asked.where("not maybe").select("h1", "h2")
        maybe = asked.where("maybe").select("h1", "h2")
        return sure.unionByName(maybe.join(self.postings().select("h1", "h2").join(maybe, ["h1", "h2"], "left_semi").distinct(), ["h1", "h2"], "left_anti"))

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents (doc_id) out; keys that no document holds any more leave the filters."""
        old = self.postings()
        ids = keep(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "line-ids")
        touched = keep(old.join(ids, "doc_id", "left_semi").select("h1", "h2").distinct(), "line-touched")
        left = old.join(ids, "doc_id", "left_anti")
        gone = keep(touched.join(left.join(touched, ["h1", "h2"], "left_semi").select("h1", "h2").distinct(), ["h1", "h2"], "left_anti"), "line-gone")
        self._save(None, ids, self._changed(gone, True, left))

    def compact(self, n_shards: int | None = None) -> None:
        """All versions as one, with filters built anew over as many shards as the keys ask for, or n_shards."""
        postings = keep(self.postings(), "line-all")
        keys = postings.select("h1", "h2").distinct()
        self.n_shards = n_shards or keys.count() // SHARD_KEYS + 1
        self._save(postings, None, shard_filters(keys, self.n_shards), self.version + 1)

    def drops(self) -> DataFrame:
        """(doc_id, h1, h2) of the lines that go at present: held by two or more documents, this not the smallest."""
        refs = self.ref_counts().where("n_docs >= 2").select("h1", "h2", "keeper")
        return self.postings().join(refs, ["h1", "h2"]).where("doc_id <> keeper").select("doc_id", "h1", "h2")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
