"""Shared helpers: tables, work folders that executors share, held-out rows, label samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch to Python. A row is a whole text of up to some 100 KB, so batches stay at a few MB.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, own, True)
        named = "file://" + own
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/gridloom-{what}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def work(spark: SparkSession):
    """A function like keep(), whose tables are removed at the end of the block: what is read from them has to be kept by then."""
    made: list[str] = []

    def put(df: DataFrame, what: str) -> DataFrame:
        made.append(new_dir(spark, what))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        yield put
    finally:
        for path in made:
            drop_dir(spark, path)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """At most n rows in an Arrow batch of the jobs that run inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: Column | str) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def label_sample(labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """(doc_id, y) of at most per_class training rows of each class, the same rows on every run.

    Rows that are held out, unlabelled or without an id aren't used. Two labels for a document count as the larger.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    order = F.xxhash64("doc_id")
    return rows.where("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(rows.where("y = 1").orderBy(order, "doc_id").limit(per_class))
