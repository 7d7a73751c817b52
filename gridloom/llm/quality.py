"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled training rows of quality 1; the unlabelled are all training documents, whose labels
are not looked at. A first model tells the two apart; the class prior comes from its scores of all training documents, counted in
bins, against those of the positives. Then the non-negative unbiased risk is minimised over measures of the whole text
(repetition, symbols, case, lengths, lines).

Labelled positives are a bounded sample (per_class rows, the first by hash of doc_id). Risks of the unlabelled, the scale of measures,
the prior and the scores cover every document and whole texts: a step of a fit is one job that adds up the risk and its derivatives
where the measures lie, so the driver gets at most a few hundred numbers a step.

Defined results: a null or empty text is scored like any other, its measures are zero; a row without doc_id is never held
out nor a training row; rows that repeat a doc_id each get a row; without positives every score is high; an empty table
gives an empty table. Columns besides the two named ones are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, held_out, keep, label_sample, tune
from .logistic import Linear, binned_prior, constant, curvature, fit_non_negative, fit_two, slopes, standard

PER_CLASS, THRESHOLD = 8_000, 0.3
RUN = re.compile(r"([^\w\s])\1+")
DIGIT = re.compile(r"\d")
WORD_BYTES = bytes(range(128, 256)) + b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\r\t"
N_MEASURES = 26
#: Bins of a score in which all training documents are counted, and how far they reach.
BIN, BINS = 0.05, 400


def measures(text: str | None) -> list[float]:
    """Numbers that describe a whole text, without its words."""
    if not text or not (pieces := text.split()):
        return [0.0] * N_MEASURES
    n, chars, raw = len(pieces), len(text), text.encode()
    distinct = len(set(pieces))
    repeats = sum(map(str.__eq__, pieces, pieces[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    base = [
        np.log1p(n),
        np.log1p(chars / n),
        len(RUN.findall(text)) / n,
        repeats / n,
        np.log1p(distinct) / np.log1p(n),
        distinct / n,
        sum(map(str.isupper, pieces)) / n,
        sum(not p.isalnum() and not any(map(str.isalnum, p)) for p in pieces if len(p) < 4) / n,
        len(raw.translate(None, WORD_BYTES)) / chars,
        (text.count(".") + text.count("?")) / n,
        len(DIGIT.findall(text)) / chars,
        np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        text.count(",") / n,
        sum(map(str.islower, pieces)) / n,
        max(map(len, pieces)) / (10 + max(map(len, pieces))),
    ]
    bent = [np.sqrt(base[i]) for i in (2, 3, 6, 7, 8)] + [base[i] > t for i, t in ((2, 0.05), (3, 0.05), (6, 0.1), (7, 0.05), (8, 0.1))]
    return [float(x) for x in (*base, *bent)]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the measures of every row's whole text."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([measures(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_MEASURES)


def counted(rows: DataFrame, model: Linear) -> tuple[np.ndarray, np.ndarray]:
    """(edges, counts) of the margins of rows (x): at most 2 * BINS + 1 numbers come to the driver."""

    def run(batches):
        total = np.zeros(2 * BINS + 1, np.int64)
        for b in batches:
            at = np.clip(np.floor(model.margin(_matrix(b, 0)) / BIN), -BINS, BINS).astype(int) + BINS
            total += np.bincount(at, minlength=len(total))
        on = np.flatnonzero(total)
        yield pa.record_batch([pa.array(on, pa.int64()), pa.array(total[on], pa.int64())], ["bin", "n"])

    counts = np.zeros(2 * BINS + 1, np.int64)
    for r in rows.select("x").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    return (np.arange(-BINS, BINS + 1)) * BIN, counts


def added_up(rows: DataFrame, numbers) -> np.ndarray:
    """numbers(matrix) of every batch of rows (x), added up: by task, then by place in the shuffle."""

    def run(batches):
        total = 0.0
        for b in batches:
            total = total + numbers(_matrix(b, 0))
        if np.ndim(total):
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "value"])

    with arrow_rows(rows.sparkSession, 8192):
        got = rows.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(got, key=lambda r: r["at"])])


def fit_quality(rows: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, prior: float | None = None) -> tuple[Linear, float]:
    """(model, class prior) for measured rows (doc_id, x). Of positives that repeat an id the fits take the one with the least measures."""
    train = rows.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = F.broadcast(label_sample(labels.where("quality = 1"), "quality", per_class).select("doc_id"))  # at most per_class rows
    got = train.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    if not got:
        return constant(N_MEASURES, 2.0), 1.0
    pos = np.array([r["x"] for r in got], float)
    s = added_up(train, lambda x: np.r_[len(x), x.sum(0), (x * x).sum(0)])
    mean = s[1 : N_MEASURES + 1] / s[0]
    scale = np.sqrt(np.maximum(s[N_MEASURES + 1 :] / s[0] - mean * mean, 0))
    scale[scale < 1e-6] = 1.0
    over = lambda numbers: lambda w: added_up(train, lambda x: numbers(standard(x, mean, scale), w))
    if prior is None:
        first = fit_two(over(curvature), mean, scale, pos)
        prior = binned_prior(first.margin(pos), *counted(train, first))
    return fit_non_negative(over(slopes), mean, scale, pos, prior), prior


def scored(rows: DataFrame, model: Linear) -> DataFrame:
    """(doc_id, score) of measured rows (doc_id, x)."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(model.score(_matrix(b, 1)))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def score_quality(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    return scored(measured(docs, id_col, text_col), model)


def keep_quality(docs: DataFrame, model: Linear, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            x = np.array([measures(t) for t in b.column(at).to_pylist()], float)
            if len(x):
                yield b.filter(pa.array(model.score(x) >= threshold))

    tune(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = keep(measured(docs), "quality-measures")  # some 200 bytes a document: texts are read once
    model, _ = fit_quality(rows, labels)
    out = scored(rows, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
