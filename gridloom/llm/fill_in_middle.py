"""Fill-in-the-middle arrangements of whole texts, and the texts restored from them, in SQL functions alone.

A text is cut into units: runs of ASCII letters, and every other code point by itself. Two hashes of the document's id
choose where the prefix and the middle end, a third whether the text stays plain, a fourth which arrangement it takes:
psm (prefix, suffix, middle) or spm (suffix, prefix, middle). Each part follows its sentinel.

Restoring needs the output and its form only. No part holds a sentinel, and a sentinel begins with the only `<` in it, so
none can arise where a part meets the next sentinel: there is one way to read an output.

Defined results: a null text counts as empty; empty texts and texts that hold a sentinel stay plain, without parts; a
null id hashes as an empty one; rows that repeat an id or a text each get their row; an empty table gives an empty table.
Columns besides the two named ones are ignored, whatever their names. A plan has no exchange: texts go through one
projection after another, and a row needs memory in proportion to its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"


def hashes(key: Column, n: int = 4) -> list[Column]:
    """The first n groups of eight hex digits of sha256(key), as unsigned integers."""
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def part(units: Column, begin: Column, end: Column) -> Column:
    """The text of units begin (from 0) up to but without end."""
    return F.array_join(F.slice(units, (begin + 1).cast("int"), (end - begin).cast("int")), "")


def restore(output: Column, form: Column) -> Column:
    """The exact text that an output was arranged from."""
    psm = F.regexp_replace(output, f"(?s)^{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)$", "$2$3$1")
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, arranged_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output): n units; the three parts are null where form is plain.

    seed gives other cuts for the same documents. arranged_percent of the texts are arranged, spm_percent of these as spm.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[h.alias(f"h{i + 1}") for i, h in enumerate(hashes(key))])
    plain = (F.col("text") == "") | F.col("text").rlike(SENTINEL) | (F.col("h3") % 100 >= arranged_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns({"units": F.regexp_extract_all("text", F.lit(UNIT), 0), "form": form})
    n = F.size("units").cast("long")
    rows = rows.withColumn("n", n).withColumns({"a": F.col("h1") % (F.col("n") + 1), "b": F.col("h2") % (F.col("n") + 1)})
    rows = rows.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    cuts = {"prefix": (F.lit(0), F.col("a")), "middle": (F.col("a"), F.col("b")), "suffix": (F.col("b"), F.col("n"))}
    rows = rows.select("doc_id", "text", "n", "form", *[F.when(F.col("form") != "plain", part(F.col("units"), *c)).alias(k) for k, c in cuts.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    length = lambda c: F.char_length(c).cast("long").alias(f"{c}_chars")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = rows.select("doc_id", "n", "form", length("prefix"), length("middle"), "output", restore(F.col("output"), F.col("form")).alias("restored"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(F.col("restored")).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
    ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:], ''), '') AS z FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m
    ELSE '<S>' || z || '<P>' || p || '<M>' || m END AS output FROM p)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o"""
