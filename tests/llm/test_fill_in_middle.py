"""Fill-in-the-middle: arrangements by hand, restored texts, odd rows, and the query against its SQL."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from gridloom.llm.fill_in_middle import OP11_SQL, fill_in_middle, op11_fill_in_middle, restore

SCHEMA = "doc_id long, text string, output int, units string, h1 string, form int"


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, None, text
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", pre, mid, suf, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", pre, mid, suf, f"<P>{pre}<S>{suf}<M>{mid}"


def rows():
    r = random.Random(3)
    pool = ["word", "Ab", " ", "\n", "\r\n", "<", ">", "<P", "S>", "<M", "é", "ß", "😀", "é", "中", "$1", "\\", "0", "_", "\t", " ", "\x85"]
    out = [(i, "".join(r.choice(pool) for _ in range(r.randint(0, 30)))) for i in range(300)]
    out += [(400, None), (401, ""), (402, "has <P> in it"), (403, "<S>"), (404, "x<M>"), (405, "\n"), (406, "a"), (None, "no id at all"), (None, None), (-7, "negative id here"), (407, "long text, " * 60_000)]
    return out + [out[5], (5, "another text of the same id")]


def as_df(spark, data):
    return spark.createDataFrame([(i, t, 1, "u", "h", 2) for i, t in data], SCHEMA)


def test_by_hand_and_restored(spark):
    data = rows()
    got = fill_in_middle(as_df(spark, data)).withColumn("restored", restore(F.col("output"), F.col("form"))).collect()
    want = sorted(((*by_hand(*x), x[1] or "") for x in data), key=str)
    assert sorted((tuple(x) for x in got), key=str) == want
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}


def test_shares_and_seed(spark):
    df = as_df(spark, [(i, "some words to cut here") for i in range(4000)])
    n = {r["form"]: r["count"] for r in fill_in_middle(df).groupBy("form").count().collect()}
    assert 300 < n["plain"] < 500 and 600 < n["spm"] < 840
    assert {r["form"] for r in fill_in_middle(df, arranged_percent=0).select("form").distinct().collect()} == {"plain"}
    assert {r["form"] for r in fill_in_middle(df, arranged_percent=100, spm_percent=100).select("form").distinct().collect()} == {"spm"}
    other = fill_in_middle(df, seed=2).select("output").collect()
    assert other != fill_in_middle(df).select("output").collect()


def test_empty_table_and_plan(spark):
    df = as_df(spark, [(1, "x")])
    assert fill_in_middle(df.where("false")).collect() == []
    plan = fill_in_middle(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow", plan) and plan.count("regexp_extract_all") == 1


def test_query_against_sql(spark, sf, tmp_path):
    db = duckdb.connect()
    odd = str(tmp_path)
    as_df(spark, rows()).select("doc_id", "text").write.parquet(f"{odd}/documents.parquet")
    for folder, at in ((sf, f"{sf}/documents.parquet"), (odd, f"{odd}/documents.parquet/*.parquet")):
        db.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{at}'")
        got = op11_fill_in_middle(spark, folder)
        want = db.sql(OP11_SQL)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
        assert all(x["restored_sha256"] for x in got.collect())
