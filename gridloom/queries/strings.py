"""String functions over the text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import strings as S
from .registry import Registry

REG = Registry()


def _part(name: str, value, sql: str) -> None:
    REG.add(f"str_{name}", lambda s, d: table(s, d, "part").select("p_partkey", value(F.col("p_name"), F.col("p_type")).alias("v")), f"SELECT p_partkey, {sql} AS v FROM part")


_part("split", lambda n, t: F.size(S.split(n, " ")), "CAST(len(string_split(p_name, ' ')) AS INT)")
_part("merge", lambda n, t: S.merge(S.split(n, " "), "_"), "replace(p_name, ' ', '_')")
_part("contains", lambda n, t: S.contains(n, "a", "zz"), "contains(p_name, 'a') OR contains(p_name, 'zz')")
_part("contains_case_insensitive", lambda n, t: S.contains_case_insensitive(t, "Brass", "tin"), "contains(lower(p_type), 'brass') OR contains(lower(p_type), 'tin')")
_part("replace", lambda n, t: S.replace(n, "a", "<a>"), "replace(p_name, 'a', '<a>')")
_part("begins_with", lambda n, t: S.begins_with(t, "S", "P"), "starts_with(p_type, 'S') OR starts_with(p_type, 'P')")
_part("ends_with", lambda n, t: S.ends_with(t, "L", "S"), "ends_with(p_type, 'L') OR ends_with(p_type, 'S')")
_part("trim_space", lambda n, t: S.trim_space(F.concat(F.lit(" \t"), n, F.lit("\n "))), "trim(p_name, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")
_part("to_lower", lambda n, t: S.to_lower(t), "lower(p_type)")
_part("equal_case_insensitive", lambda n, t: S.equal_case_insensitive(F.upper(n), n), "true")
_part("common_prefix", lambda n, t: F.length(S.common_prefix(n, F.concat(F.substring(n, 1, 3), F.lit("#")))), "least(3, length(p_name))")
_part("remove_all_suffix", lambda n, t: S.remove_all_suffix(F.concat(F.lit("k"), F.col("p_partkey"), F.lit(".nii.gz"))), "'k' || p_partkey")
_part("complete_suffix", lambda n, t: S.complete_suffix(F.concat(F.lit("k"), F.col("p_partkey"), F.lit(".nii.gz"))), "'.nii.gz'")
_part("match_wildcard", lambda n, t: S.match_wildcard(t, "*A*"), "contains(p_type, 'A')")


@REG("str_split_by_line_breaks", "SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, chr(13))), lambda x: x <> '')) AS INT) AS v FROM documents")
def line_breaks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(S.split_by_line_breaks(F.col("text"))).alias("v"))


@REG("str_prefix_pages", "SELECT page_id, starts_with(url, 'https') AS v FROM pages")
def prefix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.begins_with(F.col("url"), "https").alias("v"))
