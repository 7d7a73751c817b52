"""String functions, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split(s: Column, delimiter: str) -> Column:
    return F.split(s, re.escape(delimiter), -1)


def split_by_line_breaks(s: Column) -> Column:
    """Lines without carriage returns at their ends; empty ones go."""
    return F.filter(F.transform(F.split(s, "\n", -1), lambda x: F.regexp_replace(x, "\r+$", "")), lambda x: x != "")


def merge(tokens: Column, delimiter: str) -> Column:
    return F.array_join(tokens, delimiter)


def contains(s: Column, *needles: str) -> Column:
    """Any of the needles is in s."""
    out = F.lit(False)
    for n in needles:
        out = out | s.contains(n)
    return out


def contains_case_insensitive(s: Column, *needles: str) -> Column:
    return contains(F.lower(s), *[n.lower() for n in needles])


def replace(s: Column, needle: str, by: str) -> Column:
    """All occurrences; nothing for an empty needle."""
    return F.replace(s, F.lit(needle), F.lit(by)) if needle else s


def begins_with(s: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | s.startswith(p)
    return out


def ends_with(s: Column, *suffixes: str) -> Column:
    out = F.lit(False)
    for x in suffixes:
        out = out | s.endswith(x)
    return out


def trim_space(s: Column) -> Column:
    return F.trim(s, F.lit(" \t\n\x0b\x0c\r"))


def remove_all_suffix(s: Column) -> Column:
    """Without extensions of up to five characters, as long as there are such."""
    return F.regexp_replace(s, r"(\.[^./\\]{1,5})+$", "")


def complete_suffix(s: Column) -> Column:
    """The last extension with its dot, or both of one that ends in .gz; empty if none."""
    return F.regexp_extract(s, r"((?:\.[^./\\]+)?\.gz|\.[^./\\]+)$", 1)


def to_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def equal_case_insensitive(a: Column, b: Column) -> Column:
    return to_lower(a) == to_lower(b)


def common_prefix(a: Column, b: Column) -> Column:
    """The longest prefix that both have."""
    n = F.least(F.length(a), F.length(b))
    k = F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda best, i: F.when(F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i), i).otherwise(best))
    return F.substring(a, F.lit(1), k)


def match_wildcard(s: Column, pattern: str) -> Column:
    """Whether s fits a pattern of stars and question marks."""
    return s.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def match_strings(a: str, b: str, c: str) -> str | None:
    """The string that stands to c as b stands to a, by taking what differs between a and b out of c; None if there is none."""
    if a == c:
        return b
    if a == b:
        return c
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    old, new = a[head : len(a) - tail], b[head : len(b) - tail]
    if old and old in c:
        return c.replace(old, new, 1)
    if not old and tail and c.endswith(a[len(a) - tail :]):
        return c[: len(c) - tail] + new + c[len(c) - tail :]
    if not old and head and c.startswith(a[:head]):
        return c[:head] + new + c[head:]
    return None
