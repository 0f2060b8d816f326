"""Strings and regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_part(text: Column, delimiter: str, n: int) -> Column:
    """Part 0 means part 1; negative counts from the end; out of range gives ''."""
    return F.split_part(text, F.lit(delimiter), F.lit(n or 1))


def split(text: Column, delimiter: str) -> Column:
    return F.split(text, re.escape(delimiter), -1)


def split_to_table(text: Column, delimiter: str) -> Column:
    """Generator of (index, value); the index is 1-based like the source's."""
    parts = F.transform(split(text, delimiter), lambda v, i: F.struct((i + 1).alias("index"), v.alias("value")))
    return F.inline(parts)


def tokens(text: Column, delimiters: str = " ") -> Column:
    """Words between any of the delimiter characters; empty words are dropped."""
    return F.filter(F.split(text, "[" + re.escape(delimiters) + "]+"), lambda w: w != "")


def regexp_substr(text: Column, pattern: str) -> Column:
    return F.regexp_substr(text, F.lit(pattern))


def regexp_like(text: Column, pattern: str) -> Column:
    """Anchored to the whole string (``rlike`` alone is a search)."""
    return text.rlike(f"^(?:{pattern})\\z")


def regexp_instr(text: Column, pattern: str) -> Column:
    """Place of the first match, from 1; 0 without one."""
    return F.regexp_instr(text, F.lit(pattern))


def charindex(needle: str, text: Column) -> Column:
    return F.locate(needle, text)


def initcap(text: Column) -> Column:
    """Capitalises after whitespace only; agree the rule before a port relies on it."""
    return F.initcap(text)
