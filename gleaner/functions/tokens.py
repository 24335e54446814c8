"""Tokens of the lexical index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; Han, Hiragana, Katakana and
    Hangul runs become overlapping pairs, as CJK analysers make them."""
    cjk = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"([{cjk}]+)", " $1 ")
    parts = F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda t: t != "")

    def pairs(t: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(F.length(t) > 1, two).otherwise(F.array(t))

    return F.flatten(F.transform(parts, lambda t: F.when(t.rlike(f"^[{cjk}]"), pairs(t)).otherwise(F.array(t))))


def latin_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, without the pairs: cheaper where
    the corpus has no CJK text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")
