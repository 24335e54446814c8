"""Text expressions of the passage model.  ``(?U)`` makes the white space and
digit classes Unicode-aware."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_BARE = r"https?://\S+|www\.\S+"
# Fixed value: what ends a sentence, so that the line is no heading.
_ENDS = "。；;！？!?：:"
ZERO_WIDTH = r"[​-‍⁠﻿]"


#: Fixed value: what ``(?U)\\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row; inside a
    lambda nothing else keeps a repeated expression from being repeated."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Removes all Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def index_text(text: Column) -> Column:
    """What is indexed of a text: links and images leave their visible label,
    bare addresses go; a label that is an address goes too."""
    # every pattern needs one of these, which most texts lack
    marks = ("<", "[", "http", "www.")
    return once(F.coalesce(text, F.lit("")), lambda t: F.when(reduce(or_, [t.contains(x) for x in marks]), _unlinked(t)).otherwise(t))


def _unlinked(t: Column) -> Column:
    t = F.regexp_replace(t, r"(?is)<a\b[^>]*>\s*(?:https?://|www\.)[^<\s]*\s*</a>", "")
    t = F.regexp_replace(t, r"(?is)<a\b[^>]*>(.*?)</a>", "$1")
    t = F.regexp_replace(t, rf"!?\[\s*(?:{_BARE})?\s*\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", "")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", "$1")
    t = F.regexp_replace(t, r"<https?://[^>\s]*>", "")
    return F.regexp_replace(t, _BARE, "")


def index_label(text: Column) -> Column:
    """One line's label: without heading marks, zero-width characters, links."""
    t = F.regexp_replace(strip(text), ZERO_WIDTH, "")
    t = index_text(F.regexp_replace(t, r"^#{1,6}\s*", ""))
    return strip(F.regexp_replace(t, r"[ \t]+", " "))


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else null.  Order of the rules: hash marks,
    chapter, section and article numbers, dotted numbers, list numbers.  A
    chapter's number stands by itself; a list number's line is short."""
    # all rules ask for one of these at the start, which few lines have
    maybe = line.rlike(r"^(?U)\s*[#第（(\d一二三四五六七八九十百千零〇两]")
    return F.when(maybe, once(strip(line), _level))


def _level(t: Column) -> Column:
    number, alone = "[一二三四五六七八九十百千零〇两0-9]+", r"(?![\p{L}\p{N}_])"
    dotted = F.regexp_extract(t, r"^((?U)\d+(?:\.\d+){1,5})\s+\S", 1)
    dots = F.length(dotted) - F.length(F.replace(dotted, F.lit("."), F.lit("")))
    open_ = ~t.rlike(f"[{_ENDS}]$")
    short = open_ & (F.length(t) <= 30)
    return (
        F.when(t.rlike(r"^#{1,6}(?U)\s+\S"), F.length(F.regexp_extract(t, "^(#{1,6})", 1)))
        .when(t.rlike(f"^第{number}(?:章|编|部分){alone}"), 1)
        .when(t.rlike(f"^第{number}节{alone}"), 2)
        .when(t.rlike(f"^第{number}条{alone}"), 3)
        .when((dotted != "") & (F.length(t) <= 80) & open_, F.least(dots + 1, F.lit(6)))
        .when(short & t.rlike(r"^(?U)\d+[、.．]\s*\S"), 4)
        .when(short & t.rlike(f"^{number}、\\S"), 4)
        .when(short & t.rlike(f"^[（(]{number}[）)]"), 2)
    )


def has_heading(text: Column, deepest: int | None = None) -> Column:
    """Does any line reach a heading level of at most ``deepest`` (1 to 8)."""
    most = max(1, min(deepest or 5, 8))
    return F.exists(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.coalesce(heading_level(x) <= most, F.lit(False)))


def table_cells(line: Column) -> Column:
    """Cells of a table row: outer bars dropped, escaped bars kept."""
    t = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(t, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def is_delimiter_row(line: Column) -> Column:
    cells = table_cells(line)
    return line.contains("-") & F.forall(cells, lambda c: c.rlike(r"^:?-+:?$"))


def row_sentence(header: Column, row: Column) -> Column:
    """``name: value`` for the cells of a row that have a value."""
    pairs = F.zip_with(
        F.transform(header, lambda h, i: F.when(h == "", F.concat(F.lit("列"), (i + 1).cast("string"))).otherwise(h)),
        row,
        lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(h, F.lit(": "), v)),
    )
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), "；")


def chunk_title(text: Column, fallback: Column) -> Column:
    """The first article label, else the first label, of a passage; at most 80
    characters."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~is_delimiter_row(x))
    labels = F.transform(
        lines,
        lambda x: F.when(
            x.rlike(r"^\s*\|.*\|\s*$"), F.array_join(F.filter(table_cells(x), lambda c: c != ""), " / ")
        ).otherwise(index_label(x)),
    )

    def first(labels: Column) -> Column:
        article = F.filter(labels, lambda x: x.rlike("^第[一二三四五六七八九十百千零〇两0-9]+条"))
        return F.coalesce(F.get(article, F.lit(0)), F.get(labels, F.lit(0)), fallback)

    return F.substring(once(F.filter(labels, lambda x: x != ""), first), 1, 80)


def canonical_text(text: Column) -> Column:
    """Line ends unified, trailing blanks and long gaps removed."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(canonical_text(text).cast("binary"), 256)


def split_thinking(text: Column) -> tuple[Column, Column]:
    """(thinking, answer) of a reply with ``<think>`` parts."""
    t = F.coalesce(text, F.lit(""))
    inside = F.regexp_extract_all(t, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1))
    return F.array_join(F.transform(inside, strip), "\n"), strip(F.regexp_replace(t, r"(?s)<think>.*?(</think>|$)", ""))


def citations(text: Column) -> Column:
    """Numbers of the ``[n]`` marks, in order, once each."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    )


def tool_name(name: Column) -> Column:
    """Lower-case letters, digits and underscores, at most 64."""
    t = F.regexp_replace(F.lower(strip(F.coalesce(name, F.lit("")))), r"[^a-z0-9_]+", "_")
    return F.substring(F.regexp_replace(t, r"^_+|_+$", ""), 1, 64)


#: What a hit of each kind of index entry is called.
HIT_LABELS = {"child": "子块", "auto": "补充索引", "image": "图片", "title": "标题"}


def hit_label(kind: Column) -> Column:
    """The label of a hit by its kind of entry; a passage itself has none."""
    label = F.lit("")
    for name, said in HIT_LABELS.items():
        label = F.when(kind == name, said).otherwise(label)
    return label


def locator_in(response: Column) -> Column:
    """The first ``locator:`` line of a tool's reply."""
    return F.trim(F.regexp_extract(F.coalesce(response, F.lit("")), r"(?m)^(?:定位：|locator:)[ \t]*(.+?)[ \t]*$", 1))


def unfenced(text: Column) -> Column:
    """Without a code fence around the whole; at most 800 characters."""
    t = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"^```[a-zA-Z]*\n?|\n?```$", "")
    return F.substring(strip(t), 1, 800)
