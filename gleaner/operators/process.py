"""From sources to passages with their index entries and vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import chunk_title, strip
from gleaner.operators.chunk import Config, child_entries, embed_items, split_pieces

#: What a config given as JSON may say; missing keys take the defaults.
CONFIG = "mode string, split string, size int, overlap int, child boolean, child_size int, qa boolean"


def coerced(config: Column) -> Column:
    """A stored config with its defaults: children are on for custom splits
    that make no pairs, unless the config says otherwise."""
    c = F.from_json(F.coalesce(config, F.lit("{}")), CONFIG)
    mode, qa = F.coalesce(c["mode"], F.lit("auto")), F.coalesce(c["qa"], F.lit(False))
    size = F.coalesce(c["size"], F.lit(1000))
    size = F.when(size <= 0, 0).otherwise(F.greatest(size, F.lit(64)))
    overlap = F.least(F.greatest(F.coalesce(c["overlap"], F.lit(0)), F.lit(0)), F.floor(size / 2).cast("int"))
    return F.struct(
        mode.alias("mode"),
        F.when(mode == "custom", F.coalesce(c["split"], F.lit("paragraph"))).otherwise("paragraph").alias("split"),
        size.alias("size"),
        overlap.alias("overlap"),
        F.coalesce(c["child"], (mode == "custom") & ~qa).alias("child"),
        F.coalesce(c["child_size"], F.lit(512)).alias("child_size"),
        qa.alias("qa"),
    )


def described(c: Column) -> Column:
    """One line on how a source is split."""
    size = F.when(c["size"] == 0, "no limit").otherwise(F.concat(c["size"].cast("string"), F.lit(" characters")))
    return F.concat_ws(
        ", ",
        F.when(c["qa"], "pairs").otherwise(F.concat(c["mode"], F.lit(" by "), c["split"])),
        size,
        F.when(c["overlap"] > 0, F.concat(F.lit("overlap "), c["overlap"].cast("string"))),
        F.when(c["child"], F.concat(F.lit("children of "), c["child_size"].cast("string"))),
    )


def units(sources: DataFrame, c: Config, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """source_id, position, title, text, indexes (id, type, text): children of
    the prose, then a sentence for each table row, where children are wanted."""
    rows = split_pieces(sources, c, id_col, text_col)

    def entries(kind: str, texts: Column, before: Column) -> Column:
        name = lambda i: F.concat(F.lit(f"{kind}-"), (before + i + 1).cast("string"))
        return F.transform(texts, lambda t, i: F.struct(name(i).alias("id"), F.lit(kind).alias("type"), t.alias("text")))

    wanted = c.mode == "custom" and c.child and not c.qa
    rows = rows.select(F.col("id").alias("source_id"), "position", "x.text", child_entries(F.col("x.prose"), c).alias("kids"), "x.rows")
    said = F.col("rows") if wanted else F.array().cast("array<string>")
    return rows.select(
        "source_id",
        "position",
        chunk_title(F.col("text"), F.lit("")).alias("title"),
        "text",
        F.concat(entries("child", F.col("kids"), F.lit(0)), entries("row", said, F.size("kids"))).alias("indexes"),
    )


def preview(rows: DataFrame, size: int) -> DataFrame:
    """Counts and lengths of the passages to be."""
    n = F.length("text")
    return rows.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.min(n).alias("shortest"),
        F.max(n).alias("longest"),
        F.bround(F.avg(n)).cast("long").alias("mean"),
        F.count_if(n > size).alias("n_oversize"),
        F.sum(F.greatest(F.size("indexes"), F.lit(1))).alias("n_indexes"),
    )


#: Passages and characters that a preview shows.
SHOWN, SHOWN_CHARS = 50, 24_000


def shown(rows: DataFrame, title: str = "", most: int = SHOWN) -> DataFrame:
    """source_id, position, title, text, chars, indexes of the first passages of
    each source; one without a title is named by its number."""
    named = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit(f"{title} · "), F.col("position").cast("string")))
    rows = rows.where(F.col("position") <= most)
    return rows.select("source_id", "position", named.alias("title"), "text", F.length("text").alias("chars"), "indexes")


def shown_text(text: Column, most: int = SHOWN_CHARS) -> Column:
    """(text, truncated, chars) of a parsed text."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.substring(t, 1, most).alias("text"), (F.length(t) > most).alias("truncated"), F.length(t).alias("chars"))


def items(rows: DataFrame) -> DataFrame:
    """source_id, position, item, kind, text: what is embedded, in order."""
    kids = F.transform(F.filter("indexes", lambda x: x["type"] == "child"), lambda x: x["text"])
    rest = F.filter("indexes", lambda x: x["type"] != "child")
    made = embed_items(F.col("title"), F.col("text"), F.lit(None).cast("string"), kids, rest)
    # not an inner posexplode: its filter on the array's size would make it again
    rows = rows.select("source_id", "position", F.posexplode_outer(made).alias("item", "i")).where(F.col("i").isNotNull())
    return rows.select("source_id", "position", "item", "i.kind", "i.text")


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")


def hashed_vector(text: str, dim: int = 64) -> np.ndarray:
    """A stand-in for an embedding model: signed hashes of words, unit length."""
    said = [0] * dim
    for w in text.lower().split():
        h = _word_hash(w)
        said[h % dim] += 1 if h >> 63 else -1
    v = np.array(said, dtype=float)
    n = np.linalg.norm(v)
    return v / n if n else v


def embedded(rows: DataFrame, embed: Callable[[list[str]], list] | None = None, text_col: str = "text", batch: int = 8) -> DataFrame:
    """``rows`` with a column ``vec``.  ``embed`` takes a list of at most
    ``batch`` texts and returns as many vectors; it runs in the tasks."""

    def stand_in(texts: list[str]) -> list:
        return [hashed_vector(t).tolist() for t in texts]

    model = embed or stand_in
    schema = rows.schema
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = [t or "" for t in b.column(at).to_pylist()], []
            for i in range(0, len(texts), batch):
                got = model(texts[i : i + batch])
                if len(got) != len(texts[i : i + batch]):
                    raise ValueError("as many vectors as texts are expected")
                out += [list(map(float, v)) for v in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], [*b.schema.names, "vec"])

    return rows.mapInArrow(run, T.StructType([*schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))]))


def captioned(body: Column, captions: Column) -> Column:
    """A text with its image captions: none, one as the body, or sections."""
    many = F.array_join(F.transform(captions, lambda c, i: F.concat(F.lit("## 图 "), (i + 1).cast("string"), F.lit("\n"), c)), "\n\n")
    said = F.when(F.size(captions) == 0, "").when(F.size(captions) == 1, F.get(captions, F.lit(0))).otherwise(many)
    return F.array_join(F.filter(F.array(strip(F.coalesce(body, F.lit(""))), said), lambda x: x != ""), "\n\n")


def uncovered_tail(text: Column, last: Column) -> Column:
    """What follows the last occurrence of the last passage, if it occurs."""
    parts = F.split(text, F.concat(F.lit("\\Q"), last, F.lit("\\E")))
    return F.when((last != "") & text.contains(last), strip(F.element_at(parts, -1))).otherwise("")


def numbered(rows: DataFrame, key: str, *order) -> DataFrame:
    """Positions from 1 within each key."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
