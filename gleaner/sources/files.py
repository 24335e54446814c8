"""Files to texts: dispatch by suffix, decoding, office documents, images."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.web import html_text
from gleaner.operators.cuts import stored

TEXT, HTML, IMAGES = ("txt", "md", "markdown", "csv"), ("html", "htm"), ("png", "jpg", "jpeg", "webp", "gif")
LEAST_IMAGE, MOST_BLOBS = 32, 24
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def decode(raw: bytes) -> str:
    """UTF-8, else GB 18030, else Latin-1, which takes any bytes."""
    for name in ("utf-8", "gb18030"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def docx_text(raw: bytes) -> str:
    """Paragraphs of a document; those of a heading style get hash marks."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        if not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        outline = p.find(f"{_W}pPr/{_W}outlineLvl")
        name = style.get(f"{_W}val", "") if style is not None else ""
        level = None
        if outline is not None and outline.get(f"{_W}val", "").isdigit():
            level = int(outline.get(f"{_W}val")) + 1
        elif m := re.search(r"(?:heading|标题)\s*(\d)", name, re.IGNORECASE):
            level = int(m[1])
        elif name.lower() == "title":
            level = 1
        out.append(f"{'#' * min(level, 6)} {text}" if level and level <= 6 else text)
    return "\n\n".join(out)


def pdf_text(raw: bytes) -> str:
    """Page texts, with whichever PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise ValueError("no PDF library is installed") from missing
    return "\n\n".join((page.extract_text() or "").strip() for page in PdfReader(io.BytesIO(raw)).pages)


_PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_PARSED)
def _parsed(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    texts, errors = [], []
    for raw, k in zip(content, kind, strict=True):
        try:
            made = {"docx": docx_text, "pdf": pdf_text}.get(k, decode)(bytes(raw))
            texts.append(made)
            errors.append(None)
        except Exception as e:  # one broken file must not end the job
            texts.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return pd.DataFrame({"text": texts, "error": errors})


def read_files(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """path, kind, text, error of every file below ``path``.

    Images have an empty text and need at least 32 bytes; other endings are an
    error of their own row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if partitions:
        files = files.repartition(partitions)
    kind = suffix(F.col("path"))
    rows = files.select("path", kind.alias("kind"), "content", "length")
    known = F.col("kind").isin(*TEXT, *HTML, *IMAGES, "docx", "pdf")
    image = F.col("kind").isin(*IMAGES)
    rows = rows.withColumn("p", F.when(known & ~image, _parsed("content", "kind")))
    text = F.when(image, "").when(F.col("kind").isin(*HTML), html_text(F.col("p.text"))).otherwise(F.col("p.text"))
    error = (
        F.when(~known, F.concat(F.lit("unsupported file type: "), "kind"))
        .when(image & (F.col("length") < LEAST_IMAGE), "image too small")
        .otherwise(F.col("p.error"))
    )
    return rows.select("path", "kind", text.alias("text"), error.alias("error"))


def distinct_blobs(blobs: list[bytes]) -> list[bytes]:
    """The first of each, in order, 24 at most."""
    return list(dict.fromkeys(blobs))[:MOST_BLOBS]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text of UTF-8 files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_passages(passages: DataFrame, path: str, key: str = "source_id", buckets: int = 64) -> None:
    """Replaces the passages of the sources at hand, and of no others.  Sources
    lie in buckets by a hash; only theirs are read and written again."""
    spark = passages.sparkSession
    at = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = stored(passages.withColumn("bucket", at))
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # buckets at most
    try:
        old = spark.read.parquet(path)
    except AnalysisException:  # nothing was written yet
        old = fresh.limit(0)
    kept = old.where(F.col("bucket").isin(touched)).join(fresh.select(key).distinct(), key, "left_anti")
    both = stored(kept.select(*fresh.columns).unionByName(fresh))  # before its place is overwritten
    both.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
