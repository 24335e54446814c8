"""Reviewed drafts become sources with passages, vectors and postings in one
change; single passages are patched in an overlay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import content_hash
from gleaner.operators import cuts
from gleaner.operators.chunk import embed_items
from gleaner.operators.cuts import spread
from gleaner.operators.process import embedded
from gleaner.operators.retrieve import BOOSTS
from gleaner.operators.store import Store

_OWNED = "kb_id string, source_id string"
_PASSAGE = f"{_OWNED}, chunk_id string, position int, title string, text string, answer string, indexes string, locator string"
#: The tables of a store of knowledge bases.
TABLES = {
    "sources": (f"{_OWNED}, type string, title string, locator string, status string, hash string, n int", "source_id"),
    "passages": (_PASSAGE, "source_id"),
    "vectors": (f"{_OWNED}, chunk_id string, kind string, vec array<double>", "source_id"),
    "patches": (_PASSAGE, "chunk_id"),
    "patched_vectors": (f"{_OWNED}, chunk_id string, kind string, vec array<double>", "chunk_id"),
}


def stored(df: DataFrame) -> DataFrame:
    """As ``cuts.stored``, packed closer: texts lie there as long as the change lasts."""
    return cuts.stored(df, "zstd")


def knowledge_store(spark, path: str) -> Store:
    return Store(spark, path, TABLES, BOOSTS)


def _vectors(passages: DataFrame, title, embed) -> DataFrame:
    """A vector for each text that is embedded for a passage."""
    none = F.array().cast("array<string>")
    items = F.explode(embed_items(title, F.col("text"), F.col("answer"), none))
    texts = passages.select("kb_id", "source_id", "chunk_id", items.alias("i")).select("kb_id", "source_id", "chunk_id", "i.kind", "i.text")
    return embedded(texts, embed).drop("text")


def open_drafts(drafts: DataFrame, now: str) -> DataFrame:
    """For each kb_id and fingerprint the newest draft that is ready and has
    not expired."""
    ready = drafts.where((F.col("status") == "ready") & (F.col("expires_at") > now))
    order = Window.partitionBy("kb_id", "fingerprint").orderBy(F.desc("created_at"), F.desc("draft_id"))
    return ready.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def commit_drafts(store: Store, drafts: DataFrame, now: str, embed: Callable[[list[str]], list] | None = None) -> DataFrame:
    """draft_id, status, reason: ``committed``, or ``refused`` and why.

    ``drafts``: draft_id, kb_id, type, title, locator, raw_text, status,
    expires_at, units (array of title, text, answer, indexes).  A draft goes to
    the source of its kb_id, type and locator, and replaces what that has; of
    several drafts for one source the greatest id counts.  All of them show in
    one version; if anything fails before it, none does, and they stay ready.
    """
    change = store.change()
    named = F.coalesce(F.nullif(F.trim("locator"), F.lit("")), F.col("title"))
    units = F.filter("units", lambda u: F.coalesce(u["text"], F.lit("")) != "")
    page = (F.col("type") == "web") & (F.coalesce("raw_text", F.lit("")) != "")
    # each text once from here: that of a draft as its hash, and the units that count
    known = stored(change.current("sources").select("kb_id", "type", F.col("locator").alias("_locator"), "source_id"))
    reason = (
        F.when((F.col("status") != "ready") | F.col("status").isNull(), "not ready")
        .when(~F.coalesce(F.col("expires_at") > now, F.lit(False)), "expired")
        .when(F.size("_units") <= 0, "nothing to store")
    )
    # each text once from here: that of a draft as its hash, and the units that count
    rows = drafts.withColumns({"_locator": named, "_units": units, "_hash": F.when(page, content_hash(F.col("raw_text")))}).drop("raw_text", "units")
    rows = rows.withColumn("_why", reason).withColumn("_units", F.when(F.col("_why").isNull(), F.col("_units")))
    # a source keeps its id; a new one's comes from its key, so that a second try makes the same
    fresh = F.concat(F.lit("src_"), F.substring(F.sha2(F.to_json(F.array("kb_id", "type", "_locator")).cast("binary"), 256), 1, 16))
    rows = spread(rows).join(known, ["kb_id", "type", "_locator"], "left").withColumn("source_id", F.coalesce("source_id", fresh))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    # of drafts for one source only the keys are moved
    keys = rows.where("_why is null").select("kb_id", "type", "_locator", "draft_id", "_row")
    nth = F.row_number().over(Window.partitionBy("kb_id", "type", "_locator").orderBy(F.desc("draft_id")))
    older = stored(keys.withColumn("_n", nth).where("_n > 1").select("_row", F.lit("superseded").alias("_older")))
    rows = rows.join(older, "_row", "left").withColumn("reason", F.coalesce("_why", "_older"))
    good = rows.where("reason is null").withColumns({"locator": F.col("_locator"), "title": F.coalesce("title", F.lit(""))})
    passages = good.select("kb_id", "source_id", "locator", F.posexplode("_units").alias("p", "u")).select(
        "kb_id", "source_id",
        F.concat("source_id", F.lit("-"), F.substring(F.sha2(F.concat_ws("|", "source_id", F.col("p") + 1, "u.text").cast("binary"), 256), 1, 16)).alias("chunk_id"),
        (F.col("p") + 1).alias("position"), F.substring(F.coalesce("u.title", F.lit("")), 1, 255).alias("title"), F.col("u.text").alias("text"),
        F.coalesce("u.answer", F.lit("")).alias("answer"), F.coalesce("u.indexes", F.lit("")).alias("indexes"),
        F.concat("locator", F.lit(" #"), F.col("p") + 1).alias("locator"),
    )
    # passages are read from the stored rows each time, not stored a second time
    vectors = stored(_vectors(passages, F.col("title"), embed))
    empty = good.join(vectors.select("source_id").distinct(), "source_id", "left_anti").count()
    if empty:
        raise ValueError(f"{empty} drafts have no text to embed")
    sources = good.select(
        "kb_id", "source_id", "type", "title", "locator", F.lit("synced").alias("status"),
        F.col("_hash").alias("hash"), F.size("_units").alias("n"),
    )
    owners = good.select("source_id")
    for name, part in (("sources", sources), ("passages", passages), ("vectors", vectors)):
        change.replace(name, part, owners, True)
    patched = change.current("patches").join(owners, "source_id", "left_semi").select("chunk_id")
    for name in ("patches", "patched_vectors"):
        change.replace(name, change.current(name).limit(0), patched)
    change.index().put(passages, good.select("kb_id", "source_id"))
    change.commit()
    return rows.select("draft_id", F.when(F.col("reason").isNull(), "committed").otherwise("refused").alias("status"), "reason")


def current_passages(store: Store, change=None) -> DataFrame:
    """Passages with the overlay merged in."""
    of = change or store
    base, over = of.current("passages"), of.current("patches")
    return base.join(over.select("chunk_id"), "chunk_id", "left_anti").unionByName(over)


def current_vectors(store: Store) -> DataFrame:
    base, over = store.current("vectors"), store.current("patched_vectors")
    patched = store.current("patches").select("chunk_id")
    return base.join(patched, "chunk_id", "left_anti").unionByName(over)


def patch_passages(store: Store, patches: DataFrame, embed: Callable[[list[str]], list] | None = None) -> int:
    """Changes title, text, answer or indexes of single passages (chunk_id and
    those columns; null leaves a value, a blank title too); returns how many
    there were.  Only they are embedded and indexed again."""
    change = store.change()
    # of a size that is known, so that few of them are broadcast and the passages not moved
    asked = stored(patches.select("chunk_id", *[F.col(c).alias(f"_{c}") for c in ("title", "text", "answer", "indexes")]))
    old = stored(current_passages(store, change).join(asked, "chunk_id"))
    kept = old.drop("_title", "_text", "_answer", "_indexes")
    title = F.coalesce(F.nullif(F.substring(F.trim("_title"), 1, 255), F.lit("")), F.col("title"))
    changed = {"title": title} | {c: F.coalesce(f"_{c}", c) for c in ("text", "answer", "indexes")}
    new = stored(old.withColumns(changed).select(*kept.columns))
    n = new.count()
    if n:
        change.replace("patches", new)
        change.replace("patched_vectors", _vectors(new, F.col("title"), embed), new.select("chunk_id"))
        change.index().patch(kept, new)
        change.commit()
    return n


def fold(store: Store) -> None:
    """Writes the overlay into the buckets of the sources it belongs to."""
    change = store.change()
    patches = stored(change.current("patches"))
    owners = stored(patches.select("source_id").distinct())
    passages, vectors = current_passages(store), current_vectors(store)
    for name, rows in (("passages", passages), ("vectors", vectors)):
        change.replace(name, rows.join(owners, "source_id", "left_semi"), None, True)
    for name in ("patches", "patched_vectors"):
        change.replace(name, change.current(name).limit(0), patches.select("chunk_id"))
    change.index().compact()
    change.commit()
