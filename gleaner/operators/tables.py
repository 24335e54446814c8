"""Keyed upserts, cascades, trees and other set work on tables of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import strip


def first_by(rows: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_sources(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """``known`` after taking in ``incoming``, both kb_id, type, locator,
    title, text; incoming also ``seq``.

    Within a batch the first of a key counts, rows without locator or text are
    skipped, and a blank title keeps the old one.
    """
    keys = ["kb_id", "type", "locator"]
    fresh = incoming.where("trim(coalesce(locator, '')) <> '' and trim(coalesce(text, '')) <> ''")
    fresh = first_by(fresh, keys, F.col("seq")).select(*keys, F.col("title").alias("_title"), F.col("text").alias("_text"))
    new = F.col("_text").isNotNull()
    title = F.coalesce(F.nullif(F.trim("_title"), F.lit("")), F.col("title"), F.lit(""))
    return known.join(fresh, keys, "full_outer").select(
        *keys,
        F.when(new, title).otherwise(F.col("title")).alias("title"),
        F.coalesce("_text", "text").alias("text"),
        F.when(new, "syncing").otherwise("synced").alias("status"),
    )


def tree_closure(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", most: int = 64) -> DataFrame:
    """ancestor, node: every node below each node, itself included.  The
    relation doubles its reach each round, so depth d takes log2(d) joins."""
    from gleaner.operators.cuts import settled

    step = nodes.where(F.col(parent_col).isNotNull()).select(F.col(parent_col).alias("ancestor"), F.col(id_col).alias("node"))
    reach = nodes.select(F.col(id_col).alias("ancestor"), F.col(id_col).alias("node")).unionByName(step).distinct()
    n = -1
    for _ in range(most):
        reach = settled(reach)
        if (now := reach.count()) == n:
            break
        n = now
        further = reach.alias("a").join(reach.alias("b"), F.col("a.node") == F.col("b.ancestor"))
        reach = further.select("a.ancestor", "b.node").distinct()
    return reach


def below(nodes: DataFrame, doomed: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """The nodes of ``doomed`` that exist, and all below them.  Each round
    takes the children of what the round before found, so the work grows with
    the subtrees, not with the forest; a circle ends where it began."""
    from gleaner.operators.cuts import stored

    kids = nodes.select(F.col(parent_col).alias("_up"), F.col(id_col))
    found = last = stored(nodes.join(doomed.select(id_col).distinct(), id_col, "left_semi").select(id_col).distinct())
    while last.head(1):
        step = kids.join(last.withColumnRenamed(id_col, "_up"), "_up").select(id_col).distinct()
        last = stored(step.join(found, id_col, "left_anti"))
        found = found.unionByName(last)
    return found


def delete_below(nodes: DataFrame, doomed: DataFrame, owned: dict[str, tuple[DataFrame, str]], id_col: str = "id", parent_col: str = "parent_id") -> dict[str, DataFrame]:
    """Tables after the deletion of nodes with all below them: ``nodes``
    itself, and each of ``owned`` (name -> rows, the column that names a node)."""
    gone = below(nodes, doomed, id_col, parent_col)
    rows = {"nodes": delete_cascade(nodes, gone, id_col)}
    return rows | {name: delete_cascade(df, gone.withColumnRenamed(id_col, col), col) for name, (df, col) in owned.items()}


def delete_cascade(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not to go."""
    return rows.join(doomed.select(key).distinct(), key, "left_anti")


def in_order(owners: DataFrame, items: DataFrame, owner: str, ids: str, item: str) -> DataFrame:
    """Rows of ``items`` in the order of each owner's id list; unknown ids
    drop out and the rest close up."""
    listed = owners.select(owner, F.posexplode(ids).alias("_p", item)).join(items, item)
    w = Window.partitionBy(owner).orderBy("_p")
    return listed.withColumn("position", F.row_number().over(w)).drop("_p")


def strip_ids(owners: DataFrame, ids: str, gone: Sequence[str]) -> DataFrame:
    """The id lists without the given ids, order kept."""
    return owners.withColumn(ids, F.filter(ids, lambda x: ~x.isin(list(gone))))


def missing_ids(owners: DataFrame, items: DataFrame, owner: str, ids: str, item: str) -> DataFrame:
    """owner, missing: listed ids that do not exist."""
    listed = owners.select(owner, F.explode(ids).alias(item)).join(items.select(item), item, "left_anti")
    return listed.groupBy(owner).agg(F.array_sort(F.collect_set(item)).alias("missing"))


def unique_names(wanted: DataFrame, taken: DataFrame, most: int = 64, tries: int = 49) -> DataFrame:
    """id, wanted, name: each its name or, where that is taken, with the first
    free of _2, _3, ...; null beyond ``tries``.

    ``wanted``: id, wanted; ``taken``: name.  Of several that want one name the
    smallest id has it; names that are wanted as they are go before numbered
    ones.
    """
    nth = F.row_number().over(Window.partitionBy("wanted").orderBy("id"))
    held = taken.select(F.col("name").alias("wanted")).distinct().withColumn("_held", F.lit(True))
    rows = wanted.select("id", "wanted", nth.alias("_n")).join(held, "wanted", "left")
    plain = rows.where("_held is null and _n = 1").select("id", "wanted", F.col("wanted").alias("name"))
    rest = rows.where("_held or _n > 1").withColumn("_k", F.col("_n") - F.when(F.col("_held").isNull(), 1).otherwise(0)).drop("_n", "_held")
    names = rest.select("wanted").distinct().select("wanted", F.explode(F.sequence(F.lit(2), F.lit(tries))).alias("_i"))
    end = F.concat(F.lit("_"), F.col("_i").cast("string"))
    names = names.withColumn("name", F.concat(F.substring(F.col("wanted"), F.lit(1), most - F.length(end)), end))
    used = taken.select("name").unionByName(wanted.select(F.col("wanted").alias("name"))).distinct()
    names = names.join(used, "name", "left_anti")
    # one name may be made for two that are wanted: the lesser of them has it
    names = first_by(names, ["name"], F.col("wanted"), F.col("_i"))
    free = names.withColumn("_k", F.row_number().over(Window.partitionBy("wanted").orderBy("_i"))).select("wanted", "_k", "name")
    return plain.unionByName(rest.join(free, ["wanted", "_k"], "left").select("id", "wanted", "name"))


def put_cases(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Cases (case_id, tool_id, query, expect) after taking in others, by id:
    texts are trimmed, and rows without a query or an expectation left out."""
    said = {c: strip(F.coalesce(c, F.lit(""))) for c in ("query", "expect")}
    fresh = incoming.withColumns(said).where("query <> '' and expect <> ''").select("case_id", "tool_id", "query", "expect")
    return known.join(fresh.select("case_id"), "case_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def cleared(log: DataFrame) -> tuple[DataFrame, int]:
    """An empty log, and how many rows went."""
    return log.limit(0), log.count()


def page_changes(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """locator, action of a sync, a full outer join on the stored locator.

    ``known``: locator, hash, status; ``fetched``: locator, hash, code.  A page
    that is gone (404, 410) is deleted; another failure marks an error and
    keeps the passages; a page not fetched stays; a new, changed or unsynced
    page is written, an unchanged one only seen.
    """
    k = known.select("locator", F.col("hash").alias("_old"), F.col("status").alias("_status"), F.lit(True).alias("_k"))
    action = (
        F.when(F.col("code").isNull(), "keep")
        .when(F.col("code").isin(404, 410), F.when(F.col("_k"), "delete").otherwise("skip"))
        .when(F.col("code") >= 400, F.when(F.col("_k"), "error").otherwise("skip"))
        .when(F.col("_k").isNull(), "insert")
        .when((F.col("_old") != F.col("hash")) | (F.col("_status") != "synced"), "update")
        .otherwise("seen")
    )
    return k.join(fetched, "locator", "full_outer").select("locator", action.alias("action"))


def apply_changes(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """The known pages (locator, hash, status) after a sync."""
    acts = page_changes(known, fetched)
    rows = acts.join(known, "locator", "left").join(fetched.select("locator", F.col("hash").alias("_new")), "locator", "left")
    written = F.col("action").isin("insert", "update")
    status = F.when(F.col("action") == "error", "error").when(F.col("action") == "keep", F.col("status")).otherwise("synced")
    return rows.where(~F.col("action").isin("delete", "skip")).select(
        "locator", F.when(written, F.col("_new")).otherwise(F.col("hash")).alias("hash"), status.alias("status")
    )


def retained(log: DataFrame, since, most: int = 2000, time_col: str = "created_at", id_col: str = "id", drop=None) -> DataFrame:
    """The newest ``most`` rows not older than ``since``, without what
    ``drop`` names: a top-k, not a sort of the log."""
    rows = log.where(F.col(time_col) >= since)
    if drop is not None:
        rows = rows.where(~drop)
    return rows.orderBy(F.desc(time_col), F.desc(id_col)).limit(most)


def page_of(log: DataFrame, order: Sequence, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of a list; the limit is held between 1 and 200."""
    return log.orderBy(*order).offset(max(offset, 0)).limit(max(1, min(limit, 200)))


def where_given(log: DataFrame, **filters) -> DataFrame:
    """Conjunction of the filters that are not None: ``col=value``, or
    ``col__from`` and ``col__to`` for a half-open range."""
    for name, value in filters.items():
        if value is None or value == "":
            continue
        col, _, bound = name.partition("__")
        log = log.where(
            F.col(col) >= value if bound == "from" else F.col(col) < value if bound == "to" else F.col(col) == value
        )
    return log


def slot_fallback(wanted: DataFrame, models: DataFrame, kind: str) -> DataFrame:
    """kb_id, model_id: the knowledge base's own model, else the workspace's,
    else the first active one of the kind."""
    active = models.where((F.col("kind") == kind) & F.col("active"))
    first = active.agg(F.min("model_id")).first()[0]
    rows = wanted.join(active.select(F.col("model_id").alias("own_id"), F.lit(True).alias("_ok")), "own_id", "left")
    return rows.select(
        "kb_id",
        F.when(F.coalesce("own_id", F.lit("")) != "", F.when(F.col("_ok"), F.col("own_id")))
        .otherwise(F.coalesce(F.nullif("workspace_id", F.lit("")), F.lit(first)))
        .alias("model_id"),
    )
