"""Upserts, cascades, trees and list work over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import tables as O
from gleaner.plans.common import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """with k as (select 'kb' as kb_id, 'chat' as type, conv_id::varchar as locator, min(text) as title, 'old' as text from conversations where role = 'user' group by conv_id),
i as (select 'kb' as kb_id, 'chat' as type, case when role = 'user' then conv_id::varchar else 'new' || conv_id end as locator,
 case when turn = 0 then '' else text end as title, text, turn as seq from conversations),
f as (select * from (select *, row_number() over (partition by kb_id, type, locator order by seq) as n from i where trim(text) <> '') where n = 1)
select coalesce(k.kb_id, f.kb_id) as kb_id, coalesce(k.type, f.type) as type, coalesce(k.locator, f.locator) as locator,
 case when f.text is not null then coalesce(nullif(trim(f.title), ''), k.title, '') else k.title end as title,
 coalesce(f.text, k.text) as text, case when f.text is not null then 'syncing' else 'synced' end as status
from k full outer join f on k.locator = f.locator"""
)
def source_upsert(spark: SparkSession, d: str) -> DataFrame:
    chat = table(spark, d, "conversations")
    kb = [F.lit("kb").alias("kb_id"), F.lit("chat").alias("type")]
    known = chat.where("role = 'user'").groupBy("conv_id").agg(F.min("text").alias("title"))
    known = known.select(*kb, F.col("conv_id").cast("string").alias("locator"), "title", F.lit("old").alias("text"))
    locator = F.when(F.col("role") == "user", F.col("conv_id").cast("string")).otherwise(F.concat(F.lit("new"), "conv_id"))
    title = F.when(F.col("turn") == 0, "").otherwise(F.col("text"))
    incoming = chat.select(*kb, locator.alias("locator"), title.alias("title"), "text", F.col("turn").alias("seq"))
    return O.upsert_sources(known, incoming)


def _tree(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return r.unionByName(n).unionByName(c)


_SQL_TREE = """tree as (select 'r' || r_regionkey as id, null as parent_id from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation
 union all select 'c' || c_custkey, 'n' || c_nationkey from customer)"""


@query(
    f"""with recursive {_SQL_TREE}, reach(ancestor, node) as (select id, id from tree union select r.ancestor, t.id from reach r join tree t on t.parent_id = r.node)
select * from reach"""
)
def kb_tree_closure(spark: SparkSession, d: str) -> DataFrame:
    return O.tree_closure(_tree(spark, d))


@query(
    """select o_orderkey from orders where o_custkey not in (select c_custkey from customer join nation on n_nationkey = c_nationkey where n_regionkey = 2)"""
)
def source_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Orders left when a region goes with all below it."""
    below = O.tree_closure(_tree(spark, d)).where("ancestor = 'r2' and node like 'c%'")
    doomed = below.select(F.expr("cast(substring(node, 2) as bigint)").alias("o_custkey"))
    return O.delete_cascade(table(spark, d, "orders").select("o_orderkey", "o_custkey"), doomed, "o_custkey").select("o_orderkey")


def _owners(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array((F.col("c_custkey") % 30).cast("int"), F.col("c_nationkey"), F.lit(999))
    return table(spark, d, "customer").select("c_custkey", F.array_distinct(ids).alias("ids"))


_SQL_OWNERS = "o as (select c_custkey, [(c_custkey % 30)::int, c_nationkey::int, 999] as ids from customer), e as (select c_custkey, ids[i] as n_nationkey, i from (select c_custkey, ids, unnest([1, 2, 3]) as i from o) where not (i = 2 and ids[1] = ids[2]))"


@query(
    f"""with {_SQL_OWNERS} select c_custkey, n_name, row_number() over (partition by c_custkey order by i) as position
from e join nation n on n.n_nationkey = e.n_nationkey"""
)
def whitelist_order(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    return O.in_order(_owners(spark, d), items, "c_custkey", "ids", "n_nationkey").select("c_custkey", "n_name", "position")


@query(
    f"""with {_SQL_OWNERS} select c_custkey, list_sort(list(distinct n_nationkey)) as missing from e
where n_nationkey not in (select n_nationkey from nation) group by 1"""
)
def set_completeness(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"))
    return O.missing_ids(_owners(spark, d), items, "c_custkey", "ids", "n_nationkey")


@query(
    f"""with {_SQL_OWNERS} select c_custkey, list_filter(case when ids[1] = ids[2] then [ids[1], 999] else ids end, lambda x: x not in (3, 999)) as ids from o"""
)
def strip_deleted_ids(spark: SparkSession, d: str) -> DataFrame:
    return O.strip_ids(_owners(spark, d), "ids", [3, 999])


@query(
    f"""with {_SQL_OWNERS}, r as (select c_custkey, i, n_name, row_number() over (partition by n_name order by c_custkey, i) as k from e join nation n on n.n_nationkey = e.n_nationkey)
select n_name, c_custkey, i::bigint as position from r where k = 1"""
)
def tool_name_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each name once, from the first endpoint that lists it."""
    ids = F.array((F.col("c_custkey") % 30).cast("int"), F.col("c_nationkey"))
    rows = table(spark, d, "customer").select("c_custkey", F.posexplode(ids).alias("p", "n_nationkey"))
    rows = rows.join(table(spark, d, "nation").select(F.col("n_nationkey").cast("int"), "n_name"), "n_nationkey")
    return O.first_by(rows, ["n_name"], F.col("c_custkey"), F.col("p")).select(
        "n_name", "c_custkey", (F.col("p") + 1).cast("long").alias("position")
    )


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def orphan_uploads(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return O.delete_cascade(table(spark, d, "part").select("p_partkey"), used, "p_partkey")


@query(
    """select c_custkey, count(o_orderkey) as n_orders from customer left join orders on o_custkey = c_custkey group by 1"""
)
def doc_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("select distinct source from documents where source not in ('src1', 'src2', 'src3')")
def uncovered_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that no tool's list names."""
    docs = table(spark, d, "documents").select("source").distinct()
    lists = spark.createDataFrame([(["src1", "src2"],), (["src3"],)], "ids array<string>")
    return docs.join(lists.select(F.explode("ids").alias("source")), "source", "left_anti")


@query(
    """with m as (select s_suppkey as model_id, s_acctbal > 0 as active from supplier)
select c_custkey as kb_id, case when c_acctbal > 5000 then m.model_id when c_acctbal > 0 then c_nationkey::bigint
 else (select min(model_id) from m where active) end as model_id
from customer left join m on m.model_id = c_custkey % 120 and active and c_acctbal > 5000"""
)
def slot_fallback(spark: SparkSession, d: str) -> DataFrame:
    padded = lambda c: F.lpad(c.cast("string"), 9, "0")  # noqa: E731  so that text order is number order
    own = F.when(F.col("c_acctbal") > 5000, padded(F.col("c_custkey") % 120)).otherwise("")
    shop = F.when(F.col("c_acctbal") > 0, padded(F.col("c_nationkey"))).otherwise("")
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("kb_id"), own.alias("own_id"), shop.alias("workspace_id"))
    models = table(spark, d, "supplier").select(
        padded(F.col("s_suppkey")).alias("model_id"), F.lit("chat").alias("kind"), (F.col("s_acctbal") > 0).alias("active")
    )
    return O.slot_fallback(wanted, models, "chat").select("kb_id", F.col("model_id").cast("long").alias("model_id"))


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, d, "pages").withColumn("locator", F.concat(F.lit("#"), "page_id"))
    status = F.when(F.col("page_id") % 7 == 0, "error").otherwise("synced")
    known = pages.where(F.col("url").startswith("https")).select("locator", F.sha2(F.col("url").cast("binary"), 256).alias("hash"), status.alias("status"))
    text = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.col("url"))
    code = F.when(F.col("page_id") % 11 == 0, 404).when(F.col("page_id") % 13 == 0, 503).otherwise(200)
    fetched = pages.where("url not like '%#top'").select("locator", F.sha2(text.cast("binary"), 256).alias("hash"), code.alias("code"))
    return known, fetched


_SQL_PAGES = """k as (select '#' || page_id as locator, sha256(url) as hash, case when page_id % 7 = 0 then 'error' else 'synced' end as status from pages where starts_with(url, 'https')),
f as (select '#' || page_id as locator, sha256(case when page_id % 3 = 0 then html else url end) as hash,
 case when page_id % 11 = 0 then 404 when page_id % 13 = 0 then 503 else 200 end as code from pages where url not like '%#top'),
a as (select coalesce(k.locator, f.locator) as locator, case when code is null then 'keep' when code = 404 then case when k.locator is null then 'skip' else 'delete' end
 when code >= 400 then case when k.locator is null then 'skip' else 'error' end when k.locator is null then 'insert'
 when k.hash <> f.hash or k.status <> 'synced' then 'update' else 'seen' end as action, k.hash as old, f.hash as new, k.status
 from k full outer join f on k.locator = f.locator)"""


@query(f"with {_SQL_PAGES} select locator, action from a")
def page_change_detect(spark: SparkSession, d: str) -> DataFrame:
    return O.page_changes(*_pages(spark, d))


@query(
    f"""with {_SQL_PAGES} select locator, case when action in ('insert', 'update') then new else old end as hash,
 case when action = 'error' then 'error' when action = 'keep' then status else 'synced' end as status from a where action not in ('delete', 'skip')"""
)
def page_sync_apply(spark: SparkSession, d: str) -> DataFrame:
    return O.apply_changes(*_pages(spark, d))


# conversations


@query(
    """select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 24"""
)
def history_tail(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, d, "conversations").withColumn("n", F.row_number().over(w))
    return rows.where("n <= 24").select("conv_id", "turn", "role")


@query("select conv_id, turn, [turn::int, 3] as marks from conversations where turn <> 3 union all select conv_id, turn, [3] from conversations where turn = 3")
def citations(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.format_string(" [%d] and [3], again [%d]", "turn", "turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.citations(text).alias("marks"))


@query(
    r"""select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as answer, 'as ' || role as thinking from conversations"""
)
def thinking_split(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("<think> as "), "role", F.lit(" </think>"), "text")
    thinking, answer = T.split_thinking(text)
    return table(spark, d, "conversations").select("conv_id", "turn", answer.alias("answer"), thinking.alias("thinking"))


@query(
    """select conv_id, turn, i as part, substr(text, (i - 1) * 24 + 1, 24) as text from
 (select conv_id, turn, text, unnest(generate_series(1, (length(text) + 23) // 24)) as i from conversations where role = 'assistant')"""
)
def answer_slices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'assistant' and length(text) > 0")
    n = F.expr("cast((length(text) + 23) div 24 as bigint)")
    rows = rows.select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("part"))
    piece = F.substring(F.col("text"), ((F.col("part") - 1) * 24 + 1).cast("int"), F.lit(24))
    return rows.select("conv_id", "turn", "part", piece.alias("text"))


@query(
    """select source, coalesce(string_agg(t, '、' order by t, doc_id), '无') as titles from (select source, doc_id, substr(string_split(text, chr(10))[1], 1, 80) as t,
 row_number() over (partition by source order by substr(string_split(text, chr(10))[1], 1, 80), doc_id) as n from documents) where n <= 12 group by source"""
)
def sibling_summary(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve titles of each source, in one text."""
    title = F.substring(F.split("text", "\n")[0], 1, 80)
    rows = table(spark, d, "documents").select("source", "doc_id", title.alias("t"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("t", "doc_id"))).where("n <= 12")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"])
    return rows.groupBy("source").agg(F.array_join(listed, "、").alias("titles"))


@query(
    r"""select page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')[1:64] as name from pages"""
)
def tool_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.tool_name(F.col("url")).alias("name"))


@query("select page_id, url as locator from pages")
def locator_extract(spark: SparkSession, d: str) -> DataFrame:
    reply = F.concat(F.lit("[1] title\nbody\nlocator: "), "url", F.lit("  \nlocator: second"))
    return table(spark, d, "pages").select("page_id", T.locator_in(reply).alias("locator"))


@query(
    """with recursive n as (select doc_id as id, case when doc_id > 0 then (doc_id - 1) // 3 end as parent_id, source from documents),
gone(id) as (select id from n where id % 41 = 7 union select n.id from n join gone on n.parent_id = gone.id)
select n.id, n.source, count(l.doc_id) as n_labels from n left join labels l on l.doc_id = n.id
where n.id not in (select id from gone) group by 1, 2"""
)
def tree_delete(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a tree; some nodes go with all below them and their labels."""
    parent = F.when(F.col("doc_id") > 0, F.expr("(doc_id - 1) div 3"))
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), parent.alias("parent_id"), "source")
    labels = table(spark, d, "labels").select("doc_id")
    left = O.delete_below(nodes, nodes.where("id % 41 = 7"), {"labels": (labels, "doc_id")})
    n = left["labels"].groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n_labels"))
    return left["nodes"].join(n, "id", "left").select("id", "source", F.coalesce("n_labels", F.lit(0)).alias("n_labels"))


@query(
    """with w as (select page_id as id, 'search_' || (page_id % 9) as wanted from pages),
t as (select 'search_' || k as name from (select unnest(range(0, 9, 2)) as k) union all select 'search_1_' || k from (select unnest(range(2, 50, 3)) as k)),
n as (select *, row_number() over (partition by wanted order by id) as n, wanted in (select name from t) as held from w),
k as (select id, wanted, held, n, case when held then n else n - 1 end as k from n),
c as (select s.wanted, s.wanted || '_' || i as name, row_number() over (partition by s.wanted order by i) as k
 from (select distinct wanted from w) s, (select unnest(range(2, 50)) as i) where s.wanted || '_' || i not in (select name from t))
select k.id, k.wanted, case when not held and n = 1 then k.wanted else c.name end as name from k left join c on c.wanted = k.wanted and c.k = k.k"""
)
def unique_tool_names(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("search_"), F.col("page_id") % 9).alias("wanted"))
    held = table(spark, d, "pages").select(F.col("page_id").alias("k"))
    taken = held.where("k < 9 and k % 2 = 0").select(F.concat(F.lit("search_"), "k").alias("name"))
    taken = taken.unionByName(held.where("k between 2 and 49 and (k - 2) % 3 = 0").select(F.concat(F.lit("search_1_"), "k").alias("name")))
    return O.unique_names(wanted, taken)


@query(
    """select item_id as case_id, item_id % 5 as tool_id, trim(text) as query, 'known' as expect from benchmark where item_id % 3 <> 0 or trim(text) = '' or item_id % 2 = 1
union all select item_id, item_id % 5, trim(text), 'new ' || item_id from benchmark where item_id % 3 = 0 and item_id % 2 = 0 and trim(text) <> ''"""
)
def eval_case_put(spark: SparkSession, d: str) -> DataFrame:
    """Cases after some were sent again, half of those without expectation."""
    bench = table(spark, d, "benchmark")
    known = bench.select(F.col("item_id").alias("case_id"), (F.col("item_id") % 5).alias("tool_id"), F.trim("text").alias("query"), F.lit("known").alias("expect"))
    expect = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" new "), "item_id", F.lit(" "))).otherwise("  ")
    sent = bench.where("item_id % 3 = 0").select(F.col("item_id").alias("case_id"), (F.col("item_id") % 5).alias("tool_id"), F.concat(F.lit(" "), "text").alias("query"), expect.alias("expect"))
    return O.put_cases(known, sent)
