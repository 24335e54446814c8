"""Evaluation queries.  Benchmark items are the cases, with the item's text as
query and as expectation; events stand for runs of the tool ``user_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import evaluate as E
from gleaner.operators import retrieve as R
from gleaner.operators.cuts import stored
from gleaner.plans.common import sql_tokens, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SQL_HITS = f"""q as (select item_id as case_id, text as expect, list_distinct({sql_tokens("text")}) as ws from benchmark),
w as (select case_id, unnest(ws) as term from q),
h as (select doc_id, {sql_tokens("text")} as t from documents),
s as (select count(*)::double as n, avg(len(t)::double) as avgdl from h),
p as (select doc_id, len(t)::double as dl, unnest(t) as term from h),
f as (select term, doc_id, dl, count(*)::double as tf from p where term in (select term from w) group by 1, 2, 3),
df as (select term, count(*)::double as df from f group by 1),
sc as (select case_id, doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double)
 / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl))), 4) as score
 from f join df on f.term = df.term join w on w.term = f.term, s group by 1, 2),
hits as (select * from (select *, row_number() over (partition by case_id order by score desc, doc_id) as rank from sc) where rank <= 20)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("expect"))


@query(
    f"""with {_SQL_HITS}, m as (select q.case_id, rank, contains(d.text, trim(expect)) or contains(d.source, trim(expect)) as hit
 from q left join hits on hits.case_id = q.case_id left join documents d on d.doc_id = hits.doc_id)
select case_id, bool_or(coalesce(hit, false)) as ok, min(case when hit then rank end) as best_rank, count(rank) as n_hits from m group by 1"""
)
def eval_run(spark: SparkSession, d: str) -> DataFrame:
    cases, docs = _cases(spark, d), table(spark, d, "documents")
    asked = cases.select(F.col("case_id").alias("query_id"), F.col("expect").alias("query"))
    found = stored(R.search_many(docs, asked, "doc_id", F.col("text")))
    # the hits' size is known, so their texts alone are moved where they are few
    hits = docs.join(found, F.col("chunk_id") == F.col("doc_id")).select(
        F.col("query_id").alias("case_id"), "rank", F.col("source").alias("title"), F.col("chunk_id").cast("string").alias("locator"), "text"
    )
    return E.run_cases(cases, hits)


@query(
    f"""with {_SQL_HITS.replace("hits as (select * from (select *, row_number() over (partition by case_id order by score desc, doc_id) as rank from sc) where rank <= 20)", "")}
t as (select item_id as case_id, item_id % 4 as tool_id from benchmark),
ok as (select sc.*, t.tool_id, d.source, d.text from sc join t on t.case_id = sc.case_id join documents d on d.doc_id = sc.doc_id
  where t.tool_id = 0 or (t.tool_id = 1 and d.doc_id % 2 = 0) or (t.tool_id = 2 and d.source in ('src1', 'src3'))),
r as (select *, row_number() over (partition by case_id order by score desc, doc_id) as rank from ok),
m as (select r.case_id, bool_or(contains(r.text, trim(q.expect)) or contains(r.source, trim(q.expect))) as ok, count(*) as n
  from r join q on q.case_id = r.case_id where rank <= case tool_id when 0 then 20 when 1 then 5 else 60 end group by 1)
select t.tool_id, t.case_id, coalesce(m.ok, false) as ok, coalesce(m.n, 0) as n_hits,
 case when t.tool_id = 3 then 'no source chosen' when m.ok then 'found' else 'missed' end as detail,
 count(*) over (partition by t.tool_id) as total, count_if(coalesce(m.ok, false)) over (partition by t.tool_id) as passed
from t left join m on m.case_id = t.case_id"""
)
def eval_tools(spark: SparkSession, d: str) -> DataFrame:
    """Four tools in one plan: all sources, every other document's, two
    sources, none."""
    docs = table(spark, d, "documents").withColumn("bit", (F.col("doc_id") % 2).cast("string"))
    source = F.concat_ws("/", "source", "bit")
    passages = docs.select(source.alias("source_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), "text", F.lit("").alias("locator"))
    every = passages.select("source_id").distinct()
    of = F.when(F.col("t") == 0, True).when(F.col("t") == 1, F.col("source_id").endswith("/0")).when(F.col("t") == 2, F.col("source_id").rlike("^src[13]/")).otherwise(False)
    tools = every.select("source_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("t")).groupBy("t").agg(F.array_sort(F.collect_list(F.when(of, F.col("source_id")))).alias("source_ids"))
    top = F.when(F.col("t") == 0, 20).when(F.col("t") == 1, 5).otherwise(60)
    tools = tools.select(F.col("t").alias("tool_id"), "source_ids", F.lit("fulltext").alias("mode"), F.lit(0.2).alias("similarity"), top.alias("top"), F.lit(False).alias("rerank"))
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), (F.col("item_id") % 4).alias("tool_id"), F.col("text").alias("query"), F.col("text").alias("expect"))
    runs = E.run_tools(tools, cases, passages)
    rows = runs.select("tool_id", "total", "passed", F.explode("items").alias("i"))
    detail = F.when(F.col("i.detail").startswith("found "), "found").when(F.col("i.detail").startswith("missed; "), "missed").otherwise(F.col("i.detail"))
    return rows.select("tool_id", "i.case_id", "i.ok", F.greatest(F.coalesce(F.size("i.hits"), F.lit(0)), F.lit(0)).cast("long").alias("n_hits"), detail.alias("detail"), "total", "passed")


@query(
    r"""select doc_id, trim(line) <> '' and (contains(source, trim(line)) or contains(doc_id::varchar, trim(line))
 or (length(regexp_replace(line, '\s', '', 'g')) >= 8 and contains(text, trim(line)))) as hit
from (select doc_id, source, text, string_split(text, chr(10))[-1] as line from documents)"""
)
def expect_hit(spark: SparkSession, d: str) -> DataFrame:
    """Does a document fulfil the expectation of its own last line."""
    docs = table(spark, d, "documents")
    line = F.element_at(F.split("text", "\n"), -1)
    return docs.select(
        "doc_id", E.expect_hit(line, F.col("source"), F.col("doc_id").cast("string"), F.col("text")).alias("hit")
    )


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("tool_id"),
        F.col("event_id").alias("run_id"),
        F.col("ts").alias("created_at"),
        F.floor("value").cast("long").alias("passed"),
        (F.col("event_type") == "error").cast("long").alias("failed"),
        F.col("event_type").alias("config"),
    )


_SQL_RUNS = """runs as (select user_id as tool_id, event_id as run_id, ts as created_at, floor(value)::bigint as passed,
 (event_type = 'error')::bigint as failed, event_type as config from events),
cases as (select distinct o_custkey % 200 as tool_id, o_orderkey as case_id from orders),
latest as (select * from (select *, row_number() over (partition by tool_id order by created_at desc, run_id desc) as n from runs) where n = 1),
summary as (select c.tool_id, n_cases, run_id, passed, failed, case when run_id is not null then failed = 0 and passed > 0 end as ok
 from (select tool_id, count(*) as n_cases from cases group by 1) c left join latest l on l.tool_id = c.tool_id)"""


def _tool_cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("tool_id"), F.col("o_orderkey").alias("case_id")).distinct()


@query(f"with {_SQL_RUNS} select tool_id, run_id, passed, failed, config from latest")
def eval_latest_run(spark: SparkSession, d: str) -> DataFrame:
    return E.latest_runs(_runs(spark, d)).select("tool_id", "run_id", "passed", "failed", "config")


@query(f"with {_SQL_RUNS} select * from summary")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summaries(_tool_cases(spark, d), _runs(spark, d))


@query(
    f"""with {_SQL_RUNS}, tools as (select distinct c_custkey as tool_id from customer),
r as (select t.tool_id, case when n_cases is null then 'no cases' when run_id is null then 'never run'
 when failed > 0 then failed || ' failed' end as reason from tools t left join summary s on s.tool_id = t.tool_id)
select * from r where reason is not null"""
)
def release_gate(spark: SparkSession, d: str) -> DataFrame:
    tools = table(spark, d, "customer").select(F.col("c_custkey").alias("tool_id")).distinct()
    return E.release_gate(tools, E.summaries(_tool_cases(spark, d), _runs(spark, d)))


@query(
    f"""with {_SQL_RUNS} select tool_id, run_id, coalesce(lag(config) over (partition by tool_id order by created_at, run_id) <> config, false) as drifted from runs"""
)
def eval_run_drift(spark: SparkSession, d: str) -> DataFrame:
    return E.run_drift(_runs(spark, d))


@query(
    """with e as (select distinct user_id as tool_id, event_type as query, 'k' || json_extract_string(props, '$.k') as expect from events where event_type <> 'error')
select e.* from e where not exists (select 1 from (select distinct user_id as tool_id, event_type as query, 'k' || json_extract_string(props, '$.k') as expect
 from events where value > 50) x where x.tool_id = e.tool_id and x.query = e.query and x.expect = e.expect)"""
)
def case_from_log(spark: SparkSession, d: str) -> DataFrame:
    """Logged calls as new cases, without those there are already."""
    rows = table(spark, d, "events")
    fields = [
        F.col("user_id").alias("tool_id"),
        F.col("event_type").alias("query"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("expect"),
    ]
    known = rows.where("value > 50").select(*fields).distinct()
    return rows.where("event_type <> 'error'").select(*fields).distinct().join(known, ["tool_id", "query", "expect"], "left_anti")


@query(
    """select label, count(*) as n_docs, avg(quality)::double as good, sum(toxic)::bigint as n_toxic from
 (select d.source as label, l.quality, l.toxic from documents d join labels l on l.doc_id = d.doc_id) group by label"""
)
def graded_sources(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return (
        docs.select("doc_id", F.col("source").alias("label"))
        .join(labels, "doc_id")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.avg("quality").alias("good"), F.sum("toxic").alias("n_toxic"))
    )
