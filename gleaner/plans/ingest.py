"""Ingestion, stored indexes, replies of models, and small list work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import replies as P
from gleaner.operators import index as I
from gleaner.operators import process as X
from gleaner.operators import retrieve as R
from gleaner.operators import tables as O
from gleaner.operators.chunk import Config
from gleaner.operators.cuts import shared_folder
from gleaner.plans.common import TERMS, sql_bm25, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {sql_bm25('bm', 'text')} select chunk_id, round(raw, 6) as score from bm where round(raw, 6) > 0 order by 2 desc, 1 limit 50")
def stored_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking as without an index, from postings on disk."""
    path = shared_folder(spark)
    I.write_index(table(spark, d, "documents"), path, "doc_id", F.col("text"))
    return I.search_index(spark, path, TERMS).withColumn("chunk_id", F.col("chunk_id").cast("long"))


_FIELDS = (("title", "string_split(text, chr(10))[1]"), ("text", "text"), ("answer", "lang"), ("indexes", "source"))
_SQL_AFTER = """after as (select doc_id, lang, source, case when source = 'src3' then text || ' therble therble' else text end as text
 from documents where coalesce(source, '') <> 'src5' and not (source = 'src3' and doc_id % 4 <> 3))"""


@query(
    f"""with {_SQL_AFTER}, {", ".join(sql_bm25(f"f{i}", x, "after") for i, (_, x) in enumerate(_FIELDS))},
s as (select f1.chunk_id, round(greatest({", ".join(f"f{i}.raw * {R.BOOSTS[n]}::double" for i, (n, _) in enumerate(_FIELDS))}), 6) as score
 from f0 join f1 on f1.chunk_id = f0.chunk_id join f2 on f2.chunk_id = f0.chunk_id join f3 on f3.chunk_id = f0.chunk_id)
select chunk_id, score from s where score > 0 order by score desc, chunk_id::varchar limit 50"""
)
def index_replace_delete(spark: SparkSession, d: str) -> DataFrame:
    """Four weighted fields, indexed in two batches; then one source is
    replaced, one deleted, and the older segments are merged."""
    docs = table(spark, d, "documents")
    rows = docs.select(
        F.lit("kb").alias("kb_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("chunk_id"),
        F.split("text", "\n")[0].alias("title"), "text", F.col("lang").alias("answer"), F.col("source").alias("indexes"),
    )
    index = I.Segments(spark, shared_folder(spark), R.BOOSTS)
    index.put(rows.where("chunk_id % 3 = 0"))
    index.put(rows.where("chunk_id % 3 <> 0"))
    changed = rows.where("source_id = 'src3' and chunk_id % 4 = 3")
    index.replace(changed.withColumn("text", F.concat("text", F.lit(" therble therble"))).withColumn("title", F.split("text", "\n")[0]))
    index.compact(keep=1)
    index.delete("kb", "src5")
    return index.search(TERMS).select(F.col("chunk_id").cast("long").alias("chunk_id"), "score")


@query(
    r"""with t as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as term from documents)
select term, count(distinct doc_id) as df, count(*) as n from t group by term"""
)
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    rows = I.postings(table(spark, d, "documents"), "doc_id", F.col("text"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


_UNITS = Config(mode="custom", split="size", size=800, child=True, child_size=200, trigger="force")


@query()
def process_units(spark: SparkSession, d: str) -> DataFrame:
    return X.units(table(spark, d, "documents"), _UNITS)


@query()
def process_preview(spark: SparkSession, d: str) -> DataFrame:
    return X.preview(X.units(table(spark, d, "documents"), _UNITS), 800)


@query()
def embed_vectors(spark: SparkSession, d: str) -> DataFrame:
    return X.embedded(X.items(X.units(table(spark, d, "documents"), _UNITS))).drop("text")


@query(
    """select vec_id as point_id, label, case when label in (1, 2) then 'fresh' else 'known' end as origin from embeddings
where label <> 5 union all select vec_id + 1000000, label, 'fresh' from embeddings where label in (1, 2)"""
)
def vector_upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    """Points of two labels are replaced, new ones added, one label deleted."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.col("embedding").alias("vec"))
    known, some = rows.withColumn("origin", F.lit("known")), rows.where("label in (1, 2)").withColumn("origin", F.lit("fresh"))
    fresh = some.unionByName(some.withColumn("point_id", F.col("point_id") + 1000000))
    return I.delete_points(I.upsert_vectors(known, fresh), label=5).select("point_id", "label", "origin")


@query(
    """select event_id, case when event_id % 3 = 0 then 'auto' else 'custom' end as mode, case when event_id % 3 = 0 then 'paragraph' else 'size' end as split,
 case when event_id % 3 = 0 then 1000 when event_id % 3 = 1 then 64 else 0 end as size, case when event_id % 3 = 1 then 32 else 0 end as overlap,
 event_id % 3 <> 0 as child from events"""
)
def config_coerce(spark: SparkSession, d: str) -> DataFrame:
    given = (
        F.when(F.col("event_id") % 3 == 0, '{"split": "size"}')
        .when(F.col("event_id") % 3 == 1, '{"mode": "custom", "split": "size", "size": 20, "overlap": 90}')
        .otherwise('{"mode": "custom", "split": "size", "size": -1, "overlap": 5}')
    )
    c = table(spark, d, "events").select("event_id", X.coerced(given).alias("c"))
    return c.select("event_id", "c.mode", "c.split", "c.size", "c.overlap", "c.child")


@query(
    """select vec_id, [case when vec_id % 2 = 0 then 0 else 0.5 end::double, 0::double, 0.25::double] as scores from embeddings"""
)
def rerank_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Scores put at their passages' places; what is not named scores 0."""
    flat = '{"results": [{"index": 2, "relevance_score": 0.25}]}'
    nested = '{"output": {"results": [{"index": 2, "score": 0.25}, {"index": 0, "score": 0.5}]}}'
    body = F.when(F.col("vec_id") % 2 == 0, flat).otherwise(nested)
    return table(spark, d, "embeddings").select("vec_id", P.rerank_scores(body, F.lit(3)).alias("scores"))


@query("select vec_id, [[vec_id::double], [1.5::double, 2::double]] as vectors from embeddings")
def embeddings_parse(spark: SparkSession, d: str) -> DataFrame:
    body = F.format_string('{"data": [{"index": 1, "embedding": [1.5, 2]}, {"index": 0, "embedding": [%d]}]}', "vec_id")
    return table(spark, d, "embeddings").select("vec_id", P.embeddings(body).alias("vectors"))


@query("select n_nationkey, case when n_nationkey % 3 = 0 then ['a', 'b'] when n_nationkey % 3 = 1 then [n_name] else ['m1', 'm2'] end as models from nation")
def model_list(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    body = (
        F.when(k == 0, '{"data": [{"id": "a"}, {"id": "b"}, {"id": "a"}]}')
        .when(k == 1, F.format_string('{"models": [{"model": "%s"}]}', "n_name"))
        .otherwise('["m1", "m2", "m1"]')
    )
    return table(spark, d, "nation").select("n_nationkey", P.model_names(body).alias("models"))


@query(
    """select event_id, case when event_type = 'error' then 'bad_key' else event_type end as code, case when event_type = 'error' then 'no access' else 'flat' end as message from events"""
)
def error_fields(spark: SparkSession, d: str) -> DataFrame:
    nested = '{"error": {"code": "bad_key", "message": "no access"}}'
    body = F.when(F.col("event_type") == "error", nested).otherwise(F.format_string('{"code": "%s", "message": "flat"}', "event_type"))
    code, message = P.error_fields(body)
    return table(spark, d, "events").select("event_id", code.alias("code"), message.alias("message"))


@query(
    """select event_id, case when event_type = 'view' then 'ok' when event_type in ('click', 'error') then 'retry' else 'fatal' end as kind from events"""
)
def retry_class(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 503).otherwise(400)
    body = F.when(F.col("event_type") == "error", "Rate-limit reached").otherwise("bad request")
    return table(spark, d, "events").select("event_id", P.retry_class(status, body).alias("kind"))


@query("select conv_id, turn, 'what' as q, text as a from conversations where trim(text) <> ''")
def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs from fenced replies whose list breaks off."""
    whole = F.to_json(F.struct(F.lit("what").alias("question"), F.trim("text").alias("answer")))
    reply = F.concat(F.lit("<think>hm</think>Here:\n```json\n["), whole, F.lit(', {"question": "cut'))
    rows = table(spark, d, "conversations").where("trim(text) <> ''")
    return rows.select("conv_id", "turn", F.explode(P.qa_pairs(reply)).alias("p")).select("conv_id", "turn", "p.q", "p.a")


@query("select item_id, [text, 'second'] as texts from benchmark")
def string_list(spark: SparkSession, d: str) -> DataFrame:
    reply = F.to_json(F.struct(F.array(F.col("text"), F.lit("second")).alias("items")))
    return table(spark, d, "benchmark").select("item_id", P.string_list(reply).alias("texts"))


@query("select conv_id, string_agg(case when role = 'assistant' then 'output_text' else 'input_text' end || ':' || text, '|' order by turn) as parts from conversations group by conv_id")
def message_shape(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m")
    )
    parts = F.transform(P.as_input(F.col("m")), lambda x: F.concat(x["content"][0]["type"], F.lit(":"), x["content"][0]["text"]))
    return rows.select("conv_id", F.array_join(parts, "|").alias("parts"))


@query(
    """select item_id, case item_id % 3 when 0 then text when 1 then text || chr(10) || chr(10) || 'one' else text || chr(10) || chr(10) || '## 图 1' || chr(10) || 'one' || chr(10) || chr(10) || '## 图 2' || chr(10) || 'two' end as text from benchmark"""
)
def caption_join(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id") % 3
    captions = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("one"))).otherwise(F.array(F.lit("one"), F.lit("two")))
    return table(spark, d, "benchmark").select("item_id", X.captioned(F.col("text"), captions).alias("text"))


@query("select item_id, 'tail ' || item_id as tail from benchmark")
def uncovered_tail(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit("\nmiddle\n"), "text", F.lit(" tail "), "item_id")
    return table(spark, d, "benchmark").select("item_id", X.uncovered_tail(text, F.col("text")).alias("tail"))


@query(
    """select user_id, round(100 * sum((event_type <> 'error')::int) / count(*))::bigint as pass_rate, bool_or(value > 90) as any_high, count(*) filter (where event_type = 'error') as failed from events group by 1"""
)
def pass_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(
        F.round(100 * F.count_if(F.col("event_type") != "error") / F.count(F.lit(1))).cast("long").alias("pass_rate"),
        F.bool_or(F.col("value") > 90).alias("any_high"),
        F.count_if(F.col("event_type") == "error").alias("failed"),
    )


@query(
    """select doc_id, least(1.0::double, round(0.28 * (contains(lower(text), 'that')::int + contains(lower(text), 'of the')::int + contains(lower(text), 'ention')::int)
 + case when contains(lower(text), 'that of the ention') then 0.35 else 0 end, 6)::double) as score from documents"""
)
def simple_score(spark: SparkSession, d: str) -> DataFrame:
    """The prototype's scorer: a share for each part, more for the whole."""
    text = F.lower("text")
    parts = sum(text.contains(p).cast("int") for p in ("that", "of the", "ention"))
    whole = F.when(text.contains("that of the ention"), 0.35).otherwise(0.0)
    score = F.least(F.lit(1.0), F.round(F.lit(0.28) * parts + whole, 6))
    return table(spark, d, "documents").select("doc_id", score.alias("score"))


@query("select user_id from (select user_id from events where event_type = 'purchase' intersect select user_id from events where event_type = 'error') union select 1000000 + c_custkey from customer where c_nationkey = 3 except select user_id from events where value > 300")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    both = e.where("event_type = 'purchase'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))
    more = table(spark, d, "customer").where("c_nationkey = 3").select((F.col("c_custkey") + 1000000).alias("user_id"))
    return both.union(more).distinct().exceptAll(e.where("value > 300").select("user_id").distinct())


@query("select s_suppkey as kb_id, case when s_nationkey = 3 then 7 else s_nationkey end as slot from supplier")
def slot_retarget(spark: SparkSession, d: str) -> DataFrame:
    slot = F.when(F.col("s_nationkey") == 3, 7).otherwise(F.col("s_nationkey"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("kb_id"), slot.alias("slot"))


@query("select region.r_name || ' / ' || n_name || ' / ' || c_name as path, c_custkey from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select(F.concat_ws(" / ", "r_name", "n_name", "c_name").alias("path"), "c_custkey")


@query("select p_partkey, p_name, row_number() over (partition by p_brand order by p_partkey) as position from part")
def running_position(spark: SparkSession, d: str) -> DataFrame:
    return X.numbered(table(spark, d, "part"), "p_brand", "p_partkey").select("p_partkey", "p_name", F.col("position").cast("long").alias("position"))


@query(
    """with k as (select c_custkey as id, c_name as name, 'old' as origin from customer where c_nationkey <> 4), f as (select c_custkey as id, upper(c_name) as name, 'seed' as origin from customer where c_nationkey in (4, 5))
select * from f union all select * from k where id not in (select id from f)"""
)
def seed_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    known = c.where("c_nationkey <> 4").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("old").alias("origin"))
    seed = c.where("c_nationkey in (4, 5)").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.lit("seed").alias("origin"))
    return O.delete_cascade(known, seed, "id").select("id", "name", "origin").unionByName(seed)
