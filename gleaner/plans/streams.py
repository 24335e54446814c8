"""Streaming jobs run to the end of their input, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import drafts as D
from gleaner.operators.cuts import shared_folder
from gleaner.operators.store import Store, SyncFailed, sync_site
from gleaner.plans.common import table
from gleaner.streaming import jobs, sse

QUERIES, SQL = {}, {}
PAGES = {"pages": ("locator string, title string, text string, hash string, status string, error string", "locator")}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return jobs.read_new(spark, f"{d}/{name}.parque[t]", table(spark, d, name))


@query("select event_id, ts as at, event_type, json_extract_string(props, '$.k')::bigint as tokens from events")
def stream_log_ingest(spark: SparkSession, d: str) -> DataFrame:
    out = shared_folder(spark)
    jobs.ingest_log(_stream(spark, d, "events"), f"{out}/log", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/log").select("event_id", F.col("at").cast("timestamp_ntz").alias("at"), "event_type", "tokens")


@query("select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    out = shared_folder(spark)
    jobs.count_by_day(_stream(spark, d, "events"), f"{out}/days", f"{out}/progress").awaitTermination()
    return jobs.daily_counts(spark, f"{out}/days").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("select '#' || page_id as locator, sha256(html) as hash, 'synced' as status from pages where not starts_with(url, 'http:')")
def stream_page_sync(spark: SparkSession, d: str) -> DataFrame:
    """Pages without encryption answer 404."""
    out = shared_folder(spark)
    code = F.when(F.col("url").startswith("http:"), 404).otherwise(200)
    fetched = _stream(spark, d, "pages").select(
        F.concat(F.lit("#"), "page_id").alias("locator"),
        F.sha2(F.col("html").cast("binary"), 256).alias("hash"),
        code.alias("code"),
        F.col("page_id").alias("seq"),
    )
    store = jobs.page_store(spark, f"{out}/pages")
    jobs.sync_pages(fetched, store, f"{out}/progress").awaitTermination()
    return store.current("pages").select("locator", "hash", "status")


@query(
    """with s as (select page_id, page_id % 7 as k, html from pages)
select '#' || page_id as locator, case when k = 3 then sha256(html || '!') else sha256(html) end as hash,
 case when k = 2 then 'error' else 'synced' end as status, case when k = 2 then 'fetch failed: HTTP 503' end as error,
 case when k = 3 then length(html) + 1 else length(html) end as n from s where k <> 1"""
)
def site_sync_batches(spark: SparkSession, d: str) -> DataFrame:
    """Three batches: all pages; then one in seven gone, one failing, one
    changed; then those that failed, failing again."""
    pages = table(spark, d, "pages")
    store = Store(spark, shared_folder(spark), {**PAGES, "passages": ("page string, text string", "page")})

    def fetched(rows: DataFrame, text, code) -> DataFrame:
        text = F.when(code < 400, text)
        return rows.select(F.concat(F.lit("#"), "page_id").alias("locator"), F.lit("").alias("title"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("hash"), code.alias("code"))

    k, html = F.col("page_id") % 7, F.col("html")
    sync_site(store, fetched(pages, html, F.lit(200)))
    code = F.when(k == 1, 404).when(k == 2, 503).otherwise(200)
    sync_site(store, fetched(pages.where(k.isin(1, 2, 3)), F.concat(html, F.lit("!")), code))
    try:
        sync_site(store, fetched(pages.where(k == 2), html, F.lit(503)))
    except SyncFailed:
        pass
    n = store.current("passages").select(F.col("page").alias("locator"), F.length("text").cast("long").alias("n"))
    return store.current("pages").select("locator", "hash", "status", "error").join(n, "locator")


_UNITS = "array(struct('head' as title, substring(text, 1, 200) as text, lang as answer, '' as indexes), struct('tail' as title, substring(text, 201) as text, '' as answer, '' as indexes))"


@query(
    """with d as (select doc_id, unnest([1, 2]) as position, text, lang from documents where doc_id % 5 <> 4 and length(text) > 0),
u as (select doc_id, position, case position when 1 then text[1:200] else text[201:] end as text from d)
select doc_id, position, case when doc_id % 50 = 0 and position = 1 then 'patched ' || doc_id else text end as text,
 '#' || doc_id || ' #' || position as locator from u where text <> ''"""
)
def drafts_commit_patch(spark: SparkSession, d: str) -> DataFrame:
    """Documents as drafts of two units, one in five expired; then the first
    passage of one source in fifty is patched and the overlay folded in."""
    docs = table(spark, d, "documents")
    store = D.knowledge_store(spark, shared_folder(spark))
    rows = docs.select(
        F.col("doc_id").cast("string").alias("draft_id"), F.lit("kb").alias("kb_id"), F.lit("file").alias("type"), F.col("source").alias("title"),
        F.concat(F.lit("#"), "doc_id").alias("locator"), F.col("text").alias("raw_text"), F.lit("ready").alias("status"),
        F.when(F.col("doc_id") % 5 == 4, "2020").otherwise("2030").alias("expires_at"), F.expr(_UNITS).alias("units"),
    )
    D.commit_drafts(store, rows, "2025")
    at = F.regexp_extract("locator", r"^#(\d+) ", 1).cast("long")
    some = D.current_passages(store).where((at % 50 == 0) & (F.col("position") == 1))
    none = F.lit(None).cast("string")
    patch = some.select("chunk_id", none.alias("title"), F.concat(F.lit("patched "), at).alias("text"), none.alias("answer"), none.alias("indexes"))
    D.patch_passages(store, patch)
    D.fold(store)
    return D.current_passages(store).select(at.alias("doc_id"), "position", "text", "locator")


def _events(rows: DataFrame) -> DataFrame:
    """Each turn as one wire event."""
    delta = F.to_json(F.struct(F.lit("response.output_text.delta").alias("type"), F.col("text").alias("delta")))
    chunk = F.to_json(
        F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))
    )
    line = F.concat(F.lit("data: "), F.when(F.col("role") == "user", delta).otherwise(chunk))
    e = rows.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), sse.parse_event(line).alias("e"))
    return e.select("stream_id", "seq", "e.*")


@query(
    "select conv_id as stream_id, string_agg(text, '' order by turn) as answer, '' as thinking, count(*) as n_events from conversations group by conv_id"
)
def sse_merge(spark: SparkSession, d: str) -> DataFrame:
    return sse.merged(_events(table(spark, d, "conversations")))


@query("select conv_id as stream_id, string_agg(text, '' order by turn) as answer, count(*) as n_events from conversations group by conv_id")
def stream_sse_merge(spark: SparkSession, d: str) -> DataFrame:
    """The same merge with state, each reply ended by a done event."""
    out = shared_folder(spark)
    chat = table(spark, d, "conversations")
    ends = chat.groupBy(F.col("conv_id").alias("stream_id")).agg((F.count(F.lit(1))).alias("seq"))
    ends = ends.select("stream_id", "seq", F.lit("done").alias("kind"), F.lit("").alias("text"))
    rows = _events(chat).select("stream_id", "seq", "kind", "text").unionByName(ends)
    rows.write.parquet(f"{out}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{out}/events")
    q = (
        sse.merge_stream(stream)
        .writeStream.format("parquet")
        .option("path", f"{out}/replies")
        .option("checkpointLocation", f"{out}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{out}/replies")


_SQL_TOOLS = "select conv_id as stream_id, (turn % 3)::int as tool, string_agg(case when turn < 3 then role else '' end, '' order by turn) as name, string_agg(text, '' order by turn) as arguments from conversations where text is not null group by 1, 2"


def _tool_events(rows: DataFrame) -> DataFrame:
    """Each turn as a piece of one of three tool calls."""
    function = F.struct(F.when(F.col("turn") < 3, F.col("role")).alias("name"), F.col("text").alias("arguments"))
    call = F.struct((F.col("turn") % 3).alias("index"), function.alias("function"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(call).alias("tool_calls")).alias("delta"))).alias("choices")))
    e = rows.where("text is not null").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), sse.parse_event(F.concat(F.lit("data: "), body)).alias("e"))
    return e.select("stream_id", "seq", "e.*")


@query(_SQL_TOOLS)
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    return sse.merged_tools(_tool_events(table(spark, d, "conversations")))


@query(_SQL_TOOLS)
def stream_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """The same with state, each reply ended by a done event."""
    out = shared_folder(spark)
    rows = _tool_events(table(spark, d, "conversations")).select("stream_id", "seq", "kind", F.col("tool").cast("int").alias("tool"), "name", "text")
    ends = rows.groupBy("stream_id").agg(F.count(F.lit(1)).alias("seq"))
    none = F.lit("")
    ends = ends.select("stream_id", "seq", F.lit("done").alias("kind"), F.lit(None).cast("int").alias("tool"), none.alias("name"), none.alias("text"))
    rows.unionByName(ends).write.parquet(f"{out}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{out}/events")
    writer = sse.merge_tool_stream(stream).writeStream.format("parquet").option("path", f"{out}/calls")
    writer.option("checkpointLocation", f"{out}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/calls")


@query(
    """select doc_id as id, text[1:2000] as query, nullif(case when doc_id % 3 = 0 then text[1:2000] else '' end, '') as error,
 (case when doc_id % 3 = 0 and text <> '' then text when text <> '' then text else 'tools/call' end)[1:255] as summary,
 greatest(doc_id - 50, 0) as latency_ms from documents where text is not null and doc_id % 7 <> 0"""
)
def stream_call_log(spark: SparkSession, d: str) -> DataFrame:
    """Documents as calls, some of them pings, appended to a log by a stream."""
    out = shared_folder(spark)
    docs = table(spark, d, "documents").where("text is not null")
    body = F.to_json(F.struct(F.col("text").alias("q")))
    calls = docs.select(
        F.col("doc_id").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at"), F.when(F.col("doc_id") % 7 == 0, "ping").otherwise("tools/call").alias("method"),
        F.col("text").alias("query"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("error"), F.lit(None).cast("string").alias("summary"), (F.col("doc_id") - 50).alias("latency_ms"), body.alias("request_body"),
    )
    calls.write.parquet(f"{out}/calls")
    stream = spark.readStream.schema(calls.schema).parquet(f"{out}/calls")
    jobs.ingest_calls(stream, f"{out}/log", f"{out}/progress").awaitTermination()
    log = spark.read.parquet(f"{out}/log").where(F.length("request_body") <= 48_000)
    return log.select("id", "query", "error", "summary", "latency_ms")
