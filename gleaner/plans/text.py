"""Text, page and passage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import html as H
from gleaner.functions import web as W
from gleaner.operators import chunk as C
from gleaner.operators.cuts import spread
from gleaner.plans.common import table
from gleaner.sources import crawl

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BARE = r"https?://\S+|www\.\S+"


def _sql_index_text(x: str) -> str:
    steps = [
        (r"(?is)<a\b[^>]*>\s*(?:https?://|www\.)[^<\s]*\s*</a>", ""),
        (r"(?is)<a\b[^>]*>(.*?)</a>", r"\1"),
        (rf"!?\[\s*(?:{_BARE})?\s*\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", ""),
        (r"!?\[([^\]]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", r"\1"),
        (r"<https?://[^>\s]*>", ""),
        (_BARE, ""),
    ]
    out = f"coalesce({x}, '')"
    for pattern, new in steps:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return out


_LINKED = "text || ' [label ' || doc_id || '](https://example.org/a) see https://example.org/b <a href=\"/x\">more</a>'"


@query(f"select doc_id, {_sql_index_text(_LINKED)} as indexed from documents")
def index_text(spark: SparkSession, d: str) -> DataFrame:
    tail = ' [label %s](https://example.org/a) see https://example.org/b <a href="/x">more</a>'
    given = F.concat("text", F.format_string(tail, F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", T.index_text(given).alias("indexed"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    prefix = (
        F.when(F.col("pos") % 3 == 0, F.concat(F.repeat(F.lit("#"), (F.col("pos") % 7).cast("int")), F.lit(" ")))
        .when(F.col("pos") % 3 == 1, "1.2.3 ")
        .otherwise("")
    )
    return rows.withColumn("line", F.concat(prefix, F.col("line")))


_SQL_LINES = r"""l as (select doc_id, i - 1 as pos, case when (i - 1) % 3 = 0 then repeat('#', ((i - 1) % 7)::int) || ' '
 when (i - 1) % 3 = 1 then '1.2.3 ' else '' end || ls[i] as line
 from (select doc_id, ls, unnest(generate_series(1, len(ls))) as i from (select doc_id, string_split(text, chr(10)) as ls from documents))),
t as (select doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') as t from l),
h as (select doc_id, pos, (case when regexp_matches(t, '^#{1,6}\s+\S') then length(regexp_extract(t, '^(#{1,6})', 1))
 when regexp_matches(t, '^\d+(?:\.\d+){1,5}\s+\S') and length(t) <= 80 and not regexp_matches(t, '[。；;！？!?：:]$')
 then least(length(regexp_extract(t, '^(\d+(?:\.\d+)*)', 1)) - length(replace(regexp_extract(t, '^(\d+(?:\.\d+)*)', 1), '.', '')) + 1, 6)
 when regexp_matches(t, '^\d+[、.．]\s*\S') and length(t) <= 30 and not regexp_matches(t, '[。；;！？!?：:]$') then 4
 when regexp_matches(t, '^[（(][一二三四五六七八九十百千零〇两0-9]+[）)]') and length(t) <= 30 and not regexp_matches(t, '[。；;！？!?：:]$') then 2 end)::int as level from t)"""


@query(f"with {_SQL_LINES} select doc_id, pos::int as pos, level from h")
def heading_level(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "pos", T.heading_level(F.col("line")).cast("int").alias("level"))


@query(f"with {_SQL_LINES} select doc_id, bool_or(coalesce(level <= 3, false)) as headed from h group by doc_id")
def has_heading(spark: SparkSession, d: str) -> DataFrame:
    whole = _lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return whole.select("doc_id", T.has_heading(text, 3).alias("headed"))


@query(
    f"""with {_SQL_LINES}, c as (select doc_id, pos, level, sum(case when level <= 3 then 1 else 0 end) over (partition by doc_id order by pos) as section from h)
select doc_id, section::bigint as section, count(*) as n_lines, min(pos)::int as first_line from c group by 1, 2"""
)
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    """Islands between headings, by a running count."""
    from pyspark.sql import Window

    rows = _lines(spark, d).withColumn("level", T.heading_level(F.col("line")))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum(F.when(F.col("level") <= 3, 1).otherwise(0)).over(upto))
    return rows.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.min("pos").alias("first_line"))


@query(
    f"""with {_SQL_LINES}, c as (select h.doc_id, h.pos, last_value(case when level is not null then h.pos end ignore nulls)
 over (partition by h.doc_id order by h.pos rows unbounded preceding) as under from h) select doc_id, pos::int as pos, under::int as under from c"""
)
def nearest_heading(spark: SparkSession, d: str) -> DataFrame:
    """The position of the last heading above each line."""
    from pyspark.sql import Window

    rows = _lines(spark, d).withColumn("level", T.heading_level(F.col("line")))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    under = F.last(F.when(F.col("level").isNotNull(), F.col("pos")), ignorenulls=True).over(upto)
    return rows.select("doc_id", "pos", under.alias("under"))


_CANON = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
 '(?m)[ \t]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"select doc_id, sha256({_CANON.format(x='text')}) as hash from documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(
    r"""select doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda l: contains(l, '|')),
 lambda l: list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^\|', ''), '\|$', ''), '|'),
 lambda c: trim(c))) as cells from documents where contains(text, '|')"""
)
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("text").contains("|"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.contains("|"))
    return rows.select("doc_id", F.transform(lines, T.table_cells).alias("cells"))


@query(
    r"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x:
 case when regexp_matches(x, '^\s*\|.*\|\s*$') then null else trim(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) end),
 lambda x: x <> '') as ls from documents)
select doc_id, substr(coalesce(ls[1], 'untitled'), 1, 80) as title from l"""
)
def chunk_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.chunk_title(F.col("text"), F.lit("untitled")).alias("title"))


_UNESC = "replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_STRIPPED = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _sql_tag(name: str) -> str:
    inner = rf"regexp_replace(regexp_extract(html, '(?is)<{name}\b[^>]*>(.*?)</{name}\s*>', 1), '<[^>]+>', '', 'g')"
    return _STRIPPED.format(x=rf"regexp_replace({_UNESC.format(x=inner)}, '\s+', ' ', 'g')")


@query(
    rf"""select page_id, substr(coalesce(nullif({_sql_tag("title")}, ''), nullif({_sql_tag("h1")}, ''),
 nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/?$', 1), ''),
 nullif(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ''), ''), 1, 255) as title from pages"""
)
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", W.page_title(F.col("html"), F.col("url")).alias("title"))


def _sql_html_text(x: str) -> str:
    def sub(y: str, pattern: str, new: str) -> str:
        return f"regexp_replace({y}, '{pattern}', {new}, 'g')"

    for tag in ("script", "style", "noscript"):
        x = sub(x, rf"(?is)<{tag}\b.*?</{tag}\s*>", "''")
    x = f"substr({x}, 1, 1200000)"
    for tag in ("button", "svg"):
        x = sub(x, rf"(?is)<{tag}\b.*?</{tag}\s*>", "''")
    x = sub(x, r"(?s)<!--.*?-->", "''")
    quote = "[\"'']"
    x = sub(x, rf"(?is)<a\b[^>]*href={quote}(?:javascript:|mailto:|tel:|data:|#)[^\"'']*{quote}[^>]*>(.*?)</a>", r"'\1'")
    x = sub(x, rf"(?is)<a\b[^>]*href={quote}([^\"'']+){quote}[^>]*>(.*?)</a>", r"'[\2](\1)'")
    for n in range(1, 7):
        x = sub(x, rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", rf"chr(10) || chr(10) || '{'#' * n} \1' || chr(10) || chr(10)")
    x = sub(x, r"(?i)<br\s*/?>", "chr(10)")
    x = sub(x, r"(?i)</p\s*>", "chr(10) || chr(10)")
    x = _UNESC.format(x=sub(x, "<[^>]+>", "' '"))
    x = sub(sub(x, r"[ \t]+", "' '"), r" ?\n ?", "chr(10)")
    return sub(sub(x, r"\n{3,}", "chr(10) || chr(10)"), r"^\s+|\s+$", "''")


@query(f"select page_id, {_sql_html_text('html')} as text from pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", W.html_text(F.col("html")).alias("text"))


@query()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Text by events, with absolute links; what has none says so."""
    found = H.page_text(F.col("html"), F.col("url"))
    return table(spark, d, "pages").withColumn("r", found).select("page_id", "r.text", "r.error")


@query()
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """Text and links of the articles of a page alone."""
    pages = table(spark, d, "pages")
    text, hrefs = H.page_text(F.col("html"), F.col("url"), "article"), H.page_hrefs(F.col("html"), "article")
    return pages.withColumn("r", text).select("page_id", "r.text", "r.error", F.coalesce(F.size(hrefs), F.lit(0)).alias("n_links"))


@query()
def crawl_site(spark: SparkSession, d: str) -> DataFrame:
    """The pages put on one site, each linking to three others."""
    n = F.col("page_id")
    to = F.concat(*[F.format_string(f'<a href="/docs/p{{}}%d">{k}</a>'.replace("{}", ""), (n * 3 + k) % 997) for k in (2, 1, 3)])
    rows = table(spark, d, "pages").select(F.format_string("https://site.example/docs/p%d", n).alias("url"), F.concat(F.when(n % 5 != 3, F.col("html")).otherwise(""), to).alias("html"))
    got = crawl.crawl(rows, "https://site.example/docs/p0", most_pages=40, deepest=6)
    return got.select("rank", "url", "depth", F.length("text").alias("n"))



@query()
def page_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.posexplode(W.links(F.col("html"), F.col("url"))).alias("position", "link"))


@query(
    r"""select page_id, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1))
 || coalesce(nullif(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/') || regexp_extract(url, '(\?[^#]+)', 1) as normal from pages"""
)
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", W.normal_url(F.col("url"), F.col("url")).alias("normal"))


@query(
    r"""with p as (select page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host,
 regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages)
select page_id, path = '/en' or starts_with(path, '/en/') as in_scope from p"""
)
def url_scope(spark: SparkSession, d: str) -> DataFrame:
    """Is a page inside the English section of its host."""
    root = F.concat(F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1), F.lit("/en"))
    return table(spark, d, "pages").select("page_id", W.in_scope(root, F.col("url")).alias("in_scope"))


# passages


@query(
    r"""with w as (select doc_id, i, regexp_replace(substr(text, i, 1000), '^\s+|\s+$', '', 'g') as t
 from (select doc_id, text, unnest(generate_series(1, greatest(length(text), 1), 800)) as i from documents))
select doc_id, row_number() over (partition by doc_id order by i) as position, t as text from w where t <> ''"""
)
def chunk_hard_window(spark: SparkSession, d: str) -> DataFrame:
    parts = C.hard_windows(F.col("text"), 1000, 200)
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("p", "text"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("position"), "text")


@query(
    """select doc_id, length(text) > 500 as by_least, length(text) > 1400 as by_context, true as forced from documents"""
)
def chunk_should_split(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        C.should_split(t, C.Config(min_size=500)).alias("by_least"),
        C.should_split(t, C.Config(trigger="maxSize", context=2000)).alias("by_context"),
        C.should_split(t, C.Config(trigger="force")).alias("forced"),
    )


@query(
    r"""with p as (select doc_id, list_filter(list_transform(string_split(replace(text, ';', '.'), '.'),
 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ps from documents)
select doc_id, i as position, ps[i] as text from (select doc_id, ps, unnest(generate_series(1, len(ps))) as i from p)"""
)
def chunk_delimiter(spark: SparkSession, d: str) -> DataFrame:
    parts = C.by_delimiter(F.col("text"), ".|;", 0)
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("p", "text"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("position"), "text")


@query(
    r"""with a as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？；!?\n]*[。！？；!?\n]?'),
 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ps from documents)
select doc_id, i as position, ps[i] as text from (select doc_id, ps, unnest(generate_series(1, len(ps))) as i from a)"""
)
def chunk_sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(C.sentences(F.col("text"), 0)).alias("p", "text"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("position"), "text")


def _split(name: str, config: C.Config):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return C.split_documents(table(spark, d, "documents"), config)

    QUERIES[name] = run


_split("chunk_paragraph", C.Config())
_split("chunk_size_overlap", C.Config(mode="custom", split="size", size=600, overlap=100, trigger="force"))
_split("chunk_char", C.Config(mode="custom", split="char", size=400, delimiter=".|\\n", trigger="force"))
_split("chunk_qa_window", C.Config(qa=True, size=2000))


@query()
def child_indexes(spark: SparkSession, d: str) -> DataFrame:
    c = C.Config(mode="custom", split="size", size=2000, child=True, child_size=300, trigger="force")
    rows = C.split_documents(table(spark, d, "documents"), c)
    entries = rows.select("doc_id", "position", F.posexplode_outer(C.child_entries(F.col("text"), c)).alias("entry", "text"))
    return entries.where(F.col("text").isNotNull())


@query(
    r"""with b as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as body, regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g') as head from documents),
i as (select doc_id, 0 as entry, 'title' as kind, head as text from b where head <> '' and head <> body and length(body) >= length(head) + 40
 union all select doc_id, 1, 'default', case when head = '' or starts_with(body, head) then body else head || chr(10) || body end from b where body <> '')
select doc_id, (row_number() over (partition by doc_id order by entry) - 1)::int as entry, kind, text from i"""
)
def embed_items(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    items = C.embed_items(F.split("text", "\n")[0], F.col("text"), F.lit(None).cast("string"), none)
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(items).alias("entry", "i"))
    return rows.select("doc_id", "entry", "i.kind", "i.text")


@query(
    r"""with w as (select doc_id, regexp_replace(substr(text, i, 1000), '^\s+|\s+$', '', 'g') as t
 from (select doc_id, text, unnest(generate_series(1, greatest(length(text), 1), 1000)) as i from documents))
select doc_id, count(*) as n_chunks, min(length(t)) as shortest, max(length(t)) as longest, sum(length(t))::bigint as chars,
 count(*) filter (where length(t) > 900) as n_long from w where t <> '' group by doc_id"""
)
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(C.hard_windows(F.col("text"), 1000)).alias("t"))
    n = F.length("t")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.min(n).cast("long").alias("shortest"),
        F.max(n).cast("long").alias("longest"),
        F.sum(n).alias("chars"),
        F.count_if(n > 900).alias("n_long"),
    )


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Pages as Markdown: their text with headings, and a generated table."""
    pages = spread(table(spark, d, "pages"))
    rows = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.format_string("| r%d | %d |", i, i * i)), "\n")
    grid = F.concat(F.lit("\n\n| name | square |\n| --- | --- |\n"), rows, F.lit("\n\n```sql\nselect 1\n# no heading\n```\n"))
    return pages.select(F.col("page_id").alias("doc_id"), F.concat(W.html_text(F.col("html")), grid).alias("text"))


@query()
def md_blocks(spark: SparkSession, d: str) -> DataFrame:
    return C.markdown_blocks(_markdown(spark, d))


@query()
def md_parents(spark: SparkSession, d: str) -> DataFrame:
    return C.split_markdown(_markdown(spark, d), 600)


@query(
    "select page_id as doc_id, i as row, 'name: r' || i || '；square: ' || (i * i) as sentence from (select page_id, unnest(generate_series(1, 30)) as i from pages)"
)
def table_rows(spark: SparkSession, d: str) -> DataFrame:
    found = C.markdown_blocks(_markdown(spark, d)).where("kind = 'table' and text like '| name | square |%'")
    lines = F.split("text", "\n")
    rows = found.select("doc_id", lines[0].alias("head"), F.posexplode(F.slice(lines, 3, F.size(lines))).alias("p", "line"))
    said = T.row_sentence(T.table_cells(F.col("head")), T.table_cells(F.col("line")))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("row"), said.alias("sentence"))


@query("select doc_id, doc_id % 3 = 0 and length(trim(text)) > 0 as atomic from documents where not contains(text, '```')")
def atomic_passages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as code under a heading, code with a line after it, prose."""
    line = F.regexp_replace("text", r"\s+", " ")
    code = F.concat(F.lit("# Head\n\n```\n"), line, F.lit("\n```"))
    body = F.when(F.length(F.trim("text")) == 0, "").when(F.col("doc_id") % 3 == 0, code).when(F.col("doc_id") % 3 == 1, F.concat(code, F.lit("\n\nand more"))).otherwise(line)
    return table(spark, d, "documents").where(~F.col("text").contains("```")).select("doc_id", C.is_atomic(body).alias("atomic"))
