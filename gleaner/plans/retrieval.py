"""Retrieval queries.  The tables have no key between passages and vectors:
``vec_id`` stands for ``doc_id``, and four vectors make a passage where points
are folded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.numbers import rounded
from gleaner.functions.text import index_text
from gleaner.functions.tokens import tokens
from gleaner.operators import retrieve as R
from gleaner.operators.cuts import spread
from gleaner.plans.common import SQL_COSINE, SQL_POOLS, SQL_RRF, TERMS, sql_bm25, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lex(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return R.top(R.lexical(docs, TERMS, "doc_id", {"text": (F.col("text"), 1.0)}))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


def _sem(spark: SparkSession, d: str, keep=None) -> DataFrame:
    return R.top(R.vector(table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id", "embedding", keep))


@query(f"with {SQL_POOLS}, {SQL_RRF} select * from fused order by score desc, chunk_id limit 20")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return R.search(_lex(spark, d), _sem(spark, d))


@query(f"with {SQL_POOLS} select * from lex")
def lexical_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lex(spark, d)


@query(
    f"""with {sql_bm25("a", "string_split(text, chr(10))[1]")}, {sql_bm25("b", "text")}
select a.chunk_id, round(greatest(a.raw * 2::double, b.raw), 6) as score from a join b on a.chunk_id = b.chunk_id
where round(greatest(a.raw * 2::double, b.raw), 6) > 0 order by 2 desc, 1 limit 50"""
)
def lexical_multifield_best(spark: SparkSession, d: str) -> DataFrame:
    """The first line is the title, with twice the weight."""
    docs = table(spark, d, "documents")
    fields = {"title": (F.split("text", "\n")[0], 2.0), "text": (F.col("text"), 1.0)}
    return R.top(R.lexical(docs, TERMS, "doc_id", fields))


@query(
    f"""with {sql_bm25("bm", "text")} select chunk_id, round(raw, 6) as score from bm join documents on doc_id = chunk_id
where round(raw, 6) > 0 and contains(lower(text), 'in the') order by 2 desc, 1 limit 50"""
)
def lexical_phrase_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    keep = F.lower("text").contains("in the")
    return R.top(R.lexical(docs, TERMS, "doc_id", {"text": (F.col("text"), 1.0)}, keep))


@query(
    f"""with {sql_bm25("bm", "text")} select chunk_id, round(raw, 6) as score from bm join documents on doc_id = chunk_id
where round(raw, 6) > 0 and source in ('src1', 'src2') order by 2 desc, 1 limit 50"""
)
def lexical_source_filter(spark: SparkSession, d: str) -> DataFrame:
    """Statistics stay global when the sources are restricted."""
    docs = table(spark, d, "documents")
    keep = F.col("source").isin("src1", "src2")
    return R.top(R.lexical(docs, TERMS, "doc_id", {"text": (F.col("text"), 1.0)}, keep))


_ROMAN, _HAN = "abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥金木水火"
_HAN_QUERY = "酉辛甲酉"  # a word of the corpus, written alike
_SQL_HAN = f"translate(lower(coalesce(text, '')), '{_ROMAN}', '{_HAN}')"


def _sql_han_bm25() -> str:
    terms = list(dict.fromkeys(_HAN_QUERY[i : i + 2] for i in range(len(_HAN_QUERY) - 1)))
    tf = [f"len(list_filter(t, lambda x: x = '{v}'))::double as tf{i}" for i, v in enumerate(terms)]
    df = ", ".join(f"sum((tf{i} > 0)::int) as df{i}" for i in range(len(terms)))
    part = [
        f"ln(1 + (n - df{i} + 0.5::double) / (df{i} + 0.5::double)) * (tf{i} * 2.2::double)"
        f" / (tf{i} + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl))"
        for i in range(len(terms))
    ]
    run = f"[{_HAN}]"
    return rf"""w as (select doc_id, list_filter(regexp_split_to_array(regexp_replace({_SQL_HAN}, '({run}+)', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as ws from documents),
t as (select doc_id, flatten(list_transform(ws, lambda x: case when regexp_matches(x, '^{run}') and length(x) > 1
 then list_transform(range(1, length(x)), lambda i: substr(x, i::int, 2)) else [x] end)) as t from w),
f as (select doc_id, len(t)::double as dl, {", ".join(tf)} from t), s as (select count(*)::double as n, avg(dl) as avgdl, {df} from f),
bm as (select doc_id as chunk_id, round({" + ".join(part)}, 6) as score from f, s)"""


@query(f"with {_sql_han_bm25()} select chunk_id, score from bm where score > 0 order by 2 desc, 1 limit 50")
def lexical_cjk(spark: SparkSession, d: str) -> DataFrame:
    """The corpus written in Han characters, searched by pairs of them."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("text", F.translate(F.lower("text"), _ROMAN, _HAN))
    terms = R.query_terms(spark, _HAN_QUERY)
    return R.top(R.lexical(docs, terms, "doc_id", {"text": (F.col("text"), 1.0)}, tokenise=tokens))


@query(f"with {SQL_POOLS} select * from sem")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sem(spark, d)


@query(
    f"""with {SQL_POOLS}, l as (select vec_id, label from embeddings)
select chunk_id, score from allsem join l on vec_id = chunk_id where label in (1, 2) order by score desc, chunk_id limit 50"""
)
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _sem(spark, d, F.col("label").isin(1, 2))


@query(
    f"""with {SQL_POOLS}, p as (select chunk_id // 4 as c, chunk_id, score, 'k' || (chunk_id % 4) as kind from sem),
r as (select *, row_number() over (partition by c order by score desc, chunk_id) as n from p)
select c as chunk_id, score, kind from r where n = 1"""
)
def vector_chunk_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The pool is cut before its points are folded to passages."""
    points = _sem(spark, d).withColumn("chunk", F.expr("chunk_id div 4")).withColumn(
        "kind", F.concat(F.lit("k"), F.col("chunk_id") % 4)
    )
    return R.best_point(points)


@query(f"with {SQL_POOLS} select *, 'lexical' as note from lex order by score desc, chunk_id limit 20")
def mode_fulltext(spark: SparkSession, d: str) -> DataFrame:
    return R.search(_lex(spark, d), _sem(spark, d), "fulltext")


@query(f"with {SQL_POOLS} select *, 'semantic' as note from sem where score >= 0.2::double order by score desc, chunk_id limit 20")
def mode_embedding(spark: SparkSession, d: str) -> DataFrame:
    return R.search(_lex(spark, d), _sem(spark, d), "embedding")


@query(
    f"""with {SQL_POOLS}, {SQL_RRF},
f as (select *, row_number() over (order by score desc, chunk_id) as fused_rank from fused),
vr as (select chunk_id, score, row_number() over (order by score desc, chunk_id) as r from sem)
select f.chunk_id, f.fused_rank, f.score as fused_score, f.note, lr.r as lexical_rank, lr.score as lexical_score,
 vr.r as vector_rank, vr.score as vector_score, coalesce(vr.score < 0.2::double, false) as vector_dropped
from f left join lr on lr.chunk_id = f.chunk_id left join vr on vr.chunk_id = f.chunk_id where fused_rank <= 20"""
)
def search_trace(spark: SparkSession, d: str) -> DataFrame:
    return R.trace(_lex(spark, d), _sem(spark, d))


@query(
    f"""with {SQL_POOLS}, {SQL_RRF.replace("0.2::double", "0.3::double")},
f as (select *, row_number() over (order by score desc, chunk_id) as r from fused),
weak as (select chunk_id, score, 'below threshold' as reason, 0 as g from sem
  where score < 0.3::double and chunk_id not in (select chunk_id from f where r <= 20)),
behind as (select chunk_id, score, 'behind the cut' as reason, 1 as g from f
  where r > 20 and chunk_id not in (select chunk_id from weak)),
u as (select *, row_number() over (order by g, score desc, chunk_id) as position from (select * from weak union all select * from behind))
select position, chunk_id, score, reason from u where position <= 8"""
)
def search_dropped(spark: SparkSession, d: str) -> DataFrame:
    return R.dropped(_lex(spark, d), _sem(spark, d), 0.3)


@query(
    f"""with {SQL_POOLS}, h as (select lex.chunk_id, round((list_contains(t, 'that')::int + list_contains(t, 'therble')::int
 + list_contains(t, 'ention')::int) / 3::double, 6) as score from lex join bm_t on bm_t.chunk_id = lex.chunk_id)
select chunk_id, score, 'reranked' as note from h order by score desc, chunk_id limit 20"""
)
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(_lex(spark, d), table(spark, d, "documents"), TERMS, "doc_id", F.col("text"))


@query(
    """with n as (select vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n, embedding from embeddings)
select vec_id, list_transform(embedding, lambda x: round(x::double / n, 6)) as unit from n"""
)
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    unit = F.transform(R.l2_normalised(F.col("embedding")), lambda x: rounded(x, 6))
    return table(spark, d, "embeddings").select("vec_id", unit.alias("unit"))


@query(
    f"""with {SQL_POOLS} select chunk_id, score from sem join documents on doc_id = chunk_id
where contains(lower(concat_ws(' ', source, text)), 'that')"""
)
def warehouse_filter(spark: SparkSession, d: str) -> DataFrame:
    """A substring filter after the vector pool; points without a passage go."""
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "chunk_id")
    rows = _sem(spark, d).join(docs, "chunk_id")
    return rows.where(F.lower(F.concat_ws(" ", "source", "text")).contains("that")).select("chunk_id", "score")


@query(
    f"""with {SQL_POOLS} select string_agg('[' || n || '] ' || source || ' (' || printf('%.2f', score) || ')' || chr(10) || text
 || chr(10) || 'locator: #' || chunk_id, chr(10) || chr(10) order by n) as body
from (select *, row_number() over (order by score desc, chunk_id) as n from lex) join documents on doc_id = chunk_id where n <= 5"""
)
def format_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "chunk_id")
    hits = R.ranked(R.top(_lex(spark, d), 5), "n").join(docs, "chunk_id")
    return R.hits_text(hits, "n", F.col("source"), F.col("text"), F.concat(F.lit("#"), F.col("chunk_id")))


@query(
    f"""with q as (select item_id as query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) as ws from benchmark),
w as (select query_id, unnest(ws) as term from q),
h as (select doc_id as chunk_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as t from documents),
s as (select count(*)::double as n, avg(len(t)::double) as avgdl from h),
p as (select chunk_id, len(t)::double as dl, unnest(t) as term from h),
f as (select term, chunk_id, dl, count(*)::double as tf from p where term in (select term from w) group by 1, 2, 3),
df as (select term, count(*)::double as df from f group by 1),
sc as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double)
 / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl))), 4) as score
 from f join df on f.term = df.term join w on w.term = f.term, s group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc)
select query_id, chunk_id, rank from r where rank <= 20"""
)
def search_many_queries(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = R.search_many(table(spark, d, "documents"), queries, "doc_id", F.col("text"))
    return found.select("query_id", "chunk_id", "rank")


@query(
    r"""with t as (select doc_id, string_split(text, chr(10))[1] as title, text from documents)
select doc_id as chunk_id, regexp_replace(title, 'https?://\S+|www\.\S+', '', 'g') as title,
 regexp_replace(text, 'https?://\S+|www\.\S+', '', 'g') as text, '#' || doc_id as locator from t"""
)
def lexical_document(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        index_text(F.split("text", "\n")[0]).alias("title"),
        index_text(F.col("text")).alias("text"),
        F.concat(F.lit("#"), "doc_id").alias("locator"),
    )
