"""Tables and pieces of SQL that several plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TERMS = ("that", "therble", "ention")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def sql_bm25(name: str, text: str, source: str = "documents", key: str = "doc_id", terms: tuple[str, ...] = TERMS) -> str:
    """CTEs ending in ``name``(chunk_id, raw): the score of one field."""
    tf = [f"len(list_filter(t, lambda x: x = '{v}'))::double as tf{i}" for i, v in enumerate(terms)]
    df = [f"sum((tf{i} > 0)::int) as df{i}" for i in range(len(terms))]
    parts = [
        f"ln(1 + (n - df{i} + 0.5::double) / (df{i} + 0.5::double)) * (tf{i} * 2.2::double)"
        f" / (tf{i} + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl))"
        for i in range(len(terms))
    ]
    return f"""{name}_t as (select {key} as chunk_id, {sql_tokens(text)} as t from {source}),
{name}_f as (select chunk_id, len(t)::double as dl, {", ".join(tf)} from {name}_t),
{name}_s as (select count(*)::double as n, avg(dl) as avgdl, {", ".join(df)} from {name}_f),
{name} as (select chunk_id, {" + ".join(parts)} as raw from {name}_f, {name}_s)"""


SQL_COSINE = """(list_sum(list_transform(list_zip(a, b), lambda p: p[1]::double * p[2]::double))
 / (sqrt(list_sum(list_transform(a, lambda x: x::double * x::double)))
    * sqrt(list_sum(list_transform(b, lambda x: x::double * x::double)))))"""

#: lex(chunk_id, score) and sem(chunk_id, score): both pools of 50.
SQL_POOLS = f"""{sql_bm25("bm", "text")},
lex as (select chunk_id, round(raw, 6) as score from bm where round(raw, 6) > 0 order by 2 desc, 1 limit 50),
pair as (select e.vec_id as chunk_id, e.embedding as a, (select embedding from embeddings where vec_id = 0) as b from embeddings e),
allsem as (select chunk_id, round({SQL_COSINE}, 6) as score from pair),
sem as (select * from allsem order by score desc, chunk_id limit 50)"""

SQL_RRF = """lr as (select chunk_id, row_number() over (order by score desc, chunk_id) as r, score from lex),
sr as (select chunk_id, row_number() over (order by score desc, chunk_id) as r, score from sem where score >= 0.2::double),
fused as (select coalesce(lr.chunk_id, sr.chunk_id) as chunk_id,
  round(coalesce(1::double / (lr.r + 60), 0) + coalesce(1::double / (sr.r + 60), 0), 6) as score,
  case when lr.r is not null and sr.r is not null then 'mixed' when lr.r is not null then 'lexical' else 'semantic' end as note
  from lr full outer join sr on lr.chunk_id = sr.chunk_id)"""
