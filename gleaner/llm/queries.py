"""The queries ``opN_<name>`` and their SQL, over the tables of a folder."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import chat, decontam, exact_dedup, langid, line_dedup, metric_topk, minhash, mixing, periodic, pii, quality, token_align, url_templates
from gleaner.llm.common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # of the test tables only; whoever replaces real data has a secret of their own
    return pii.replace_entities(_table(spark, sf_dir, "documents"), b"the test tables")


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and sums of each conversation, from its segments as they come:
    only running states are held."""
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
    kinds += [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema, rows, open_ = pa.schema(kinds), [], False
    conv = turns = learned = None
    n = chars = length = 0

    def row() -> dict:
        values = conv, n, turns.hexdigest(), chars, learned.hexdigest(), length
        return dict(zip(schema.names, values, strict=True))

    for b in batches:
        for key, body, s, e in zip(*(b.column(i) for i in range(4)), strict=True):
            if not open_ or key.as_py() != conv:
                if open_:
                    rows.append(row())
                open_, conv, turns, learned, n, chars, length = True, key.as_py(), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            text, raw = body.as_py(), body.as_buffer()
            for role, said in chat.read_turns(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for x, y in zip(s.as_py(), e.as_py(), strict=True):
                part = chat.unescape(raw[x:y].to_pybytes().decode())
                learned.update(part.encode())
                chars += len(part)
            length += len(text)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if open_:
        yield pa.RecordBatch.from_pylist([row()], schema)


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted conversations say, read from their segments."""
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return dealt.select("conv_id", "body", "starts", "ends").mapInArrow(
        _read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(chat.format_segments(rows.unionByName(more)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict_language(docs, docs.where(crc_mod("doc_id", 4) != 2))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    score = quality.scorer(docs, labels)
    out = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return decontam.contamination(docs, bench).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_topk.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def planted(text: str, doc_id: int) -> str:
    """The text with the contract's repetition in it."""
    words, h = _WORD.findall(text), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[:a] + [words[a + i % p] for i in range(n - a)])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("string")
    def with_repeats(text: pa.Array, doc_id: pa.Array) -> pa.Array:
        return pa.array((planted(t, i) for t, i in zip(text.to_pylist(), doc_id.to_pylist(), strict=True)), pa.string())

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0) & F.col("text").isNotNull()
    some = docs.where(hit).select("doc_id", with_repeats("text", "doc_id").alias("text"))
    found = periodic.periodic_runs(docs.where(~F.coalesce(hit, F.lit(False))).unionByName(some))
    best = F.get("runs", F.col("strongest"))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * get(runs, strongest).length div get(runs, strongest).period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


TOKENIZERS = "/opt/tokenizers"


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = token_align.alignment(docs, f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model", digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as ws from documents
), sh as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') as g
  from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as i from w where len(ws) > 0)
), n as (
  select doc_id, count(*) as n from sh group by doc_id
), pair as (
  select a.doc_id as a, b.doc_id as b, count(*) as m from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id
  group by 1, 2
), link as (
  select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 75 * (x.n + y.n - m)
), two as (
  select a, b from link union all select b, a from link
), reach(a, b) as (
  select a, a from two union select r.a, two.b from reach r join two on r.b = two.a
), comp as (
  select a as doc_id, min(b) as component_id from reach group by a
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.component_id, w.doc_id) as component_id,
       coalesce(c.component_id, w.doc_id) is not distinct from w.doc_id as kept
from w left join n on n.doc_id = w.doc_id left join comp c on c.doc_id = w.doc_id
"""

OP8_SQL = rf"""
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), iw as (
  select distinct item_id, list_slice(ws, i, i + 12) as win
  from (select item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) as i from b where len(ws) > 0)
), ln as (
  select distinct len(win) as k from iw
), dw as (
  select rid, k, i, list_slice(ws, i, i + k - 1) as win
  from (select rid, ws, k, unnest(generate_series(1, len(ws) - k + 1)) as i from d, ln where len(ws) >= k)
), h as (
  select dw.rid, dw.i, dw.k, iw.item_id from dw join iw on dw.win = iw.win
), hw as (
  select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(i, i + k - 1)) as p from h) group by rid
), hi as (
  select rid, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct rid, item_id::varchar as item from h where item_id is not null) group by rid
)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hw on hw.rid = d.rid left join hi on hi.rid = d.rid
"""

OP11_SQL = r"""
with v as (
  select row_number() over () as rid, vec_id, [floor(64 * x::double) for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.rid, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.rid <> c.rid and len(q.v) = len(c.v) where q.vec_id % 20 = 0
), r as (
  select *, row_number() over (partition by rid order by score desc, vec_id asc nulls last)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP3_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\|start_header_id\|>|\|end_header_id\|>|\|endoftext\|>|\|im_start\|>|\|im_end\|>|\|eot_id\|>|</SYS>>|<SYS>>|/INST\]|INST\]|/s>|s>)', '\1\\\2', 'g') as safe
  from c
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(safe) + length('<|im_end|>') + 1)::bigint as formatted_chars
from e group by conv_id
"""

OP4_SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (
  select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm
)
select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id as kept,
       sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""

OP9_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, text, string_split(text, chr(10)) as ls from documents
), w as (
  select rid, doc_id, i - 1 as pos, list_slice(ls, i, i + 2) as win
  from (select rid, doc_id, ls, unnest(generate_series(1, len(ls) - 2)) as i from d
        where doc_id is not null and len(ls) >= 3)
), f as (
  select win, min((doc_id, pos)) as first from w group by win having count(*) > 1
), later as (
  select rid, doc_id, pos, first from w join f on w.win = f.win where (doc_id, pos) > first
), span as (
  select rid, case when doc_id = first[1] and pos < first[2] + 3 then first[2] + 3 else pos end as s, pos + 2 as e from later
), cut as (
  select distinct rid, unnest(generate_series(s, e)) as line from span
), n as (
  select rid, count(*) as n, list(line) as lines from cut group by rid
)
select doc_id,
       case when n.rid is null then text else coalesce(array_to_string(
         [x for x, i in ls if not list_contains(n.lines, i - 1)], chr(10)), '') end as text,
       coalesce(len(ls), 0)::bigint as n_lines, coalesce(n, 0)::bigint as n_removed
from d left join n on n.rid = d.rid
"""

OP10_SQL = r"""
with d as (
  select doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::bigint as w,
         source_size * 3 as cap from s
), r as (
  select *, cap::double / w as r from w
), l as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over b, 0))::double
            / (sum(w) over () - coalesce(sum(w) over b, 0))::double as lam
  from r window b as (order by r, source asc nulls last rows between unbounded preceding and 1 preceding)
), f as (
  select lam as level from l where lam <= r order by r, source asc nulls last limit 1
), p as (
  select source, source_size, least(cap::double, coalesce((select level from f), 0::double) * w) as target from l
), q as (
  select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end as copies from p
), c as (
  select d.doc_id, d.size, q.source_size, q.target, q.copies, q.target - q.copies * q.source_size as rem,
         sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as cum,
         sum(d.size) over (partition by d.source, d.h) as own
  from d join q on d.source is not distinct from q.source
)
select doc_id, size, source_size, target,
       (size * (copies + case when rem > 0 and (cum <= rem or (cum - own < rem and cum - rem < rem - (cum - own)))
                              then 1 else 0 end))::bigint as taken
from c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_url_templates": op2_url_templates,
        "op3_chat_format": op3_chat_format,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_language_id": op6_language_id,
        "op7_quality": op7_quality,
        "op8_decontamination": op8_decontamination,
        "op9_line_dedup": op9_line_dedup,
        "op10_mixing": op10_mixing,
        "op11_exact_topk": op11_exact_topk,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_format": OP3_SQL,
        "op4_exact_dedup": OP4_SQL,
        "op5_minhash_near_dedup": OP5_SQL,
        "op8_decontamination": OP8_SQL,
        "op9_line_dedup": OP9_SQL,
        "op10_mixing": OP10_SQL,
        "op11_exact_topk": OP11_SQL,
    }
