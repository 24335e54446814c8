"""Expressions over call logs: tokens, summaries, sanitised JSON."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEEPEST, LONGEST_TEXT, LONGEST_LIST, MOST_KEYS, PREVIEW, CAP = 8, 4000, 40, 80, 8, 48_000


def tokens(usage: Column) -> tuple[Column, Column, Column]:
    """(prompt, completion, total) of a usage object in JSON, under either of
    the two names in use; the total falls back to the sum."""

    def number(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object(usage, f"$.{n}").try_cast("long") for n in names])

    prompt = number("prompt_tokens", "input_tokens")
    completion = number("completion_tokens", "output_tokens")
    total = F.coalesce(number("total_tokens"), prompt + F.coalesce(completion, F.lit(0)))
    return prompt, completion, total


def logged(method: Column) -> Column:
    """Is a call worth a row: not a ping, not a notification."""
    m = F.coalesce(method, F.lit(""))
    return (m != "ping") & ~m.startswith("notifications/")


def http_ok(status: Column, error: Column) -> Column:
    return (F.coalesce(status, F.lit(0)) > 0) & (status < 400) & (F.coalesce(error, F.lit("")) == "")


def purpose(kind: Column) -> Column:
    """What a model was called for, by the kind of the call."""
    return (
        F.when(kind == "models", "discover")
        .when(kind.startswith("embedding"), "embed")
        .when(kind.isin("rerank", "chat"), kind)
        .otherwise("call")
    )


def call_summary(kind: Column, request: Column, response: Column, error: Column, status: Column, ok: Column) -> Column:
    """One line on a call of a model: its error, else its status, else what was
    asked for by its kind.  ``request`` and ``response`` are JSON; what is no
    JSON counts as absent."""
    asked, got = F.try_parse_json(request), F.try_parse_json(response)

    def rows(v: Column, path: str) -> Column:
        return F.try_variant_get(v, path, "array<variant>")

    def said(v: Column, path: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
        return F.when(is_text, F.try_variant_get(v, path, "string"))

    def line(text: Column) -> Column:
        return F.nullif(F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, 120), F.lit(""))

    users = F.transform(
        F.filter(rows(asked, "$.messages"), lambda m: said(m, "$.role") == "user"), lambda m: said(m, "$.content")
    )
    users = F.filter(users, lambda t: t.isNotNull())
    reply = F.coalesce(said(got, "$.choices[0].message.content"), said(got, "$.choices[0].text"))
    n = F.when(rows(asked, "$.input").isNotNull(), F.size(rows(asked, "$.input"))).when(said(asked, "$.input").isNotNull(), 1).otherwise(0)
    vec = "$.data[0].embedding"
    dim = F.coalesce(F.try_variant_get(got, f"{vec}.dim", "int"), F.when(rows(got, vec).isNotNull(), F.size(rows(got, vec))), F.lit(0))
    docs = F.coalesce(rows(asked, "$.documents"), rows(asked, "$.input.documents"))
    models = F.coalesce(rows(got, "$.data"), rows(got, "$"))
    # The texts of the summaries.
    return (
        F.when(F.coalesce(error, F.lit("")) != "", F.substring(error, 1, 160))
        .when(~F.coalesce(ok, F.lit(False)) & (F.coalesce(status, F.lit(0)) != 0), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(kind == "chat", F.coalesce(line(F.try_element_at(users, F.lit(-1))), line(reply), F.lit("对话")))
        .when(kind.startswith("embedding") & (n > 0) & (dim > 0), F.concat(n.cast("string"), F.lit(" 条 · "), dim.cast("string"), F.lit(" 维")))
        .when(kind.startswith("embedding") & (n > 0), F.concat(n.cast("string"), F.lit(" 条文本")))
        .when(kind.startswith("embedding"), "向量化")
        .when((kind == "rerank") & (F.coalesce(F.size(docs), F.lit(0)) > 0), F.concat(F.lit("重排 "), F.size(docs).cast("string"), F.lit(" 篇")))
        .when(kind == "rerank", "重排")
        .when((kind == "models") & models.isNotNull(), F.concat(F.lit("拉取到 "), F.size(models).cast("string"), F.lit(" 个模型")))
        .when(kind == "models", "拉取模型列表")
        .otherwise(kind)
    )


def capped(value: Column, most: int = CAP) -> Column:
    """The value, or a small object with its size and beginning."""
    preview = F.to_json(F.struct(F.length(value).alias("_chars"), F.substring(value, 1, 2000).alias("_preview")))
    return F.when(F.length(value) > most, preview).otherwise(value)


def tool_arguments(raw: Column) -> Column:
    """A JSON object as it is; anything else as the query of one."""
    text = F.coalesce(raw, F.lit(""))
    is_object = F.get_json_object(text, "$").isNotNull() & text.rlike(r"^\s*\{")
    return F.when(is_object, text).otherwise(F.to_json(F.struct(text.alias("query"))))


def rpc_ok(reply: Column) -> Column:
    """A call without a reply is fine; one with an error isn't."""
    failed = F.get_json_object(reply, "$.error").isNotNull() | (F.get_json_object(reply, "$.result.isError") == "true")
    return reply.isNull() | ~F.coalesce(failed, F.lit(False))


def fingerprint(*fields: Column) -> Column:
    """Digest of named columns as JSON, independent of their order."""
    ordered = sorted(fields, key=lambda c: c._jc.toString())
    return F.sha2(F.to_json(F.struct(*ordered)).cast("binary"), 256)


def _clean(value, depth: int = 0):
    if depth > DEEPEST:
        return "…"
    if isinstance(value, str):
        return value if len(value) <= LONGEST_TEXT else f"{value[:LONGEST_TEXT]}…(+{len(value) - LONGEST_TEXT})"
    if isinstance(value, list):
        if len(value) > PREVIEW and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value):
            return {"_vector": True, "dim": len(value), "preview": value[:PREVIEW]}
        out = [_clean(v, depth + 1) for v in value[:LONGEST_LIST]]
        return out + [{"_omitted": len(value) - LONGEST_LIST}] if len(value) > LONGEST_LIST else out
    if isinstance(value, dict):
        return {k: _clean(value[k], depth + 1) for k in list(value)[:MOST_KEYS]}
    return value


@F.arrow_udf(T.StringType())
def sanitised(body: pa.Array) -> pa.Array:
    """JSON with long texts clipped, long lists cut, vectors summed up."""
    out = []
    for text in body.to_pylist():
        try:
            out.append(None if text is None else json.dumps(_clean(json.loads(text)), ensure_ascii=False))
        except ValueError:
            out.append(_clean(text))
    return pa.array(out, pa.string())


#: How long the texts of a log row may be.
LONGEST = {"query": 2000, "error": 2000, "summary": 255, "client_ip": 64, "client_region": 120}


def safe_request(message: Column) -> Column:
    """What is kept of a request of the tool protocol: its method, and its
    parameters if they are an object."""
    params = F.get_json_object(message, "$.params")
    kept = F.when(params.rlike(r"^\s*\{"), params).otherwise("{}")
    method = F.coalesce(F.to_json(F.array(F.get_json_object(message, "$.method"))), F.lit("[null]"))
    return F.concat(F.lit('{"method":'), F.substring(method, F.lit(2), F.length(method) - 2), F.lit(',"params":'), kept, F.lit("}"))


def log_row(calls: DataFrame) -> DataFrame:
    """Calls as they are appended to the log: bodies sanitised and capped,
    texts cut to their length, no negative latency, no blank error; without a
    summary the error, else the query, else the method."""
    cut = {c: F.substring(F.coalesce(c, F.lit("")), 1, n) for c, n in LONGEST.items() if c in calls.columns}
    blank = F.lit("")
    first = [F.nullif(F.coalesce(c, blank), blank) for c in ("summary", "error", "query", "method") if c in calls.columns]
    cut["summary"] = F.substring(F.coalesce(*first, blank), 1, LONGEST["summary"])
    if "error" in cut:
        cut["error"] = F.nullif(cut["error"], blank)
    if "latency_ms" in calls.columns:
        cut["latency_ms"] = F.greatest(F.coalesce("latency_ms", F.lit(0)), F.lit(0))
    for c in ("request_body", "response_body"):
        if c in calls.columns:
            cut[c] = capped(sanitised(F.col(c)))
    return calls.withColumns(cut)


def address_label(ip: Column) -> Column:
    """本机 for loopback, 内网 for private ranges, else null."""
    t = F.regexp_replace(F.trim(F.coalesce(ip, F.lit(""))), "(?i)^::ffff:", "")
    private = r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|(?i)f[cd][0-9a-f]{2}:|(?i)fe80:)"
    return F.when(t.rlike(r"^127\.") | (t == "::1") | (t == "localhost"), "本机").when(t.rlike(private), "内网")
