"""What models and services reply: JSON in many shapes."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DECODER = json.JSONDecoder()
_PAIR = T.StructType([T.StructField("q", T.StringType()), T.StructField("a", T.StringType())])


def salvage(text: str | None):
    """The JSON value in a reply, or None.

    Thinking and fences go; the value starts at the first bracket; of a list
    that breaks off, the items that are whole remain.
    """
    t = re.sub(r"<think>.*?(?:</think>|$)", "", text or "", flags=re.DOTALL)
    if fenced := re.search(r"```(?:json)?\s*(.*?)(?:```|$)", t, flags=re.DOTALL):
        t = fenced[1]
    start = min((i for i in (t.find("["), t.find("{")) if i >= 0), default=-1)
    if start < 0:
        return None
    try:
        return _DECODER.raw_decode(t, start)[0]
    except ValueError:
        pass
    items, at = [], start + 1
    while t[start] == "[":
        at += len(re.match(r"[\s,]*", t[at:])[0])
        try:
            value, at = _DECODER.raw_decode(t, at)
        except ValueError:
            break
        items.append(value)
    return items or None


def _items(value) -> list:
    if isinstance(value, dict):
        lists = [v for v in value.values() if isinstance(v, list)]
        return lists[0] if lists else [value]
    return value if isinstance(value, list) else []


def pairs(text: str | None) -> list[dict]:
    """Question and answer pairs under any of the names in use."""
    out = []
    for item in _items(salvage(text)):
        if isinstance(item, dict):
            q = next((item[k] for k in ("q", "question", "Q") if item.get(k)), "")
            a = next((item[k] for k in ("a", "answer", "A") if item.get(k)), "")
        elif isinstance(item, list) and len(item) == 2:
            q, a = item
        else:
            continue
        if str(q).strip() and str(a).strip():
            out.append({"q": str(q).strip(), "a": str(a).strip()})
    return out


def strings(text: str | None) -> list[str]:
    out = []
    for item in _items(salvage(text)):
        if isinstance(item, dict):
            item = next((item[k] for k in ("text", "content", "q") if item.get(k)), "")
        if isinstance(item, str) and item.strip():
            out.append(item.strip())
    return out


@F.arrow_udf(T.StringType())
def json_value(reply: pa.Array) -> pa.Array:
    found = [salvage(t) for t in reply.to_pylist()]
    return pa.array([None if v is None else json.dumps(v, ensure_ascii=False) for v in found], pa.string())


@F.arrow_udf(T.ArrayType(_PAIR))
def qa_pairs(reply: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("q", pa.string()), ("a", pa.string())]))
    return pa.array([pairs(t) for t in reply.to_pylist()], kind)


@F.arrow_udf(T.ArrayType(T.StringType()))
def string_list(reply: pa.Array) -> pa.Array:
    return pa.array([strings(t) for t in reply.to_pylist()], pa.list_(pa.string()))


def _first(body: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(body, p) for p in paths])


def chat_text(body: Column) -> Column:
    return F.coalesce(
        _first(body, "$.choices[0].message.content", "$.output_text", "$.output[0].content[0].text", "$.message.content"),
        F.lit(""),
    )


def embeddings(body: Column) -> Column:
    """Vectors of a reply, by their index."""
    rows = F.from_json(body, "data array<struct<index: int, embedding: array<double>>>")["data"]
    order = F.array_sort(F.transform(rows, lambda r, i: F.struct(F.coalesce(r["index"], i).alias("i"), r["embedding"].alias("v"))))
    return F.transform(order, lambda r: r["v"])


def rerank_scores(body: Column, n: Column) -> Column:
    """A score for each of ``n`` passages; those not named get 0."""
    item = "index: int, relevance_score: double, score: double"
    parsed = F.from_json(body, f"results array<struct<{item}>>, output struct<results: array<struct<{item}>>>")
    rows = F.coalesce(parsed["results"], parsed["output"]["results"], F.array().cast(f"array<struct<{item}>>"))

    def of(i: Column) -> Column:
        mine = F.get(F.filter(rows, lambda r: r["index"] == i), F.lit(0))
        return F.coalesce(mine["relevance_score"], mine["score"], F.lit(0.0))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), of)).otherwise(F.array().cast("array<double>"))


def model_names(body: Column) -> Column:
    """Names in a list of models, once each: objects or plain texts, under
    ``data``, ``models`` or bare."""
    rows = _first(body, "$.data", "$.models", "$")
    objects = F.from_json(rows, "array<struct<id: string, model: string, name: string>>", {"mode": "PERMISSIVE"})
    plain = F.from_json(rows, "array<string>")
    named = F.transform(objects, lambda r: F.coalesce(r["id"], r["model"], r["name"]))
    is_text = rows.rlike(r'^\s*\[\s*"')
    return F.array_distinct(F.filter(F.when(is_text, plain).otherwise(named), lambda x: F.coalesce(x, F.lit("")) != ""))


def error_fields(body: Column) -> tuple[Column, Column]:
    """(code, message) of an error reply, nested or flat."""
    code = _first(body, "$.error.code", "$.error.type", "$.code")
    message = _first(body, "$.error.message", "$.message", "$.detail", "$.error")
    return code, F.substring(F.coalesce(message, body), 1, 2000)


def retry_class(status: Column, body: Column) -> Column:
    """retry, fatal or ok, by status and what the reply says."""
    said = F.regexp_replace(F.lower(F.coalesce(body, F.lit(""))), r"[\s_-]+", "")
    busy = said.rlike("ratelimit|toomanyrequests|overloaded|temporarilyunavailable|timeout")
    return (
        F.when((status >= 200) & (status < 400), "ok")
        .when(status.isin(408, 409, 425, 429, 500, 502, 503, 504) | busy, "retry")
        .otherwise("fatal")
    )


def as_input(messages: Column) -> Column:
    """Chat messages as the parts of the other request format."""
    return F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"),
            F.array(
                F.struct(
                    F.when(m["role"] == "assistant", "output_text").otherwise("input_text").alias("type"),
                    F.coalesce(m["content"], F.lit("")).alias("text"),
                )
            ).alias("content"),
        ),
    )


def clipped_reply(items: Column, most: int = 8, chars: int = 4000) -> Column:
    """The first items of a tool's reply, each text clipped."""
    return F.transform(F.slice(items, 1, most), lambda t: F.substring(t, 1, chars))
