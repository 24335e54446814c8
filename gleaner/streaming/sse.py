"""Model replies that arrive as server-sent events.

The parser is column expressions; the merge keeps, for each stream, the text
so far and the tool calls by index, whose names and arguments concatenate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def parse_event(data: Column) -> Column:
    """kind (token, thinking, tool, done, other), text, tool index and name of
    one ``data:`` line, in either of the two wire formats."""
    body = F.trim(F.regexp_replace(F.coalesce(data, F.lit("")), r"^data:\s*", ""))
    kind = F.get_json_object(body, "$.type")
    delta = F.get_json_object(body, "$.choices[0].delta.content")
    thought = F.get_json_object(body, "$.choices[0].delta.reasoning_content")
    call = "$.choices[0].delta.tool_calls[0]"
    index = F.get_json_object(body, f"{call}.index").try_cast("int")
    return F.struct(
        F.when((body == "[DONE]") | (kind == "response.completed"), "done")
        .when((kind == "response.output_text.delta") | delta.isNotNull(), "token")
        .when(thought.isNotNull(), "thinking")
        .when(index.isNotNull(), "tool")
        .otherwise("other")
        .alias("kind"),
        F.coalesce(
            F.when(kind == "response.output_text.delta", F.get_json_object(body, "$.delta")),
            delta,
            thought,
            F.get_json_object(body, f"{call}.function.arguments"),
            F.lit(""),
        ).alias("text"),
        index.alias("tool"),
        F.coalesce(F.get_json_object(body, f"{call}.function.name"), F.lit("")).alias("name"),
    )


def merged(events: DataFrame, key: str = "stream_id", order: str = "seq") -> DataFrame:
    """Batch: stream_id, answer, thinking, n_events; events have kind, text."""
    rows = F.array_sort(F.collect_list(F.struct(order, "kind", "text")))

    def joined(kind: str) -> Column:
        return F.array_join(F.transform(F.filter("e", lambda x: x["kind"] == kind), lambda x: x["text"]), "")

    return events.groupBy(key).agg(rows.alias("e")).select(
        key,
        joined("token").alias("answer"),
        joined("thinking").alias("thinking"),
        F.size("e").cast("long").alias("n_events"),
    )


def merged_tools(events: DataFrame, key: str = "stream_id", order: str = "seq") -> DataFrame:
    """Batch: stream_id, tool, name, arguments of each tool call."""
    rows = F.array_sort(F.collect_list(F.struct(order, "name", "text")))
    return (
        events.where("kind = 'tool'")
        .groupBy(key, "tool")
        .agg(rows.alias("e"))
        .select(
            key,
            "tool",
            F.array_join(F.transform("e", lambda x: x["name"]), "").alias("name"),
            F.array_join(F.transform("e", lambda x: x["text"]), "").alias("arguments"),
        )
    )


def merge_stream(events: DataFrame, idle: str | None = None) -> DataFrame:
    """Streaming: a row for each reply once its ``done`` event has come, and
    all events before it, of any kind; ``seq`` of the done event is their
    number.  With ``idle``, such as "10 minutes", a reply that hears nothing for
    so long is given as it is; that needs a trigger that goes on, as one that
    ends with its input would wait for ever.

    ``events``: stream_id, seq, kind, text.  The state of a stream is its
    pieces so far by sequence number, so late or repeated pieces do no harm;
    it ends with the reply.
    """

    def reply(key: tuple, pieces: dict[int, str]) -> pd.DataFrame:
        answer = "".join(pieces[s] for s in sorted(pieces))
        return pd.DataFrame({"stream_id": [key[0]], "answer": [answer], "n_events": [len(pieces)]})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, texts, last = state.get if state.exists else ([], [], None)
        pieces = dict(zip(seqs, texts, strict=True))
        if state.hasTimedOut:
            state.remove()
            yield reply(key, pieces)
            return
        for b in batches:
            for s, k, t in zip(b["seq"], b["kind"], b["text"], strict=True):
                if k == "done":
                    last = int(s)
                else:
                    pieces.setdefault(int(s), t if k == "token" and t is not None else "")
        if last is not None and len(pieces) >= last:
            state.remove()
            yield reply(key, pieces)
        else:
            state.update((list(pieces), list(pieces.values()), last))
            if wait:
                state.setTimeoutDuration(wait)

    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    return events.groupBy("stream_id").applyInPandasWithState(
        step,
        "stream_id long, answer string, n_events long",
        "seqs array<long>, texts array<string>, last long",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout,
    )


def merge_tool_stream(events: DataFrame, idle: str | None = None) -> DataFrame:
    """Streaming ``merged_tools``: the tool calls of a reply, a row for each
    index, once its ``done`` event and all events before it have come, or with
    ``idle`` after so long a silence.

    ``events``: stream_id, seq, kind, tool, name, text.  The state of a reply
    is the pieces of its calls, by sequence number, and the numbers of its other
    events; names and arguments are put together in order at the end, so late
    and repeated pieces do no harm.
    """

    def calls(key: tuple, pieces: dict[int, tuple]) -> pd.DataFrame:
        out: dict[int, list[str]] = {}
        for s in sorted(pieces):
            tool, name, text = pieces[s]
            if tool is not None and tool >= 0:
                slot = out.setdefault(tool, ["", ""])
                slot[0] += name
                slot[1] += text
        rows = [(key[0], i, n, a) for i, (n, a) in sorted(out.items())]
        return pd.DataFrame(rows, columns=["stream_id", "tool", "name", "arguments"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, tools, names, texts, last = state.get if state.exists else ([], [], [], [], None)
        pieces = dict(zip(seqs, zip(tools, names, texts, strict=True), strict=True))
        if state.hasTimedOut:
            state.remove()
            yield calls(key, pieces)
            return
        for b in batches:
            for s, k, i, n, t in zip(b["seq"], b["kind"], b["tool"], b["name"], b["text"], strict=True):
                if k == "done":
                    last = int(s)
                elif k == "tool" and not pd.isna(i):
                    pieces.setdefault(int(s), (int(i), n or "", t or ""))
                else:
                    pieces.setdefault(int(s), (-1, "", ""))
        if last is not None and len(pieces) >= last:
            state.remove()
            yield calls(key, pieces)
        else:
            state.update((list(pieces), *map(list, zip(*pieces.values(), strict=True)), last) if pieces else ([], [], [], [], last))
            if wait:
                state.setTimeoutDuration(wait)

    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    return events.groupBy("stream_id").applyInPandasWithState(
        step,
        "stream_id long, tool int, name string, arguments string",
        "seqs array<long>, tools array<int>, names array<string>, texts array<string>, last long",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout,
    )
