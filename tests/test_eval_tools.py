"""All tools in one plan beside one search at a time, in plain Python."""

import math
import random

from gleaner.operators import evaluate as E
from gleaner.operators.process import hashed_vector

WORDS = [f"w{i}" for i in range(25)]


def _search(tool, query, passages):
    _, sources, mode, similarity, top, rerank = tool
    terms = list(dict.fromkeys(query.split()))
    if not terms or not sources:
        return []
    n, avgdl = len(passages), sum(len(t.split()) for _, _, _, t, _ in passages) / len(passages)
    df = {w: sum(w in t.split() for _, _, _, t, _ in passages) for w in terms}
    mine = [p for p in passages if p[0] in sources]
    lex = []
    for _, c, _, t, _ in mine:
        w = t.split()
        s = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / avgdl)) for x in terms if x in w)
        if any(x in w for x in terms):
            lex.append((-round(s, 4), c))
    lex = sorted(lex)[: max(top, 50)]
    q, sem = hashed_vector(query), []
    for _, c, _, t, _ in mine:
        sem.append((-round(float(q @ hashed_vector(t)), 6), c))
    sem = [x for x in sorted(sem)[: max(top, 50)] if -x[0] >= similarity]
    if mode == "fulltext":
        got = [(s, c, "lexical") for s, c in lex]
    elif mode == "embedding":
        got = [(s, c, "semantic") for s, c in sem]
    else:
        lr, sr = ({c: i + 1 for i, (_, c) in enumerate(x)} for x in (lex, sem))
        got = [(-round(sum(1 / (r[c] + 60) for r in (lr, sr) if c in r), 6), c, "mixed" if c in lr and c in sr else "lexical" if c in lr else "semantic") for c in {*lr, *sr}]
    if rerank:
        text = {p[1]: p[3].split() for p in passages}
        got = [(-round(sum(x in text[c] for x in terms) / len(terms), 6), c, "reranked") for _, c, _ in got]
    return [(c, note) for _, c, note in sorted(got)[:top]]


def test_tools_in_one_plan_are_tools_one_by_one(spark):
    rng = random.Random(6)
    passages = [(f"s{i % 5}", i, f"title {i % 7}", " ".join(rng.choices(WORDS, k=rng.randint(1, 25))), f"loc{i}") for i in range(120)]
    tools = [
        (1, ["s0", "s1"], "fulltext", 0.2, 5, False),
        (2, ["s0", "s2", "s4"], "mix", 0.3, 8, False),
        (3, ["s3"], "embedding", 0.1, 6, False),
        (4, ["s1", "s2", "s3"], "mix", 0.2, 4, True),
        (5, [], "mix", 0.2, 4, False),
        (6, ["s0"], "mix", 0.2, 4, False),
    ]
    cases = []
    for i in range(40):
        tool = rng.choice([1, 2, 3, 4, 5])
        cases.append((i, tool, " ".join(rng.choices(WORDS, k=rng.randint(1, 4))) if i % 13 else " ", f"title {i % 7}" if i % 2 else "nowhere"))
    t = spark.createDataFrame(tools, "tool_id int, source_ids array<string>, mode string, similarity double, top int, rerank boolean")
    c = spark.createDataFrame(cases, "case_id int, tool_id int, query string, expect string")
    p = spark.createDataFrame(passages, "source_id string, chunk_id int, title string, text string, locator string")
    v = spark.createDataFrame([(s, i, hashed_vector(x).tolist()) for s, i, _, x, _ in passages], "source_id string, chunk_id int, vec array<double>")
    runs = {r.tool_id: r for r in E.run_tools(t, c, p, v).collect()}
    assert set(runs) == {x[1] for x in cases}  # the tool without cases has no run
    by_id = {x[0]: x for x in tools}
    title = {x[1]: x[2] for x in passages}
    for tool, run in runs.items():
        own = sorted((x for x in cases if x[1] == tool), reverse=True)
        assert [i.case_id for i in run["items"]] == [x[0] for x in own] and run.total == len(own) == run.passed + run.failed
        assert (run.config.mode, run.config.limit, run.config.rerank) == (by_id[tool][2], by_id[tool][4], by_id[tool][5])
        for item, (_, _, query, expect) in zip(run["items"], own, strict=True):
            want = _search(by_id[tool], query, passages)
            assert [(h.chunk_id, h.note) for h in item.hits or []] == want
            assert item.ok == any(expect in title[x] for x, _ in want)
            if not query.strip():
                assert item.detail == "no query"
            elif not by_id[tool][1]:
                assert item.detail == "no source chosen"
            else:
                assert item.detail.startswith("found" if item.ok else f"missed; {len(want)} hits")
        assert run.passed == sum(i.ok for i in run["items"])


def test_history_and_forgetting(spark):
    runs = spark.createDataFrame([(1, "a", "2024"), (1, "b", "2025"), (2, "c", "2026")], "tool_id int, run_id string, created_at string")
    cases = spark.createDataFrame([(1, 1), (2, 2)], "tool_id int, case_id int")
    assert [r.run_id for r in E.runs_of(runs, limit=0).collect()] == ["c"]
    assert [r.run_id for r in E.runs_of(runs, 1).collect()] == ["b", "a"]
    left = E.without_tools(spark.createDataFrame([(1,)], "tool_id int"), runs, cases)
    assert [x.count() for x in left] == [1, 1]
