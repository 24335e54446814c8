"""Bucketed tables, site sync, drafts and patches."""

import os

import pytest
from pyspark.sql import functions as F

from gleaner.operators import drafts as D
from gleaner.operators import store as S

PAGES = {"pages": ("locator string, title string, text string, hash string, status string, error string", "locator"), "passages": ("page string, text string", "page")}
FETCHED = "locator string, title string, text string, hash string, code int"


def _state(store):
    pages = {r.locator: (r.title, r.text, r.hash, r.status, r.error) for r in store.current("pages").collect()}
    return pages, {r.page: r.text for r in store.current("passages").collect()}


def test_site_sync_over_batches(spark, tmp_path):
    store = S.Store(spark, str(tmp_path), PAGES)
    first = [(f"u{i}", f"T{i}", f"t{i}", f"h{i}", 200) for i in range(200)] + [("bad", None, None, None, 404), ("down", None, None, None, 503)]
    assert S.sync_site(store, spark.createDataFrame(first, FETCHED)) == 200
    before = {(n, b): f for n, b, f in store.manifest()[1]}
    assert len({b for n, b in before if n == "pages"}) > 30
    second = [("u1", "", "new", "h", 200), ("u2", "T", "t2", "h2", 200), ("u3", None, None, None, 410), ("u4", None, None, None, 503), ("fresh", None, "f", "hf", 200)]
    assert S.sync_site(store, spark.createDataFrame(second, FETCHED)) == 3
    pages, passages = _state(store)
    assert pages["u1"] == ("T1", "new", "h", "synced", None) and passages["u1"] == "new"
    assert pages["u2"] == ("T", "t2", "h2", "synced", None) and passages["u2"] == "t2"
    assert "u3" not in pages and "u3" not in passages
    assert pages["u4"] == ("T4", "t4", "h4", "error", "fetch failed: HTTP 503") and passages["u4"] == "t4"
    assert pages["fresh"][0] == "fresh" and pages["u5"] == ("T5", "t5", "h5", "synced", None) and len(pages) == 200
    # only the buckets of touched pages were written
    after = {(n, b): f for n, b, f in store.manifest()[1]}
    moved = {b for (n, b), f in after.items() if n == "pages" and before.get((n, b)) != f}
    assert 0 < len(moved) <= 5
    # a page that failed is written again though its text is the same
    assert S.sync_site(store, spark.createDataFrame([("u4", "T4", "t4", "h4", 200)], FETCHED)) == 1
    assert _state(store)[0]["u4"][3:] == ("synced", None)
    assert S.swept(store, keep=1) > 0 and _state(store)[0].keys() == pages.keys()


def test_all_failed_sync_is_an_error(spark, tmp_path):
    store = S.Store(spark, str(tmp_path), PAGES)
    change = store.change()
    change.replace("pages", spark.createDataFrame([("a", "A", "x", "h", "syncing", None), ("b", "B", "y", "h", "syncing", None), ("c", "C", "z", "h", "synced", None)], PAGES["pages"][0]))
    change.replace("passages", spark.createDataFrame([("b", "y")], "page string, text string"))
    change.commit()
    with pytest.raises(S.SyncFailed):
        S.sync_site(store, spark.createDataFrame([("c", None, None, None, 404)], FETCHED), "site is down")
    pages, _ = _state(store)
    assert pages["a"][3:] == ("error", "site is down") and pages["b"][3] == "syncing" and "c" not in pages


UNIT = "array<struct<title: string, text: string, answer: string, indexes: string>>"
DRAFT = f"draft_id string, kb_id string, type string, title string, locator string, raw_text string, status string, expires_at string, units {UNIT}"


def _draft(i, locator, texts, status="ready", expires="2030", kind="web"):
    return (i, "kb", kind, f"Title {locator}", locator, " ".join(texts), status, expires, [(f"t{n}", t, None, None) for n, t in enumerate(texts)])


def _results(store):
    return {r.draft_id: (r.status, r.reason) for r in store.collect()}


def test_drafts_show_all_at_once(spark, tmp_path, monkeypatch):
    store = D.knowledge_store(spark, str(tmp_path))
    rows = [_draft("d1", "u1", ["alpha one", "beta two", ""]), _draft("d2", "u2", ["gamma three"]), _draft("d3", "u3", ["x"], "committed"), _draft("d4", "u4", ["x"], expires="2020"), _draft("d5", "u5", [""]), _draft("d0", "u1", ["older"])]
    got = _results(D.commit_drafts(store, spark.createDataFrame(rows, DRAFT), "2025"))
    assert got == {"d1": ("committed", None), "d2": ("committed", None), "d3": ("refused", "not ready"), "d4": ("refused", "expired"), "d5": ("refused", "nothing to store"), "d0": ("refused", "superseded")}
    version = store.manifest()[0]
    passages = {r.text: r for r in store.current("passages").collect()}
    assert set(passages) == {"alpha one", "beta two", "gamma three"} and passages["beta two"].position == 2 and passages["beta two"].locator == "u1 #2"
    assert {r.chunk_id for r in store.current("vectors").collect()} == {p.chunk_id for p in passages.values()}
    assert [r.chunk_id for r in store.index().search(["alpha"]).collect()] == [passages["alpha one"].chunk_id]
    assert {r.locator: (r.n, r.hash is not None) for r in store.current("sources").collect()} == {"u1": (2, True), "u2": (1, True)}

    # a failure between two tables leaves the old version readable
    def fails(texts):
        raise RuntimeError("model is down")

    again = spark.createDataFrame([_draft("d6", "u1", ["delta four"])], DRAFT)
    with pytest.raises(Exception, match="model is down"):
        D.commit_drafts(store, again, "2025", fails)
    replace = S.Change.replace
    monkeypatch.setattr(S.Change, "replace", lambda self, name, *a: (_ for _ in ()).throw(OSError("disk")) if name == "vectors" else replace(self, name, *a))
    with pytest.raises(OSError):
        D.commit_drafts(store, again, "2025")
    monkeypatch.undo()
    assert store.manifest()[0] == version and {r.text for r in store.current("passages").collect()} == set(passages)
    assert store.index().search(["delta"]).count() == 0
    source = passages["alpha one"].source_id
    assert _results(D.commit_drafts(store, again, "2025")) == {"d6": ("committed", None)}
    assert {r.text for r in store.current("passages").collect()} == {"delta four", "gamma three"}
    assert {r.source_id for r in store.current("passages").where("text = 'delta four'").collect()} == {source}
    assert store.index().search(["alpha"]).count() == 0 and store.index().passages() == 2


def test_one_passage_is_patched(spark, tmp_path):
    store = D.knowledge_store(spark, str(tmp_path))
    D.commit_drafts(store, spark.createDataFrame([_draft("d1", "u1", ["alpha one", "beta two"]), _draft("d2", "u2", ["gamma three"])], DRAFT), "2025")
    of = {r.text: r.chunk_id for r in store.current("passages").collect()}
    vectors = {(r.chunk_id, r.kind): list(r.vec) for r in D.current_vectors(store).collect()}
    base = [e for e in store.manifest()[1] if e[0] in ("passages", "vectors")]
    log = str(tmp_path / "asked")

    def model(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    patch = spark.createDataFrame([(of["beta two"], " ", "beta changed here", None, "extra"), ("no such", "t", "x", None, None)], "chunk_id string, title string, text string, answer string, indexes string")
    assert D.patch_passages(store, patch, model) == 1
    assert set(open(log).read().split("\n")) <= {"t1\nbeta changed here".split("\n")[0], "beta changed here", ""}
    assert [e for e in store.manifest()[1] if e[0] in ("passages", "vectors")] == base  # untouched

    def check():
        now = {r.chunk_id: r for r in D.current_passages(store).collect()}
        assert len(now) == 3 and now[of["beta two"]].text == "beta changed here" and now[of["beta two"]].title == "t1" and now[of["beta two"]].position == 2
        got = {(r.chunk_id, r.kind): list(r.vec) for r in D.current_vectors(store).collect()}
        assert {k: v for k, v in got.items() if k[0] != of["beta two"]} == {k: v for k, v in vectors.items() if k[0] != of["beta two"]}
        assert all(v[1] == 1.0 and len(v) == 2 for k, v in got.items() if k[0] == of["beta two"])
        index = store.index()
        assert [r.chunk_id for r in index.search(["changed"]).collect()] == [of["beta two"]] and index.search(["two"]).count() == 0
        assert [r.chunk_id for r in index.search(["extra"]).collect()] == [of["beta two"]] and index.passages() == 3

    check()
    D.fold(store)
    assert store.current("patches").count() == 0
    check()
    assert os.path.isdir(tmp_path / "versions")
    # a draft for the same source takes the patch away
    D.commit_drafts(store, spark.createDataFrame([_draft("d9", "u1", ["omega"])], DRAFT), "2025")
    assert {r.text for r in D.current_passages(store).collect()} == {"omega", "gamma three"}
    assert D.open_drafts(spark.createDataFrame([("a", "k", "f", "ready", "2026", "2024"), ("b", "k", "f", "ready", "2026", "2025"), ("c", "k", "f", "ready", "2020", "2026")], "draft_id string, kb_id string, fingerprint string, status string, expires_at string, created_at string"), "2025").select("draft_id").collect()[0][0] == "b"


def test_drafts_store_each_text_once(spark, tmp_path, monkeypatch):
    from gleaner.operators import drafts as D

    stored, seen = D.stored, []
    monkeypatch.setattr(D, "stored", lambda df: seen.append(set(df.columns)) or stored(df))
    rows = spark.createDataFrame(
        [("1", "kb", "web", "t", "l", "raw", "ready", "2030", [("h", "text", "", "")])],
        "draft_id string, kb_id string, type string, title string, locator string, raw_text string, status string, expires_at string, "
        "units array<struct<title: string, text: string, answer: string, indexes: string>>",
    )
    s = D.knowledge_store(spark, str(tmp_path))
    assert D.commit_drafts(s, rows, "2025").first().status == "committed"
    assert not any({"raw_text", "units"} & c for c in seen) and sum("_units" in c for c in seen) == 1
    assert s.current("sources").first().hash and s.current("passages").first().text == "text"


def test_rows_that_stay_are_not_shuffled(spark, tmp_path):
    """Of a bucket that a change touches, other owners' rows are written where
    they are read; new rows are, where tasks have enough of them."""
    from gleaner.operators.cuts import in_place

    store = S.Store(spark, str(tmp_path), {"t": ("id string, text string", "id")})
    rows = spark.range(4000).selectExpr("cast(id as string) as id", "concat('text ', id) as text").coalesce(2)
    assert in_place(rows) and not in_place(rows.limit(500).repartition(4))
    change = store.change()
    change.replace("t", rows)
    change.commit()
    # the tasks' own files, in each bucket
    assert len(store.current("t").inputFiles()) == 2 * S.BUCKETS
    change = store.change()
    change.replace("t", spark.createDataFrame([("7", "new"), ("x", "more")], "id string, text string"))
    change.commit()
    got = {r.id: r.text for r in store.current("t").collect()}
    assert len(got) == 4001 and got["7"] == "new" and got["x"] == "more" and got["8"] == "text 8"


def test_drafts_of_one_source_and_no_text_twice(spark, tmp_path, monkeypatch):
    """Passages are not stored beside the drafts they come from; sources that
    were known keep their ids; of drafts for one source the greatest id counts."""
    from gleaner.operators import drafts as D

    store, seen, kept = D.knowledge_store(spark, str(tmp_path)), [], D.stored
    monkeypatch.setattr(D, "stored", lambda df: seen.append(set(df.columns)) or kept(df))
    first = [_draft("a", "u1", ["one"]), _draft("b", "u1", ["two", "three"]), _draft("c", "u2", ["four"])]
    got = _results(D.commit_drafts(store, spark.createDataFrame(first, DRAFT), "2025"))
    assert got == {"a": ("refused", "superseded"), "b": ("committed", None), "c": ("committed", None)}
    assert not any("text" in c for c in seen)
    ids = {r.locator: r.source_id for r in store.current("sources").collect()}
    assert _results(D.commit_drafts(store, spark.createDataFrame([_draft("d", "u1", ["five"])], DRAFT), "2025")) == {"d": ("committed", None)}
    assert {r.locator: r.source_id for r in store.current("sources").collect()} == ids
    assert {r.text for r in D.current_passages(store).collect()} == {"five", "four"}
