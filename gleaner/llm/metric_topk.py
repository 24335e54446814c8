"""Exact top-k by inner product, with M-trees searched best node first.

Vectors become points of a metric space: with M the greatest squared norm, each
gets one more coordinate, sqrt(M - |v|^2), and a query gets 0 there; then the
squared distance of query q and point v is |q|^2 + M - 2 q.v, so the nearest
points have the greatest products.

Points are dealt to trees by the nearest of a bounded number of pivots; a pivot
with more rows than a tree holds (equal vectors, say) is split by a hash.  A
task builds its tree from the bottom: rows are halved by their distances to two
far points until they fill pages, runs of pages fill the pages above.  A page
holds its entries' vectors, distances to the page's routing object, covering
radii and smallest ids; it is one row of a table.

A query first searches the tree whose root is nearest, then, with the k-th
score found there, those trees whose roots leave room for a better one.  Within
a tree it goes from the leaf of the greatest possible score to lesser ones and
ends where none can count; the queries of a block do so together.  By the
triangle inequality the stored distances to the routing object bound an entry's
distance; only entries whose bound may still count, for some query of those
that are at the page, are computed.  Bounds have a margin for rounding; scores
are exact integers and decide.

Edge cases: vectors that are null, or hold a null or non-finite component, take
no part, neither as queries nor as candidates.  Only vectors of one length are
compared (those of no components have score 0).  Repeated rows are candidates
of each other; rows with a null id are candidates, after all others of equal
score, and no queries.  A score beyond 63 bits and a sign is the greatest or least such number.
An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import bound_batches, written

PAGE = 64
_LAST = (1 << 63) - 1
_EXACT = float(1 << 53)


def packed(v: np.ndarray) -> bytes:
    """Whole numbers as bytes, in the narrowest of int8, int16, int32, float64."""
    top = np.abs(v).max(initial=0)
    kind = "<i1" if top < 1 << 7 else "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return v.astype(kind).tobytes()


def unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows of float64 from ``packed`` vectors of ``dim`` components."""
    out = np.zeros((len(raw), dim))
    for k, x in enumerate(raw):
        if dim:
            out[k] = np.frombuffer(x, dtype={1: "<i1", 2: "<i2", 4: "<i4", 8: "<f8"}[len(x) // dim])
    return out


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all queries with all rows, as 64-bit numbers."""
    if np.abs(rows).max(initial=0) * np.abs(q).max(initial=0) * max(1, q.shape[1]) < _EXACT:
        return (q @ rows.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(x, r, strict=True)) for r in rows] for x in q]
    return np.array([[max(-_LAST, min(_LAST, x)) for x in line] for line in exact], dtype=np.int64).reshape(len(q), len(rows))


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))[:, None]])


def _distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - one) ** 2).sum(axis=1))


def _order(points: np.ndarray) -> np.ndarray:
    """Rows in an order of which every run of PAGE, PAGE^2, ... is close
    together: halves by the difference of distances to two far points."""
    order = np.arange(len(points))
    stack = [(0, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a <= PAGE:
            continue
        own = order[a:b]
        x = points[own]
        p = x[np.argmax(_distances(x, x[0]))]
        dp = _distances(x, p)
        key = dp - _distances(x, x[np.argmax(dp)])
        order[a:b] = own[np.argsort(key, kind="stable")]
        unit = PAGE
        while unit * PAGE < b - a:
            unit *= PAGE
        mid = a + -(-(b - a) // unit) // 2 * unit
        stack += [(a, mid), (mid, b)]
    return order


def build(vectors: np.ndarray, ids: np.ndarray, top: float) -> list[dict]:
    """Pages of an M-tree, the leaves first, the root's last.

    Each page: ``first`` (number of its first entry: a row, or a page of the
    level below), ``routing`` (row of its routing object), and for its entries
    the rows of their objects, distances to the routing object, covering radii
    and smallest ids.
    """
    points = _lifted(vectors, top)
    n, level, pages = len(points), 0, []
    objects, low = np.arange(n), ids  # of the entries of this level
    span = 1  # rows below an entry
    while True:
        made, count = [], len(objects)
        for first in range(0, count, PAGE):
            own = objects[first : first + PAGE]
            rows = points[first * span : (first + PAGE) * span]
            centre = rows.mean(axis=0)
            routing = int(own[np.argmin(_distances(points[own], centre))])
            away = _distances(points[own], points[routing])
            radii = np.zeros(len(own))
            if level:
                for k, o in enumerate(own):
                    at = (first + k) * span
                    radii[k] = _distances(points[at : at + span], points[o]).max()
            made.append({"level": level, "first": first, "routing": routing, "objects": own, "away": away, "radii": radii, "low": low[first : first + PAGE]})
        pages += made
        if len(made) == 1:
            return pages
        objects = np.array([p["routing"] for p in made])
        low = np.array([p["low"].min() for p in made])
        span, level = span * PAGE, level + 1


class Tree:
    """A tree read from its pages, and the search of many queries in it."""

    def __init__(self, pages: pd.DataFrame, dim: int, top: float):
        self.top, self.levels = top, {}
        self.computed = self.spared = 0
        for r in pages.sort_values(["level", "page"]).itertuples():
            away, radii = np.frombuffer(r.bounds, dtype="<f8").reshape(2, -1)
            rows, low = np.frombuffer(r.ids, dtype="<i8").reshape(2, -1)
            self.levels.setdefault(r.level, []).append((unpacked(r.vectors, dim), away, radii, rows, low, int(r.routing)))

    def search(self, q: np.ndarray, k: int, own: np.ndarray, floor: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """(query, score, id, row) of each query's k best rows but its ``own``;
        of those only that do not come after ``floor`` (scores, ids).

        Each query visits leaves from the one of the greatest possible score
        on, until none can hold a row before its k-th; the queries advance
        together, by 1, 2, 4, ... leaves, so that a leaf is met by many at once.
        """
        base = ((q * q).sum(axis=1) + self.top)[:, None]
        margin = 1e-9 * (base + 1)
        score, ident = floor[0].copy(), floor[1].copy()  # of the k-th row so far

        def room(distance: np.ndarray, base=base, margin=margin) -> np.ndarray:
            # scores are clipped, so their bounds are as well
            return np.maximum(np.floor((base - np.maximum(distance, 0) ** 2) / 2 + margin), -float(_LAST))

        def may(bound: np.ndarray, low: np.ndarray, of=slice(None)) -> np.ndarray:
            s, i = score[of][:, None], ident[of][:, None]
            return ~(bound < s) & ~((bound == s) & (low > i))

        def distance(points: np.ndarray) -> np.ndarray:
            self.computed += len(q) * len(points)
            return np.sqrt(np.maximum(base - 2 * (q @ points.T), 0))

        top = max(self.levels)
        v, *_, routing = self.levels[top][0]
        to_routing = distance(v[routing : routing + 1])  # of the pages of a level
        bounds, low = np.full((len(q), 1), np.inf), np.array([-_LAST - 1])
        for level in range(top, 0, -1):
            ub, to, lows = [], [], []
            for n, (v, away, radii, _, below, _) in enumerate(self.levels[level]):
                bound = room(np.abs(to_routing[:, n : n + 1] - away) - radii)
                bound = np.minimum(bound, bounds[:, n : n + 1])
                d = np.full(bound.shape, np.nan)
                live = np.flatnonzero(may(bound, below).any(axis=0))
                self.spared += len(q) * (len(v) - len(live))
                d[:, live] = distance(v[live])
                bound[:, live] = np.fmin(bound[:, live], room(d[:, live] - radii[live]))
                ub.append(bound)
                to.append(d)
                lows.append(below)
            bounds, to_routing, low = np.hstack(ub), np.hstack(to), np.concatenate(lows)
        best = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        order = np.argsort(-bounds, axis=1, kind="stable")
        at, stride = 0, 1
        while at < order.shape[1]:
            asked = order[:, at : at + stride]
            at, stride = at + stride, stride * 2
            wanted = may(np.take_along_axis(bounds, asked, axis=1), low[asked])
            who, nth = np.nonzero(wanted)
            if not len(who):
                continue
            page = asked[who, nth]
            turn = np.argsort(page, kind="stable")
            who, page = who[turn], page[turn]
            cuts = np.flatnonzero(np.diff(page)) + 1
            found = [best]
            for of, n in zip(np.split(who, cuts), page[np.concatenate(([0], cuts))].tolist(), strict=True):
                v, away, _, rows, ids, _ = self.levels[0][n]
                live = may(room(np.abs(to_routing[of, n : n + 1] - away), base[of], margin[of]), ids, of)
                entries = np.flatnonzero(live.any(axis=0))
                self.computed += len(of) * len(entries)
                self.spared += len(of) * (len(v) - len(entries))
                s = products(q[of], v[entries])
                ok = (s > score[of][:, None]) | ((s == score[of][:, None]) & (ids[entries] <= ident[of][:, None]))
                a, b = np.nonzero(ok & (rows[entries] != own[of][:, None]))
                found.append((of[a], s[a, b], ids[entries][b], rows[entries][b]))
            who, s, ids, rows = (np.concatenate(x) for x in zip(*found, strict=True))
            turn = np.lexsort((rows, ids, -s, who))
            who = who[turn]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            best = tuple(x[rank < k] for x in (who, s[turn], ids[turn], rows[turn]))
            last = rank == k - 1
            score[who[last]], ident[who[last]] = s[turn][last], ids[turn][last]
        return best


def _parts(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: float, is_query: Column) -> DataFrame:
    """(rid, id, query, dim, v) of the rows that take part; v holds
    floor(scale * component) of each component, ``packed``."""
    some = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector_col).cast("array<double>").alias("v"))
    some = some.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            ends = np.cumsum(size)
            numbers = np.floor(scale * flat)
            raw = [packed(numbers[e - n : e]) for n, e in zip(size.tolist(), ends.tolist(), strict=True)]
            norm = [float(numbers[e - n : e] @ numbers[e - n : e]) for n, e in zip(size.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("query"), pa.array(size, pa.int32()), pa.array(norm), pa.array(raw, pa.binary())], ["id", "query", "dim", "norm", "v"])

    out = some.mapInArrow(task, "id long, query boolean, dim int, norm double, v binary")
    return out.withColumn("rid", F.monotonically_increasing_id())


def _nearest(roots: dict[int, tuple[np.ndarray, np.ndarray]], tops: dict[int, float], b: pa.RecordBatch, lift: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the rows of each length: their places, vectors as points (lifted, or
    with 0 as last coordinate), and distances to the objects of ``roots``."""
    dims, raw = _parts(b, "dim"), b.column("v").to_pylist()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        v = unpacked([raw[i] for i in at.tolist()], dim)
        points = _lifted(v, tops[dim]) if lift else np.hstack([v, np.zeros((len(v), 1))])
        objects = roots[dim][0]
        far = (points**2).sum(axis=1)[:, None] + (objects**2).sum(axis=1)[None, :] - 2 * points @ objects.T
        yield at, v, points, np.sqrt(np.maximum(far, 0))


def _by_length(rows: list, tops: dict[int, float]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dim -> (points, numbers) of (dim, number, v, ...) rows."""
    out = {}
    for dim in tops:
        own = [r for r in rows if r[0] == dim]
        out[dim] = (_lifted(unpacked([bytes(r[2]) for r in own], dim), tops[dim]), np.array([r[1] for r in own], dtype=np.int64))
    return out


def top_products(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    tree_rows: int = 8192,
    query_rows: int = 1024,
    pivots: int = 64,
    most_trees: int = 16384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query``, the
    ``k`` other rows of the greatest inner products of floor(scale * x), ties to
    the smaller id.

    Broadcast: ``pivots`` points and the roots of the trees; those are at most
    about ``most_trees`` (trees grow beyond ``tree_rows`` rows for that) plus the
    pivots.  A task holds one tree and about ``query_rows`` queries.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = written(whole_numbers(df, id_col, vector_col, scale, is_query))
    facts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.sum(F.col("query").cast("long")).alias("q")).collect()
    tops = {r.dim: r.top for r in facts}
    n, n_query = sum(r.n for r in facts), sum(r.q for r in facts)
    if not n_query:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    tree_rows = max(tree_rows, -(-n // most_trees))
    # the pivots: rows of the smallest hashes, a bounded number of each length
    h = Window.partitionBy("dim").orderBy(F.xxhash64("rid"), "rid")
    chosen = rows.select("dim", "rid", "v", F.row_number().over(h).alias("r")).where(F.col("r") <= pivots).drop("r").collect()
    near = spark.sparkContext.broadcast((_by_length(sorted(chosen), tops), tops))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects, tops = near.value
        for b in batches:
            pivot = np.zeros(len(b), dtype=np.int32)
            for at, _, _, far in _nearest(objects, tops, b, True):
                pivot[at] = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot)], [*b.schema.names, "pivot"])

    dealt = written(rows.mapInArrow(deal, "id long, query boolean, dim int, norm double, v binary, rid long, pivot int"))
    sizes = dealt.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("m")).withColumn("parts", F.ceil(F.col("m") / tree_rows).cast("long"))
    keyed = dealt.join(F.broadcast(sizes), ["dim", "pivot"])  # a row a pivot
    tree = F.struct("dim", "pivot", F.pmod(F.xxhash64(F.lit("part"), "rid"), "parts").alias("part"))
    keyed = keyed.select(F.xxhash64(tree).alias("tree"), "dim", "rid", F.coalesce("id", F.lit(_LAST)).alias("id"), "v")

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        pdf = pdf.sort_values(["id", "rid"], kind="stable")
        v = unpacked(pdf["v"].tolist(), dim)
        order = _order(_lifted(v, near.value[1][dim]))
        v, ids, rid = v[order], pdf["id"].to_numpy()[order], pdf["rid"].to_numpy()[order]
        out = []
        for p in build(v, ids, near.value[1][dim]):
            entries = rid[p["objects"]] if p["level"] == 0 else p["first"] + np.arange(len(p["objects"]))
            out.append({
                "tree": key[0], "dim": dim, "level": p["level"], "page": p["first"] // PAGE,
                "routing": int(np.flatnonzero(p["objects"] == p["routing"])[0]), "vectors": [packed(x) for x in v[p["objects"]]],
                "bounds": np.stack([p["away"], p["radii"]]).tobytes(), "ids": np.stack([entries, p["low"]]).astype("<i8").tobytes(),
                "reach": None,
            })
        top = out[-1]
        top["reach"] = float(np.frombuffer(top["bounds"], dtype="<f8").reshape(2, -1).sum(axis=0).max())
        return pd.DataFrame(out)

    pages = written(keyed.groupBy("tree").applyInPandas(grow, "tree long, dim int, level int, page int, routing int, vectors array<binary>, bounds binary, ids binary, reach double"))
    tops_of = pages.where(F.col("reach").isNotNull()).select("dim", "tree", F.get("vectors", F.col("routing")).alias("v"), "reach").collect()
    roots = sorted((r.dim, r.tree, bytes(r.v), r.reach) for r in tops_of)
    reach = {dim: np.array([r[3] for r in roots if r[0] == dim]) for dim in tops}
    shared = spark.sparkContext.broadcast((_by_length(roots, tops), tops, reach))
    blocks = max(1, -(-n_query // query_rows))
    queries = dealt.where("query").select("rid", "id", "dim", "v", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects, tops, _ = shared.value
        for b in batches:
            tree = np.zeros(len(b), dtype=np.int64)
            for at, _, _, far in _nearest(objects, tops, b, False):
                tree[at] = objects[int(b.column("dim")[int(at[0])].as_py())][1][far.argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree)], [*b.schema.names, "tree"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other trees that may hold a row before the k-th found so far."""
        objects, tops, reach = shared.value
        for b in batches:
            seen, n_found, score = _parts(b, "seen"), _parts(b, "n_found"), _parts(b, "kth")
            where, trees = [], []
            for at, v, _, far in _nearest(objects, tops, b, False):
                dim = int(b.column("dim")[int(at[0])].as_py())
                base = (v * v).sum(axis=1) + tops[dim]
                room = np.floor((base[:, None] - np.maximum(far - reach[dim][None, :], 0) ** 2) / 2 + 1e-9 * (base[:, None] + 1))
                room = np.maximum(room, -float(_LAST))
                go = ~(room < score[at][:, None]) | (n_found[at] < k)[:, None]
                go &= objects[dim][1][None, :] != seen[at][:, None]
                i, j = np.nonzero(go)
                where.append(at[i])
                trees.append(objects[dim][1][j])
            rows = pa.array(np.concatenate(where) if where else np.zeros(0, np.int64))
            part = b.take(rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(trees) if trees else np.zeros(0, np.int64))], [*b.schema.names, "tree"])

    def look(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["rid", "query_id", "score", "vec_id", "row"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        dim = int(left["dim"].iloc[0])
        full = (right["n_found"] >= k).to_numpy()
        floor = np.where(full, right["kth"], -_LAST - 1), np.where(full, right["kth_id"], _LAST)
        rid = right["rid"].to_numpy()
        who, *found = Tree(left, dim, shared.value[1][dim]).search(unpacked(right["v"].tolist(), dim), k, rid, floor)
        return pd.DataFrame(dict(zip(names, (rid[who], right["id"].to_numpy()[who], *found), strict=True)))

    def searched(asked: DataFrame) -> DataFrame:
        # a tree goes to the blocks that ask for it
        units = asked.select(F.col("tree").alias("unit_tree"), F.col("block").alias("unit_block")).distinct()
        sent = pages.join(units, F.col("tree") == F.col("unit_tree")).groupBy("unit_tree", "unit_block")
        found = sent.cogroup(asked.groupBy("tree", "block")).applyInPandas(look, "rid long, query_id long, score long, vec_id long, row long")
        return written(found)

    asked = queries.mapInArrow(first, "rid long, id long, dim int, v binary, block int, tree long")
    asked = written(asked.withColumns({"n_found": F.lit(0), "kth": F.lit(0).cast("long"), "kth_id": F.lit(0).cast("long")}))
    one = searched(asked)
    kth = one.groupBy("rid").agg(F.count(F.lit(1)).cast("int").alias("n_found"), F.min(F.struct("score", (-F.col("vec_id")).alias("i"))).alias("worst"))
    kth = kth.select("rid", "n_found", F.col("worst.score").alias("kth"), (-F.col("worst.i")).alias("kth_id"))
    known = asked.drop("n_found", "kth", "kth_id").withColumnRenamed("tree", "seen").join(kth, "rid", "left").na.fill(0, ["n_found", "kth", "kth_id"])
    kept = "rid long, id long, dim int, v binary, block int, seen long, n_found int, kth long, kth_id long"
    more = written(known.mapInArrow(rest, f"{kept}, tree long"))
    two = searched(more)
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id", "row"))
    both = one.unionByName(two).withColumn("rank", rank).where(F.col("rank") <= k)
    return both.select("query_id", "rank", F.when(F.col("vec_id") != _LAST, F.col("vec_id")).alias("vec_id"), "score")
