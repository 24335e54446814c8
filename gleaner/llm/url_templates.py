"""URL filtering with host rules and a path-template tree.

Level by level, the segments below each node of a host's tree are counted.
Branches of a node whose urls go on alike (by the commonest shape of what
follows) fall into cells by their share of bad labels, in eighths of a right
angle (arcsine of the root), and by their share of labelled urls, in quarters.
The cells of a shape, in this order, are one pool at first.  A pool is split in
two where a likelihood-ratio test over shapes and labels finds the greatest
difference, while this test tells its two parts, or any cell and the rest of
its pool, apart.  So every cell is like the whole of its pool, not only like
its neighbour.  A pool stays in the tree if it differs, by the same test, from
all urls of the node taken together; all others are merged into one wildcard
branch.  A pool of several branches is named by the first of them and the
number of others, ``{first+others}``.  The share that a branch has of its node
doesn't matter, only that it has ``least_urls``.  A node has 276 cells at most,
however many branches it has.

This goes on while a node has ``least_urls`` urls with a further segment.
Below any other node no branch can stay, so its urls are done at once.  The
tree is made from the distinct (host, path) and their counts; the rows are not
moved before the end.

Every leaf is a template.  Its purity is the share of bad among its labelled
urls, smoothed towards the rates of its host and, with half the weight, of the
same template on all hosts, and these towards ``prior``.  Templates at or above
``reject`` are blocked.  Labels come from a column, or else from the rules' own
verdicts; as the rules aren't a sample of the urls, ``prior`` is a parameter.

Edge cases: a null url, or one without ``://``, has an empty host and path;
repeated rows get equal results; without labels every purity is ``prior``; an
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut, written

SHAPES = ["end", "number", "hex", "word", "file", "other"]


def host_and_path(url: str) -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; rules are (host, path,
    verdict), a short list."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def shape(seg: Column) -> Column:
    return (
        F.when(seg.isNull(), "end")
        .when(seg.rlike(r"^\d+$"), "number")
        .when(seg.rlike(r"^(?i)(?=.*\d)[0-9a-f-]{8,}$"), "hex")
        .when(seg.rlike(r"\.[A-Za-z0-9]{1,5}$"), "file")
        .when(seg.rlike(r"^[\p{L}_-]+$"), "word")
        .otherwise("other")
    )


def _g_test(parts: list[tuple[str, str]], n: str, total: str) -> Column:
    """2 * sum of observed * ln(observed / expected)."""
    out = F.lit(0.0)
    for own, pool in parts:
        expected = F.col(pool) * F.col(n) / F.col(total)
        out = out + F.when(F.col(own) > 0, 2 * F.col(own) * F.log(F.col(own) / expected)).otherwise(0.0)
    return out


def _critical(shapes: list[str], labels: list[str], normal: float) -> Column:
    """Quantile of the chi-squared distribution (Wilson and Hilferty's
    formula), by the number of classes that the node has at all."""

    def classes(names: list[str]) -> Column:
        return sum((F.col(f"all_{p}") > 0).cast("int") for p in names)

    free = F.greatest(classes(shapes) + classes(labels) - 2, F.lit(1)).cast("double")
    spread = 2 / (9 * free)
    return free * F.pow(1 - spread + normal * F.sqrt(spread), F.lit(3.0))


def _apart(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic of each row of ``own`` against the row of
    ``other``; both are counts of shapes and then of labels."""
    both, size = own + other, len(SHAPES)
    n, m = own[:, :size].sum(1, keepdims=True), other[:, :size].sum(1, keepdims=True)
    out = np.zeros(len(own))
    for part, share in ((own, n / (n + m)), (other, m / (n + m))):
        ratio = np.divide(part, both * share, out=np.ones_like(part), where=part > 0)
        out += 2 * (part * np.log(ratio)).sum(1)
    return out.round(9)


def _divided(counts: np.ndarray, normal: float) -> list[int]:
    """Pool number of each cell (row), in order."""
    out, todo, pool = [0] * len(counts), [(0, len(counts))], 0
    while todo:
        a, b = todo.pop()
        part = counts[a:b]
        if b - a > 1:
            every, left = part.sum(0), part.cumsum(0)[:-1]
            size = len(SHAPES)
            free = max(1, int((every[:size] > 0).sum() + (every[size:] > 0).sum()) - 2)
            bar = free * (1 - 2 / (9 * free) + normal * (2 / (9 * free)) ** 0.5) ** 3
            between = _apart(left, every - left)
            if max(between.max(), _apart(part, every - part).max()) >= bar:
                middle = a + 1 + int(between.argmax())
                todo += [(middle, b), (a, middle)]
                continue
        out[a:b] = [pool] * (b - a)
        pool += 1
    return out


def _pool_numbers(normal: float) -> Callable[[Column], Column]:
    @F.arrow_udf("array<int>")
    def numbers(cells: pa.Array) -> pa.Array:
        # one row a node and shape, an array of the counts of each of its cells
        ends = np.diff(cells.offsets.to_numpy()).cumsum()
        flat = cells.flatten().flatten().to_numpy(zero_copy_only=False).astype(float)
        rows = np.split(flat.reshape(-1, len(SHAPES) + 3), ends[:-1]) if len(cells) else []
        return pa.array([_divided(r, normal) for r in rows], pa.list_(pa.int32()))

    return numbers


def _pools(
    stats: DataFrame, node: DataFrame, parts: list[str], least_urls: int, critical: Column, normal: float
) -> tuple[DataFrame, DataFrame]:
    """The branches that may stay, each with its cell (``follow``, ``rate``,
    ``cover``); and the cells that do stay, with the name of their pool and
    whether its urls go on.

    A node has 46 cells a shape at most, so what is gathered here is small.
    """
    keys, cell = ["host", "template"], ["follow", "rate", "cover"]
    most = F.greatest(*[F.col(f"k_{s}") for s in SHAPES])
    follow = F.coalesce(*[F.when(F.col(f"k_{s}") == most, F.lit(i)) for i, s in enumerate(SHAPES)])
    labelled = F.col("bad_n") + F.col("good_n")
    angle = F.floor(F.asin(F.sqrt(F.col("bad_n") / labelled)) * (16 / math.pi) + 1e-9)
    rate = F.when(labelled == 0, 0).otherwise(1 + angle).cast("int")
    cover = F.floor(4 * labelled / F.col("n")).cast("int")
    fit = shape(F.col("seg")).isin("word", "file", "other") & (F.col("n") >= least_urls)
    some = stats.where(fit).withColumns({"follow": follow, "rate": rate, "cover": cover})
    sums = [F.sum(p).alias(p) for p in ["n", *parts]]
    cells = some.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("members"), F.min("seg").alias("first"), *sums)
    lists = cells.groupBy(*keys, "follow").agg(
        F.sort_array(F.collect_list(F.struct("rate", "cover", "members", "first", "n", *parts))).alias("cells")
    )
    counts = F.transform("cells", lambda c: F.array(*[c[p] for p in parts]))
    lists = lists.withColumn("pool", _pool_numbers(normal)(counts))
    each = lists.select(*keys, "follow", F.explode(F.arrays_zip("cells", "pool")).alias("c"))
    cells = cut(each.select(*keys, "follow", "c.cells.*", "c.pool"))
    pools = cells.groupBy(*keys, "follow", "pool").agg(F.sum("members").alias("members"), F.min("first").alias("first"), *sums)
    unlike = _g_test([(p, f"all_{p}") for p in parts], "n", "all_n") >= critical
    name = F.when(F.col("members") == 1, F.col("first")).otherwise(F.format_string("{%s+%d}", "first", F.col("members") - 1))
    on = (F.col("n") - F.col("k_end")) >= least_urls
    kept = pools.join(node, keys).where(unlike | (F.col("branches") == 1))
    kept = kept.select(*keys, "follow", "pool", name.alias("_name"), on.alias("_on"))
    return some, cells.select(*keys, *cell, "pool").join(kept, [*keys, "follow", "pool"]).drop("pool")


def templates(paths: DataFrame, least_urls: int = 3, normal: float = 1.645, salts: int = 16) -> DataFrame:
    """``paths`` (host, segs, bad_n, good_n, none_n, ...) with a column
    ``template``.

    ``normal``: quantile of the normal distribution at which branches count as
    unlike, by default the 5 % level.  ``salts``: tasks that the urls of one
    node are dealt out to.
    """
    now = paths.withColumns({"template": F.lit(""), "salt": F.pmod(F.xxhash64("segs"), F.lit(salts)).cast("int")})
    keys = ["host", "template"]
    shapes, labels = [f"k_{s}" for s in SHAPES], ["bad_n", "good_n", "none_n"]
    parts = shapes + labels
    critical = _critical(shapes, labels, normal)
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    done = [now.where(F.size("segs") == 0)]
    live, d = now.where(F.size("segs") > 0), 0
    while not live.isEmpty():
        seg = F.get("segs", F.lit(d))
        follow = shape(F.get("segs", F.lit(d + 1)))
        n = F.col("bad_n") + F.col("good_n") + F.col("none_n")
        stats = live.groupBy(*keys, seg.alias("seg")).agg(
            F.sum(n).alias("n"),
            *[F.sum(F.when(follow == s, n).otherwise(0)).alias(f"k_{s}") for s in SHAPES],
            *[F.sum(c).alias(c) for c in labels],
        )
        stats = cut(stats)
        pool = stats.groupBy(*keys).agg(
            F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("branches"), *[F.sum(p).alias(f"all_{p}") for p in parts]
        )
        some, kept = _pools(stats, pool.where(F.col("all_n") >= least_urls), parts, least_urls, critical, normal)
        # the branches and urls of one node are dealt out, with the few decisions on them
        some = some.select(*keys, "seg", "follow", "rate", "cover", F.pmod(F.xxhash64("seg"), F.lit(salts)).cast("int").alias("salt"))
        named = some.join(cut(kept.select("*", every_salt)), [*keys, "follow", "rate", "cover", "salt"])
        named = cut(named.select(*keys, "seg", "_name", "_on").select("*", every_salt))
        rest = stats.join(named.where("salt = 0").select(*keys, "seg"), [*keys, "seg"], "left_anti")
        merged = rest.groupBy(*keys).agg((F.sum(F.col("n") - F.col("k_end")) >= least_urls).alias("_all_on"))
        now = live.withColumn("seg", seg).join(named, [*keys, "seg", "salt"], "left")
        now = now.join(cut(merged.select("*", every_salt)), [*keys, "salt"], "left")
        # below a node of too few urls there are only wildcards
        on = F.coalesce("_on", "_all_on", F.lit(False))
        tail = F.when(on, "").otherwise(F.repeat(F.lit("/*"), F.size("segs") - (d + 1)))
        now = now.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("_name", F.lit("*")), tail))
        now = written(now.withColumn("_live", on & (F.size("segs") > d + 1)).drop("seg", "_name", "_on", "_all_on"))
        done.append(now.where("not _live").drop("_live"))
        live, d = now.where("_live").drop("_live"), d + 1
        if len(done) > 32:
            done = [cut(reduce(DataFrame.unionByName, done))]
    return reduce(DataFrame.unionByName, done).drop("salt")


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    bad_col: str | None = None,
    reject: float = 0.5,
    weight: float = 10.0,
    prior: float = 0.2,
) -> DataFrame:
    """One row for each row: page_id, host, path, rule, verdict, template,
    purity (smoothed share of bad), n_labelled (of the template).

    ``bad_col``: 1 bad, 0 good, null unlabelled; without it the verdicts of
    the rules are the labels.  ``weight``: labels that the smoothing counts for.
    """
    host, path = host_and_path(url_col)
    base = pages.select(
        F.col(id_col).alias("id"),
        host.alias("host"),
        path.alias("path"),
        *([F.col(bad_col).cast("int").alias("bad")] if bad_col else []),
    )
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", name).withColumn("said", verdict)
    if not bad_col:
        base = base.withColumn("bad", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    base = cut(base)
    paths = base.groupBy("host", "path").agg(
        F.count_if(F.col("bad") == 1).alias("bad_n"),
        F.count_if(F.col("bad") == 0).alias("good_n"),
        F.count_if(F.col("bad").isNull() | ~F.col("bad").isin(0, 1)).alias("none_n"),
    )
    leaves = cut(templates(cut(paths.withColumn("segs", segs))).drop("segs"))

    def rates(*by: str, tag: str) -> DataFrame:
        return leaves.groupBy(*by).agg(
            F.sum(F.col("bad_n") + F.col("good_n")).alias(f"n_{tag}"), F.sum("bad_n").alias(f"bad_{tag}")
        )

    bad, strength = F.lit(weight * prior), F.lit(weight)
    for t, most in (("h", weight), ("t", weight / 2)):
        own = F.least(F.col(f"n_{t}").cast("double"), F.lit(most))
        bad = bad + F.when(F.col(f"n_{t}") > 0, own * F.col(f"bad_{t}") / F.col(f"n_{t}")).otherwise(0.0)
        strength = strength + own
    purity = (F.col("bad_l") + weight * (bad / strength)) / (F.col("n_l") + weight)
    table = (
        rates("host", "template", tag="l")
        .join(rates("host", tag="h"), "host")
        .join(rates("template", tag="t"), "template")
        .select("host", "template", F.round(purity, 9).alias("purity"), F.col("n_l").alias("n_labelled"))
    )
    judged = cut(leaves.select("host", "path", "template").join(table, ["host", "template"]))
    return base.join(judged, ["host", "path"]).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("said", F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"),
        "template",
        "purity",
        "n_labelled",
    )
