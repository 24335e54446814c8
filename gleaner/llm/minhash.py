"""Near duplicates by b-bit MinHash, banding and exact confirmation.

Each text is a set of hashed word shingles.  128 minima are taken; bands of
four minima give candidates, and of each minimum four low bits are kept,
packed into eight longs.  A candidate's similarity is estimated from these
bits by counting equal ones and correcting for chance collisions; a pair whose
estimate is within five standard errors of the threshold, or above, is then
decided on the full sets.

No bucket is expanded into all its pairs.  Texts with equal sets form a class
of which one stands for all.  Each class is first compared with one other, the
first class of most of its buckets; the links confirmed make components.
Only buckets in which several components still meet are looked at again, in
two passes.  In the first, the largest component of a bucket is dealt out in
blocks, once, and the bucket's other texts go to each block.  In the second,
these others meet each other, in pairs of blocks.  Both compare signatures in
place and tell which texts should visit which component.  That component's
texts are dealt out in blocks, every visitor goes to each of them, and is
compared on the full sets until a link is found.  No link between components is
missed that the bands and the estimate let through.

What is moved grows with the size of a bucket times the number of its texts
outside the largest component, over the size of a block.  It is quadratic only
for texts that share buckets and estimates but never link, such as very many
texts that are all 0.6 to 0.74 alike.

With 32 bands of 4, two texts at the very threshold of 0.75 share no band with
probability (1 - 0.75^4)^32 = 5e-6, and the estimate of such a pair lies five
standard errors low with less than 2e-6; both become less with similarity.

Edge cases: null and empty texts have an empty set and are linked with
nothing, not even each other; a text of fewer words than a shingle is one
shingle.  Rows that share an id count as one document.  A row with a null id
takes part only as an exact copy of others.  An empty table gives an empty
result.  Other columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Bloom, bound_batches, cut, without_ids
from gleaner.llm.graph import components
from gleaner.llm.textcols import NOT_SPACE, mix, shingles, slices, word_hashes, words

HASHES, BANDS, BITS = 128, 32, 4
ROWS = HASHES // BANDS
LONGS = HASHES * BITS // 64
SALTS = 32
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_C = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, off in slices(column):
        starts, ends, begin = words(data, off, NOT_SPACE)
        sh, at = shingles(word_hashes(data, starts, ends), begin, width)
        for i in range(len(at) - 1):
            s = np.sort(sh[at[i] : at[i + 1]])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            yield s


def _minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        best = np.minimum(best, (x[i : i + 2048, None] * _A + _B).min(axis=0))
    return best


def _longs(flat: np.ndarray, each: int) -> pa.Array:
    offsets = np.arange(0, len(flat) + 1, each, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        n = np.zeros(b.num_rows, dtype=np.int64)
        s1, s2 = np.zeros(b.num_rows, dtype=np.uint64), np.zeros(b.num_rows, dtype=np.uint64)
        low = np.zeros((b.num_rows, HASHES), dtype=np.uint32)
        for i, s in enumerate(_sets(b.column(1), width)):
            n[i] = len(s)
            s1[i], s2[i] = s.sum(), mix(s).sum()
            if len(s):
                low[i] = _minima(s)
        v = low.astype(np.uint64).reshape(-1, BANDS, ROWS)
        h = np.zeros(v.shape[:2], dtype=np.uint64) + _BAND
        for k in range(0, ROWS, 2):
            h = mix(h ^ ((v[:, :, k] << np.uint64(32)) | v[:, :, k + 1]))
        # the low bits of A * x + B only depend on those of x, so the minima are mixed
        last = ((low ^ _C) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        bits = last.astype(np.uint64).reshape(-1, LONGS, 64 // BITS)
        packed = (bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array(n),
                pa.array(s1.view(np.int64)),
                pa.array(s2.view(np.int64)),
                _longs(np.ascontiguousarray(h).reshape(-1), BANDS),
                _longs(np.ascontiguousarray(packed).reshape(-1), LONGS),
            ],
            ["id", "n", "s1", "s2", "bands", "sig"],
        )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """id, n (set size), s1, s2 (digest of the set), bands, sig (packed bits)."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        lambda it: _sign(it, width), "id long, n long, s1 long, s2 long, bands array<long>, sig array<long>"
    )


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for chance: of two
    different minima, one in 2^BITS agrees in the bits kept."""
    nibble = F.lit(0x1111111111111111).cast("long")
    differ = F.lit(0)
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2))
        differ = differ + F.bit_count(y.bitwiseAND(nibble))
    same = 1 - differ / HASHES
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def margin(threshold: float) -> float:
    """The estimate below which a pair at the threshold lies less than once in
    500,000."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - 5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held).combine_chunks()
        cols = [t.column(c).to_numpy() for c in keys]
        same = np.logical_and.reduce([k == k[-1] for k in cols])
        done = 0 if same.all() else t.num_rows - int(same[::-1].argmin())
        if done:
            yield t.slice(0, done)
        held = t.slice(done).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(t: pa.Table, keys: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    key = np.stack([t.column(c).to_numpy() for c in keys])
    cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
    return zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [t.num_rows])), strict=True)


def _packed(t: pa.Table) -> np.ndarray:
    return t.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima that differ in their low bits, for each row of a with each of b."""
    d = a[:, None, :] ^ b[None, :, :]
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=2)


def _most_differing(least: float) -> float:
    chance = 2.0**-BITS
    return HASHES * (1 - (least * (1 - chance) + chance))


def _visits(batches: Iterator[pa.RecordBatch], least: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Blocks of buckets -> (visitor, component): texts that may be linked
    with a text of another component.  Guests only meet hosts; in blocks
    without hosts all meet each other, and the smaller component visits."""
    most = _most_differing(least)
    keys = ("bh", "lo", "hi")
    for t in _groups(batches, keys):
        cls, comp, size, n, host = (t.column(c).to_numpy() for c in ("cls", "comp", "size", "n", "host"))
        sig, visitor, visited = _packed(t), [], []
        for s, e in _bounds(t, keys):
            hosts = np.flatnonzero(host[s:e] == 1) + s
            a, b = np.flatnonzero(host[s:e] == 0) + s, (hosts if len(hosts) else np.arange(s, e))
            for i in range(0, len(a), 128):
                p = a[i : i + 128]
                x, y = n[p][:, None], n[b][None, :]
                ok = comp[p][:, None] != comp[b][None, :]
                ok &= 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
                if not ok.any():
                    continue
                q, r = np.nonzero(ok & (_differ(sig[p], sig[b]) <= most))
                u, v = p[q], b[r]
                # the smaller component visits; of equal ones the later
                swap = (host[v] == 0) & ((size[u] > size[v]) | ((size[u] == size[v]) & (comp[u] < comp[v])))
                visitor.append(cls[np.where(swap, v, u)])
                visited.append(comp[np.where(swap, u, v)])
        if visitor:
            both = np.unique(np.stack([np.concatenate(visitor), np.concatenate(visited)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["cls", "visited"])


def _linked(batches: Iterator[pa.RecordBatch], least: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a component's texts, each followed by its visitors -> links.
    The texts of one block are held, its visitors pass by.  A visitor's
    partners are tried by likeliness; one link is enough."""
    most, key, held = _most_differing(least), None, []

    def met(host: list[pa.RecordBatch], guests: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        h = pa.Table.from_batches(host).combine_chunks()
        cls, n, sig, raw = h.column("cls").to_numpy(), h.column("n").to_numpy(), _packed(h), h.column("set").combine_chunks()
        g = pa.Table.from_batches([guests])
        own_sig, own_set = _packed(g), guests.column("set")
        for i, (c, m) in enumerate(zip(g.column("cls").to_pylist(), g.column("n").to_pylist(), strict=True)):
            differ = _differ(own_sig[i : i + 1], sig)[0]
            some = np.flatnonzero((100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (differ <= most))
            mine = np.frombuffer(own_set[i].as_buffer(), dtype=np.uint64)
            for y in some[np.argsort(differ[some], kind="stable")]:
                if _similar(mine, np.frombuffer(raw[int(y)].as_buffer(), dtype=np.uint64), percent):
                    yield min(c, int(cls[y])), max(c, int(cls[y]))
                    break

    for b in batches:
        if not b.num_rows:
            continue
        keys = ("visited", "block", "guest")
        links = []
        for s, e in _bounds(pa.Table.from_batches([b]), keys):
            part = b.slice(s, e - s)
            visited, block, guest = (part.column(c)[0].as_py() for c in keys)
            if key != (visited, block):
                key, held = (visited, block), []
            if not guest:
                held.append(part)
            elif held:
                links += met(held, part)
        if links:
            left, right = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    if len(p) > len(q):
        p, q = q, p
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _set_rows(batches: Iterator[pa.RecordBatch], width: int, test) -> Iterator[pa.RecordBatch]:
    """id, set of the rows that pass the filter, whose places follow id and
    text."""
    for b in batches:
        b = b.filter(pa.array(test([c.to_numpy() for c in b.columns[2:]])))
        if b.num_rows:
            sets = [s.tobytes() for s in _sets(b.column(1), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "set"])


def _confirm_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        ok = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            p, q = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (x, y))
            ok[i] = _similar(p, q, percent)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])


def _sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, set: the shingles of the texts whose id is in ``ids``, and of few
    others.  The other texts are neither hashed nor moved."""
    # an id stands there once for each of its visits, of which a group has many
    known = Bloom(cut(ids.distinct()), "id")
    test = known.tester()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the filter and the sets in one worker
    rows = rows.select("id", "text", *[p.alias(f"h{i}") for i, p in enumerate(known.places("id"))])
    return rows.mapInArrow(lambda it: _set_rows(it, width, test), "id long, set binary")


def confirm(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = _sets_of(docs, ids, id_col, text_col, width)
    one = pairs.join(sets.withColumnRenamed("id", "a").withColumnRenamed("set", "x"), "a")
    two = one.join(sets.withColumnRenamed("id", "b").withColumnRenamed("set", "y"), "b")
    return two.select("a", "b", "x", "y").mapInArrow(
        lambda it: _confirm_rows(it, percent), "a long, b long"
    )


def _mixed(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """bh, cls, main, m: the buckets in which several components meet, with the
    one that has most texts there and how many it has."""
    shared = shared.select("bh", "cls")
    labelled = shared.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    counted = labelled.groupBy("bh", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = counted.groupBy("bh").agg(
        F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("m").alias("all")
    )
    mixed = cut(mixed.where("comps > 1").select("bh", "top.m", "all", F.col("top.comp").alias("main")))
    return cut(shared.join(mixed, "bh"))


def _across(
    docs: DataFrame,
    shared: DataFrame,
    nodes: DataFrame,
    bits: DataFrame,
    block: int,
    percent: int,
    with_main: bool,
    id_col: str,
    text_col: str,
    width: int,
) -> DataFrame:
    """Links between different components that meet in a bucket: with its main
    one, or of the others with each other."""
    least = margin(percent / 100)
    sizes = cut(nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("size")))
    rows = shared.join(nodes.join(sizes, "comp"), "cls")
    own = ["bh", "lo", "hi", "host", "cls", "comp", "size", "n", "sig"]
    if with_main:
        # its texts once, each of the others with every block of them
        blocks = F.ceil(F.col("m") / block).cast("int")
        main = F.col("comp") == F.col("main")
        mine = F.pmod(F.xxhash64("cls"), blocks).cast("int")
        rows = rows.withColumn("host", main.cast("int")).withColumn(
            "lo", F.explode(F.when(main, F.array(mine)).otherwise(F.sequence(F.lit(0), blocks - 1)))
        ).withColumn("hi", F.lit(0))
    else:
        blocks = F.ceil(F.col("m") / block).cast("int")
        rows = (
            rows.withColumn("host", F.lit(0))
            .withColumn("mine", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
        )
    rows = rows.select(*own).repartition("bh", "lo", "hi").sortWithinPartitions("bh", "lo", "hi")
    visits = cut(rows.mapInArrow(lambda it: _visits(it, least, percent), "cls long, visited long").distinct())
    if visits.isEmpty():
        return visits.select(F.col("cls").alias("a"), F.col("visited").alias("b"))
    # the components visited, in blocks, and each visitor with every block
    deal = F.ceil(F.col("size") / (block // 4)).cast("int")
    goal = sizes.join(visits.select(F.col("visited").alias("comp")).distinct(), "comp")
    hosts = nodes.join(goal, "comp").select(
        F.col("comp").alias("visited"),
        F.pmod(F.xxhash64("cls"), deal).cast("int").alias("block"),
        F.lit(0).alias("guest"), "cls", "n", "sig",
    )
    guests = (
        visits.join(goal.withColumnRenamed("comp", "visited"), "visited")
        .join(bits, "cls")
        .select("visited", F.explode(F.sequence(F.lit(0), deal - 1)).alias("block"), F.lit(1).alias("guest"), "cls", "n", "sig")
    )
    both = cut(hosts.unionByName(guests))
    sets = _sets_of(docs, both.select(F.col("cls").alias("id")), id_col, text_col, width)
    ready = (
        both.join(sets.withColumnRenamed("id", "cls"), "cls")
        .repartition("visited", "block")
        .sortWithinPartitions("visited", "block", "guest", "cls")
    )
    return ready.mapInArrow(lambda it: _linked(it, least, percent), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    block: int = 2048,
) -> DataFrame:
    """One row for each row: doc_id, n_shingles, component_id, kept.

    ``percent``: least similarity, in hundredths.  ``block``: most members of
    a bucket compared in one block; larger buckets are dealt out by pairs of
    blocks.
    """
    sigs = cut(signatures(docs, id_col, text_col, width))
    some = sigs.where("n > 0")
    # materialised, so that a very large class is split in the join
    classes = cut(some.groupBy("s1", "s2", "n").agg(F.min("id").alias("cls")))
    members = cut(some.select("id", "n", "s1", "s2").join(classes, ["s1", "s2", "n"]).select("id", "n", "cls"))
    reps = (
        some.join(classes.select("cls").distinct(), F.col("id") == F.col("cls"))
        .dropDuplicates(["id", "s1", "s2"])
        .select("cls", "n", "bands", "sig")
    )
    reps = cut(reps)
    ex = reps.select(F.explode("bands").alias("bh"), "cls")
    hubs = cut(ex.groupBy("bh").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    shared = cut(ex.join(hubs.drop("m"), "bh"))
    bits = reps.select("cls", "n", "sig")

    # each text with that first text of its buckets with which it shares most
    often = F.transform(
        F.array_distinct("hubs"),
        lambda h: F.struct(F.size(F.filter("hubs", lambda x: x == h)).alias("c"), (-h).alias("h")),
    )
    star = (
        shared.where("cls <> hub")
        .groupBy("cls")
        .agg(F.collect_list("hub").alias("hubs"))
        .select((-F.array_max(often)["h"]).alias("a"), F.col("cls").alias("b"))
    )
    left = bits.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = bits.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    likely = (
        star.join(left, "a")
        .join(right, "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        .where(estimate(F.col("sa"), F.col("sb")) >= margin(percent / 100))
        .select("a", "b")
    )
    links = cut(confirm(docs, cut(likely), id_col, text_col, width, percent))
    comps = cut(components(links))
    # then what still meets in a bucket: first with the largest component
    # there, then the others with each other
    shared = _mixed(shared, comps)
    for with_main in (True, False):
        if shared.isEmpty():
            break
        nodes = bits.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        nodes = cut(nodes.join(shared.select("cls").distinct(), "cls", "left_semi"))
        found = cut(_across(docs, shared, nodes, bits, block, percent, with_main, id_col, text_col, width))
        if with_main:
            # all that a bucket's main component has there is done
            rest = shared.join(nodes.select("cls", "comp"), "cls").where("comp <> main").select("bh", "cls")
        if not found.isEmpty():
            # what is joined so far is a star for each component
            links = comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found)
            comps = cut(components(links))
        if with_main:
            others = _mixed(rest, comps)
            shared = others.withColumn("m", F.col("all"))
    # the members of one class are dealt out over several tasks
    salted = comps.select(F.col("node").alias("cls"), "comp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    named = dealt.join(salted, ["cls", "salt"], "left").select("id", "n", F.coalesce("comp", "cls").alias("component"))
    alone = sigs.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return named.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the
    smallest id; all columns.  Rows with a null id stay, and rows that share an
    id stay or go together."""
    found = near_duplicates(docs, id_col, text_col, width, percent)
    lost = cut(found.groupBy(id_col).agg(F.bool_or("kept").alias("any")).where("not any"))
    return without_ids(docs, lost, id_col, id_col)
