"""Near-duplicate groups by MinHash and an LSH forest of sorted signature orders.

Every document becomes the set of its five-word shingles. Documents with one
and the same set form a class; only one document of a class goes on. A class
has some orders of DEPTH minima each. In each order all classes are sorted by
their whole signature, over range partitions, so no prefix, however frequent,
is one task's. Neighbours there have the longest common prefixes; a run of
neighbours with a common prefix of at least some minima is a region, and a
dense region is gone through at the depth that its density asks for, as the
nearest rows are those with the longest prefixes. `forest` chooses the number
of orders and the least depth for a percentage. Work goes in three rounds:

1. each class with its neighbour in the first order that gives it one (linear
   in the classes); confirmed links give first components;
2. of each order, all pairs of a region at most WINDOW places apart whose
   components still differ;
3. regions of more than WINDOW + 1 classes that still hold several components
   are gone through exactly: a prefix-filter join on their shingles, rarest
   first, gives all pairs of different components that can be similar enough.

Links are confirmed on the full sets: 100 * common >= 85 * union by default.
Components come from alternating large-star and small-star steps on written
edges, so no group is ever gathered in a task or on the driver.

Defined cases: a null or empty text, or one without words, has an empty set and
links with nothing; rows with one doc_id and one text are one document, rows
with one doc_id and other texts are documents of their own; a null doc_id ranks
after all ids, and is the component_id if no other document is in the
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.llm.common import NO_ID, Cache, dropped, materialise, real_id, space_words, splitmix, tidied, with_rid

WIDTH, DEPTH, WINDOW = 5, 8, 4
#: Parts that a region's rows are dealt into where they meet their region's summary.
_SALT = 16
#: At the percentage itself, an order is to show a pair at least so often, and all orders to miss it at most so often.
SHOWN, MISSED = 0.4, 1e-4
_BLOCK = 4096
#: Counters of the sketch of shingle frequencies: 4 MB, whatever the input.
SKETCH = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: Cache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = space_words(text) if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(WIDTH, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * _MULTIPLIER + h[i : i + len(out)]
    return np.unique(splitmix(out))


def word_hashes() -> Cache:
    return Cache(xxhash.xxh3_64_intdigest)


def forest(percent: int) -> tuple[int, int]:
    """Orders and least common depth for a percentage: 16 and 5 for 85, 18 and 4 for 80."""
    t = min(percent / 100, 0.99)
    depth = max([d for d in range(1, DEPTH) if t**d >= SHOWN], default=1)
    return math.ceil(math.log(MISSED) / math.log(1 - t**depth)), depth


def _permutations(trees: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = trees * DEPTH
    return rng.integers(0, 2**32, n, dtype=np.uint32)[:, None], (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def signature(hashes: np.ndarray, perms) -> np.ndarray:
    """Minima of the set under all orders."""
    xor, odd = perms
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), _BLOCK):
        np.minimum(out, ((low[None, i : i + _BLOCK] ^ xor) * odd).min(axis=1), out=out)
    return out


_SIGNED = "rid long, dig binary, n_shingles long, cls binary, sig binary"


def _signer(orders: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, perms = word_hashes(), _permutations(orders)
        for batch in batches:
            n, cls, sig = [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s, perms).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["rid", "dig", "n_shingles", "cls", "sig"])

    return sign


def prefix_key(order: np.ndarray, minima: np.ndarray, least: int) -> np.ndarray:
    """One number for each row's order and first `least` minima."""
    key = splitmix(order.astype(np.uint64) + np.uint64(1))
    for depth in range(least):
        key = splitmix(key * _MULTIPLIER + minima[:, depth].astype(np.uint64))
    return key.view(np.int64)


def common_prefix(order: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """How many first minima each row shares with the one before it; 0 for the first and across orders."""
    same = np.cumprod(minima[1:] == minima[:-1], axis=1).sum(axis=1) * (order[1:] == order[:-1])
    return np.concatenate([[0], same])


_RUNS = "pid int, idx long, ord int, node long, key long, prev long, sig binary"


def _neighbours(least: int):
    """Of sorted rows (ord, sig, node), those in a region: with their place idx, the region's key, and the neighbour before.

    The first and last row of a partition come in any case, with sig, so that neighbours across partitions can be told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, idx, held = TaskContext.get().partitionId(), 0, None

        def rows(order, minima, node, lcp, prev, keep, edge):
            nonlocal idx
            at = np.flatnonzero(keep)
            sig = [minima[i].astype(">u4").tobytes() if edge[i] else None for i in at]
            out = [np.full(len(at), pid, np.int32), idx + np.arange(len(at)), order[at], node[at], prefix_key(order[at], minima[at], least)]
            idx += len(at)
            before = pa.array(prev[at], pa.int64(), mask=lcp[at] < least)
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in out), before, pa.array(sig, pa.binary())], names=["pid", "idx", "ord", "node", "key", "prev", "sig"])

        for batch in batches:
            if not batch.num_rows:
                continue
            order, node = batch.column(0).to_numpy().astype(np.int32), batch.column(2).to_numpy()
            minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(len(order), -1).astype(np.uint32)
            first = held is None
            if not first:
                order, minima, node = (np.concatenate([h, x]) for h, x in zip(held[:3], (order, minima, node), strict=True))
            lcp, prev = common_prefix(order, minima), np.concatenate([node[:1], node[:-1]])
            if not first:
                lcp[0], prev[0] = held[3], held[4]
            keep = (lcp[:-1] >= least) | (lcp[1:] >= least)
            edge = np.zeros(len(order), bool)
            if first:
                edge[0] = True
            elif held[5]:
                edge[0] = True
            if len(order) > 1:
                yield rows(order[:-1], minima[:-1], node[:-1], lcp[:-1], prev[:-1], keep | edge[:-1], edge)
            held = (order[-1:], minima[-1:], node[-1:], lcp[-1], prev[-1], len(order) == 1 and bool(edge[0]))
        if held:
            one = np.ones(1, bool)
            yield rows(held[0], held[1], held[2], np.array([held[3]]), np.array([held[4]]), one, one)

    return run


def _borders(runs: DataFrame, least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Of the partitions' first and last rows (two a partition): (pid, rows before it), and (ord, node, prev) of neighbours across partitions."""
    ends = sorted(runs.filter("sig is not null").select("pid", "idx", "ord", "node", "sig").collect())
    before, found, total = {}, [], 0
    for i, row in enumerate(ends):
        if i and ends[i - 1].pid != row.pid:
            last = ends[i - 1]
            total += last.idx + 1
            both = np.frombuffer(bytes(last.sig) + bytes(row.sig), ">u4").reshape(2, -1)
            if common_prefix(np.array([last.ord, row.ord]), both)[1] >= least:
                found.append((row.ord, row.node, last.node))
        before.setdefault(row.pid, total)
    return list(before.items()), found


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = word_hashes(), (None, None)
        for batch in batches:
            a, b, ta, tb = batch.columns
            keep = []
            ids = a.to_pylist()
            for i, one in enumerate(ids):
                if last[0] != one:
                    last = (one, shingles(ta[i].as_py(), words))
                left, right = last[1], shingles(tb[i].as_py(), words)
                if min(len(left), len(right)) * 100 < percent * max(len(left), len(right)):
                    continue
                common = len(np.intersect1d(left, right, assume_unique=True))
                if common and 100 * common >= percent * (len(left) + len(right) - common):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], names=["a", "b"])

    return confirm


def confirmed(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose full sets are similar enough; texts has node and text."""
    side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"t{n}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
    return materialise(both.mapInArrow(tidied(_confirmer(percent)), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): comp is the smallest node reachable."""
    e = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    state = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = state(e)
    while was[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        was_e, e = e, materialise(small.union(least.select(F.col("m").alias("a"), "b")).distinct())
        dropped(was_e)
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("comp")), F.struct(F.col("a").alias("node"), F.col("a").alias("comp")))).alias("x")).select("x.*").distinct()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sketch: how many sets have a shingle in each of SKETCH counters."""
    found = np.zeros(SKETCH, np.int64)
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy().view(np.uint64)
        np.add(found, np.bincount((flat % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH), out=found)
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["slot", "n"])


def _prefixes(sketch, percent: int):
    """The shingles of each set that a similar partner must have one of, rarest first; those of no other set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            node, comp, size, rest, shingle = [], [], [], [], []
            for i, one in enumerate(batch.column(2)):
                s = one.values.to_numpy()
                n = len(s)
                df = counts[(s.view(np.uint64) % np.uint64(SKETCH)).astype(np.int64)]
                order = np.lexsort((s, df))[: n - -(-percent * n // 100) + 1]
                order, at = order[df[order] > 1], np.flatnonzero(df[order] > 1)
                shingle.append(s[order])
                rest.append(n - at)
                for out, v in ((node, i), (comp, i), (size, n)):
                    out.append(np.full(len(at), v))
            node, comp, size, rest, shingle = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (node, comp, size, rest, shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(node)), batch.column(1).take(pa.array(comp)), pa.array(size, pa.int64()), pa.array(rest, pa.int64()), pa.array(shingle, pa.int64())], names=["node", "comp", "n", "rest", "s"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = word_hashes()
    for batch in batches:
        sets = [shingles(text.as_py(), words).view(np.int64) for text in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.int64()))], names=["node", "comp", "s"])


def _prefix_pairs(texts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of nodes (node, comp) from different components that can be similar enough.

    With shingles in one order, similar sets share one of their first
    n - ceil(percent * n / 100) + 1, and at the first they share, the smaller
    rest bounds what they have in common. The order is by counts in a sketch
    of fixed size (any order is right; rarest first gives few pairs). The
    bound is put to cells of equal size and rest before nodes are paired.
    """
    sets = materialise(texts.join(nodes, "node").select("node", "comp", "text").mapInArrow(tidied(_sets), "node long, comp long, s array<long>"))
    slots = sets.select("s").mapInArrow(tidied(_counted), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    sketch = np.ones(SKETCH, np.int32)
    sketch[slots.column("slot").to_numpy()] = np.minimum(slots.column("n").to_numpy(), 2**31 - 1)
    shared = texts.sparkSession.sparkContext.broadcast(sketch)
    prefix = materialise(sets.mapInArrow(tidied(_prefixes(shared, percent)), "node long, comp long, n long, rest long, s long"))
    dropped(sets)
    cells = materialise(prefix.groupBy("s", "n", "rest").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    mixed = cells.groupBy("s").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l < h").select("s")
    cells = cells.join(mixed, "s")
    left, right = (cells.select("s", *[F.col(c).alias(f"{c}_{x}") for c in ("n", "rest", "lo", "hi")]) for x in "ab")
    common = F.least("rest_a", "rest_b")
    fits = (100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)) & (F.least("lo_a", "lo_b") < F.greatest("hi_a", "hi_b"))
    cells = left.join(right, "s").filter(fits).select("s", "n_a", "rest_a", "n_b", "rest_b")
    left, right = (prefix.select("s", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "rest", "comp")]) for x in "ab")
    return left.join(cells, ["s", "n_a", "rest_a"]).join(right, ["s", "n_b", "rest_b"]).filter("a < b and comp_a <> comp_b").select("a", "b").distinct()


def _digest(text):
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def _grouped(documents: DataFrame, percent: int) -> DataFrame:
    """One row per document: rid, dig, n_shingles, and first and rep, the smallest (rid, dig) of its component and of its class."""
    spark = documents.sparkSession
    docs = with_rid(documents).select("rid", _digest(F.col("text")).alias("dig"), F.col("text").cast("binary").alias("text"))
    orders, least = forest(percent)
    signed = materialise(docs.mapInArrow(tidied(_signer(orders)), _SIGNED))
    filled = signed.filter("n_shingles > 0")
    classes = filled.groupBy("cls").agg(F.min(F.struct("rid", "dig")).alias("rep"), F.first("sig").alias("sig"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))

    at = F.transform(F.sequence(F.lit(0), F.lit(orders - 1)), lambda t: F.struct(t.alias("ord"), F.substring("sig", t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("sig")))
    by = ["ord", "sig", "node"]
    trees = classes.select("node", F.explode(at).alias("k")).select("k.ord", "k.sig", "node").repartitionByRange(*by).sortWithinPartitions(*by)
    runs = materialise(trees.mapInArrow(tidied(_neighbours(least)), _RUNS))
    before, across = _borders(runs, least)
    starts = spark.createDataFrame(before, "pid int, start long")  # a row a partition
    placed = runs.join(F.broadcast(starts), "pid").select("node", "key", (F.col("start") + F.col("idx")).alias("pos"))
    texts = classes.join(runs.select("node").distinct(), "node").select("node", "rep.rid", "rep.dig").hint("merge")
    texts = materialise(docs.groupBy("rid", "dig").agg(F.first("text").alias("text")).join(texts, ["rid", "dig"]).select("node", "text"))

    steps = runs.filter("prev is not null").select("ord", "node", "prev").union(spark.createDataFrame(across, "ord int, node long, prev long"))
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    steps = materialise(steps.groupBy("node").agg(F.min_by("prev", "ord").alias("prev")).select(*ordered("node", "prev")).distinct())
    comps = materialise(components(confirmed(texts, steps, percent)))

    with_comp = lambda c: placed.join(c, "node", "left").select("key", "pos", "node", F.coalesce("comp", "node").alias("comp"))
    near = with_comp(comps).withColumn("block", F.floor(F.col("pos") / WINDOW))
    left = near.select("key", "block", F.col("pos").alias("pos_a"), F.col("node").alias("x"), F.col("comp").alias("comp_a"))
    right = near.select("key", F.explode(F.array("block", F.col("block") - 1)).alias("block"), F.col("pos").alias("pos_b"), F.col("node").alias("y"), F.col("comp").alias("comp_b"))
    close = left.join(right, ["key", "block"]).filter(f"pos_b > pos_a and pos_b <= pos_a + {WINDOW} and comp_a <> comp_b").select(*ordered("x", "y")).distinct()
    close = materialise(close.join(steps, ["a", "b"], "left_anti"))
    edges = lambda c: c.select(F.col("comp").alias("a"), F.col("node").alias("b"))
    comps = materialise(components(edges(comps).union(confirmed(texts, close, percent))))

    rest = with_comp(comps)
    mixed = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(f"n > {WINDOW + 1} and lo < hi").select("key", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))).alias("salt"))
    rest = rest.withColumn("salt", F.pmod(F.col("pos"), F.lit(_SALT)).cast("int"))
    dense = materialise(rest.join(mixed, ["key", "salt"], "left_semi").select("node", "comp").distinct())
    if not dense.isEmpty():
        pairs = _prefix_pairs(texts, dense, percent).join(steps.union(close), ["a", "b"], "left_anti")
        comps = components(edges(comps).union(confirmed(texts, pairs, percent)))

    found = classes.join(comps, "node", "left").select("cls", "rep", F.coalesce("comp", "node").alias("comp"))
    found = found.join(found.groupBy("comp").agg(F.min("rep").alias("first")), "comp")
    out = filled.select("rid", "dig", "n_shingles", "cls").join(found, "cls").select("rid", "dig", "n_shingles", "first", "rep")
    own = F.struct("rid", "dig")
    return out.union(signed.filter("n_shingles = 0").select("rid", "dig", "n_shingles", own, own))


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (smallest doc_id with the same set)."""
    return _grouped(documents, percent).select(
        real_id(F.col("rid")).alias("doc_id"),
        "n_shingles",
        real_id(F.col("first.rid")).alias("component_id"),
        (F.struct("rid", "dig") == F.col("first")).alias("kept"),
        real_id(F.col("rep.rid")).alias("class_id"),
    )


def keep_one(documents: DataFrame, percent: int = 85) -> DataFrame:
    """The documents with one of each near-duplicate group, all columns kept; rows of one doc_id and text become one."""
    decided = materialise(_grouped(documents, percent).select("rid", "dig", (F.struct("rid", "dig") == F.col("first")).alias("stays")))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid"), _digest(F.col("text")).alias("dig"))
    rows = rows.join(decided.filter("not stays").distinct().hint("shuffle_hash"), ["rid", "dig"], "left_anti")
    if not decided.filter("stays").groupBy("rid", "dig").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["rid", "dig"])
    return rows.select("row.*")
