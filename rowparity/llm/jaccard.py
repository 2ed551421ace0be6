"""Documents linked by the Jaccard similarity of their word n-grams: a blocked sparse product of the incidence matrix.

The matrix A has a row for each distinct set of n-grams and a column for each n-gram; A times its transpose holds every
pair's overlap. Two sets are linked if 100 * overlap >= percent * union, which bounds what has to be multiplied:

1. A set of s n-grams links to another only if they share `least(s)` = ceil(s * percent / 100) of them. n-grams of one set
   alone count against that. First those whose hash is low are counted, of all documents (copies of a set are one), which
   rules out most sets; then all n-grams of what is left.
2. Ordered from rare to frequent, linked sets share one of the first s - least(s) + 1 n-grams (their heads). Sets that
   share one are in one diagonal block, so blocks are the connected components of heads, and the product is zero outside.
3. A block is multiplied in pieces: sets in the order of their sizes, tile by tile, and tiles whose sizes alone rule a link
   out are left out. Overlaps accumulate over strips of columns, frequent columns by a dense matrix product, others pair by
   pair; after every strip rows go that no longer can reach the bound with what is still to come.
4. A block beyond a task's size is first multiplied with a few of its sets (pivots), whose links join most of a large group
   of near copies. Then it is cut into chunks, sets of one group together, and pairs of chunks are a task each; two chunks
   of one group are left out, as nothing new can come of them.

Overlaps are exact but for equal 64-bit hashes. Tasks give a spanning forest of their links, not all pairs; the groups come
from components of these. No list of an n-gram's documents is ever gathered: counts are partial aggregates, and a task
holds two chunks of bounded rows and n-grams (one set alone may be larger).

Defined results: a null text is empty. A document with fewer words than n has its whole sequence as its only n-gram; one
without words has none, links with nothing and is its own class. A document without id joins nothing: it has the
class of its set if a document with an id has the same set, else null. Repeated rows come as often as they are there. A doc_id names one text: rows of one
id with different texts are classed each by its own text. Very long texts are one row of 8 bytes a distinct n-gram. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, saved
from .texts import in_parts, word_hashes

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: The share of n-grams, by their hashes, that the first count looks at.
LOW = 0.3
#: A task's side: so many sets and n-grams.
ROWS, ENTRIES = 1024, 600_000
PIVOTS = 48
TILE, STRIP = 256, 1 << 12


def grams(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(width, len(h))
    out = h[: len(h) - k + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = out * MULTIPLIER + h[i : i + len(out)]
        out = (out ^ (out >> np.uint64(32)) ^ np.uint64(k)) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(mers: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(mers.tobytes()) - (1 << 63)


def prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, node (named by the set; null without n-grams) of every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            sets = [grams(t, width) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(m) for m in sets], pa.int64()), pa.array([node_of(m) if len(m) else None for m in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "node"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n long, node long")


def entries(sets: list[tuple[int, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """A row (node, gram) for each n-gram."""
    nodes, mers = zip(*sets) if sets else ((), ())
    flat = np.concatenate(mers).view(np.int64) if mers else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(nodes, np.int64), np.array([len(m) for m in mers], np.int64))), pa.array(flat)], names=names)


def low_entries(docs: DataFrame, width: int, low: float) -> DataFrame:
    """node, gram of the n-grams with low hashes, for every document, copies too."""
    bound = np.uint64(low * 2**64) if low < 1 else np.uint64(2**64 - 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 128):
            sets = [(node_of(m), m[m <= bound]) for t in batch.column(0).to_pylist() if len(m := grams(t, width))]
            yield entries(sets, ["node", "gram"])

    return docs.select("text").mapInArrow(task, "node long, gram long")


def least(n: Column, percent: int) -> Column:
    """ceil(n * percent / 100)"""
    return F.floor((n * percent + 99) / 100)


def remaining(docs: DataFrame, found: DataFrame, width: int, percent: int, low: float) -> DataFrame:
    """node, n of the sets that the count of low n-grams doesn't rule out."""
    grouped = low_entries(docs, width, low).groupBy("gram").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    alone = grouped.where("node = other").groupBy("node").agg(F.count("*").alias("alone"))
    nodes = found.where("node is not null").groupBy("node").agg(F.first("n").alias("n"))
    left = nodes.join(alone, "node", "left")
    return left.where(F.coalesce("alone", F.lit(0)) <= F.col("n") - least(F.col("n"), percent)).select("node", "n")


def sets_of(docs: DataFrame, found: DataFrame, left: DataFrame, width: int) -> DataFrame:
    """node, n, mers: the n-grams of the sets in `left`, read from one document each."""
    ids = found.join(left.select("node"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 128):
            sets = [m for t in batch.column(0).to_pylist() if len(m := grams(t, width))]
            columns = [pa.array([node_of(m) for m in sets], pa.int64()), pa.array([len(m) for m in sets], pa.int64()), pa.array([m.tobytes() for m in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "mers"])

    read = texts.select("text").mapInArrow(task, "node long, n long, mers binary")
    return read.join(left.select("node"), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("mers").alias("mers"))


def heads(sets: DataFrame, percent: int) -> DataFrame:
    """node, gram: of every set's n-grams, the rarest first, the first n - least(n) + 1, but for those no other set has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 128):
            yield entries([(node, np.frombuffer(m, np.uint64)) for node, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], ["node", "gram"])

    every = sets.select("node", "mers").mapInArrow(task, "node long, gram long")
    shared = every.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")

    def first_ones(rows: pa.Table) -> pa.Table:
        """Of a set's n-grams that others have: those among the first, after the ones it has alone."""
        n, df, gram = rows["n"][0].as_py(), rows["df"].to_numpy(), rows["gram"].to_numpy()
        free = n + 1 - (n * percent + 99) // 100 - (n - len(gram))
        if free <= 0:
            return rows.select(["node", "gram"]).slice(0, 0)
        return rows.select(["node", "gram"]).take(pa.array(np.lexsort((gram, df))[:free]))

    known = every.join(shared, "gram").join(sets.select("node", "n"), "node")
    return known.groupBy("node").applyInArrow(first_ones, "node long, gram long")


# --- the product of two pieces of the matrix


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sets in a and b (None: in a, i < j) that are linked."""
    size_a = np.array([len(m) for m in a], dtype=np.int64)
    size_b = size_a if b is None else np.array([len(m) for m in b], dtype=np.int64)
    order_a, order_b = np.argsort(size_a, kind="stable"), np.argsort(size_b, kind="stable")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(a), TILE):
        rows = order_a[at : at + TILE]
        for to in range(at if b is None else 0, len(size_b), TILE):
            columns = order_b[to : to + TILE]
            small, large = size_a[rows], size_b[columns]
            if 100 * small[-1] < percent * large[0] or 100 * large[-1] < percent * small[0]:
                continue
            i, j = tile([a[r] for r in rows], None if b is None and to == at else [(a if b is None else b)[c] for c in columns], percent)
            found.append((rows[i], columns[j]))
    return tuple(np.concatenate(part) for part in zip(*found))


def tile(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """linked() of a tile: overlaps over strips of columns, without rows that no longer can reach the bound."""
    same = b is None
    b = a if same else b
    size_a, size_b = (np.array([len(m) for m in x], dtype=np.int64) for x in (a, b))
    # the overlap that a link needs, from 100 * c >= percent * (x + y - c)
    need = -(-percent * (size_a[:, None] + size_b[None, :]) // (100 + percent))
    alive = (100 * size_a[:, None] >= percent * size_b[None, :]) & (100 * size_b[None, :] >= percent * size_a[:, None])
    if same:
        alive &= np.arange(len(a))[:, None] < np.arange(len(a))[None, :]
    if not alive.any():
        return np.nonzero(alive)
    flat = [(np.concatenate(x), np.repeat(np.arange(len(x)), s)) for x, s in ((a, size_a), (b, size_b))]
    columns = [np.unique(f[0]) for f in flat]
    if same:
        values, times = np.unique(flat[0][0], return_counts=True)
        common = values[times > 1]
    else:
        common = np.intersect1d(*columns, assume_unique=True)
    parts = []
    for value, row in flat:
        at = np.searchsorted(common, value)
        at[at == len(common)] = 0
        ok = common[at] == value if len(common) else np.zeros(len(value), dtype=bool)
        parts.append((at[ok], row[ok]))
    times_a, times_b = (np.bincount(at, minlength=len(common)) for at, _ in parts)
    left_a, left_b = (np.bincount(row, minlength=len(x)) for (_, row), x in zip(parts, (a, b)))
    rank = np.empty(len(common), dtype=np.int64)
    rank[np.argsort(-(times_a * times_b), kind="stable")] = np.arange(len(common))  # the columns of most pairs first
    overlap = np.zeros(need.shape, dtype=np.int64)
    sides = []
    for at, row in parts:
        order = np.argsort(rank[at], kind="stable")
        sides.append((rank[at][order], row[order]))
    for start in range(0, len(common), STRIP):
        alive &= overlap + np.minimum(left_a[:, None], left_b[None, :]) >= need
        rows, cols = alive.any(axis=1), alive.any(axis=0)
        if not rows.any():
            break
        dense = []
        for (at, row), keep in zip(sides, (rows, cols)):
            lo, hi = np.searchsorted(at, (start, start + STRIP))
            index = np.cumsum(keep) - 1
            mine = keep[row[lo:hi]]
            m = np.zeros((int(keep.sum()), min(STRIP, len(common) - start)), dtype=np.float32)
            m[index[row[lo:hi][mine]], at[lo:hi][mine] - start] = 1
            dense.append((m, np.bincount(row[lo:hi], minlength=len(keep))))
        overlap[np.ix_(rows, cols)] += np.rint(dense[0][0] @ dense[1][0].T).astype(np.int64)
        left_a, left_b = left_a - dense[0][1], left_b - dense[1][1]
    return np.nonzero(alive & (overlap >= need))


class Forest:
    """Union-find over the rows of a task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[y] = x

    def edges(self, nodes: np.ndarray) -> pa.Table:
        roots = np.array([self.root(i) for i in range(len(nodes))], dtype=np.int64)
        at = np.flatnonzero(roots != np.arange(len(nodes)))
        return pa.table({"u": pa.array(nodes[at], pa.int64()), "v": pa.array(nodes[roots[at]], pa.int64())})


EDGES = "u long, v long"


def unpacked(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(m, np.uint64) for m in rows["mers"].to_pylist()]


def within_blocks(percent: int):
    """Many small blocks in one task, each multiplied with itself."""

    def task(rows: pa.Table) -> pa.Table:
        block, nodes, mers = rows["block"].to_numpy(), rows["node"].to_numpy(), unpacked(rows)
        forest = Forest(len(nodes))
        order = np.argsort(block, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            if len(at) > 1:
                i, j = linked([mers[k] for k in at], None, percent)
                forest.add(at[i], at[j])
        return forest.edges(nodes)

    return task


def between_sides(percent: int):
    """Rows of one side (first) with those of the other; all with each other if there is one side only."""

    def task(rows: pa.Table) -> pa.Table:
        nodes, mers, first = rows["node"].to_numpy(), unpacked(rows), rows["first"].to_numpy(zero_copy_only=False)
        forest = Forest(len(nodes))
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        if len(b):
            i, j = linked([mers[k] for k in a], [mers[k] for k in b], percent)
            forest.add(a[i], b[j])
        else:
            i, j = linked(mers, None, percent)
            forest.add(i, j)
        return forest.edges(nodes)

    return task


def pieces(rows: Column, n_grams: Column, most_rows: int, most_grams: int) -> Column:
    return F.greatest(F.ceil(rows / most_rows), F.ceil(n_grams / most_grams), F.lit(1)).cast("long")


def dealt(placed: DataFrame, joined: DataFrame, most_rows: int, most_grams: int) -> DataFrame:
    """The rows of large blocks, once for every pair of chunks they are in: block, i, j, first.

    joined: node, group. Groups that fill a chunk have chunks of their own, and two of one such group are no pair.
    """
    grouped = placed.join(joined, "node", "left").withColumn("group", F.coalesce("group", "node"))
    sizes = grouped.groupBy("block", "group").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    sizes = sizes.withColumn("own", (F.col("rows") >= most_rows // 2) | (F.col("grams") >= most_grams // 2))
    sizes = saved(sizes.withColumn("name", F.when(F.col("own"), F.col("group")).otherwise(F.lit(0))))
    cut = sizes.groupBy("block", "own", "name").agg(pieces(F.sum("rows"), F.sum("grams"), most_rows, most_grams).alias("parts"))
    chunk = F.xxhash64("block", "own", "name", "part").alias("chunk")
    chunks = saved(cut.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("block", "own", "name", chunk))
    other = chunks.select("block", F.col("own").alias("other_own"), F.col("name").alias("other_name"), F.col("chunk").alias("other"))
    pairs = chunks.join(other, "block").where(~(F.col("own") & F.col("other_own") & (F.col("name") == F.col("other_name")))).select("chunk", "other")
    of = sizes.select("block", "group", "own", "name").join(cut, ["block", "own", "name"])
    rows = grouped.join(of, ["block", "group"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn("chunk", chunk)
    return rows.join(pairs, "chunk").select("block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") <= F.col("other")).alias("first"), "node", "mers")


def blocks_of(sets: DataFrame, percent: int) -> DataFrame:
    """node, block of the sets whose head shares an n-gram with another's."""
    head = saved(heads(sets, percent))
    hub = head.groupBy("gram").agg(F.min("node").alias("v"), F.count("*").alias("df")).where("df > 1").select("gram", "v")
    touching = head.withColumnRenamed("node", "u").join(hub, "gram").where("u <> v").select("u", "v").distinct()
    return components(touching).select(F.col("id").alias("node"), F.col("component").alias("block"))


def products(sets: DataFrame, blocks: DataFrame, percent: int, most_rows: int = ROWS, most_grams: int = ENTRIES, pivots: int = PIVOTS) -> DataFrame:
    """sets(node, n, mers), blocks(node, block) -> (u, v): links that join all that the products of the blocks would join."""
    placed = saved(sets.join(blocks, "node"))
    sizes = saved(placed.groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("grams")))
    large = (F.col("rows") > most_rows) | (F.col("grams") > most_grams)
    few = sizes.where(~large)
    total = few.agg(F.sum("rows"), F.sum("grams")).first()
    bins = 1 + max((total[0] or 0) // most_rows, (total[1] or 0) // most_grams)
    small = placed.join(few.select("block"), "block", "left_semi").withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(bins)))
    found = saved(small.groupBy("bin").applyInArrow(within_blocks(percent), EDGES))
    big = sizes.where(large)
    if big.isEmpty():
        return found
    big = saved(placed.join(big, "block"))
    drawn = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("rows") / pivots)) == 0
    chunks = pieces(F.col("rows"), F.col("grams"), most_rows, most_grams)
    with_part = big.withColumn("part", F.pmod(F.xxhash64("node"), chunks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("part")
    facing = with_part.where(~drawn).select("block", "part", "node", "mers", F.lit(True).alias("first")).union(big.where(drawn).select("block", every, "node", "mers", F.lit(False).alias("first")))
    starred = saved(facing.groupBy("block", "part").applyInArrow(between_sides(percent), EDGES))
    joined = components(starred).select(F.col("id").alias("node"), F.col("component").alias("group"))
    rest = saved(dealt(big.drop("rows", "grams"), joined, most_rows, most_grams).groupBy("block", "i", "j").applyInArrow(between_sides(percent), EDGES))
    return found.union(starred).union(rest)


def classes(docs: DataFrame, width: int = 5, percent: int = 80, low: float = LOW, **how) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of every document."""
    found = saved(prints(docs, width))
    left = saved(remaining(docs, found, width, percent, low))
    sets = saved(sets_of(docs, found, left, width))
    joined = components(products(sets, blocks_of(sets, percent), percent, **how)).withColumnRenamed("id", "node")
    nodes = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = nodes.join(names, "component").select("node", "component_id")
    return found.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
