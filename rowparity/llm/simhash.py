"""SimHash near-duplicates by a self-join over a binary trie of fingerprints.

A sorted array of fingerprints is its own binary trie: a node is a range of values with a common prefix. The join
starts with the pair (root, root) and goes down both sides together. Each level splits the two ranges at the next bit
and makes up to four pairs; a pair whose prefixes differ adds to its error, and pairs over the budget are pruned. Small
pairs are finished by comparing their values directly.

Spark spreads the traversal: fingerprints are dealt out by pairs of subtrees below a prefix of a few bits, again only
pairs within the budget, so a fingerprint is sent once for each of its subtree pairs. The prefix grows with the number
of fingerprints until a subtree fits into a task; the bits are ordered so that the most even ones come first. Subtrees
that are still too large are cut into chunks, and every pair of chunks is a task of its own. A task
reports for each of its fingerprints one edge to the least member of its group there (a spanning forest, not all pairs)
and its number of links.

Equal fingerprints are one node, named by the least doc_id that has it. Components of the edges are found by the shared
large-star/small-star steps.

Defined results: null texts are empty; a text without words has the fingerprint zero, and is linked like any other; a
null doc_id gets the component of its fingerprint if a document with an id has that one, otherwise null; repeated rows
are returned as often as they come; a text may be as long as a row can hold, and takes about 100 bytes a word in its task;
an empty table gives no rows; other columns are ignored. A doc_id names one text: where rows of one id have
different texts, near_duplicates joins the groups whose least id it is, and first_of_each drops all rows of the id if
one of its texts belongs to a group with a smaller id, also a text that is like no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import components, saved
from .texts import in_parts, words

SEED = 42
SUBTREE = 1 << 17  # fingerprints a task may hold of one subtree, twice
LEAF = 256  # node pairs with at most so many combinations are compared directly
FRONTIER = 1 << 17  # node pairs that are expanded at a time
BIT_COUNT = np.array([[(b >> (7 - k)) & 1 for k in range(8)] for b in range(256)], dtype=np.int64)


def shingles(tokens: list[bytes], width: int) -> list[bytes]:
    if len(tokens) < width:
        return [b" ".join(tokens)] if tokens else []
    return list(map(b" ".join, zip(*(tokens[k:] for k in range(width)))))


def hashes(features: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(f, SEED) for f in features), dtype=np.uint64, count=len(features))


def majority(h: np.ndarray) -> bytes:
    """Big-endian bits that are set in over half of the rows of h (uint64, n x lanes)."""
    if not len(h):
        return bytes(8 * (h.shape[1] if h.ndim > 1 else 1))
    h = h.reshape(len(h), -1)
    columns = h.astype(">u8").view(np.uint8).reshape(len(h), -1).astype(np.int32)
    columns += 256 * np.arange(columns.shape[1], dtype=np.int32)
    seen = np.bincount(columns.ravel(), minlength=256 * columns.shape[1]).reshape(-1, 256)
    return np.packbits((2 * (seen @ BIT_COUNT) > len(h)).ravel()).tobytes()


def lanes(h: np.ndarray, n: int) -> np.ndarray:
    """n independent hashes of each value (finalizer of splitmix64 over offsets)."""
    with np.errstate(over="ignore"):
        x = h[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            fps = [int.from_bytes(majority(hashes(shingles(words(t), width))), "big", signed=True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, fp long")


# --- the join of two subtrees in one task


def split_at(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where in each range [lo, hi) of the sorted values the bit becomes 1."""
    middle = np.searchsorted(values, ((values[lo] >> np.uint64(bit)) | np.uint64(1)) << np.uint64(bit))
    return np.clip(middle, lo, hi)


def compare(a: np.ndarray, b: np.ndarray, frontier: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius in the node pairs (alo, ahi, blo, bhi)."""
    alo, ahi, blo, bhi = frontier[:4].astype(np.int64)
    na, nb = ahi - alo, bhi - blo
    sizes = na * nb
    if not len(sizes) or not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i, j = alo[of] + k // nb[of], blo[of] + k % nb[of]
    ok = np.bitwise_count(a[i] ^ b[j]) <= radius
    if same:
        ok &= i < j
    return i[ok], j[ok]


def trie_join(a: np.ndarray, b: np.ndarray | None, radius: int, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of distinct sorted values within the radius; b None: of a with itself, each pair once."""
    same = b is None
    b = a if same else b
    if not len(a) or not len(b):
        return
    stack = [(bits - 1, np.array([[0], [len(a)], [0], [len(b)], [0]], dtype=np.int32))]
    while stack:
        bit, pairs = stack.pop()
        small = (pairs[1] - pairs[0]).astype(np.int64) * (pairs[3] - pairs[2]) <= LEAF
        if bit < 0:
            small[:] = True
        leaves = pairs[:, small]
        for at in range(0, leaves.shape[1], FRONTIER // 128):
            yield compare(a, b, leaves[:, at : at + FRONTIER // 128], radius, same)
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        alo, ahi, blo, bhi, err = pairs
        am, bm = split_at(a, alo, ahi, bit), split_at(b, blo, bhi, bit)
        children = []
        for (al, ah, x), (bl, bh, y) in (((p), (q)) for p in ((alo, am, 0), (am, ahi, 1)) for q in ((blo, bm, 0), (bm, bhi, 1))):
            grown = err + (x != y)
            keep = (grown <= radius) & (al < ah) & (bl < bh)
            if same and x > y:  # of a node with itself, only one of the two mixed pairs
                keep &= alo != blo
            children.append(np.array([al, ah, bl, bh, grown], dtype=np.int32)[:, keep])
        merged = np.concatenate(children, axis=1)
        for at in range(0, merged.shape[1], FRONTIER):
            stack.append((bit - 1, merged[:, at : at + FRONTIER]))


class Groups:
    """Union-find over the indices of one task; the root of a group is its least node."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.parent, self.links = nodes, np.arange(len(nodes)), np.zeros(len(nodes), dtype=np.int64)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.links += np.bincount(i, minlength=len(self.links)) + np.bincount(j, minlength=len(self.links))
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                if self.nodes[x] > self.nodes[y]:
                    x, y = y, x
                self.parent[y] = x

    def rows(self) -> pa.Table:
        at = np.flatnonzero(self.links)
        roots = np.array([self.root(i) for i in at], dtype=np.int64)
        return pa.table({"u": self.nodes[at], "v": self.nodes[roots], "links": self.links[at]})


@dataclass(frozen=True)
class Layout:
    """The order of the bits and the length of the prefix that deals subtrees out."""

    order: tuple[int, ...]
    prefix: int


def deal(rows: DataFrame, by: list[str], prefix: int, radius: int, bits: int, subtree: int) -> DataFrame:
    """rows(node, p, by) with what their task is known by (by, a, mask, i, j) and their side in it (first).

    A task has two subtrees, a and a xor mask, or with mask 0 one with itself. A subtree of more than `subtree` rows is
    cut into chunks; a task then has chunk i of the one and chunk j of the other.
    """
    own = F.shiftrightunsigned("p", bits - prefix) if prefix else F.lit(0).cast("long")
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << prefix) if m.bit_count() <= radius])
    placed = rows.withColumn("own", own)
    large = placed.groupBy(*by, "own").count().where(F.col("count") > subtree).select(*by, "own", F.ceil(F.col("count") / subtree).cast("long").alias("n"))
    dealt = placed.withColumn("mask", F.explode(masks)).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    if large.isEmpty():
        dealt = dealt.withColumns({"chunk": F.lit(0).cast("long"), "facing": F.lit(0).cast("long")})
    else:
        large = saved(large)
        mine, theirs = large.withColumnRenamed("n", "n_own"), large.select(*by, F.col("own").alias("other"), F.col("n").alias("n_other"))
        dealt = dealt.join(mine, [*by, "own"], "left").join(theirs, [*by, "other"], "left")
        one = F.lit(1).cast("long")
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.coalesce("n_own", one))).withColumn("facing", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("n_other", one) - 1)))
    same, low = F.col("mask") == 0, F.col("own") < F.col("other")
    first = F.when(same, F.col("chunk") <= F.col("facing")).otherwise(low)
    ends = {"a": F.least("own", "other"), "first": first, "i": F.when(first, F.col("chunk")).otherwise(F.col("facing")), "j": F.when(first, F.col("facing")).otherwise(F.col("chunk"))}
    return dealt.withColumns(ends).drop("own", "other", "chunk", "facing", "n_own", "n_other")


TASK = ["a", "mask", "i", "j"]


def with_itself(rows: pa.Table) -> bool:
    return rows["mask"][0].as_py() == 0 and rows["i"][0] == rows["j"][0]


def permuted(order: tuple[int, ...]) -> F.Column:
    """fp with its bits in the given order (the first becomes the highest), as SQL expressions."""
    out = F.lit(0).cast("long")
    for to, bit in enumerate(order):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1).cast("long")), len(order) - 1 - to))
    return out


def layout(nodes: DataFrame, subtree: int = SUBTREE, least: int = 6, bits: int = 64) -> Layout:
    """Two small aggregates over the distinct fingerprints: how even each bit is, then the largest subtree."""
    ones = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(bits)]
    row = nodes.agg(F.count("*").alias("n"), *ones).first()
    order = tuple(sorted(range(bits), key=lambda b: (abs(2 * (row[f"b{b}"] or 0) - row["n"]), b)))
    prefix = least
    while row["n"] > subtree << prefix:
        prefix += 1
    at = nodes.select(permuted(order).alias("p"))
    while row["n"] > subtree and prefix < 24:
        largest = at.groupBy(F.shiftrightunsigned("p", bits - prefix)).count().agg(F.max("count")).first()[0]
        if largest <= subtree:
            break
        prefix += 1
    return Layout(order, prefix)


def links(nodes: DataFrame, radius: int, how: Layout, bits: int = 64, subtree: int = SUBTREE) -> DataFrame:
    """nodes(fp, node) -> (u, v, links): for every node with links in a task, an edge to its group's least node."""
    dealt = deal(nodes.select("node", permuted(how.order).alias("p")), [], how.prefix, radius, bits, subtree)

    def task(rows: pa.Table) -> pa.Table:
        order = np.argsort(values := rows["p"].to_numpy().view(np.uint64))
        nodes, values = rows["node"].to_numpy()[order], values[order]
        groups = Groups(nodes)
        if with_itself(rows):
            for i, j in trie_join(values, None, radius, bits):
                groups.add(i, j)
        else:
            side = rows["first"].to_numpy(zero_copy_only=False)[order]
            a, b = np.flatnonzero(side), np.flatnonzero(~side)
            for i, j in trie_join(values[a], values[b], radius, bits):
                groups.add(a[i], b[j])
        return groups.rows()

    return dealt.groupBy(*TASK).applyInArrow(task, "u long, v long, links long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id, n_links (other fingerprints within the radius) of every document."""
    prints = saved(fingerprints(docs, width))
    nodes = saved(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = saved(links(nodes, radius, layout(nodes)))
    joined = components(found.select("u", "v"))
    degree = found.groupBy("u").agg(F.sum("links").alias("n_links")).withColumnRenamed("u", "node")
    classes = nodes.join(joined.withColumnRenamed("id", "node"), "node", "left").join(degree, "node", "left")
    named = classes.select("fp", F.coalesce("component", "node").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


# --- groups of similar texts beyond the radius of one fingerprint

WIDE = 4  # words of 64 bits
TABLES = 16
PAIRS = 1 << 19  # pairs that a task looks at together
RUN = 1 << 10  # keys alike in some pieces that are compared pair by pair; more go down the trie
BY_PIECES = 1 << 14  # texts from which on each piece of a key is dealt out
ROUND = 1 << 24  # rows of keys that are dealt out at a time


def minima(mers: np.ndarray) -> bytes:
    """64 * WIDE bits, each of the least of the mers in an order of its own: two sets differ in one with (1 - similarity) / 2."""
    order = lanes(np.zeros(1, dtype=np.uint64), 64 * WIDE)[0] | np.uint64(1)
    if not len(mers):
        return bytes(8 * WIDE)
    least = np.full(64 * WIDE, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(mers), 4096):
            np.minimum(least, (mers[at : at + 4096, None] * order).min(axis=0), out=least)
        bits = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return np.packbits(bits.astype(np.uint8)).tobytes()


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, node (named by the set of shingles), keys: sixteen 32-bit fingerprints of that set, wide: 256 bits of its minima and its size."""
    names = ["doc_id", "node", "keys", "wide"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            sets = [jaccard.grams(text, width) for text in batch.column(1).to_pylist()]
            columns = [
                pa.array([jaccard.node_of(m) for m in sets], pa.int64()),
                pa.array([majority(lanes(m, TABLES // 2)) for m in sets], pa.binary()),
                pa.array([minima(m) + len(m).to_bytes(8, "little") for m in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, node long, keys binary, wide binary")


def may_be_alike(x: np.ndarray, y: np.ndarray, limit: int, least: float) -> np.ndarray:
    """Of rows of minima and sizes: at most `limit` bits apart, and of sizes that a Jaccard similarity of `least` allows."""
    apart = np.bitwise_count(x[:, :WIDE] ^ y[:, :WIDE]).sum(axis=1, dtype=np.int64)
    return (apart <= limit) & (np.minimum(x[:, WIDE], y[:, WIDE]) >= least * np.maximum(x[:, WIDE], y[:, WIDE]) - 1e-9)


def products(blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The index pairs of blocks (from, rows, from, rows), some at a time."""
    ends = np.cumsum(blocks[:, 1] * blocks[:, 3])
    for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        t = np.arange(at, min(at + PAIRS, int(ends[-1])))
        of = np.searchsorted(ends, t, side="right")
        t = t - (ends - blocks[:, 1] * blocks[:, 3])[of]
        yield blocks[of, 0] + t // blocks[of, 3], blocks[of, 2] + t % blocks[of, 3]


def near_keys(a: np.ndarray, b: np.ndarray | None, radius: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """trie_join() for short keys, of which by chance many are near: keys within the radius have all but `radius` pieces of their bits alike.

    For each choice of pieces the keys are sorted by these, and those that are alike in them compared; a pair comes with
    the first of its choices.
    """
    keys = a if b is None else np.concatenate([a, b])
    first = len(keys) if b is None else len(a)
    vary = int(np.bitwise_or.reduce(keys ^ keys[0])).bit_length() if len(keys) else 0
    pieces = next((m for m in range(radius + 1, radius + 4) if vary * (m - radius) >= m * (len(keys).bit_length() - 1)), radius + 4)
    if len(keys) <= LEAF or vary < pieces:
        yield from trie_join(a, b, radius, bits)
        return
    ends = [vary * k // pieces for k in range(pieces + 1)]
    masks = [(1 << y) - (1 << x) for x, y in zip(ends, ends[1:])]
    chosen = [np.uint64(sum(c)) for c in combinations(masks, pieces - radius)]
    for k, mask in enumerate(chosen):
        order = np.argsort(keys & mask, kind="stable")  # sides stay apart, and a side's keys in order
        v = keys[order]
        start = np.flatnonzero(np.append(True, (v[1:] ^ v[:-1]) & mask != 0))
        n = np.diff(np.append(start, len(v)))
        later = np.repeat(start + n, n) - np.arange(len(v)) - 1

        def fresh(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i, j = np.minimum(order[i], order[j]), np.maximum(order[i], order[j])
            differ = keys[i] ^ keys[j]
            ok = (np.bitwise_count(differ) <= radius) & ((j >= first) & (i < first) if b is not None else True)
            for before in chosen[:k]:
                ok &= differ & before != 0
            return i[ok], j[ok] - (0 if b is None else first)

        for at in np.flatnonzero(n > RUN).tolist():
            run = np.arange(start[at], start[at] + n[at])
            later[run] = 0
            own = run[order[run] < first]
            rest = run[len(own) :]
            for i, j in trie_join(v[own], v[rest] if b is not None else None, radius, bits):
                yield fresh(own[i], (own if b is None else rest)[j])
        i = np.arange(len(v))
        for d in range(1, RUN):
            i = i[later[i] >= d]
            if not len(i):
                break
            for at in range(0, len(i), PAIRS):
                x = i[at : at + PAIRS]
                x = x[np.bitwise_count(v[x] ^ v[x + d]) <= radius]
                yield fresh(x, x + d)


def join_alike(values: np.ndarray, side: np.ndarray | None, wide: np.ndarray, groups: Groups, radius: int, limit: int, bits: int, least: float) -> None:
    """Join in groups all rows whose keys are within the radius and that may be alike.

    Rows are sorted by side and value; with sides, only rows of different ones are paired. Of the rows with a key, those
    like the first of them are a group at once, so of two keys whose first rows are alike only the others are paired.
    """
    starts = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (side[1:] != side[:-1] if side is not None else False)))
    sizes = np.diff(np.append(starts, len(values)))
    hub = np.repeat(starts, sizes)
    like = may_be_alike(wide, wide[hub], limit, least)
    own = np.flatnonzero(like & (hub != np.arange(len(values))))
    groups.add(hub[own], own)
    # within a key, rows like its first come before the others
    order = np.lexsort((~like, hub))
    alike = np.add.reduceat(like, starts).astype(np.int64)

    def add(blocks: list[np.ndarray]) -> None:
        every = np.concatenate([b.T for b in blocks])
        for x, y in products(every[(every[:, 1] > 0) & (every[:, 3] > 0)]):
            x, y = order[x], order[y]
            ok = (x != y) & may_be_alike(wide[x], wide[y], limit, least)
            groups.add(x[ok], y[ok])

    if side is None:
        rest = starts + alike
        add([np.array([rest, sizes - alike, starts, sizes])])
    keys = values[starts]
    first = len(keys) if side is None else int(np.count_nonzero(~side[starts]))
    for i, j in near_keys(keys[:first], None if side is None else keys[first:], radius, bits):
        j = j if side is None else j + first
        met = may_be_alike(wide[starts[i]], wide[starts[j]], limit, least)
        groups.add(starts[i][met], starts[j][met])
        a, b = i[met], j[met]
        add([
            np.array([starts[a] + alike[a], sizes[a] - alike[a], starts[b], sizes[b]]),
            np.array([starts[a], alike[a], starts[b] + alike[b], sizes[b] - alike[b]]),
            np.array([starts[i][~met], sizes[i][~met], starts[j][~met], sizes[j][~met]]),
        ])


def turned(prefix: int, radius: int) -> F.Column:
    """Rows (piece, p): p with each of radius + 1 pieces of its 32 bits foremost, of which keys within the radius have one alike."""
    width, low = 32 // (radius + 1), F.lit((1 << 32) - 1).cast("long")
    turns = [k * width for k in range(radius + 1)] if prefix else [0]
    p = [F.shiftleft("p", s).bitwiseOR(F.shiftright("p", 32 - s)).bitwiseAND(low) if s else F.col("p") for s in turns]
    return F.inline(F.array(*[F.struct(F.lit(s).alias("piece"), x.alias("p")) for s, x in zip(turns, p)]))


def candidate_links(keyed: DataFrame, radius: int, limit: int, prefix: int, subtree: int, similarity: float) -> DataFrame:
    """(u, v): of the rows (node, wide, t, p), those that may be alike joined in each task, as edges to its least node.

    A row is sent once for each piece of its key, to the task of that piece's first `prefix` bits, however many these are.
    """
    dealt = deal(keyed.select("node", "wide", "t", turned(prefix, radius)), ["t", "piece"], prefix, 0, 32, subtree)

    def task(rows: pa.Table) -> pa.Table:
        values, side = rows["p"].to_numpy().astype(np.uint64), ~rows["first"].to_numpy(zero_copy_only=False)
        itself = with_itself(rows)
        if itself:
            side[:] = False
        order = np.lexsort((rows["node"].to_numpy(), values, side))
        wide = np.frombuffer(b"".join(rows["wide"].to_pylist()), dtype=np.uint64).reshape(-1, WIDE + 1)[order]
        groups = Groups(rows["node"].to_numpy()[order])
        join_alike(values[order], None if itself else side[order], wide, groups, radius, limit, 32, similarity)
        return groups.rows().select(["u", "v"])

    return dealt.groupBy("t", "piece", *TASK).applyInArrow(task, "u long, v long").where("u <> v")


def verified(blocks: DataFrame, drawn: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """(u, v): links of blocks (node, block) by the exact Jaccard similarity of their sets, enough to join all that are linked."""
    sets = saved(jaccard.sets_of(docs, drawn, blocks, width))
    return jaccard.products(sets, blocks, round(100 * least))


def similar(docs: DataFrame, width: int = 5, radius: int = 3, limit: int = 43, subtree: int = SUBTREE, least: float = 0.8) -> DataFrame:
    """doc_id, component_id of the documents with an id: groups of texts whose shingle sets have a similarity of `least` or more.

    Two sets are candidates if one of sixteen 32-bit SimHash fingerprints of their shingles is within the radius (found by
    near_keys(); 0.99 of the pairs at a similarity of 0.8, more above) and 256 bits of their minima differ in at most
    `limit` (26 on average at 0.8, standard deviation 5; 128 for unrelated texts); sets of sizes that rule the similarity
    out are none. Tables are dealt out some at a time, at most ROUND rows but for a single one, and what a round has shuffled
    is deleted at its end: a text is sent 64 times whatever their number, until 256 subtrees no longer fit into tasks. A task gives a spanning forest of its candidates, never pairs, and the components of these are blocks.
    Inside a block all sets are compared exactly, by the blocked product of the n-gram join, so a link has a similarity of
    0.8 or more, and one inside a block is found even if its two ends were no candidates.
    """
    drawn = saved(sketches(docs, width).where(F.col("doc_id").isNotNull()))
    nodes = saved(drawn.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("wide").alias("wide")))
    n = nodes.count()
    prefix = int(n > BY_PIECES)
    while n > subtree << prefix and prefix < 32 // (radius + 1):
        prefix += 1
    part = F.conv(F.hex(F.substring(F.col("keys"), F.col("t") * 4 + 1, F.lit(4))), 16, 10).cast("long").alias("p")
    at_once = max(1, ROUND // max(1, n * (radius + 1 if prefix else 1)))
    rounds = []
    for t in range(0, TABLES, at_once):
        table = F.explode(F.sequence(F.lit(t), F.lit(min(t + at_once, TABLES) - 1)))
        keyed = nodes.select("node", "wide", table.alias("t"), "keys").select("node", "wide", "t", part)
        rounds.append(saved(candidate_links(keyed, radius, limit, prefix, subtree, least)))
    blocks = saved(components(reduce(DataFrame.union, rounds)).select(F.col("id").alias("node"), F.col("component").alias("block")))
    joined = components(verified(blocks, drawn, docs, width, least)).withColumnRenamed("id", "node")
    placed = nodes.select("node", "doc_id").join(joined, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    names = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return drawn.join(placed.join(names, "comp").select("node", "component_id"), "node").select("doc_id", "component_id")


def first_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs but for those whose group has a document with a smaller id; rows without an id stay."""
    groups = similar(docs, **how)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
