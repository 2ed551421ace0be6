"""Deleted interpolation: an n-gram model whose maximum-likelihood estimates are mixed with learned weights.

P(w | h) = w0[b] / (V + 1) + w1[b] c(w) / N + w2[b] c(h w) / c(h) + ..., where b is the bucket (powers of two) of the
frequency of the longest context. The weights of a bucket come from expectation-maximisation: counts from the kept
training documents predict the tokens of the deleted ones. The final model uses the counts of both.

How it runs. Documents are gathered into blocks of some MB, each a row with its tokens as indices into its vocabulary
(no shuffle; written once). A block asks for the counts of its distinct n-grams: a row per block and hash shard. Each
shard adds up what the blocks have counted and answers each block in the order of its question, so n-grams cross the
network once per block, not once per token, and answers are bare counts. A block and its answers then meet to give the
events of expectation-maximisation (from the deleted documents' blocks alone) and, with the weights, the scores.
Iterations are small aggregates over the events; only weights (buckets x orders) reach the driver.

n-grams are known by hashes of 20 bits more than it takes to number the corpus' n-grams (up to 64). Defined results: a
null text is empty, its only token the end; texts may be of any length that a row can hold; a null doc_id is held out;
repeated rows count and are returned as often as they come; equal texts have equal scores; other columns are ignored;
without training tokens every probability is uniform; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .texts import in_parts, words

HELD_OUT, KEPT, DELETED = 0, 1, 2
END, BEGIN = b"\n", b"\n\n"  # no word holds white space
BLOCK_BYTES = 8 << 20
BUCKETS = 40
LEAST_WEIGHT = 1e-6  # so that what the deleted documents never showed keeps a probability
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SHARD_TOKENS = 5 << 19  # of the corpus, for each order and shard: about a million n-grams that blocks ask for
SPARE_BITS = 20  # of a hash beyond those that number the corpus' n-grams: one in a million meets another
BLOCKS = "block long, deleted boolean, n_tokens long, doc_ids array<long>, roles binary, lengths binary, tokens binary, vocabulary binary"


def roles(folds: int = 5, fold: int = 1, deleted_folds: int = 20, deleted_fold: int = 4) -> F.Column:
    """Held out: crc32 of the id as text falls into the fold. Of the others, a part is deleted from the counts that the weights are learned with."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    return F.when(crc.isNull() | (crc % folds == fold), HELD_OUT).when(crc % deleted_folds == deleted_fold, DELETED).otherwise(KEPT)


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of the array, plane by plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def expand(data: bytes, dtype: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def sorted_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def keys_of(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, "<u8"), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents' tokens; deleted documents have blocks of their own."""
    import xxhash

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), roles().alias("role"), F.col("text").cast("string").alias("text"))

    class Open:
        def __init__(self, deleted: bool):
            self.deleted, self.size, self.known = deleted, 0, {END: 0}
            self.ids, self.roles, self.docs = [], [], []

        def add(self, doc, role: int, text: str | None) -> None:
            known, tokens = self.known, words(text)
            for t in set(tokens).difference(known):
                known[t] = len(known)
            self.docs.append(np.fromiter(map(known.__getitem__, tokens), dtype="<i4", count=len(tokens)))
            self.ids.append(doc)
            self.roles.append(role)
            self.size += len(text or "") + 8

        def row(self, block: int) -> tuple:
            end = np.zeros(1, dtype="<i4")
            tokens = np.concatenate([x for d in self.docs for x in (d, end)])
            vocabulary = np.fromiter(map(xxhash.xxh64_intdigest, self.known), dtype="<u8", count=len(self.known))
            lengths = np.array([len(d) + 1 for d in self.docs], dtype="<i4")
            return block, self.deleted, len(tokens), self.ids, np.array(self.roles, dtype=np.uint8).tobytes(), lengths.tobytes(), squeeze(tokens), vocabulary.tobytes()

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        parts = {False: Open(False), True: Open(True)}

        def full(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            part, parts[deleted] = parts[deleted], Open(deleted)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(part.row(first + made), kinds)], names=names)

        for batch in in_parts(batches):
            for doc, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = parts[role == DELETED]
                part.add(doc, role, text)
                if part.size >= block_bytes:
                    yield full(part.deleted)
        for deleted in (False, True):
            if parts[deleted].docs:
                yield full(deleted)

    return source.mapInArrow(task, BLOCKS)


@dataclass
class Block:
    """A block's distinct n-grams of each order, by hash, and where each token finds its own."""

    roles: np.ndarray
    lengths: np.ndarray
    keys: list[np.ndarray]  # an order's distinct hashes, sorted
    of: list[np.ndarray]  # a token's place in them; for contexts see before

    @classmethod
    def read(cls, row: dict, order: int, bits: int = 64) -> Block:
        """bits: of the hashes' highest ones that tell n-grams apart."""
        tokens, hashes = expand(row["tokens"], "<i4"), np.frombuffer(row["vocabulary"], dtype="<u8")
        lengths = np.frombuffer(row["lengths"], dtype="<i4")
        begin = mix(np.array([int.from_bytes(BEGIN, "big")], dtype=np.uint64))[0]
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # in its document
        keys, of = [], []
        h = gram = hashes[tokens]
        for n in range(1, order + 1):
            if n > 1:
                back = np.full(len(tokens), begin, dtype=np.uint64)
                inside = place >= n - 1
                back[inside] = h[np.flatnonzero(inside) - (n - 1)]
                with np.errstate(over="ignore"):
                    gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(n))
            k, i = np.unique(gram >> np.uint64(64 - bits), return_inverse=True)
            keys.append(k)
            of.append(i)
        return cls(np.frombuffer(row["roles"], dtype=np.uint8), lengths, keys, of)

    def counts(self, n: int, role: int) -> np.ndarray:
        chosen = np.repeat(self.roles == role, self.lengths)
        return np.bincount(self.of[n][chosen], minlength=len(self.keys[n])).astype("<u4")


def shard_bounds(keys: np.ndarray, shards: int, bits: int) -> list[int]:
    """Where each shard, a range of the hashes, begins in the sorted keys."""
    first = np.array([(s << bits) // shards for s in range(shards)], dtype=np.uint64)
    return np.searchsorted(keys, first).tolist() + [len(keys)]


QUESTIONS = "block long, shard int, ord int, keys binary, kept binary, deleted binary"
ANSWERS = "block long, shard int, ord int, kept binary, deleted binary, types long, kept_types long, total long, kept_total long"


def questions(block_rows: DataFrame, order: int, shards: int, bits: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block.read(row, order, bits)
                for n, keys in enumerate(block.keys):
                    kept, deleted = block.counts(n, KEPT), block.counts(n, DELETED)
                    at = shard_bounds(keys, shards, bits)
                    rows = [(row["block"], s, n, sorted_keys(keys[a:b]), squeeze(kept[a:b]), squeeze(deleted[a:b])) for s, (a, b) in enumerate(zip(at, at[1:])) if a < b]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in QUESTIONS.split(", ")])

    return block_rows.mapInArrow(task, QUESTIONS)


def answers(asked: DataFrame) -> DataFrame:
    """For every question the corpus counts of its n-grams, in its order; types and totals once per shard and order."""

    def task(rows: pa.Table) -> pa.Table:
        block, keys = rows["block"].to_pylist(), [keys_of(x) for x in rows["keys"].to_pylist()]
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        kept, deleted = (np.bincount(of, weights=np.concatenate([expand(x, "<u4") for x in rows[c].to_pylist()]), minlength=len(distinct)).astype("<u4") for c in ("kept", "deleted"))
        cut = np.cumsum([len(k) for k in keys])[:-1]
        parts = np.split(of, cut)
        n = len(parts)
        once = lambda x: pa.array([int(x)] + [0] * (n - 1), pa.int64())
        both = kept.astype(np.int64) + deleted
        columns = {"block": pa.array(block, pa.int64()), "shard": rows["shard"], "ord": rows["ord"], "kept": pa.array([squeeze(kept[p]) for p in parts], pa.binary()), "deleted": pa.array([squeeze(deleted[p]) for p in parts], pa.binary())}
        return pa.table(columns | {"types": once((both > 0).sum()), "kept_types": once((kept > 0).sum()), "total": once(both.sum()), "kept_total": once(kept.sum(dtype=np.int64))})

    return asked.groupBy("shard", "ord").applyInArrow(task, ANSWERS)


@dataclass(frozen=True)
class Totals:
    types: int
    tokens: int
    documents: int


def estimates(block: Block, told: list[np.ndarray], totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token: its count, its estimates of order 0, 1, ... and its bucket."""
    count = [t[i].astype(np.float64) for t, i in zip(told, block.of)]
    p = [np.full(len(count[0]), 1.0 / (totals.types + 1)), count[0] / max(1, totals.tokens)]
    first = np.zeros(len(count[0]), dtype=bool)
    first[np.cumsum(block.lengths) - block.lengths] = True
    context = np.full(len(count[0]), float(totals.tokens))
    for n in range(1, len(count)):
        # the context of a token is the (n-1)-gram that ends before it; a document's first has the beginning as its context
        context = np.where(first, float(totals.documents), np.append(0.0, count[n - 1][:-1]))
        p.append(np.divide(count[n], context, out=np.zeros_like(context), where=context > 0))
    bucket = np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)
    return count[0], np.array(p), np.minimum(bucket, BUCKETS - 1)


def told_of(rows: pa.Table, order: int, kept_only: bool) -> list[np.ndarray]:
    out = []
    for n in range(order):
        mine = sorted((r for r in rows.select(["shard", "ord", "kept", "deleted"]).to_pylist() if r["ord"] == n), key=lambda r: r["shard"])
        kept = np.concatenate([expand(r["kept"], "<u4") for r in mine]).astype(np.int64)
        out.append(kept if kept_only else kept + np.concatenate([expand(r["deleted"], "<u4") for r in mine]))
    return out


def events(block_rows: DataFrame, told: DataFrame, totals: Totals, order: int, bits: int) -> DataFrame:
    """From the deleted documents: bucket, estimates and number of the tokens that agree in them, a row per block."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Block.read(row, order, bits)
            _, p, bucket = estimates(block, told_of(right, order, True), totals)
            distinct, n = np.unique(np.vstack([bucket, p]), axis=1, return_counts=True)
            out.append((distinct[0].astype("<i4").tobytes(), squeeze(np.ascontiguousarray(distinct[1:]).ravel()), n.astype("<i4").tobytes()))
        return pa.table([pa.array(x, pa.binary()) for x in zip(*out)] if out else [pa.array([], pa.binary())] * 3, names=["bucket", "p", "n"])

    return block_rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(task, "bucket binary, p binary, n binary")


def learn(observed: DataFrame, order: int, rounds: int = 25, tolerance: float = 1e-3) -> np.ndarray:
    """Weights (buckets x orders from 0) by expectation-maximisation; a bucket without events takes the weights of all."""
    k = order + 1
    weights = np.full((BUCKETS + 1, k), 1.0 / k)  # the last row: all buckets as one
    for _ in range(rounds):
        now = weights

        def task(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((BUCKETS + 1, k))
            for batch in batches:
                for b, p, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    bucket, n = np.frombuffer(b, dtype="<i4"), np.frombuffer(n, dtype="<i4")
                    p = expand(p, "<f8").reshape(k, -1)
                    for rows, at in ((now[bucket].T, bucket), (now[BUCKETS][:, None], np.full(len(bucket), BUCKETS))):
                        part = p * rows
                        part *= n / part.sum(axis=0)
                        for i in range(k):
                            sums[:, i] += np.bincount(at, weights=part[i], minlength=BUCKETS + 1)
            at = np.argwhere(sums > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(sums[sums > 0])], names=["b", "k", "s"])

        got = observed.mapInArrow(task, "b long, k long, s double").groupBy("b", "k").agg(F.sum("s").alias("s")).collect()
        sums = np.zeros_like(weights)
        for r in got:
            sums[r["b"], r["k"]] = r["s"]
        if not sums.any():
            return weights[:BUCKETS]
        total = sums.sum(axis=1, keepdims=True)
        weights = np.where(total > 0, sums / np.where(total > 0, total, 1), sums[BUCKETS] / sums[BUCKETS].sum())
        if np.abs(weights - now)[total[:, 0] > 0].max() < tolerance:
            break
    weights = np.maximum(weights[:BUCKETS], LEAST_WEIGHT)
    return weights / weights.sum(axis=1, keepdims=True)


def score(docs: DataFrame, order: int = 3, block_bytes: int = BLOCK_BYTES, shards: int | None = None) -> DataFrame:
    """Base and interpolated log10 probabilities of every document."""
    made = saved(blocks(docs, block_bytes))
    size = made.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    shards = shards or max(16, -(-order * size // SHARD_TOKENS))  # grows with the corpus, so that a shard's counts fit into a task
    bits = min(64, int(order * size).bit_length() + SPARE_BITS)
    told = saved(answers(questions(made, order, shards, bits)))
    sums = told.where("ord = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "kept_types", "total", "kept_total")]).first()
    role = roles()
    n = docs.agg(F.count_if(role != HELD_OUT).alias("train"), F.count_if(role == KEPT).alias("kept")).first()
    totals, kept = Totals(sums["types"], sums["total"], n["train"]), Totals(sums["kept_types"], sums["kept_total"], n["kept"])
    deleted = made.where("deleted")
    observed = saved(events(deleted, told.join(deleted.select("block"), "block", "left_semi"), kept, order, bits))
    weights = learn(observed, order) if totals.tokens else np.eye(1, order + 1).repeat(BUCKETS, axis=0)
    smooth = np.log10(totals.tokens + 0.5 * (totals.types + 1))

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Block.read(row, order, bits)
            count, p, bucket = estimates(block, told_of(right, order, False), totals)
            at = np.cumsum(block.lengths) - block.lengths
            add = lambda x: np.add.reduceat(x, at).tolist()
            base, mixed = np.log10(count + 0.5) - smooth, np.log10((weights[bucket].T * p).sum(axis=0))
            out += zip(row["doc_ids"], (block.roles == HELD_OUT).tolist(), block.lengths.tolist(), add((count > 0).astype(np.int64)), [totals.tokens] * len(at), add(base), add(mixed))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 7, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return made.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(task, SCHEMA)
