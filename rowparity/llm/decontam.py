"""Benchmark decontamination by the q-gram lemma: find documents that hold a benchmark item within an edit budget.

If a stretch of a document is within e edits of an item of n characters, the two share at least T = n - q + 1 - q*e
q-grams, all on diagonals (document position minus item position) at most e apart. So shared q-grams are counted in
overlapping bands of diagonals, bands that reach T are retained, and a banded alignment verifies each.

Benchmark items are the stated query set: they are searched in blocks of bounded size, each block's index being
broadcast; documents stream past it and are never shuffled or joined.

Texts are compared as lower-cased (A-Z) UTF-8 bytes with ASCII white space as spaces; edits count bytes. The budget is
the given share of the item's bytes, as far as T stays positive; items shorter than q are searched exactly.

Defined results: null and empty texts hold nothing; null and empty items are in nothing; repeated documents and items
each give their rows; ids may be null; other columns are ignored (and kept by clean()); of several places of an item in
a document the one with the fewest edits, then the first, is reported. Very long texts are looked up in slices and
searched whole. Without documents or without items nothing is found, and clean() keeps every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
FILTER_BITS = 22
SLICE = 1 << 20  # positions of a text whose q-grams are looked up at a time
HITS = 1 << 21  # shared q-grams that are counted at a time
BLOCK_BYTES = 16 << 20  # of items in one broadcast index
SCHEMA = "doc_id long, item_id long, start long, end long, edits long, item_bytes long"


def normal(text: str | None) -> bytes:
    """Of the same length as the text's UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(SPACES)


def grams(data: bytes, q: int) -> np.ndarray:
    """A 64-bit hash of the q >= 8 bytes at each position; equal q-grams have equal hashes."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    padded = data + bytes(16)
    w = np.empty(len(data), dtype=np.uint64)
    for o in range(8):
        part = w[o::8]
        part[:] = np.frombuffer(padded, dtype="<u8", count=len(part), offset=o)
    with np.errstate(over="ignore"):
        h = w[:n] * np.uint64(0x9E3779B97F4A7C15) ^ w[q - 8 : q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Index:
    """Items, their budgets and thresholds, and where their q-grams occur: about 21 bytes a byte of items, and 4 MB."""

    ids: list
    items: list[bytes]
    q: int
    rate: float
    budget: np.ndarray = field(init=False)
    least: np.ndarray = field(init=False)
    short: list[int] = field(init=False)

    def __post_init__(self) -> None:
        n = np.array([len(x) for x in self.items], dtype=np.int64)
        self.budget = np.maximum(0, np.minimum((n * self.rate).astype(np.int64), (n - self.q) // self.q))
        self.least = n - self.q + 1 - self.q * self.budget
        self.short = [i for i, x in enumerate(self.items) if 0 < len(x) < self.q]
        found = [grams(x, self.q) for x in self.items]
        h = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.item = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])[order]
        self.at = (np.concatenate([np.arange(len(f), dtype=np.int32) for f in found]) if found else np.zeros(0, np.int32))[order]
        self.keys, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h)).astype(np.int32)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.step = int(self.budget.max(initial=0)) + 1  # a band has two steps of diagonals, so any e + 1 of them lie in one


def hits(index: Index, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the shared q-grams: (position in data, place in the index's lists)."""
    for s in range(0, len(data), SLICE):
        h = grams(data[s : s + SLICE + index.q - 1], index.q)
        near = np.flatnonzero(index.filter[h >> np.uint64(64 - FILTER_BITS)])
        if not len(near):
            continue
        k = np.searchsorted(index.keys, h[near])
        k[k == len(index.keys)] = 0
        ok = index.keys[k] == h[near]
        near, k = near[ok], k[ok]
        many = index.first[k + 1] - index.first[k]
        until = np.cumsum(many)
        a = 0
        while a < len(near):
            b = max(a + 1, int(np.searchsorted(until, (until[a - 1] if a else 0) + HITS, side="right")))
            m = many[a:b]
            place = np.repeat(index.first[k[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            yield np.repeat(near[a:b] + s, m), place
            a = b


def regions(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(text, item, first diagonal, last diagonal) of the retained bands, neighbouring bands as one."""
    gap = bytes(index.q)
    data = gap.join(texts)
    starts = np.cumsum([0] + [len(t) + index.q for t in texts])
    n_items, step = len(index.items), index.step
    shift = (max(map(len, index.items), default=0) // step + 2) * step  # no diagonal, and no band before one, is negative
    n_bands = (len(data) + shift) // step + 2
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at, place in hits(index, data):
        text = np.searchsorted(starts, at, side="right") - 1
        item = index.item[place]
        band = (at - starts[text] - index.at[place] + shift) // step
        key = (text * n_items + item) * n_bands + band
        new, c = np.unique(np.concatenate([key, key - 1]), return_counts=True)  # a diagonal is in its own band and the one before
        keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([counts, c]), minlength=len(keys)).astype(np.int64)
    keep = counts >= index.least[(keys // n_bands) % n_items] if len(keys) else np.zeros(0, bool)
    out: list[tuple[int, int, int, int]] = []
    for key in keys[keep].tolist():
        (text, item), band = divmod(key // n_bands, n_items), key % n_bands
        first = band * step - shift
        if out and out[-1][:2] == (text, item) and first <= out[-1][3] + 1:
            out[-1] = (*out[-1][:3], first + 2 * step - 1)
        else:
            out.append((text, item, first, first + 2 * step - 1))
    return out


def banded(item: bytes, text: bytes, first: int, last: int, anchored: bool = False) -> tuple[int, int] | None:
    """(edits, end) of the best place of the item that starts in text on the diagonals first..last; ends tie to the first.

    Row i holds, for every diagonal d, the least edits between the first i bytes of the item and a stretch of text that
    ends at i + d. anchored: the stretch starts at 0.
    """
    d = np.arange(first, last + 1)
    far = len(item) + len(text) + 1
    data = np.frombuffer(text, dtype=np.uint8)
    row = np.where((d < 0) | (d > len(text)), far, np.abs(d) if anchored else 0)
    slope = np.arange(len(d))
    for i, byte in enumerate(item, 1):
        j = d + i
        inside = (j >= 1) & (j <= len(text))
        same = np.zeros(len(d), dtype=bool)
        same[inside] = data[j[inside] - 1] == byte
        new = np.where(inside, row + ~same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        if anchored:
            new = np.where(j == 0, np.minimum(new, i), new)
        elif (j == 0).any():
            new = np.where(j == 0, i, new)
        new = np.where((j < 0) | (j > len(text)), far, new)
        row = np.minimum.accumulate(new - slope) + slope
    at = int(row.argmin())
    return (int(row[at]), len(item) + int(d[at])) if row[at] < far else None


def places(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) in bytes: the best place of each item in each text."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for text, item, first, last in regions(index, texts):
        e, x = int(index.budget[item]), index.items[item]
        lo = max(0, first - e)
        part = texts[text][lo : last + len(x) + e + 1]
        if (at := part.find(x)) >= 0:
            got = (0, lo + at, lo + at + len(x))
        else:
            end = banded(x, part, -e, last + e - lo)
            if end is None or end[0] > e:
                continue
            back = banded(x[::-1], part[: end[1]][::-1], -e, e, anchored=True)
            got = (end[0], lo + end[1] - back[1], lo + end[1])
        if (text, item) not in best or got < best[text, item]:
            best[text, item] = got
    for item in index.short:
        for text, t in enumerate(texts):
            if (at := t.find(index.items[item])) >= 0:
                best[text, item] = (0, at, at + len(index.items[item]))
    return [(text, item, start, end, edits) for (text, item), (edits, start, end) in sorted(best.items())]


def batches_of(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, normalised texts) of some MB each."""
    part: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        part.append(normal(t))
        size += len(part[-1])
        if size >= most:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def indexes(benchmark: DataFrame, q: int = 10, rate: float = 0.08, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark as indexes over blocks of items with at most about block_bytes of text (and one item more)."""
    if q < 8:
        raise ValueError("q must be at least 8")
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // (block_bytes // 2)) or 1
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        rows, size = [], 0
        for row in part.toLocalIterator():
            rows.append((row["id"], normal(row["text"])))
            size += len(rows[-1][1])
            if size > block_bytes:
                yield Index(*map(list, zip(*rows)), q, rate)
                rows, size = [], 0
        if rows:
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            yield Index(*map(list, zip(*rows)), q, rate)


def find(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08) -> DataFrame:
    """doc_id, item_id, start, end (code points), edits, item_bytes of every document and item within the budget."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out: DataFrame | None = None
    for index in indexes(benchmark, q, rate):
        shared = spark.sparkContext.broadcast(index)  # of at most BLOCK_BYTES of items

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = []
                for first, part in batches_of(texts):
                    for text, item, start, end, edits in places(index, part):
                        raw = texts[first + text].encode("utf-8", "surrogatepass")
                        at = [len(raw[:x].decode("utf-8", "ignore")) for x in (start, end)]
                        rows.append((ids[first + text], index.ids[item], *at, edits, len(index.items[item])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)

        found = source.mapInArrow(task, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08) -> DataFrame:
    """The rows of docs, with all columns, whose text holds no item.

    Between blocks of items what is left is written, so that a task holds the index of one block alone.
    """
    at = docs.columns.index("text")
    for k, index in enumerate(indexes(benchmark, q, rate)):
        if k:
            docs = saved(docs)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for first, part in batches_of(batch.column(at).to_pylist()):
                    for text, *_ in places(shared.value, part):
                        keep[first + text] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
