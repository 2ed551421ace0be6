"""Source divergence: how far the term shares of a language's sources are apart, and which terms set one off.

A source's share of a term is p = 1 + floor(unit * (count + prior) / (N + prior * V)) in whole numbers, N the source's
occurrences of kept terms and V how many terms the language keeps. All arithmetic is exact.

Systolic rotation: a language's kept terms are cut into blocks, and its sources into slots. A task holds a slot's vectors
of a block, and these stay in their partition (a cached table, dealt out by language, block and slot), while the vectors of
the other slots, compressed, go round: in every round of a round-robin tournament each slot meets one other, and the task
that receives the visitors evaluates both directions of each meeting. A slot's own sources meet in the first round, in
which the language's shares visit as well and a heap for each source ranks the terms that it has more of. A task holds two
slots of one block, whatever the size of the corpus; a round sends every vector at most once, and there are as many rounds
as slots less one. Partial sums of the blocks, and the heaps, are added up at the end.

Terms are counted in tasks as far as they fit into a dictionary, then by partial aggregation, so a hot source or term is a
few rows a task. Texts are read once.

Defined results: null text, language and source are ''. Every pair of language and source that occurs is a group, one
without terms as well; where a language keeps no term, its pairs have the value 0. A language with one source has no
pairs and no terms. Repeated rows are documents of their own. Equal values rank by the item's bytes. An empty table gives
no rows. Other columns are ignored, doc_id as well.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved, saved_at

#: A-Z are lower-cased before; of UTF-8, letters and all bytes of other characters.
TERM = re.compile(rb"[a-z\x80-\xff]+")
UNIT, PRIOR = 1_000_000_000, 5
HELD = 250_000  # counts that a task keeps before it gives them out
BLOCK = 1 << 16  # terms of a block
SLOT = 8  # sources of a slot
LONG_SAFE = (1 << 63) // UNIT - 2 * PRIOR  # counts up to here times UNIT stay in 64 bits


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of occurrences and documents; a row with the term '' for every group."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in occurrences.items():
                terms = [b"", *found]
                seen = documents[lang, source]
                columns = [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array([t.decode("utf-8") for t in terms], pa.string()),
                    pa.array([0, *found.values()], pa.int64()),
                    pa.array([0, *map(seen.__getitem__, found)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            occurrences.clear()
            documents.clear()

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in range(3))):
                    group = lang, source
                    if group not in occurrences:
                        occurrences[group], documents[group] = Counter(), Counter()
                    found = TERM.findall(text.lower())
                    mine = occurrences[group]
                    before = len(mine)
                    mine.update(found)
                    documents[group].update(set(found))
                    held += len(mine) - before
                if held > HELD:
                    yield from rows()
                    held = 0
        yield from rows()

    empty = F.lit("")
    read = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    return read.mapInArrow(task, "lang string, source string, term string, n long, docs long")


# --- vectors of a block: positions and counts


def squeezed(positions: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending positions as steps, then the counts, compressed."""
    steps = np.diff(positions, prepend=0).astype(np.int32)
    return zlib.compress(steps.tobytes() + counts.astype(np.int64).tobytes(), 1)


def spread_out(vector: bytes | None, size: int) -> np.ndarray:
    """The counts of all positions of a block."""
    out = np.zeros(size, dtype=np.int64)
    if vector:
        raw = zlib.decompress(vector)
        n = len(raw) // 12
        out[np.cumsum(np.frombuffer(raw, np.int32, n))] = np.frombuffer(raw, np.int64, n, 4 * n)
    return out


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """p of each count. Only N and V beyond 64-bit products need Python's whole numbers."""
    below = total + PRIOR * kept
    if total < LONG_SAFE:
        return 1 + UNIT * (counts + PRIOR) // below
    return np.array([1 + UNIT * (int(c) + PRIOR) // below for c in counts], dtype=np.int64)


def partner(slot: Column, slots: Column, turn: int) -> Column:
    """Whom a slot meets in a round (1 to slots - 1) of the tournament by the circle method; slots is even."""
    last, fixed = slots - 1, F.lit(turn).cast("long") % (slots - 1)
    other = F.pmod(2 * fixed - slot, last)
    return F.when(slot == last, fixed).when(slot == fixed, last).otherwise(other)


def compressed(placed: DataFrame) -> DataFrame:
    """lang, block, source, vector of the sources that have a kept term in the block."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        positions, n = rows["position"].to_numpy(), rows["n"].to_numpy()
        order = np.argsort(positions)
        lang, block, source = (k.as_py() for k in key)
        return pa.table({"lang": pa.array([lang], pa.string()), "block": pa.array([block], pa.int64()), "source": pa.array([source], pa.string()), "vector": pa.array([squeezed(positions[order], n[order])], pa.binary())})

    return placed.groupBy("lang", "block", "source").applyInArrow(task, "lang string, block long, source string, vector binary")


MEMBER = "lang string, block long, slot long, source string, vector binary, total long, kept long, size int"


def sources_of(rows: pa.Table) -> tuple[list[str], list[np.ndarray]]:
    """The sources of a slot and their shares of the block's terms, in the order of the names."""
    found = sorted(zip(*(rows[c].to_pylist() for c in ("source", "vector", "total", "kept", "size"))), key=lambda r: r[0])
    return [r[0] for r in found], [shares(spread_out(r[1], r[4]), r[2], r[3]) for r in found]


PAIRS = "lang string, source string, item string, value long"


def pair_table(lang: str, pairs: list[tuple[str, str, int]]) -> pa.Table:
    source, item, value = zip(*pairs) if pairs else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(pairs), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def met(resident: pa.Table, visitors: pa.Table) -> pa.Table:
    """Both directions of every meeting of a resident and a visitor."""
    if not resident.num_rows or not visitors.num_rows:
        return pair_table("", [])
    here, p = sources_of(resident)
    there, q = sources_of(visitors)
    out = []
    for i, x in zip(here, p):
        for j, y in zip(there, q):
            value = int(np.abs(x - y).sum())
            out += [(i, j, value), (j, i, value)]
    return pair_table(resident["lang"][0].as_py(), out)


def at_home(resident: pa.Table) -> pa.Table:
    """The meetings within a slot."""
    here, p = sources_of(resident)
    out = [(i, j, int(np.abs(x - y).sum())) for i, x in zip(here, p) for j, y in zip(here, p) if i != j]
    return pair_table(resident["lang"][0].as_py(), out)


def ranked(resident: pa.Table, terms: pa.Table, first: int) -> pa.Table:
    """The `first` terms of the block, for each source of the slot, of which it has most more than its language."""
    out = []
    lang = ""
    if resident.num_rows and terms.num_rows:
        lang, order = resident["lang"][0].as_py(), np.argsort(terms["position"].to_numpy())
        names = terms["term"].take(pa.array(order)).to_pylist()
        q = shares(terms["total"].to_numpy()[order], terms["lang_total"][0].as_py(), terms["kept"][0].as_py())
        for source, vector, total, kept, size in zip(*(resident[c].to_pylist() for c in ("source", "vector", "total", "kept", "size"))):
            counts = spread_out(vector, size)
            more = shares(counts, total, kept) - q
            at = np.flatnonzero((counts > 0) & (more > 0))
            if len(at) > first:  # all that reach the last value that can count, ties included
                least = np.partition(more[at], len(at) - first)[len(at) - first]
                at = at[more[at] >= least]
            best = heapq.nsmallest(first, ((-int(more[i]), names[i].encode(), i) for i in at))
            out += [(source, names[i], -value) for value, _, i in best]
    return pair_table(lang, out)


def divergence(docs: DataFrame, least_docs: int = 30, first: int = 50, block: int = BLOCK, slot: int = SLOT) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank.

    pair: for each other source of the language the sum over its kept terms of |p - q|, q the other's share. term: the
    `first` terms with p > q, q the language's share, by p - q. Kept are terms in at least least_docs of the language's
    documents. block, slot: how many terms and sources a task holds a side.
    """
    spark = docs.sparkSession
    counts = saved(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = saved(counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-most // block) or 1
    within = Window.partitionBy("lang", "block").orderBy("term")
    numbered = kept.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks))).withColumn("position", F.row_number().over(within).cast("int") - 1)
    terms = saved(numbered)
    sizes = terms.groupBy("lang", "block").agg(F.count("*").cast("int").alias("size"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    placed = saved(counts.join(terms.drop("total"), ["lang", "term"]).select("lang", "source", "block", "position", "n"))
    own = placed.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"))
    # slots of `slot` sources and an even number of them, so that each meets another in every round
    in_lang = groups.groupBy("lang").agg((2 * F.ceil(F.count("*") / (2 * slot))).cast("long").alias("slots"))
    named = groups.withColumn("slot", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1).join(in_lang, "lang")
    groups = saved(named.withColumn("slot", F.pmod("slot", "slots")))
    # every source of a language has its row in every block of it, with a null vector where it has no term there
    in_block = groups.join(sizes, "lang", "left").select("lang", F.coalesce("block", zero).alias("block"), "slot", "slots", "source", "total", "kept", F.coalesce("size", F.lit(0)).alias("size"))
    vectors = saved(in_block.join(compressed(placed), ["lang", "block", "source"], "left"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = ["lang", "block", "slot"]
    resident = vectors.repartition(parts, *place).persist(StorageLevel.DISK_ONLY)
    try:
        home = resident.groupBy(*place)
        result, made = [], []

        def keep(df: DataFrame) -> DataFrame:
            table, path = saved_at(df)
            made.append(path)
            return table

        result.append(keep(home.applyInArrow(at_home, PAIRS)))
        visiting = terms.join(langs, "lang").join(groups.select("lang", "slot").distinct(), "lang")
        heaps = keep(home.cogroup(visiting.groupBy(*place)).applyInArrow(lambda r, t: ranked(r, t, first), PAIRS))
        for turn in range(1, int(groups.agg(F.max("slots")).first()[0] or 1)):
            meets = partner(F.col("slot"), F.col("slots"), turn)
            # of two slots that meet, the higher one visits the lower one; languages with fewer slots are done
            going = vectors.where(F.lit(turn) < F.col("slots")).withColumn("meets", meets).where("meets < slot").drop("slot").withColumnRenamed("meets", "slot")
            result.append(keep(home.cogroup(going.groupBy(*place)).applyInArrow(met, PAIRS)))
        pairs = result[0]
        for more in result[1:]:
            pairs = pairs.union(more)
        pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
        both = pairs.unionByName(heaps.withColumn("part", F.lit("term")))
        order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        placed = both.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= first))
        final = saved(placed.select("lang", "source", "part", "item", "value", "rank"))
    finally:
        resident.unpersist()
    for path in made:
        dropped(spark, path)
    return final
