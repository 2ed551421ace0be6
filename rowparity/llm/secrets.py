"""Incremental secret scans over a blob ledger, with DataFrame operations only.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds the (blob, rule, version)
triples that have been scanned before, and what they found; only blobs with unseen pairs are scanned, each once, by the
unseen rules alone, and the findings are joined back to all paths that ever held the blob. Scanning the same history
again scans nothing.

One path stands for all that hold a blob. Which one, and which rules it still lacks, is known from hashes and paths
alone and written down, so that the matching runs above that choice, once a blob. For this, texts are shuffled once a
scan; they meet only the blobs that are not plain (held by several rows, or seen by some rule).

A rule is a regular expression; matches are leftmost and do not overlap within a kind. Positions come from splitting
the text at the matches: the lengths of the parts between them and of the matches alternate, and a running sum over
these rows gives the places, in time linear in the matches. A rule may bound the length of the match or of one of its
groups; matches that fail the bound are dropped after matching.

Defined results: a null text is an empty one; a null path is a path like any other; repeated rows of one path and text
are kept as rows; spans of one start are in the order of the rules; an empty table gives no rows; texts may be of any
length that a row can hold and have any number of matches. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exists, free_name, saved


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length is bounded
    least: int = 1
    version: int = 1
    hint: str | None = None  # a plain string without which there is no match

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The kinds that every scan has, in the order of their ties. Letters of the names match in either case by classes, as
#: case-folding options differ between engines.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", least=16),  # as runs are maximal, the same as [0-9a-f]+ of 16 or more
)
#: Spans that the operator adds to the base ones.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40, hint="gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40, hint="eyJ"),
)
RULES = BASE + ADDED
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
PARTS = "array<struct<rank:int,i:int,gap:int,n:int,ok:boolean>>"
PAIRS = "blob binary, rule string, version int"
FINDINGS = "blob binary, kind string, version int, start int, end int"
CHUNK = 4096  # code points of a text that are looked through for one cut


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _test(text: Column, rule: Rule) -> Column:
    """Most texts hold no match: the longer work runs only where this finds one."""
    return text.contains(rule.hint) & text.rlike(rule.pattern) if rule.hint else text.rlike(rule.pattern)


def _parts(text: Column, rule: Rule, rank: int, wanted: Column) -> Column:
    """The text as parts: what stands before a match, the match, and whether it keeps the rule's bound."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    bounded = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    held = F.zip_with(F.transform(matches, lambda m: F.length(m)), F.transform(bounded, lambda m: F.length(m) >= rule.least), lambda n, ok: F.struct(n.alias("n"), ok.alias("ok")))
    paired = F.zip_with(gaps, held, lambda g, m: F.struct(g.alias("gap"), m.n.alias("n"), m.ok.alias("ok")))
    rows = F.transform(paired, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), x.gap.alias("gap"), x.n.alias("n"), x.ok.alias("ok"))).cast(PARTS)
    return F.when(wanted & _test(text, rule), rows).otherwise(F.array().cast(PARTS))


@dataclass(frozen=True)
class Scan:
    """keys: path, blob of every row; findings: what the scan found; pairs: what it scanned, for the ledger."""

    keys: DataFrame
    findings: DataFrame
    pairs: DataFrame


class Ledger:
    """Pairs and findings as two tables in a folder that all executors share.

    Findings are written before the pairs they belong to: a job that ends between the two scans these blobs again, and
    a finding that stands twice counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def pairs(self) -> DataFrame:
        return self._read("pairs", PAIRS)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS)

    def add(self, found: Scan) -> None:
        found.findings.write.mode("append").parquet(f"{self.path}/findings")
        found.pairs.write.mode("append").parquet(f"{self.path}/pairs")


def scan(versions: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None) -> Scan:
    """versions(path, text), and the pairs that were scanned before: scan what is new."""
    keys = saved(versions.select("path", _blob(_text()).alias("blob")))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    # Only hashes and paths meet here. min() passes over null paths, so a null one stands only where all are null.
    state = keys.groupBy("blob").agg(F.min("path").alias("at"), F.count("*").alias("n"))
    if ledger is None:
        state = state.withColumn("unseen", wanted)
    else:
        key = F.concat_ws("@", "rule", F.col("version").cast("string"))
        seen = ledger.where(key.isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set(key).alias("seen"))
        state = state.join(seen, "blob", "left").select("blob", "at", "n", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("unseen"))
    state = saved(state)
    marked = saved(state.where((F.col("n") > 1) | (F.size("unseen") < len(rules))).select(F.col("blob").alias("of"), "at", "unseen"))
    here = versions.select("path", _text().alias("text")).withColumn("blob", _blob(F.col("text")))
    stands = F.col("of").isNull() | (F.col("path").eqNullSafe(F.col("at")) & (F.size("unseen") > 0))
    texts = here.join(marked.hint("merge"), F.col("blob") == F.col("of"), "left").where(stands)
    unseen = F.coalesce("unseen", wanted)
    parts = F.flatten(F.array(*[_parts(F.col("text"), r, i, F.array_contains(unseen, r.key)) for i, r in enumerate(rules)]))
    met = texts.select("blob", F.inline(parts)).repartition("blob", "rank")  # apart from the join, which can split a blob that very many rows hold
    met = met.dropDuplicates(["blob", "rank", "i"])  # rows of one path and text repeat
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("blob", "rank").orderBy("i")).cast("int")
    placed = met.withColumn("end", end).where("ok").withColumn("start", F.col("end") - F.col("n"))
    kinds, version = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.version) for r in rules])
    findings = saved(placed.select("blob", F.get(kinds, F.col("rank")).alias("kind"), F.get(version, F.col("rank")).alias("version"), "start", "end"))
    new = state.select("blob", F.explode("unseen").alias("key"))
    return Scan(keys, findings, new.select("blob", F.split_part("key", F.lit("@"), F.lit(1)).alias("rule"), F.split_part("key", F.lit("@"), F.lit(2)).cast("int").alias("version")))


def dealt_anew(findings: DataFrame) -> DataFrame:
    """Findings apart from the aggregate that made them, so that adaptive execution can split a blob that very many paths hold."""
    return findings.hint("rebalance")


def by_path(keys: DataFrame, findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """path, blob, spans for every row of keys: the findings of these rules' versions, none where there is no finding."""
    rank = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), i) for i, r in enumerate(rules)])
    ranked = findings.withColumn("rank", rank).where("rank is not null")
    listed = ranked.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", "rank", "end", "kind"))).cast(SPANS).alias("spans"))
    return keys.select("path", "blob").join(dealt_anew(listed), "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def digest(found: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """The counts and span strings of by_path()."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    only = F.filter("spans", lambda s: s.rank < len(base))
    of = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in base]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(text(only), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def cuts(findings: DataFrame) -> DataFrame:
    """blob, cuts: a blob's findings in order, those that overlap as one."""
    before = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int")
    upto = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = findings.select("blob", "start", "end", fresh.alias("fresh")).withColumn("group", F.sum("fresh").over(upto))
    joined = numbered.groupBy("blob", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def redacted(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the mark in place of every finding in text (overlapping ones as one), and n_chars, if there, counted again."""
    key, found, parts = (free_name(docs, n) for n in ("blob", "cuts", "parts"))
    ready = saved(cuts(findings).select(F.col("blob").alias(key), F.col("cuts").alias(found)))
    chunks = F.when(F.col(found).isNotNull(), F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    joined = docs.withColumn(key, _blob(_text())).join(ready.hint("rebalance").hint("merge"), key, "left").withColumn(parts, chunks)

    def between(a: Column, b: Column) -> Column:
        """Code points a to b of the text, from its chunks: those between are taken whole."""
        first, last = (a / CHUNK).cast("int"), (b / CHUNK).cast("int")
        of = lambda i: F.coalesce(F.get(F.col(parts), i), F.lit(""))
        ends = F.concat(F.substr(of(first), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(F.col(parts), first + 2, last - first - 1), ""), F.substr(of(last), F.lit(1), b % CHUNK))
        return F.when(first == last, F.substr(of(first), a % CHUNK + 1, b - a)).otherwise(ends)

    cut = lambda i: F.get(F.col(found), i)
    size = F.length(F.col("text"))
    kept = F.transform(F.sequence(F.lit(0), F.size(found)), lambda i: between(F.coalesce(cut(i - 1).end, F.lit(0)), F.coalesce(cut(i).start, size)))
    put = {"text": F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(kept, mark))}
    done = joined.withColumns(put)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(*docs.columns)
