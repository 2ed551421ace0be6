"""Language identification by error-correcting output codes over hashed character n-grams.

Every language has a codeword; every bit has a binary classifier, a log-odds score of the n-grams of the languages with
bit 1 against those with bit 0, each language weighing the same. A document is given the codeword with the least
weighted logistic loss; a bit weighs as much as its classifier separates the training languages. If two codewords are
about as near, the document is flagged ambiguous.

The n-gram counts of the training documents are one distributed aggregate; only the table languages x n-gram buckets
reaches the driver.

Defined results: `und` with score 0 for a null text or one without a letter, and for all if nothing could be learned;
rows with a null language or text teach nothing; a null doc_id counts as held out; ties go to the language that sorts
first; a text may be as long as a row can hold, its n-grams are counted in place; repeated rows teach as often as they
come, and are returned so; an empty table teaches nothing, and none gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, runner_up string"


def held_out(doc_id: Column | str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id does."""
    id_ = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(id_.cast("string")) % folds == fold, F.lit(True))


def has_letter(text: str) -> bool:
    return not text.isascii() and any(map(str.isalpha, text)) or any(c.isalpha() for c in text[:64]) or any(map(str.isalpha, text))


def histogram(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of the hashed n-grams of bytes of the lower-cased text, each order in the same table."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    total = np.zeros(1 << bits, dtype=np.int64)
    for n in orders:
        if len(raw) >= n:
            code = np.full(len(raw) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                code = (code << np.uint32(8)) | raw[k : len(raw) - n + 1 + k] if k < 3 else code * np.uint32(0x01000193) ^ raw[k : len(raw) - n + 1 + k]
            total += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    return total


def codewords(n: int) -> np.ndarray:
    """+1/-1 codewords of n classes: all splits up to 5 classes, else about 15 log2 n splits drawn by a fixed rule."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        cols = [[1 if (s >> c) & 1 else -1 for c in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(cols, dtype=np.float64).T
    cols, seed = [], 0
    while len(cols) < math.ceil(15 * math.log2(n)):
        bits = np.array([1 if hashlib.sha256(f"{seed}:{c}".encode()).digest()[0] & 1 else -1 for c in range(n)], dtype=np.float64)
        seed += 1
        if abs(bits.sum()) <= 0.6 * n and len({*bits}) == 2:
            cols.append(bits)
    return np.array(cols).T


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    scale: np.ndarray  # a bit's usual margin
    trust: np.ndarray  # a bit's weight in the decoding
    orders: tuple[int, ...]
    bits: int

    def predict(self, text: str | None) -> tuple[str, float, str | None]:
        """(language, score, runner-up)"""
        if not text or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, None
        if len(self.langs) == 1:
            return self.langs[0], 1.0, None
        counts = histogram(text, self.orders, self.bits)
        margin = counts @ self.weights / max(1, counts.sum()) / self.scale
        loss = np.logaddexp(0.0, -4.0 * self.code * margin) @ self.trust
        first, second = np.argsort(loss, kind="stable")[:2]
        total = loss[first] + loss[second]
        return self.langs[first], float(loss[second] / total) if total > 0 else 0.5, self.langs[second]


def train(docs: DataFrame, orders: tuple[int, ...] = (1, 2, 3), bits: int = 14, max_langs: int | None = None) -> Model:
    """Learn from the columns text and lang of all rows given.

    Every language that occurs is learned, however few rows it has. The driver holds 2**bits counts of four bytes a
    language (66 kB), which come to it language by language: labels are names of languages, a set that no corpus makes grow.
    max_langs: learn only so many, those with the most rows (of equal numbers the first by name).
    """
    size = 1 << bits

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(size, dtype=np.int64)
                sums[lang] += histogram(text, orders, bits)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    if max_langs is not None:
        usual = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
        labelled = labelled.where(F.col("lang").isin([r["lang"] for r in usual]))
    found = labelled.mapInArrow(task, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    each = found.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns"))  # at most 2**bits of a language
    learned: dict[str, np.ndarray] = {}
    for row in each.toLocalIterator():
        learned[row["lang"]] = np.zeros(size, dtype=np.float32)
        learned[row["lang"]][row["buckets"]] = row["ns"]
    langs = sorted(learned)
    counts = np.array([learned.pop(lang) for lang in langs], dtype=np.float64).reshape(len(langs), size)
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * size)
    code = codewords(len(langs))
    weights = np.zeros((size, code.shape[1]))
    for j in range(code.shape[1]):
        weights[:, j] = np.log(share[code[:, j] > 0].mean(axis=0) / share[code[:, j] < 0].mean(axis=0))
    margins = (share @ weights) * code  # what a language's own n-grams give on average; above 0 if the bit is right
    scale = np.maximum(margins.mean(axis=0), 1e-9) if len(langs) > 1 else np.ones(code.shape[1])
    trust = np.maximum(margins.min(axis=0) / scale, 0.05) if len(langs) > 1 else np.ones(code.shape[1])
    return Model(langs, code, weights, scale, trust / max(trust.sum(), 1e-9), orders, bits)


def identify(docs: DataFrame, model: Model, folds: int = 3, fold: int = 1, ambiguous_below: float = 0.6) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, runner_up of every document; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size that the model's parameters bound

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column(2).to_pylist()]
            lang, score, second = zip(*got) if got else ((), (), ())
            unsure = [x < ambiguous_below for x in score]
            arrays = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", folds, fold).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(task, SCHEMA)


def training_rows(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    return docs.where(~held_out("doc_id", folds, fold))


def accepted(docs: DataFrame, model: Model, least: float = 0.55) -> DataFrame:
    """The rows of docs, with all columns, whose language is determined with at least this score."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score, _ in got], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
