"""Whitening of embeddings: a two-pass covariance, LAPACK's symmetric eigenvectors and a broadcast projection.

Entries become whole numbers first (floor of `scale` times the entry), so that sums are exact. The fit list holds each
distinct vector of whole numbers once: a shuffle on the packed vectors, with copies merged before it. The first pass
adds the fit list's vectors up, the second the outer products of the vectors less their mean, a NumPy matrix product a
batch. Both give one partial result a partition, and treeAggregate merges these on the executors, level by level; the
driver gets one vector, then one matrix of the dimension squared, whose eigenvectors it takes. Mean and projection go
back to the tasks, and a third pass over the fit list measures how far the covariance of the whitened vectors is from
the identity.

Defined results: rows whose vector is null, or has null or non-finite entries, are dropped. The dimension is the length
that most of the others have (the longer one of two); a vector of another length lacks entries or has unknown ones, and
is dropped as well. Entries whose whole number is outside 64 bits get the nearest number inside. Repeated rows come as
often as they are there, and count once in the fit. A component without variance (fewer distinct vectors than dimensions,
constant entries) has a null whitened value and no part in identity_error, which is null if no component has any;
explained is null if nothing varies. A deviation beyond 64 bits is null. An empty table gives no rows. Other columns are
ignored; the id column may hold anything, nulls too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
#: Rows of vectors that a task holds as doubles at a time.
BATCH = 1 << 13
#: A component whose variance is below this share of the largest has none: the rest is rounding.
NO_VARIANCE = 1e-12


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * value) as 64-bit whole numbers, at the ends of their range for what is beyond."""
    with np.errstate(over="ignore"):
        x = np.floor(values.astype(np.float64) * scale)
    out = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    out[x >= 2.0**63] = LONG_MAX
    return out


def pack(x: np.ndarray) -> list[bytes]:
    """Each row as bytes of the narrowest width that holds it: equal rows, equal bytes."""
    if not len(x):
        return []
    low, high = x.min(axis=1), x.max(axis=1)
    out = np.empty(len(x), dtype=object)
    left = np.ones(len(x), dtype=bool)
    for width in (1, 2, 4, 8):
        fits = left & (low >= -(1 << (8 * width - 1))) & (high < 1 << (8 * width - 1))
        rows = x[fits].astype(f"<i{width}")
        out[fits] = [r.tobytes() for r in rows]
        left &= ~fits
    return out.tolist()


def unpack(rows: list[bytes], dimension: int) -> np.ndarray:
    x = np.empty((len(rows), dimension), dtype=np.int64)
    widths = np.array([len(r) // dimension for r in rows])
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        x[at] = np.frombuffer(b"".join(rows[i] for i in at), dtype=f"<i{width}").reshape(-1, dimension)
    return x


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector has entries, all of them finite."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, entry))


def dimension_of(rows: DataFrame, column: str) -> int | None:
    sizes = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sizes["d"] if sizes else None


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten()  # of a slice, only its own values
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def in_rows(batches: Iterator[pa.RecordBatch], rows: int = BATCH) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fit_list(rows: DataFrame, column: str, dimension: int, scale: float) -> DataFrame:
    """x: each distinct vector of whole numbers once, packed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            packed = pack(whole(matrix(batch.column(0), dimension), scale))
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["x"])

    return rows.select(column).mapInArrow(task, "x binary").distinct()


def merged(rows: DataFrame, part: Callable[[list[bytes]], tuple], depth: int = 2):
    """part() of the packed vectors of each batch, added up within the partition and over partitions by treeAggregate."""
    import pickle

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in in_rows(batches):
            if batch.num_rows:
                total = plus(total, part(batch.column(0).to_pylist()))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    parts = rows.select("x").mapInArrow(task, "part binary").rdd.map(lambda r: pickle.loads(bytes(r["part"])))
    return parts.treeAggregate(None, plus, plus, depth)


def plus(a: tuple | None, b: tuple | None) -> tuple | None:
    """The sums of two partial results, part by part."""
    if a is None or b is None:
        return b if a is None else a
    return tuple(x + y for x, y in zip(a, b))


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python's whole numbers: halves of 32 bits are added apart, so nothing overflows."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)


@dataclass(frozen=True)
class Whitening:
    """What the fit found. values, vectors: of the covariance, by falling variance; its size is that of the dimension."""

    scale: float
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray  # a column a component
    trace: float
    identity_error: float | None = None

    @property
    def dimension(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def projection(self, components: int) -> np.ndarray:
        """Columns that whiten; of nulls for components without variance."""
        e = self.values[:components]
        has = e > NO_VARIANCE * max(self.values[0], 0)
        return np.where(has, self.vectors[:, :components] / np.sqrt(np.where(has, e, 1.0)), np.nan)

    def explained(self, component: int) -> float | None:
        return float(self.values[component] / self.trace) if self.trace > 0 else None


def fit(vectors: DataFrame, column: str = "embedding", scale: float = 256.0, components: int = 4) -> Whitening | None:
    """None if no row is usable. identity_error: of the first `components` components, over the fit list."""
    rows = usable(vectors, column)
    dimension = dimension_of(rows, column)
    if dimension is None:
        return None
    listed = saved(fit_list(rows.where(F.size(column) == dimension), column, dimension, scale))
    n, sums = merged(listed, lambda packed: (len(packed), exact_sums(unpack(packed, dimension))))
    mean = np.array([float(Fraction(int(s), n)) for s in sums])

    def products(packed: list[bytes]) -> tuple[np.ndarray]:
        centred = unpack(packed, dimension) - mean
        return (centred.T @ centred,)

    covariance = merged(listed, products)[0] / n
    values, vectors_ = np.linalg.eigh((covariance + covariance.T) / 2)
    found = Whitening(scale, n, tuple(map(int, sums)), values[::-1].copy(), vectors_[:, ::-1].copy(), float(np.trace(covariance)))
    return Whitening(*list(found.__dict__.values())[:-1], measured(listed, found, components))


def measured(listed: DataFrame, model: Whitening, components: int) -> float | None:
    """The largest entry of the whitened fit list's covariance less the identity; over the components with variance."""
    mean, projection, dimension = model.mean, model.projection(components), model.dimension
    projection = projection[:, ~np.isnan(projection[0])]
    if not projection.shape[1]:
        return None

    def moments(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        y = (unpack(packed, dimension) - mean) @ projection
        return y.sum(axis=0), y.T @ y

    first, second = merged(listed, moments)
    centre = first / model.n
    return float(np.abs(second / model.n - np.outer(centre, centre) - np.eye(len(centre))).max())


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sums over the dimensions of (n x - S)^2, exactly; None beyond 64 bits."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if len(sums) * most * most <= LONG_MAX:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    out = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v <= LONG_MAX else None for v in out]


def transform(vectors: DataFrame, model: Whitening | None, column: str = "embedding", key: str = "vec_id", components: int = 4) -> DataFrame:
    """key, deviation (long), whitened (an array of the components' values) of every usable row."""
    kind = vectors.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, deviation long, whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], out)
    sums, n, dimension, scale = model.sums, model.n, model.dimension, model.scale
    held = vectors.sparkSession.sparkContext.broadcast((model.mean, model.projection(min(components, dimension))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projection = held.value
        for batch in in_rows(batches):
            if not batch.num_rows:
                continue
            x = whole(matrix(batch.column(1), dimension), scale)
            y = (x - mean) @ projection
            lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), pa.array(y.ravel(), pa.float64(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, n, sums), pa.int64()), lists], names=[key, "deviation", "whitened"])

    rows = usable(vectors, column).where(F.size(column) == dimension)
    return rows.select(key, column).mapInArrow(task, out)


def by_component(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", scale: float = 256.0, components: int = 4) -> DataFrame:
    """A row for each usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, column, scale, components)
    rows = transform(vectors, model, column, key, components)
    known = [model.explained(c) for c in range(min(components, model.dimension))] if model else []
    share = F.array(*[F.lit(v).cast("double") for v in known]) if known else F.array().cast("array<double>")
    return rows.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        key,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else None).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
