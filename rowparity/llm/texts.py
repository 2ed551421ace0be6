"""Words of texts, as the operators on shingles take them, and batches of few texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between the ASCII white space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words."""
    import xxhash

    tokens = words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
