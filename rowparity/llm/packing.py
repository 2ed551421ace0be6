"""Vector bin packing: documents into fixed-length token sequences under limits on tokens, segments and loss-bearing tokens.

Every task packs the documents of its own input partition, so nothing is shuffled. A task keeps a bounded pool of
pieces. It opens one sequence at a time and asks, among the pieces that fit in all three dimensions, for the one whose
demand has the largest weighted dot product with the room that is left; when none fits, a piece is cut to fill the
room. Weights are the pool's mean demands, so the scarce dimension counts most.

Defined results: a null text is an empty one (its document is the end id alone); a null doc_id stays null; repeated
rows are packed once each; other columns are ignored; an empty table gives no rows. Pieces of a document never overlap
and together are the whole document, whatever its length. Of pieces that suit equally well the first in the pool is
taken; the outcome depends on how the input is partitioned.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
ARROW_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
END_ID = 1
#: Fixed value: how the byte-level pre-tokenizer splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(path: str | None) -> str:
    """The given path, or the installed public file on the machine that asks."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_of(path: str) -> tuple[dict[bytes, int], list[str]]:
    """The vocabulary file's entries as bytes, in the order of their merges, and its added tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}  # the byte-level alphabet
    added = [t["content"] for t in file["added_tokens"]]
    vocab = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
    merged = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
    ids = [vocab[bytes(byte[c] for c in x + y)] for x, y in merged]
    if ids != sorted(ids):
        raise ValueError("the ids don't follow the order of the merges")
    return vocab, added


@lru_cache(maxsize=2)  # once per worker process
def encoder(path: str | None = None) -> Callable[[str], bytes]:
    """text -> its ids as little-endian uint32 bytes, as the tokenizers library gives them.

    The same vocabulary runs in tiktoken, which is several times faster; texts with an added token's string, and any
    that it refuses, go to tokenizers itself. Tests hold the two against each other.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    import tiktoken
    from tokenizers import Tokenizer

    path = tokenizer_path(path)
    exact = Tokenizer.from_file(path)
    ranks, added = ranks_of(path)
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if any(a in text for a in added):
            ids = exact.encode(text, add_special_tokens=False).ids
        else:
            try:
                ids = fast.encode_ordinary(text)
            except Exception:  # its regular expressions have a limit on backtracking
                ids = exact.encode(text, add_special_tokens=False).ids
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    return encode


class Packer:
    """Packs pieces (owner, start, length, loss) into sequences; rows() gives (owner, start, length, sequence, offset, loss)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int, min_piece: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
        self.pool, self.min_piece = pool, max(1, min_piece)
        self.owner, self.start, self.loss_from = [], [], []
        self.need = np.zeros((2 * pool, 3))
        self.n = self.sequence = 0
        self.out: list[tuple] = []

    def _append(self, owner, start: int, length: int, loss_from: int) -> None:
        if self.n == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[self.n] = length, 1, self._loss(start, length, loss_from)
        self.owner.append(owner)
        self.start.append(start)
        self.loss_from.append(loss_from)
        self.n += 1

    @staticmethod
    def _loss(start: int, length: int, loss_from: int) -> int:
        return max(0, start + length - max(start, loss_from))

    def _fitting(self, start: int, length: int, loss_from: int, room: np.ndarray) -> int:
        """The longest prefix of a piece that fits into the room."""
        length = min(length, int(room[0]))
        return min(length, max(0, loss_from - start) + int(room[2])) if room[1] >= 1 else 0

    def add(self, owner, n_tokens: int, n_loss: int) -> None:
        """Pieces that fill a sequence leave at once; the rest of the document waits in the pool."""
        start, loss_from = 0, n_tokens - n_loss
        while start < n_tokens:
            take = self._fitting(start, n_tokens - start, loss_from, self.limits)
            if take == self.limits[0]:
                self.out.append((owner, start, take, self.sequence, 0, self._loss(start, take, loss_from)))
                self.sequence += 1
            else:
                self._append(owner, start, take, loss_from)
            start += take
        if self.n >= 2 * self.pool:
            self.drain(self.pool)

    def drain(self, keep: int = 0) -> None:
        while self.n > keep:
            self._fill()

    def _fill(self) -> None:
        room, offset = self.limits.copy(), 0
        need, used = self.need[: self.n], np.zeros(self.n, dtype=bool)
        share = need / self.limits
        weight = share.mean(axis=0)
        cut: tuple | None = None
        while room[0] > 0 and room[1] > 0:
            score = np.where(used | (need > room).any(axis=1), -1.0, share @ (weight * room / self.limits))
            i = int(score.argmax())
            if score[i] < 0:
                break
            self._place(i, self.start[i], int(need[i, 0]), offset)
            used[i] = True
            room -= need[i]
            offset += int(need[i, 0])
        if room[0] >= self.min_piece and room[1] >= 1:
            left = np.flatnonzero(~used)
            if len(left):
                i = int(left[need[left, 0].argmax()])
                take = self._fitting(self.start[i], int(need[i, 0]), self.loss_from[i], room)
                if take >= self.min_piece:
                    self._place(i, self.start[i], take, offset)
                    used[i] = True
                    cut = (self.owner[i], self.start[i] + take, int(need[i, 0]) - take, self.loss_from[i])
        keep = np.flatnonzero(~used)
        self.owner, self.start, self.loss_from = ([x[i] for i in keep] for x in (self.owner, self.start, self.loss_from))
        self.need[: len(keep)] = need[keep]
        self.n = len(keep)
        if cut and cut[2]:
            self._append(*cut)
        self.sequence += 1

    def _place(self, i: int, start: int, length: int, offset: int) -> None:
        self.out.append((self.owner[i], start, length, self.sequence, offset, self._loss(start, length, self.loss_from[i])))

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(
    docs: DataFrame,
    path: str | None = None,
    max_tokens: int = 2048,
    max_segments: int = 64,
    max_loss: int | None = None,
    loss_share: str | None = None,
    pool: int = 256,
    min_piece: int = 16,
) -> DataFrame:
    """One row per piece. loss_share: a column with the share (0 to 1) of a document's last ids that bear loss; all bear it without."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")]
    cols.append((F.col(loss_share).cast("double") if loss_share else F.lit(1.0)).alias("share"))
    limit = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, limit) < 1:
        raise ValueError("every limit must be at least 1")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(max_tokens, max_segments, limit, pool, min_piece)
        first = TaskContext.get().partitionId() << 32
        crc = zlib.crc32

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(o[0], s, n, crc(o[1][4 * s : 4 * (s + n)]), len(o[1]) // 4, first + q, at, loss) for o, s, n, q, at, loss in packer.rows()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=ARROW_SCHEMA)

        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for doc, text, share in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = encode(text) + end
                n = len(ids) // 4
                packer.add((doc, ids), n, min(n, max(0, round(n * (1.0 if share is None else share)))))
            yield from flush()
        packer.drain()
        yield from flush()

    return docs.select(*cols).mapInArrow(task, SCHEMA)
