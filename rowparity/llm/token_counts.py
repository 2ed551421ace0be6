"""Count-only Viterbi: the number of pieces of a text under a unigram vocabulary, without building the pieces.

An Aho-Corasick automaton enumerates the vocabulary entries that end at each character; a dynamic program carries, for
each end, the best score and the number of pieces on the best path. Ties go as in the public tokenizers library's
unigram model: of equal scores the earliest start wins, a character without an entry of its own costs the least score
less ten, and counts as one piece a byte.

Spaces become the mark U+2581 at the start of a word and no entry crosses a word, so words are independent and each is
solved once per worker. Defined results: null and empty texts have no pieces; everything else counts, white space too;
very long texts are counted whole, a word at a time; repeated rows are counted once each; a null doc_id stays null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
SCHEMA = "doc_id long, n_chars long, n_words long, n_tokens long"


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores as the model file states them."""
    import sentencepiece

    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def counter(vocab: list[tuple[str, float]]) -> Callable[[str], int]:
    """word -> number of pieces on its best path."""
    import ahocorasick

    scores: dict[str, float] = {}
    for piece, score in vocab:
        if piece:
            scores[piece] = score  # the later of two equal pieces counts
    automaton = ahocorasick.Automaton()
    for piece, score in scores.items():
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY

    longest = max(map(len, scores), default=1)

    def count(word: str) -> int:
        # best and pieces of the last `longest` places alone, so a word of any length takes the same room
        n, room = len(word), longest + 1
        best, pieces = [0.0] * room, [0] * room
        matches = automaton.iter(word)
        ahead = next(matches, None)
        for end in range(1, n + 1):
            found = []
            while ahead is not None and ahead[0] == end - 1:
                found.append(ahead[1])
                ahead = next(matches, None)
            score, most = None, 0
            for length, gain in sorted(found, reverse=True):  # longest, that is earliest start, first
                start = (end - length) % room
                if score is None or best[start] + gain > score:
                    score, most = best[start] + gain, pieces[start] + 1
            before = (end - 1) % room
            if not any(length == 1 for length, _ in found) and (score is None or best[before] + unknown > score):
                score, most = best[before] + unknown, pieces[before] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            best[end % room], pieces[end % room] = score, most
        return pieces[n % room]

    return count


def words(text: str) -> list[str]:
    """The words with their marks, as a metaspace pre-tokenizer with a mark put before the first word gives them."""
    if not text:
        return []
    first, *rest = text.replace(MARK, " ").split(" ")
    return [MARK + w for w in ([first] if first else []) + rest]


@lru_cache(maxsize=2)  # a worker process keeps its words from task to task
def solver(path: str | None) -> tuple[Callable[[str], int], dict[str, int]]:
    return counter(vocabulary(path)), {}


KEPT_LENGTH, KEPT_CHARS = 64, 12_000_000


def token_counts(docs: DataFrame, path: str | None = None, most: int = 600_000) -> DataFrame:
    """doc_id, n_chars, n_words, n_tokens of every document.

    A worker remembers at most `most` words of up to KEPT_LENGTH characters, KEPT_CHARS in all; the others are counted anew.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = solver(path)
        chars = sum(map(len, known))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = words(text)
                new = {w: count(w) for w in set(parts).difference(known)}
                total = sum(new[w] if w in new else known[w] for w in parts)
                if len(known) <= most and chars <= KEPT_CHARS:
                    short = {w: c for w, c in new.items() if len(w) <= KEPT_LENGTH}
                    known.update(short)
                    chars += sum(map(len, short))
                rows.append((doc, len(text), len(parts), total))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, names=["doc_id", "n_chars", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(task, SCHEMA)
