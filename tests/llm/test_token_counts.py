import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from rowparity.llm import token_counts as tc


def library(vocab):
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.MARK, prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def vocab():
    return tc.vocabulary()


def test_counts_equal_the_library(vocab):
    r, count, exact = random.Random(3), tc.counter(vocab), library(vocab)
    letters = "abcdeTH  \n.,é漢😀▁<s>"
    for text in ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["", " ", "a" * 3000, "the quick brown fox", "▁▁ x"]:
        assert sum(map(count, tc.words(text))) == exact(text), repr(text)


def test_ties_go_as_in_the_library():
    pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), tc.MARK, "a", "b", "c", "ab", "bc", "abc", tc.MARK + "a", tc.MARK + "ab"]
    r = random.Random(4)
    for _ in range(60):  # whole scores tie often
        vocab = [(p, float(-r.randint(1, 3))) for p in pieces]
        count, exact = tc.counter(vocab), library(vocab)
        for text in ("abc", "aabbcc", "abcabc cab", "xaby", "bca abca"):
            assert sum(map(count, tc.words(text))) == exact(text), (vocab, text)


def test_odd_rows_and_empty_table(documents, odd_rows, vocab):
    exact = library(vocab)
    got = sorted(((r["doc_id"], r["n_chars"], r["n_tokens"]) for r in tc.token_counts(documents(odd_rows)).collect()), key=str)
    assert got == sorted(((i, len(t or ""), exact(t or "")) for i, t in odd_rows), key=str)
    assert tc.token_counts(documents(odd_rows).where("false")).count() == 0


def test_a_full_memory_changes_nothing(documents, odd_rows):
    key = lambda r: str(tuple(r))
    tc.solver.cache_clear()
    assert sorted(tc.token_counts(documents(odd_rows), most=0).collect(), key=key) == sorted(tc.token_counts(documents(odd_rows)).collect(), key=key)


def test_a_word_of_any_length_takes_little_room():
    import tracemalloc

    count = tc.counter(tc.vocabulary(None))
    word = tc.MARK + "abcdefghij" * 30_000
    tracemalloc.start()
    pieces = count(word)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert pieces > 30_000 and peak < 5_000_000


def test_what_is_not_remembered_is_counted_the_same(documents):
    rows = [(i, f"word{i} " + "x" * (i % 90) + " again") for i in range(200)]
    all_ = sorted(tuple(r) for r in tc.token_counts(documents(rows)).collect())
    assert all_ == sorted(tuple(r) for r in tc.token_counts(documents(rows), most=0).collect())
