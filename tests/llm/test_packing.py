import random
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowparity.llm import packing


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(packing.tokenizer_path(None))


def test_ids_equal_the_library(exact):
    r, encode = random.Random(1), packing.encoder()
    letters = " \n\t'a1!é漢 \x1c\x85s  .<|endoftext|>ſKİ²½​́\U0001F600_\x00'sTRE"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(5000)] + ["", "a <|endoftext|> b", " " * 50_000, "a" * 50_000, "it's  they'll\n\n ok"]
    for t in texts:
        assert list(struct.unpack(f"<{len(encode(t)) // 4}I", encode(t))) == exact.encode(t, add_special_tokens=False).ids, repr(t)


def check(rows, docs, exact, max_tokens, max_segments, max_loss):
    """Every id of every document once; sequences gapless and within all limits."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    by_id = defaultdict(list)
    for i, t in docs:
        by_id[i].append(exact.encode(t or "", add_special_tokens=False).ids + [1])
    assert pieces.keys() == by_id.keys()
    for i, wanted in by_id.items():
        n = len(wanted[0])  # repeated rows have the same text
        assert sum(p["length"] for p in pieces[i]) == n * len(wanted)
        covered = [0] * n
        for p in pieces[i]:
            part = wanted[0][p["start"] : p["start"] + p["length"]]
            assert p["length"] == len(part) > 0 and p["doc_tokens"] == n
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            for k in range(p["start"], p["start"] + p["length"]):
                covered[k] += 1
        assert set(covered) == {len(wanted)}
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= max_tokens and len(s) <= max_segments and sum(p["loss_tokens"] for p in s) <= max_loss
    return [sum(p["length"] for p in s) for s in sequences.values()]


def test_odd_rows(documents, odd_rows, exact):
    check(packing.pack(documents(odd_rows)).collect(), odd_rows, exact, 2048, 64, 2048)


def test_little_padding(documents, exact):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["alpha", "be", "gamma,", "delta"]) for _ in range(r.choice([3, 50, 300, 5000])))) for i in range(400)]
    sizes = check(packing.pack(documents(docs).coalesce(1)).collect(), docs, exact, 2048, 64, 2048)
    assert sum(2048 - n for n in sizes if n & (n - 1)) < 0.01 * sum(sizes)


@pytest.mark.parametrize(("tokens", "segments", "loss"), [(128, 3, 60), (64, 1, 64), (100, 50, 10), (1, 1, 1)])
def test_all_limits_hold(documents, exact, tokens, segments, loss):
    docs = [(i, "one two three four five six seven " * (i % 9)) for i in range(80)]
    df = documents(docs).drop("share").withColumn("share", F.when(F.col("doc_id") % 4 == 0, None).otherwise((F.col("doc_id") % 4) / 4))
    check(packing.pack(df, max_tokens=tokens, max_segments=segments, max_loss=loss, loss_share="share", min_piece=4).collect(), docs, exact, tokens, segments, loss)


def test_empty_table_and_bad_limits(documents):
    assert packing.pack(documents([(1, "x")]).where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents([(1, "x")]), max_segments=0)
