import random

import pytest

from rowparity.llm import decontam


def least_edits(item: bytes, text: bytes) -> int:
    """Of the item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def changed(r: random.Random, text: str, edits: int, letters: str) -> str:
    x = list(text)
    for _ in range(edits):
        k = r.randrange(len(x) + 1)
        how = r.random()
        if how < 0.34 or k == len(x):
            x.insert(k, r.choice(letters))
        elif how < 0.67:
            x[k] = r.choice(letters)
        else:
            del x[k]
    return "".join(x)


@pytest.mark.parametrize(("q", "rate", "seed"), [(8, 0.1, 1), (10, 0.08, 2), (12, 0.05, 3), (8, 0.03, 4)])
def test_no_match_within_the_budget_is_lost(q, rate, seed):
    r, letters = random.Random(seed), "abc d"
    items = ["".join(r.choice(letters) for _ in range(r.choice([3, 9, 40, 80, 120]))) for _ in range(8)]
    texts = ["", "a" * 300, items[2]]
    for _ in range(50):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 200)))
        k = r.randint(0, len(t))
        texts.append(t[:k] + changed(r, r.choice(items), r.randint(0, 8), letters) + t[k:])
    index = decontam.Index(list(range(8)), [decontam.normal(x) for x in items], q, rate)
    data = [decontam.normal(t) for t in texts]
    got = {(t, i): (s, e, d) for t, i, s, e, d in decontam.places(index, data)}
    expected = {(t, i): n for t, x in enumerate(data) for i, item in enumerate(index.items) if (n := least_edits(item, x)) <= index.budget[i]}
    assert {k: d for k, (_, _, d) in got.items()} == expected
    for (t, i), (s, e, d) in got.items():
        assert distance(index.items[i], data[t][s:e]) == d


def test_small_parts_give_the_same(monkeypatch):
    r = random.Random(9)
    items = [decontam.normal("".join(r.choice("ab ") for _ in range(60))) for _ in range(4)]
    texts = [decontam.normal("".join(r.choice("ab ") for _ in range(500)) + items[k % 4].decode()) for k in range(12)]
    whole = decontam.places(decontam.Index([0, 1, 2, 3], items, 8, 0.05), texts)
    monkeypatch.setattr(decontam, "SLICE", 64)
    monkeypatch.setattr(decontam, "HITS", 50)
    assert decontam.places(decontam.Index([0, 1, 2, 3], items, 8, 0.05), texts) == whole
    assert {(t, t % 4) for t in range(12)} <= {(t, i) for t, i, *_ in whole}


ITEM = "The quick brown fox jumps over the lazy dog while the band plays on and on."


def test_find_and_clean(spark, documents, odd_rows):
    rows = odd_rows + [(20, f"é 😀 {ITEM.upper()} end"), (21, ITEM.replace("brown", "green").replace(" ", "\n", 3)), (22, ITEM[:40]), (20, f"é 😀 {ITEM.upper()} end"), (None, ITEM)]
    bench = spark.createDataFrame([(1, ITEM, "-"), (2, None, "-"), (3, "", "-"), (None, "word", "-"), (4, "no such text at all here", "-")], "item_id long, text string, doc_id string")
    docs = documents(rows)
    got = sorted(map(tuple, decontam.find(docs, bench).collect()), key=str)
    n = len(ITEM)
    assert got == sorted([(20, 1, 4, 4 + n, 0, n), (20, 1, 4, 4 + n, 0, n), (21, 1, 0, n, 3, n), (None, 1, 0, n, 0, n), (4, None, 0, 4, 0, 4)], key=str)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 5
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 5, 6, 7, 8, 9, 22, None}


def test_blocks_of_items_and_empty_tables(spark, documents, monkeypatch):
    r = random.Random(5)
    items = [(i, "".join(r.choice("abcdefgh ") for _ in range(100))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents([(i, f"xx {t} yy") for i, t in items])
    assert len(list(decontam.indexes(bench, block_bytes=600))) > 3
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 600)
    monkeypatch.setattr(decontam.indexes, "__defaults__", (10, 0.08, 600))
    assert sorted((x["doc_id"], x["item_id"]) for x in decontam.find(docs, bench).collect()) == [(i, i) for i in range(30)]
    assert decontam.clean(docs, bench).count() == 0
    some = decontam.clean(docs.unionByName(documents([(99, "nothing of it")])), bench)
    assert [x["doc_id"] for x in some.collect()] == [99]
    assert some._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one index in a task
    assert decontam.find(docs, bench.where("false")).count() == 0 == decontam.find(docs.where("false"), bench).count()
    assert decontam.clean(docs, bench.where("false")).count() == 30
