"""The n-gram Jaccard join against all pairs of sets."""

import random

import numpy as np
import pytest

from rowparity.llm import jaccard


def sets(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=80):
    """doc_id -> (n, component) by all pairs."""
    found = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both and 100 * both >= percent * len(found[i] | found[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((doc, len(found[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, groups=6, size=12):
    """Groups of texts with word changes, cut ends and added paragraphs, about passages that many share."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(draw.choices(vocabulary, k=60))
    texts = []
    for _ in range(groups):
        base = draw.choices(vocabulary, k=draw.choice([3, 8, 40, 150, 300]))
        for _ in range(size):
            words = list(base)
            for _ in range(draw.randrange(0, max(2, len(words) // 30))):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                words = words[: int(len(words) * draw.uniform(0.75, 1))]
            if draw.random() < 0.3:
                words += draw.choices(vocabulary, k=draw.randrange(len(words) // 4 + 1))
            text = " ".join(words)
            texts.append(text.upper() if draw.random() < 0.1 else f"{passage} {text}" if draw.random() < 0.3 else text)
    texts += [passage] * 3 + ["", None, "  ", "one", "ONE", "two words", "Two\twords"]
    draw.shuffle(texts)
    return [(10 * i, t) for i, t in enumerate(texts)]


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("how", [{"low": 0.1}, {"low": 1.0, "most_rows": 4, "pivots": 2}, {"most_grams": 300, "pivots": 3}])
def test_as_all_pairs(documents, how):
    rows = corpus(len(how))
    assert result(jaccard.classes(documents(rows).repartition(3), **how)) == brute(rows)


def test_large_group_of_near_copies_in_chunks(documents):
    """One group beyond a task's size, with outliers that only some members link to, and half-alike texts."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(1000)]
    base = draw.choices(vocabulary, k=120)
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(draw.choice([1, 1, 2, 3, 5, 9])):
            words[draw.randrange(120)] = draw.choice(vocabulary)
        rows.append((i, " ".join(words)))
    assert result(jaccard.classes(documents(rows), most_rows=20, pivots=3)) == brute(rows)


def test_exactly_at_the_bound(documents):
    """10 shared of 12 n-grams are over 80 percent; 8 of 10 are just that; 7 of 9 are not."""
    word = [f"v{i}" for i in range(30)]
    rows = [(1, " ".join(word[:14])), (2, " ".join(word[:13] + ["x"])), (3, " ".join(word[20:]) + " a b c d"), (4, " ".join(word[20:]) + " a b"), (5, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12"), (6, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 z")]
    assert result(jaccard.classes(documents(rows))) == brute(rows)


def test_product_of_tiles():
    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(0, 1 << 60, 900).astype(np.uint64))
    a = [np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(40)]
    a += [np.unique(np.append(m, pool[:5]))[: max(1, len(m))] for m in a]
    link = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    i, j = jaccard.linked(a, None, 80)
    assert {frozenset(p) for p in zip(i.tolist(), j.tolist())} == {frozenset((x, y)) for x in range(len(a)) for y in range(x) if link(a[x], a[y])}
    assert len(i) == len(set(zip(i.tolist(), j.tolist())))
    i, j = jaccard.linked(a[:50], a[50:], 80)
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(50) for y in range(len(a) - 50) if link(a[x], a[50 + y])}


def test_odd_rows(spark, documents, odd_rows):
    found = jaccard.classes(documents(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert by[1] == by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4) and by[7] == (1, 7) and by[None] == (1, None)
    same = jaccard.classes(documents([(None, "no id here"), (9, "no id here"), (None, ""), (4, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in same) == [(0, 0), (0, 9), (4, 4), (9, 9)]
    assert jaccard.classes(documents([(1, "x")]).where("false")).count() == 0
