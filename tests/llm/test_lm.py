import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rowparity.llm import lm

WORDS = "the cat sat on a mat and then some dog ran far away from it".split()


def corpus(n=120):
    """Texts in which a word says much about the next."""
    r, out = np.random.default_rng(1), []
    for i in range(n):
        at, words = int(r.integers(len(WORDS))), []
        for _ in range(int(r.integers(0, 40))):
            words.append(WORDS[at])
            at = (at + int(r.choice([1, 2, 7], p=[0.6, 0.3, 0.1]))) % len(WORDS)
        out.append((i, " ".join(words)))
    return out


def role(i):
    if i is None or zlib.crc32(str(i).encode()) % 5 == 1:
        return lm.HELD_OUT
    return lm.DELETED if zlib.crc32(str(i).encode()) % 20 == 4 else lm.KEPT


class Brute:
    """The model from its definition."""

    def __init__(self, rows, order):
        self.order = order
        self.docs = [(i, (t or "").encode().lower().split() + ["END"]) for i, t in rows]
        self.all, self.kept = self.counts({lm.KEPT, lm.DELETED}), self.counts({lm.KEPT})
        self.weights = self.learn()

    def counts(self, roles):
        c, n_docs = Counter(), 0
        for i, ws in self.docs:
            if role(i) in roles:
                n_docs += 1
                for n in range(1, self.order + 1):
                    padded = ["BEGIN"] * (n - 1) + ws
                    c.update((n, *padded[k : k + n]) for k in range(len(ws)))
        tokens = sum(v for k, v in c.items() if k[0] == 1)
        return c, tokens, sum(1 for k in c if k[0] == 1), n_docs

    def estimates(self, ws, k, counts):
        c, tokens, types, n_docs = counts
        p, context = [1 / (types + 1), c[1, ws[k]] / max(1, tokens)], tokens
        for n in range(2, self.order + 1):
            padded = ["BEGIN"] * (n - 1) + ws
            context = n_docs if k == 0 else c[(n - 1, *padded[k : k + n - 1][-(n - 1) :])] if n == 2 else c[(n - 1, *(["BEGIN"] * (n - 2) + ws)[k - 1 : k - 1 + n - 1])]
            p.append(c[(n, *padded[k : k + n])] / context if context else 0.0)
        return p, min(lm.BUCKETS - 1, int(math.log2(context)) + 1 if context else 0)

    def learn(self):
        events = [self.estimates(ws, k, self.kept) for i, ws in self.docs if role(i) == lm.DELETED for k in range(len(ws))]
        size = self.order + 1
        w = {b: [1 / size] * size for b in [*range(lm.BUCKETS), "all"]}
        for _ in range(25):
            sums = defaultdict(lambda: [0.0] * size)
            for p, b in events:
                for key in (b, "all"):
                    z = sum(x * y for x, y in zip(w[key], p))
                    for i in range(size):
                        sums[key][i] += w[key][i] * p[i] / z
            if not events:
                break
            new = {b: [x / sum(sums[b]) for x in sums[b]] if b in sums else [x / sum(sums["all"]) for x in sums["all"]] for b in w}
            change = max(abs(x - y) for b in sums for x, y in zip(new[b], w[b]))
            w = new
            if change < 1e-3:
                break
        w = {b: [max(x, lm.LEAST_WEIGHT) for x in v] for b, v in w.items()}
        return {b: [x / sum(v) for x in v] for b, v in w.items()}

    def row(self, i, ws):
        c, tokens, types, _ = self.all
        base = sum(math.log10((c[1, w] + 0.5) / (tokens + 0.5 * (types + 1))) for w in ws)
        score = 0.0
        for k in range(len(ws)):
            p, b = self.estimates(ws, k, self.all)
            score += math.log10(sum(x * y for x, y in zip(self.weights[b], p)))
        return i, role(i) == lm.HELD_OUT, len(ws), sum(c[1, w] > 0 for w in ws), tokens, base, score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_the_definition(documents, order):
    rows = corpus() + [(None, "The CAT zzz"), (500, None), (501, ""), (502, "the cat"), (502, "the cat"), (503, "new words only")]
    brute = Brute(rows, order)
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(map(tuple, lm.score(documents(rows), order, block_bytes=600, shards=3).collect()), key=key)
    expected = sorted((brute.row(i, ws) for i, ws in brute.docs), key=key)
    for g, e in zip(got, expected, strict=True):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9) and g[6] == pytest.approx(e[6], rel=1e-5)


def test_blocks_and_shards_do_not_matter(documents):
    df = documents(corpus(60))
    first, second = (sorted(map(tuple, lm.score(df, block_bytes=b, shards=s).collect())) for b, s in ((1 << 20, 1), (200, 7)))
    assert [r[:5] for r in first] == [r[:5] for r in second]
    assert np.allclose([r[5:] for r in first], [r[5:] for r in second])


def test_the_mixture_beats_the_base_on_held_out_texts(documents):
    rows = [r for r in lm.score(documents(corpus(400))).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_arrays_go_through_compression():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm.keys_of(lm.sorted_keys(keys)) == keys).all()
    for a in (np.arange(5, dtype="<u4"), np.zeros(0, "<f8")):
        assert (lm.expand(lm.squeeze(a), a.dtype.str) == a).all()


def test_odd_rows_no_training_and_empty_table(documents, odd_rows):
    assert lm.score(documents(odd_rows)).count() == len(odd_rows)
    held = [i for i in range(200) if role(i) == lm.HELD_OUT][:3]
    for r in lm.score(documents([(i, "a b") for i in held])).collect():
        assert (r["train_tokens"], r["n_known"], r["score"]) == (0, 0, 0.0)
    assert lm.score(documents(odd_rows).where("false")).count() == 0
