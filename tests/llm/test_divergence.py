"""Source divergence against a count in plain Python, with small blocks and slots so that several rounds meet."""

import random
import re
from collections import Counter

import pytest

from rowparity.llm import divergence

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least_docs, first):
    groups, seen = {}, {}
    for text, lang, source in rows:
        lang, terms = lang or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(UPPER))
        groups.setdefault((lang, source or ""), Counter()).update(terms)
        seen.setdefault(lang, Counter()).update(set(terms))
    out = set()
    for lang in seen:
        kept = {t for t, n in seen[lang].items() if n >= least_docs}
        mine = {s: Counter({t: n for t, n in c.items() if t in kept}) for (k, s), c in groups.items() if k == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in mine.items()}, share(sum(mine.values(), Counter()))
        for s in mine:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < first}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "-", "-", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, block string, n long").repartition(3)


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("slot", [1, 2, 50])
def test_as_counted_plainly(spark, slot):
    draw = random.Random(slot)
    words = [f"{a}{b}" for a in "abcdéß漢" for b in ("x", "Y", "zé", "")]
    rows = []
    for lang, sources in (("en", 9), ("de", 4), ("xx", 1), (None, 2)):
        for _ in range(150):
            s = draw.randrange(sources)
            text = " ".join(draw.choices(words, [1 + (i * (s + 3)) % 11 for i in range(len(words))], k=draw.randrange(0, 25)))
            rows.append((text if draw.random() < 0.95 else None, lang, f"s{s}" if s else None))
    rows += [(" 12 ;;", "en", "only signs"), (None, "en", "no text"), ("rare words here", "zz", "a"), ("Ab", "zz", "b")]
    # a hot source: a third of all rows
    rows += [("ax AX bY", "en", "hot")] * 300
    assert found(divergence.divergence(frame(spark, rows), 20, 5, block=7, slot=slot)) == brute(rows, 20, 5)


def test_every_slot_meets_every_other_once(spark):
    for slots in (2, 4, 6, 10):
        met = set()
        for turn in range(1, slots):
            rows = spark.range(slots).select("id", divergence.partner(divergence.F.col("id"), divergence.F.lit(slots).cast("long"), turn).alias("to")).collect()
            pairs = {(r["id"], r["to"]) for r in rows}
            assert all(a != b and (b, a) in pairs for a, b in pairs) and len(pairs) == slots
            assert not met & pairs
            met |= pairs
        assert len(met) == slots * (slots - 1)


def test_residents_are_not_shuffled_in_a_round(spark):
    place = ["lang", "block", "slot"]
    rows = spark.createDataFrame([("en", 0, k, "s", None, 0, 0, 0) for k in range(4)], divergence.MEMBER)
    resident = rows.repartition(4, *place).persist()
    plan = resident.groupBy(*place).cogroup(rows.groupBy(*place)).applyInArrow(divergence.met, divergence.PAIRS)
    text = plan._jdf.queryExecution().executedPlan().toString()
    resident.unpersist()
    before = text.split("InMemoryRelation")[0]
    assert "InMemory" in text and before.count("Exchange") <= 1


def test_large_counts_stay_exact():
    import numpy as np

    counts = np.array([0, 1, 5 * 10**9])
    for total in (10**10, 9 * 10**9, 3 * 10**12):
        assert divergence.shares(counts, total, 7).tolist() == [1 + 10**9 * (c + 5) // (total + 35) for c in counts.tolist()]


def test_vectors_survive_compression():
    import numpy as np

    positions = np.array([0, 3, 4, 99])
    counts = np.array([1, 2**40, 3, 4])
    dense = divergence.spread_out(divergence.squeezed(positions, counts), 100)
    assert dense[positions].tolist() == counts.tolist() and dense.sum() == counts.sum()
    assert divergence.spread_out(None, 3).tolist() == [0, 0, 0]


def test_odd_tables(spark, documents, odd_rows):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.divergence(empty).count() == 0
    rows = [(r[1], "en", str(i % 3)) for i, r in enumerate(odd_rows)] * 3
    assert found(divergence.divergence(frame(spark, rows), 2, 4)) == brute(rows, 2, 4)
