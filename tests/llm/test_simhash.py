import random

import numpy as np
import pytest
import xxhash

from rowparity.llm import simhash
from rowparity.llm.common import components


def brute_fingerprint(text, width=3):
    tokens = (text or "").encode().lower().split()
    parts = [b" ".join(tokens[k : k + width]) for k in range(max(1, len(tokens) - width + 1))] if tokens else []
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    """(doc_id, fingerprint) -> least id reachable, links of the fingerprint."""
    parent = {i: i for i, _ in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in prints:
        for j, y in prints:
            if (x ^ y).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    distinct = {x for _, x in prints}
    return {i: root(i) for i, _ in prints}, {x: sum(x != y and (x ^ y).bit_count() <= radius for y in distinct) for x in distinct}


@pytest.mark.parametrize(("n", "bits", "radius"), [(200, 8, 2), (2000, 14, 2), (3000, 64, 2), (500, 64, 5), (1, 64, 2), (0, 64, 2)])
def test_trie_join_finds_each_pair_once(n, bits, radius, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "FRONTIER", 512)
    r = np.random.default_rng(n)
    base = r.integers(0, 1 << min(bits, 63), n, dtype=np.uint64)
    flip = np.uint64(1) << r.integers(0, bits, n // 3).astype(np.uint64)
    v = np.unique(np.concatenate([base, base[: n // 3] ^ flip]))
    got = [(i, j) for x, y in simhash.trie_join(v, None, radius, bits) for i, j in zip(x.tolist(), y.tolist())]
    expected = {(i, i + 1 + j) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= radius).tolist()}
    assert len(got) == len(set(got)) and set(got) == expected
    a, b = v[::2], v[1::2]
    got = [(i, j) for x, y in simhash.trie_join(a, b, radius, bits) for i, j in zip(x.tolist(), y.tolist())]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(b ^ a[i]) <= radius).tolist()}


def test_near_duplicates_match_brute_force(documents, odd_rows):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = [x for x in odd_rows if x[0] is not None]
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([2, 3, 30, 400]))]
        rows.append((100 + 3 * i, " ".join(words)))
        words[r.randrange(len(words))] = "other"
        rows += [(101 + 3 * i, " ".join(words)), (102 + 3 * i, " ".join(words).upper())]
    got = simhash.near_duplicates(documents([*rows, (None, rows[20][1]), (None, "nobody has this")])).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    component, links = brute_components(prints, 2)
    by_print = {f: component[i] for i, f in prints}
    assert len(got) == len(rows) + 2
    for g in got:
        f = int(g["fingerprint"], 16)
        if g["doc_id"] is not None:
            assert (f, g["component_id"], g["n_links"]) == (dict(prints)[g["doc_id"]], component[g["doc_id"]], links[f])
        else:
            assert g["component_id"] == by_print.get(f)
    assert {g["fingerprint"] for g in got if g["doc_id"] in (1, 2, 3)} == {"0" * 16}


@pytest.mark.parametrize("cut", [False, True])  # into chunks
def test_a_large_group_over_several_subtrees(spark, cut):
    r = np.random.default_rng(3)
    center = int(r.integers(0, 1 << 62))
    values = {center} | {center ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)} | set(r.integers(0, 1 << 62, 500).tolist())
    prints = [(i, v) for i, v in enumerate(sorted(values))]
    nodes = spark.createDataFrame([(v, i) for i, v in prints], "fp long, node long")
    how = simhash.layout(nodes, subtree=40, least=2) if not cut else simhash.Layout(tuple(range(64)), 1)
    assert how.prefix > 2 or cut
    found = simhash.links(nodes, 2, how, subtree=60 if cut else simhash.SUBTREE)
    component, links = brute_components(prints, 2)
    got = {x["u"]: 0 for x in found.collect()}
    for x in found.collect():
        got[x["u"]] += x["links"]
    assert got == {i: links[v] for i, v in prints if links[v]}
    joined = {x["id"]: x["component"] for x in components(found.select("u", "v")).collect()}
    assert {i: joined.get(i, i) for i, _ in prints} == component


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(300)]
    r = random.Random(2)
    r.shuffle(chain)
    hub = [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(chain + hub, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def prose(r, n):
    return [f"{r.choice('abcdefgh')}{r.randrange(300)}" for _ in range(n)]


def similarity(x, y):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (x.lower().split(), y.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_texts_are_grouped_and_others_are_not(documents):
    r, rows, pairs = random.Random(4), [], []
    for i in range(60):
        words = prose(r, r.choice([120, 300, 600]))
        copy = list(words)
        for _ in range(len(words) // 80):
            copy[r.randrange(len(copy))] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        pairs.append(similarity(rows[-2][1], rows[-1][1]))
    group = {x["doc_id"]: x["component_id"] for x in simhash.similar(documents(rows)).collect()}
    near = [i for i, s in enumerate(pairs) if s >= 0.8]
    assert len(near) > 40 and sum(group[2 * i + 1] == 2 * i for i in near) >= 0.97 * len(near)
    assert all(c // 2 == i // 2 for i, c in group.items())


def test_groups_do_not_depend_on_the_deal(documents):
    r, rows = random.Random(5), []
    base = prose(r, 200)
    for i in range(80):  # one large group of near copies
        copy = list(base)
        copy[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(prose(r, 100))) for i in range(100)]
    df = documents(rows)
    whole = {x["doc_id"]: x["component_id"] for x in simhash.similar(df).collect()}
    assert df.count() > 4 * 20  # so that the large group is cut into chunks
    parts = {x["doc_id"]: x["component_id"] for x in simhash.similar(df, subtree=20).collect()}
    assert whole == parts == {i: 0 if i < 80 else i for i, _ in rows}


def test_first_of_each_keeps_rows_and_columns(documents, odd_rows):
    df = documents([*odd_rows, (50, "same row"), (None, "same row")])
    kept = simhash.first_of_each(df)
    assert kept.columns == df.columns
    ids = sorted((x["doc_id"] for x in kept.collect()), key=str)
    # 1, 2 and 3 have no words and are alike; 7 stays with both its rows, 50 goes; rows without an id stay
    assert ids == sorted([1, 4, 5, 6, 7, 7, 8, 9, None, None], key=str)
    assert simhash.first_of_each(df.where("false")).count() == 0 == simhash.near_duplicates(df.where("false")).count()


def test_changed_blocks_are_grouped_exactly_from_the_threshold(documents):
    r, rows, pairs = random.Random(6), [], []
    own = lambda n: [f"x{r.randrange(10**7)}" for _ in range(n)]
    for i in range(200):
        words = own(300)
        n = r.choice([24, 30, 45, 55])  # replaced: similarities of about 0.84, 0.80, 0.73, 0.68
        copy = words[:100] + own(n) + words[100 + n :] if i % 2 else words + own(r.choice([60, 70, 100, 130]))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        pairs.append(similarity(rows[-2][1], rows[-1][1]))
    group = {x["doc_id"]: x["component_id"] for x in simhash.similar(documents(rows)).collect()}
    near = [i for i, s in enumerate(pairs) if s >= 0.8]
    assert len(near) > 50 and sum(group[2 * i + 1] == 2 * i for i in near) >= 0.98 * len(near)
    assert len(near) < 150 and all(group[2 * i + 1] == 2 * i + 1 for i, s in enumerate(pairs) if s < 0.8)


def test_a_large_group_is_not_compared_pair_by_pair(documents, monkeypatch):
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [r.choice(vocabulary) for _ in range(300)]

    def copy():
        out = list(base)
        for at in r.sample(range(300), 3):
            out[at] = r.choice(vocabulary)
        return " ".join(out)

    rows = [(i, copy()) for i in range(300)] + [(300 + i, " ".join(r.choice(vocabulary) for _ in range(300))) for i in range(40)]
    counted = []
    mine = simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda edges, *more: counted.append(edges.count()) or mine(edges, *more))
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar(documents(rows)).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[i] == i for i in range(300, 340))
    assert sum(counted) < 2 * 300


def test_groups_match_brute_force(documents):
    r = random.Random(22)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(150, 300))]
        rows.append(" ".join(base))
        for _ in range(4):
            out, cut = list(base), r.randint(0, 25)
            way = r.choice("abc")
            if way == "a":
                out[:cut] = []
            elif way == "b":
                out += [r.choice(vocabulary) for _ in range(cut)]
            else:
                for at in r.sample(range(len(out)), cut // 6):
                    out[at] = r.choice(vocabulary)
            rows.append(" ".join(out))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar(documents(list(enumerate(rows)))).collect()}
    wrong = [i for i in range(len(rows)) if got[i] != group[i]]
    assert len(set(group)) < 80 and len(wrong) <= 2  # a candidate in a hundred may be missed


def test_texts_of_the_same_words_in_other_orders_cost_little(documents):
    """16,000 texts that share all words and hardly a shingle: none is a candidate, and none is lost."""
    import time

    r, words = random.Random(23), [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(r.sample(words, 120))) for i in range(16_000)]
    df = documents(rows).repartition(8)
    began = time.monotonic()
    got = simhash.similar(df).collect()
    assert time.monotonic() - began < 120
    assert len(got) == 16_000 and all(x["doc_id"] == x["component_id"] for x in got)


def test_candidates_of_a_task_are_joined_as_all_pairs_would(documents):
    """join_alike leaves groups out only where they are one already."""
    r = np.random.default_rng(8)
    for sided in (False, True):
        base = r.integers(0, 1 << 62, (6, simhash.WIDE + 1)).astype(np.uint64)
        of = r.integers(0, 6, 300)
        wide = base[of]
        for row in wide:
            for _ in range(r.integers(0, 30)):
                row[r.integers(0, simhash.WIDE)] ^= np.uint64(1) << np.uint64(r.integers(0, 64))
        wide[:, simhash.WIDE] = r.integers(90, 110, 300)
        values = (np.uint64(1) << (of % 3 * 9).astype(np.uint64)) ^ r.integers(0, 8, 300).astype(np.uint64)
        side = r.integers(0, 2, 300).astype(bool) if sided else np.zeros(300, dtype=bool)
        order = np.lexsort((values, side))
        values, side, wide = values[order], side[order], wide[order]
        groups = simhash.Groups(np.arange(300))
        simhash.join_alike(values, side if sided else None, wide, groups, 3, 43, 32, 0.8)
        parent = list(range(300))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(300):
            near = simhash.may_be_alike(wide, np.repeat(wide[i : i + 1], 300, axis=0), 43, 0.8) & (np.bitwise_count(values ^ values[i]) <= 3)
            near &= (side != side[i]) if sided else True
            for j in np.flatnonzero(near).tolist():
                parent[max(root(i), root(j))] = min(root(i), root(j))
        mine, all_ = [groups.root(i) for i in range(300)], [root(i) for i in range(300)]
        # rows of one side with one key may be joined as well, where they are alike
        for i in range(300):
            for j in range(i):
                assert all_[i] != all_[j] or mine[i] == mine[j]
        if not sided:
            assert len(set(mine)) == len(set(all_)) < 300


@pytest.mark.parametrize("run", [8, simhash.RUN])  # longer runs go down the trie
def test_near_keys_finds_each_pair_once(run, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", run)
    r = np.random.default_rng(11)
    v = r.integers(0, 1 << 27, 1500, dtype=np.uint64)
    v[:300] = v[0]
    for _ in range(3):
        v[:600] ^= np.uint64(1) << r.integers(0, 27, 600).astype(np.uint64)
    v = np.unique(v)
    near = lambda a, b: {(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(b ^ a[i]) <= 3).tolist()}
    got = [(i, j) for x, y in simhash.near_keys(v, None, 3, 32) for i, j in zip(x.tolist(), y.tolist())]
    assert len(got) == len(set(got)) > 1000 and set(got) == {(i, j) for i, j in near(v, v) if i < j}
    a, b = v[::2], v[1::2]
    got = [(i, j) for x, y in simhash.near_keys(a, b, 3, 32) for i, j in zip(x.tolist(), y.tolist())]
    assert len(got) == len(set(got)) and set(got) == near(a, b)


def test_a_longer_prefix_sends_no_more_rows(spark, monkeypatch):
    """Each key goes to 4 subtrees at most, whatever their number (with masks of up to three bits to 26 at a prefix of 5), and keys within the radius meet."""
    r = np.random.default_rng(12)
    base = r.integers(0, 1 << 32, 200).tolist()
    keys = base + [x ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for x, (a, b, c) in zip(base, (r.choice(32, 3, replace=False) for _ in base))]
    same = bytes(8 * simhash.WIDE) + (100).to_bytes(8, "little")
    keyed = spark.createDataFrame([(i, same, 0, k) for i, k in enumerate(keys)], "node long, wide binary, t int, p long")
    sent, deal = [], simhash.deal
    monkeypatch.setattr(simhash, "deal", lambda *a: sent.append(deal(*a)) or sent[-1])
    joined = {x["id"]: x["component"] for x in components(simhash.candidate_links(keyed, 3, 43, 5, 1000, 0.8)).collect()}
    assert sent[0].count() <= 4 * len(keys)
    assert all(joined[i] == joined[200 + i] for i in range(200))


def test_rounds_of_tables_give_the_same(documents, monkeypatch):
    r, rows = random.Random(31), []
    for i in range(40):
        words = prose(r, 150)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-2], "changed", "end"]))]
    df = documents(rows)
    whole = {x["doc_id"]: x["component_id"] for x in simhash.similar(df).collect()}
    monkeypatch.setattr(simhash, "ROUND", 80 * 4 * 5)  # five tables, then the rest
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar(df, subtree=10).collect()} == whole == {i: i // 2 * 2 for i, _ in rows}


def test_saved_tables_leave_no_shuffle_files(spark):
    import time
    from pathlib import Path

    from rowparity.llm import common

    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*")}
    before, conf = files(), spark.conf.get(common.CLEANUP, None)
    out = common.saved(spark.range(1000).repartition(3, "id").groupBy("id").count())
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000 and spark.conf.get(common.CLEANUP, None) == conf
