import math
import random
import zlib

import numpy as np
import pytest

from rowparity.llm import language

SYLLABLES = {"en": "the and ing ion ther wh sh ed".split(), "fr": "eau é que ç oi tre è ment".split(), "de": "sch ung ö keit ä pf ß ein".split(), "es": "ción ñ ez que rr ado í bo".split()}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(n, seed=1):
    r = random.Random(seed)
    return [(i, text(r, lang, r.randint(5, 60)), lang) for i in range(n) for lang in [r.choice(list(SYLLABLES))]]


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 5, 9, 40):
        code = language.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) == {-1.0, 1.0}
        far = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert far >= (1 if n == 2 else code.shape[1] // 4)
        assert (np.abs(code.sum(axis=0)) < n).all()
    assert language.codewords(1).shape == (1, 0)


def test_held_out_accuracy(documents):
    df = documents(corpus(400))
    model = language.train(language.training_rows(df))
    got = language.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["runner_up"] != r["lang_pred"] for r in got)


def test_labels_of_held_out_rows_change_nothing(documents):
    rows = corpus(200)
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    run = lambda rows: sorted(map(tuple, language.identify(documents(rows), language.train(language.training_rows(documents(rows)))).collect()))
    assert run(rows) == run(other)


def test_odd_rows(documents, odd_rows):
    df = documents([*[(i + 100, t, lang) for i, t, lang in corpus(200)], *odd_rows, (90, "12345 -- ##", "en"), (91, text(random.Random(2), "fr", 30) + " ", None)]).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["x"]).expr("case when doc_id = 91 then null else lang end"))
    model = language.train(language.training_rows(df))
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == (language.UNDETERMINED, 0.0) for i in (1, 2, 3, 90))
    assert got[91]["lang_pred"] == "fr" and got[None]["held_out"]
    kept = language.accepted(df, model)
    assert kept.columns == df.columns and not {1, 2, 3, 90} & {r["doc_id"] for r in kept.collect()}
    assert kept.where("doc_id >= 100").count() == 200


def test_an_even_mixture_is_ambiguous(documents):
    r = random.Random(3)
    model = language.train(documents(corpus(300)))
    mixed = model.predict(" ".join(text(r, "fr", 1) + " " + text(r, "de", 1) for _ in range(200)))
    pure = model.predict(text(r, "fr", 200))
    assert {mixed[0], mixed[2]} == {"fr", "de"} and mixed[1] < pure[1] and pure[0] == "fr"


@pytest.mark.parametrize("langs", [[], ["en"]])
def test_few_languages(documents, langs):
    df = documents([(i, "the thing", lang) for i, lang in enumerate(langs * 5)] or [(0, "the thing", None)])
    df = df if langs else df.withColumn("lang", df["lang"].substr(100, 1)).where("doc_id < 0").union(df.where("false"))
    model = language.train(df)
    assert model.predict("the thing")[0] == (langs or [language.UNDETERMINED])[0]


def test_more_languages_than_are_learned_and_empty_table(documents):
    df = documents([(i, f"some text {'abcdef'[i % 6] * 9}", f"l{i % 6}") for i in range(40)])  # l0 to l3 have seven rows, the others six
    assert language.train(df, max_langs=3).langs == ["l0", "l1", "l2"]
    model = language.train(df, max_langs=6)
    assert model.langs == [f"l{i}" for i in range(6)]
    assert language.identify(df.where("false"), model).count() == 0 == language.accepted(df.where("false"), model).count()


def test_more_than_256_languages(documents):
    r = random.Random(6)
    rows = [(i, " ".join(chr(0x4E00 + 7 * (i % 300) + r.randrange(7)) for _ in range(20)), f"l{i % 300:03}") for i in range(900)]
    got = language.identify(documents(rows), language.train(documents(rows))).collect()
    assert sum(g["lang_pred"] == rows[g["doc_id"]][2] for g in got) >= 0.95 * len(rows)


def test_training_and_decoding_match_a_plain_computation(documents):
    rows = corpus(120, seed=5)
    model = language.train(documents(rows), bits=8)
    langs = sorted({lang for _, _, lang in rows})
    counts = {lang: [0.0] * 256 for lang in langs}
    for _, t, lang in rows:
        for i, n in enumerate(language.histogram(t, (1, 2, 3), 8).tolist()):
            counts[lang][i] += n
    share = {lang: [(n + 0.5) / (sum(c) + 128) for n in c] for lang, c in counts.items()}
    code = language.codewords(len(langs)).tolist()
    mean = lambda x: sum(x) / len(x)
    weights, scale, trust = [], [], []
    for j in range(len(code[0])):
        sides = [[share[lang] for lang, word in zip(langs, code) if word[j] == s] for s in (1, -1)]
        w = [math.log(mean([x[i] for x in sides[0]]) / mean([x[i] for x in sides[1]])) for i in range(256)]
        margins = [word[j] * sum(x * y for x, y in zip(share[lang], w)) for lang, word in zip(langs, code)]
        weights.append(w)
        scale.append(max(mean(margins), 1e-9))
        trust.append(max(min(margins) / scale[-1], 0.05))
    for _, t, _ in rows[:40]:
        h = language.histogram(t, (1, 2, 3), 8).tolist()
        margin = [sum(x * y for x, y in zip(h, w)) / sum(h) / s for w, s in zip(weights, scale)]
        loss = [sum(math.log1p(math.exp(-4 * c * m)) * q / sum(trust) for c, m, q in zip(word, margin, trust)) for word in code]
        best, second = sorted(range(len(langs)), key=loss.__getitem__)[:2]
        lang, score, other = model.predict(t)
        assert (lang, other) == (langs[best], langs[second]) and score == pytest.approx(loss[second] / (loss[best] + loss[second]))


def test_no_language_is_too_rare_to_be_learned(documents):
    """Over a thousand languages with one row each, and a common one."""
    import hashlib

    text = lambda k: " ".join(hashlib.sha256(f"{k} {j}".encode()).hexdigest()[:9] for j in range(12))
    rows = [(k, text(k), f"l{k:04d}") for k in range(1100)] + [(2000 + k, text(-1), "common") for k in range(40)]
    model = language.train(documents(rows))
    assert len(model.langs) == 1101 and "l1099" in model.langs
    assert np.isfinite(model.weights).all()
