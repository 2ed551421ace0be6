"""The pipeline's stages against their definitions on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from rowparity.llm import decontam, packing, queries
from tests.llm.test_packing import check

SYLLABLES = {"en": "the and ing ion ther wh sh ed".split(), "fr": "eau é que ç oi tre è ment".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, lang, n):
    return ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    r, rows = random.Random(1), []
    add = lambda text, lang="en": rows.append((len(rows), text, lang, f"s{len(rows) % 3}", None if text is None else len(text)))
    for i in range(60):
        add(" ".join(prose(r, "en" if i % 2 else "fr", r.randint(60, 200))), "en" if i % 2 else "fr")
    clean = set(range(60))
    add(rows[3][1], rows[3][2])  # an exact copy
    near = rows[5][1].split()
    near[20] = "changed"
    add(" ".join(near), rows[5][2])
    items = [" ".join(prose(r, "en", 30)) for _ in range(4)]
    add(" ".join(prose(r, "en", 40)) + " " + items[1] + " " + " ".join(prose(r, "en", 40)))
    add(items[2].upper() + " " + " ".join(prose(r, "en", 50)))
    add(None)
    add("1234 5678 --")
    secret = " ".join(prose(r, "en", 60)) + ' api_key = "0123456789abcdef0123" ' + " ".join(prose(r, "en", 30))
    add(secret)
    return rows, items, clean, {"copy": 60, "near": 61, "leaks": {62, 63}, "null": 64, "junk": 65, "secret": 66}


@pytest.fixture(scope="module")
def folder(spark, planted, tmp_path_factory):
    rows, items, _, _ = planted
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_do_what_they_say(spark, folder, planted):
    rows, items, clean, case = planted
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        docs = spark.createDataFrame(out.collect(), SCHEMA)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    every = {r[0] for r in rows}
    assert every - kept["language"].keys() == {case["null"], case["junk"]}
    assert kept["language"].keys() - kept["near_duplicates"].keys() == {case["copy"], case["near"]}
    assert kept["near_duplicates"].keys() - kept["decontamination"].keys() == case["leaks"]
    assert kept["decontamination"].keys() == kept["secrets"].keys()
    assert clean <= kept["secrets"].keys()
    texts = {r[0]: r[1] for r in rows}
    changed = {i for i, t in kept["secrets"].items() if t != texts[i]}
    assert changed == {case["secret"]} and "[SECRET]" in kept["secrets"][case["secret"]] and "0123456789abcdef" not in kept["secrets"][case["secret"]]


def test_run_equals_the_stages_one_by_one(spark, folder, planted):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    packed = corpus_pipeline.run(spark, folder).collect()
    check(packed, left, Tokenizer.from_file(packing.tokenizer_path(None)), 2048, 64, 2048)


def test_decontamination_agrees_with_plain_search(spark, folder, planted):
    rows, items, _, case = planted
    found = queries.QUERIES["op2_decontamination"](spark, folder).collect()
    plain = {(i, k) for i, t, *_ in rows if t for k, x in enumerate(items) if decontam.normal(x) in decontam.normal(t)}
    assert {(r["doc_id"], r["item_id"]) for r in found} == plain and {i for i, _ in plain} == case["leaks"]


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_runs_side_by_side_delete_only_their_own_tables(spark):
    """Two threads with open scratch() blocks: the first to end leaves the other's table alone."""
    import threading

    from rowparity.llm import common

    saved_one, may_end, found = threading.Event(), threading.Event(), {}

    def other():
        with common.scratch(spark):
            found["table"], found["path"] = common.saved_at(spark.range(5))
            saved_one.set()
            may_end.wait(60)
            found["rows"] = found["table"].count()

    thread = threading.Thread(target=other)
    with common.scratch(spark) as mine:
        thread.start()
        assert saved_one.wait(60)
        assert found["path"] not in mine
    may_end.set()
    thread.join()
    assert found["rows"] == 5 and not common.exists(spark, found["path"])


def test_clashing_columns_go_through_all_stages(spark, documents):
    """Extra columns named like the operators' own reach the packing stage unchanged."""
    import corpus_pipeline

    text = lambda k: " ".join(f"word{(k * 7 + j * 3) % 50} the of and {k}" for j in range(30))
    docs = documents([(k, text(k), "en") for k in range(12)] + [(20, text(3), "en"), (21, "password = abcdefghij12345 " + text(4), "en")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == before, name
    kept = docs.collect()
    assert kept and all(r["blob"] == r["role"] == r["block"] == "-" for r in kept)
    assert 20 not in {r["doc_id"] for r in kept} and not any("abcdefghij12345" in r["text"] for r in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(kept)
