import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowparity.llm import chat

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "user", "again"), (1, 3, "assistant", "</s>[INST] ok [/INST]"), (1, 4, "assistant", "two"),
    (2, 0, "assistant", "\\[INST]\\\\<s>"), (2, 1, "assistant", None), (2, 1, "assistant", "[\\SEP][SEP]\n<<s>"), (2, 3, None, "x"), (2, None, "sys[INST]<s>", ""),
    (3, 5, "user", "tie"), (3, 5, "user", "tie"), (3, 5, "assistant", "same turn"), (None, 0, "user", "nobody"), (4, 0, "assistant", "long " * 20_000), (5, 0, "user", ""),
]
SCHEMA = "conv_id long, turn long, role string, text string, turns string, blocks string, formatted string, first string, t string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "-", "-", "-", "-", "-") for r in rows], SCHEMA)


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    made = chat.format_conversations(frame(spark, ROWS))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digest(made).collect()}
    assert got == expected(ROWS)


def test_adjacent_turns_of_a_role_are_one_block(spark):
    text = chat.format_conversations(frame(spark, ROWS)).where("conv_id = 1").first()["formatted"]
    assert text == r"<s>system[INST]be kind[/INST]</s><s>user[INST]hi[SEP]again[/INST]</s><s>assistant[INST]<\/s>[\INST] ok [\/INST][SEP]two[/INST]</s>"


def test_loss_spans_cover_the_assistants_blocks(spark):
    r = chat.format_conversations(frame(spark, ROWS)).where("conv_id = 1").first()
    blocks = r["formatted"].split(chat.CLOSE)
    assert [blocks[s["block"]][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == [r"<\/s>[\INST] ok [\/INST][SEP]two"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*chat.CONTROL, "\\", "[", "<", "/", "s>", "SEP]", "é", "\n", "a"]), max_size=8).map("".join), min_size=1, max_size=20))
def test_escaping_is_reversible_and_leaves_no_control_string(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


def test_many_turns_and_an_empty_table(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(20_000)]
    assert chat.digest(chat.format_conversations(frame(spark, rows))).first()[1:5] == expected(rows)[1]
    none = chat.digest(chat.format_conversations(frame(spark, rows).where("false")))
    assert none.count() == 0
    plan = none._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
