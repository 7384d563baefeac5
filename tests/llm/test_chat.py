import hashlib

from pyspark.sql import functions as F

from tallymill.llm import chat
from tallymill.llm.queries import chat_records

WILD = [
    "", "\\", "<|", "<\\|", "<\\\\|", "</s>[INST] ok [/INST]", "<", "[", "a<", "|end|>", "<|end|>", "<\\<|end|>",
    "[\\INST]", "<<SYS>>x<</SYS>>", "<<|says|>", "\\<|start|>\\", "línea\n😀 <s>", "[[INST]]", "$1\\$2",
]


def test_escaping_is_reversible_and_complete(spark):
    texts = WILD + [a + b for a in WILD for b in WILD] + ["\\" * n + "<|" * n for n in range(9)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u"))
    for r in rows.collect():
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROL)


def test_layouts_come_back_as_turns(spark):
    rows = [
        (1, [("user", "hi"), ("assistant", "<|end|>"), (None, None)], None, None, None, None, None, None, None),
        (2, None, [("human", "a"), ("gpt", "b"), ("tool", "c")], None, None, None, None, None, None),
        (3, None, None, "be brief", "p", "c", None, None, None),
        (4, None, None, None, "p", "c", None, None, None),
        (5, None, None, None, None, None, "do", "with", "done"),
        (6, None, None, None, None, None, "do", None, "done"),
        (7, None, None, None, "p", None, None, None, None), (8, *[None] * 8), (9, [], *[None] * 7),
    ]
    df = spark.createDataFrame(
        rows, "id int, messages array<struct<role:string,content:string>>, "
        "conversations array<struct<from:string,value:string>>, system string, prompt string, "
        "completion string, instruction string, input string, output string",
    )
    out = chat.format_chats(df, ["id"]).withColumn("turns", chat.read_chats(F.col("formatted")))
    found = {}
    for r in out.collect():
        found[r.id] = (r.layout, r.turns and [tuple(t) for t in r.turns])
        for t, s in zip(r.turns or [], r.segments or []):
            assert s.loss == (t.role == "assistant")
            assert r.formatted[s.start : s.end].replace("<\\|", "<|") == t.text
    assert found == {
        1: ("messages", [("user", "hi"), ("assistant", "<|end|>"), ("", "")]),
        2: ("from_value", [("user", "a"), ("assistant", "b"), ("tool", "c")]),
        3: ("system_prompt", [("system", "be brief"), ("user", "p"), ("assistant", "c")]),
        4: ("prompt", [("user", "p"), ("assistant", "c")]),
        5: ("instruction_input", [("user", "do\n\nwith"), ("assistant", "done")]),
        6: ("instruction", [("user", "do"), ("assistant", "done")]),
        7: (None, None), 8: (None, None), 9: ("messages", []),
    }
    assert chat.format_chats(df.limit(0), ["id"]).count() == 0


def test_records_of_odd_conversations(spark):
    rows = [(1, 2, "assistant", None), (1, 1, "user", "x" * 200000), (2, 1, None, "a"), (2, 1, None, "a"),
            (3, None, "user", "n"), (3, 0, "assistant", "m"), (3, 0, "assistant", "k"), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_chats(chat_records(df), ["conv_id"])
    made = made.withColumn("turns", chat.read_chats(F.col("formatted")))
    made = made.withColumn("loss", chat.loss_text(F.col("turns"), F.col("segments")))
    found = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in made.collect()}
    assert found == {
        1: ([("user", "x" * 200000), ("assistant", "")], ""), 2: ([("", "a"), ("", "a")], ""),
        3: ([("user", "n"), ("assistant", "k"), ("assistant", "m")], "km"), None: ([("user", "q")], ""),
    }
    assert hashlib.sha256(b"km").hexdigest() == made.where("conv_id = 3").select(F.sha2("loss", 256)).first()[0]
