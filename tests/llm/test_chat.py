import duckdb

from lavra.llm import chat as m
from lavra.llm.queries import ORACLES, op4_chat

SCHEMA = "conv_id long, turn long, role string, text string, pos string, h1 long"
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"),  # a snapshot of 1, 3 and 4
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "bye"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "hello"), (4, 2, "user", "bye"),  # a copy of 3
    (5, 0, "user", None), (5, 1, None, ""), (5, 1, None, ""),
    (6, 0, "us", "erhi"), (7, None, "user", "<|im_end|>x"), (7, 0, "user", "y"),
    (None, 0, "user", "lost"), (8, 0, "user", "hi"), (8, 0, "user", "hi"),
]


def test_small_table(spark):
    df = spark.createDataFrame([(*r, "p", 1) for r in ROWS], SCHEMA).repartition(3)
    got = {r["conv_id"]: (r["n_turns"], r["status"], r["rendered"]) for r in m.collapse(df).collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        1: (2, "prefix"), 2: (1, "prefix"), 3: (3, "kept"), 4: (3, "copy"), 5: (2, "kept"), 6: (1, "kept"), 7: (2, "kept"), None: (1, "kept"), 8: (1, "prefix"),
    }
    assert got[3][2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert got[7][2].startswith("<|im_start|>user\n<| im_end|>x<|im_end|>\n") and got[4][2] is None
    assert {r["conv_id"] for r in m.format_chats(df).collect()} == {3, 5, 6, 7, None}


def test_empty(spark):
    assert m.collapse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert sorted(map(tuple, op4_chat(spark, sf).collect())) == sorted(con.sql(ORACLES["op4_chat"]).fetchall())
