import random

from pyspark.sql import functions as F

from inkwell.llm.queries import QUERIES
from inkwell.llm.quotation_linking import conversations, parse

SCHEMA = "conv_id long, turn long, role string, text string, digest int, body int"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def test_parse():
    assert parse("") == ("", []) and parse("> a\n>b\nown\n>> deep\n> up") == ("own", [(1, "a\nb"), (2, "deep"), (1, "up")])
    assert parse("hi\nOn Monday A wrote:\n> q\n\n-> no quote") == ("hi\n\n-> no quote", [(1, "q")])
    assert parse("> \n>\nx") == ("x", []) and parse("a\r\n> > b\r\nc") == ("a\nc", [(2, "b")])


def test_replies_follow_quotes_then_order(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "bot", "> Hello there\n> How are you?\nFine, and thank you."), (1, 2, "user", "A wrote:\n> Fine, and thank you.\n>> How are you?\nok"),
            (1, 3, "bot", "> hello   THERE\nstill"), (2, 0, "user", "> Fine, and thank you.\nelsewhere"), (2, 1, None, None), (2, 2, "user", ""), (2, 2, "user", "dup"),
            (None, 1, "x", "lost"), (3, None, None, "> Fine, and thank you."), (3, 5, "u", "> never said")]
    got = {(r.conv_id, r.turn, r.body): r for r in conversations(made(spark, rows)).collect()}
    link = {k[:2]: (r.reply_conv, r.reply_turn, r.linked_by, r.root_conv, r.root_turn) for k, r in got.items()}
    assert len(got) == len(rows)
    assert link[1, 0] == (None, None, None, 1, 0) and link[1, 1] == (1, 0, "quote", 1, 0) and link[1, 2] == (1, 1, "quote", 1, 0)
    assert link[1, 3] == (1, 0, "quote", 1, 0) and link[2, 0] == (1, 1, "quote", 1, 0) and link[2, 1] == (2, 0, "order", 1, 0)
    assert link[2, 2] == (2, 1, "order", 1, 0) and link[None, 1] == (None, None, None, None, 1) and link[3, 5] == (None, None, None, 3, 5)
    assert sorted(r.position for r in got.values() if r.conv_id == 2) == [1, 2, 3, 4]
    assert got[1, 1, "Fine, and thank you."].n_quotes == 1 and got[1, 2, "ok"].max_depth == 2
    assert conversations(made(spark, [])).count() == 0


def test_latest_earlier_message_wins_and_later_ones_never(spark):
    rows = [(7, 0, "a", "same"), (7, 1, "a", "same"), (7, 2, "b", "> same\nx"), (7, 3, "a", "same"), (8, 0, "b", "> y only later"), (9, 0, "a", "y only later")]
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in conversations(made(spark, rows)).collect()}
    assert got[7, 2] == (7, 1) and got[8, 0] == (None, None)


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(2)
    turns = rng.sample(range(10_000), 600)
    rows = conversations(made(spark, [(5, t, "u", f"m{t}") for t in turns] + [(6, 1, "u", "z")]), rows_per_part=40).where("conv_id = 5").collect()
    order = sorted(turns)
    assert sorted((r.turn, r.position, r.reply_turn, r.root_turn) for r in rows) == [(t, i + 1, order[i - 1] if i else None, order[0]) for i, t in enumerate(order)]


def test_query_and_round_trip_through_quotes(spark, small):
    """Quoting every message in the next one and linking again gives back the messages, each linked to the one before."""
    plain = spark.read.parquet(f"{small}/conversations.parquet")
    rows = {(r.conv_id, r.turn): r for r in QUERIES["op3_quotation_linking"](spark, small).collect()}
    texts = {(r.conv_id, r.turn): r for r in plain.collect()}
    before = plain.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_said"))
    quoted = plain.join(before, ["conv_id", "turn"], "left").withColumn("text", F.when(F.col("_said").isNull(), F.col("text")).otherwise(
        F.concat(F.lit("> "), F.regexp_replace("_said", "\n", "\n> "), F.lit("\n"), F.col("text"))))
    again = {(r.conv_id, r.turn): r for r in conversations(quoted).collect()}
    assert set(rows) == set(texts) == set(again)
    said = {}
    for (conv, turn), r in sorted(again.items()):
        assert r.body == texts[conv, turn].text.strip() == rows[conv, turn].body and (r.root_conv, r.position) == (rows[conv, turn].root_conv, rows[conv, turn].position)
        if (conv, turn - 1) in texts:
            assert r.linked_by == "quote" and r.reply_conv == conv and said[conv, r.reply_turn] == texts[conv, turn - 1].text
            assert rows[conv, turn].linked_by == "order" and rows[conv, turn].reply_turn == turn - 1
        said[conv, turn] = texts[conv, turn].text


def test_commonplaces_do_not_join_conversations(spark):
    rows = [(1, 0, "u", "yes"), (1, 1, "a", "a longer sentence of its own\nyes"), (2, 0, "u", "> yes\nno"), (2, 1, "a", "> a longer sentence of its own\n> yes\nso"), (2, 2, "u", "> a longer sentence of its own\nand")]
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn, r.linked_by) for r in conversations(made(spark, rows)).collect()}
    assert got[2, 0] == (None, None, None) and got[2, 1] == (1, 1, "quote") and got[2, 2] == (1, 1, "quote")
