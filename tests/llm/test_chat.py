from pyspark.sql import functions as F

from quillsieve.llm.chat import as_events, escape, fold, read_loss, read_turns, render, unescape

TEXTS = ["</s>[INST] ok [/INST]", "\\", "\\\\l<|x|>", "a\\", "<<SYS>><</SYS>><s>", "\\b[INST]\\p|>", "", "<", "|", "<</s>\n", "</s>\n<|user|>\n", "日本\n\n", None]


def test_escape_is_reversible_and_hides_marks(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(m in r.e for m in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_round_trip(spark):
    rows = [(c, k, ["user", "assistant", "sys|>tem\n", None][(k + c) % 4], t) for c in range(4) for k, t in enumerate(TEXTS)]
    chats = render(fold(as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), chunk=3)))
    for r in chats.select("conversation", "formatted", "mask", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("mask")).alias("loss")).collect():
        own = [x for x in rows if x[0] == r.conversation]
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == [x[3] or "" for x in own if x[2] == "assistant"]


def test_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "delta", "user", "Hel"), (1, 1, 3, "delta", None, "lo"), (1, 2, 4, "delta", "assistant", "bad ans"), (1, 2, 5, "delta", None, "wer"),
        (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "good"), (1, 2, 8, None, None, "!"), (1, 1, 9, "edit", None, "Hi"), (1, 1, 10, "delta", None, "?"),
        (1, 3, 11, "delta", "user", "x"), (1, 3, 12, "regenerate", None, "ignored"), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(log, "conversation long, message long, seq long, kind string, role string, text string").repartition(3)
    got = {(r.conversation, r.message): (r.role, r.text) for r in fold(df).collect()}
    assert got == {(1, 1): ("user", "Hi?"), (1, 2): ("assistant", "good!"), (1, 3): ("user", ""), (None, None): (None, "")}
    assert fold(df.limit(0)).count() == 0 and render(fold(df.limit(0))).count() == 0


def test_revised_logs_fold_to_the_same_messages(spark):
    rows = [(c, k, ["user", "assistant"][k % 2], t) for c in range(3) for k, t in enumerate([*TEXTS, "long " * 6_000])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = as_events(df, chunk=100, revised=True)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"delta", "edit", "regenerate"}
    assert fold(log).drop("at").exceptAll(fold(as_events(df)).drop("at")).count() == 0 and fold(log).count() == len(rows)


def test_repeated_rows_are_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 5)] * 2, "conv_id long, turn long, role string, text string, message int")
    assert [len(r.t) for r in render(fold(as_events(df))).select(read_turns(F.col("formatted")).alias("t")).collect()] == [2]


def test_repeated_and_tied_edits(spark):
    log = [
        (1, 1, 1, "delta", "user", "old"), (1, 1, 2, "edit", None, "NEW"), (1, 1, 2, "edit", None, "NEW"), (2, 1, 1, "edit", "user", "A"), (2, 1, 1, "edit", "user", "B"),
        (3, 1, 1, "edit", "user", "kept?"), (3, 1, 1, "regenerate", "user", None), (3, 1, 2, "delta", None, "fresh"), (4, 1, 1, "delta", "user", "x"), (4, 1, 1, "delta", "user", "x"), (4, 1, 1, "edit", "user", "y"), (5, 1, None, "edit", "user", "z"), (5, 1, None, None, "user", "early"),
    ]
    df = spark.createDataFrame([(*e, k) for k, e in enumerate(log)], "conversation long, message long, seq long, kind string, role string, text string, last int").repartition(3)
    assert {r.conversation: r.text for r in fold(df).collect()} == {1: "NEW", 2: "B", 3: "fresh", 4: "y", 5: "z"}
