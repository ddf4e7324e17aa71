"""Dialogues: worked turns, a restart in mid-stream against the batch fold, and parts that are forgotten."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import conversation as c

ROWS = [
    # conv, turn, text, positive, negative, question, suggestions
    (1, 1, "I have fever", ["E_91"], [], "E_201", []), (1, 2, "yes", [], [], "E_55", []), (1, 3, "No, not at all.", [], [], None, []), (1, 4, "yes", ["E_9"], [], None, []),
    (2, 1, "something in my throat", [], [], None, ["E_97", "E_98"]), (2, 2, "no issues related to throat", ["E_97"], [], None, []), (2, 3, "hm", [], [], None, ["E_97", "E_5"]), (2, 4, "a cough", ["E_201"], [], "E_1", []), (2, 5, "I do not have any E_1 or so at all", [], ["E_1"], "E_1", []),
    (3, 1, "   ", ["E_3"], [], "E_4", []), (3, 2, None, [], [], None, []), (3, 3, "fever, no: no fever", ["E_91"], ["E_91"], None, []),
]


def messages(spark, rows):
    said = spark.createDataFrame(rows, "conv long, turn long, text string, positive array<string>, negative array<string>, question string, suggestions array<string>")
    return said.select("conv", "turn", c.short_answer(F.col("text")).alias("answer"), c.rejects(F.col("text")).alias("rejected"), "positive", "negative", "question", "suggestions", (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))


@pytest.fixture
def stateful(spark):
    for k, v in c.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in c.STATE_STORE:
        spark.conf.unset(k)


def came_to(frame):
    return {r.conv: tuple(r)[1:] for r in frame.collect()}


def test_turns(spark):
    got = came_to(c.dialogues_of(messages(spark, ROWS)))
    assert got[1] == (["E_201", "E_9", "E_91"], ["E_55"], ["E_201", "E_55"], [], [], None, 4)
    assert got[2] == (["E_201"], ["E_1"], ["E_1"], [], ["E_97", "E_98"], None, 5)
    assert got[3] == ([], ["E_91"], [], [], [], None, 1)


@pytest.mark.parametrize("text, answer, rejected", [
    ("Yes, I do!", "yes", False), ("yeah it hurts a lot today", "yes", False), ("No.", "no", True), ("I don't", "no", False), ("not really", "no", True), ("no but I do have a bad fever", None, False), ("none of these", None, True), ("", None, False), (None, None, False), ("nobody", None, False)])
def test_short_answers(spark, text, answer, rejected):
    row = spark.createDataFrame([(text,)], "t string").select(c.short_answer(F.col("t")).alias("a"), c.rejects(F.col("t")).alias("r")).first()
    assert (row.a, row.r) == (answer, rejected)


def run(spark, folder, ttl=None):
    """Takes what has come since the last run, and ends."""
    stream = spark.readStream.schema(c.MESSAGES).parquet(f"{folder}/in")
    query = c.dialogues(stream, ttl).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    seen = {}
    query.foreachBatch(lambda frame, n: seen.update(came_to(frame))).start().awaitTermination(120)
    return seen


def test_a_restart_goes_on_where_it_was(spark, stateful, tmp_path):
    rows = messages(spark, ROWS)
    last = {}
    for part in ("turn <= 1", "turn = 2", "turn > 2"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        last |= run(spark, tmp_path)  # a new query each time, from the checkpoint
    assert last == came_to(c.dialogues_of(rows))


def test_parts_are_forgotten(spark, stateful, tmp_path):
    import time

    rows = messages(spark, ROWS)
    rows.where("conv = 1 AND turn = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path, 1000)[1][5] == "E_201"
    time.sleep(1.5)
    rows.where("conv = 1 AND turn = 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path, 1000)[1] == ([], [], ["E_55"], [], [], "E_55", 1)  # "yes" has no question left to answer
