"""Dialog context, prompts, label ranking, scoring and the training head."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmill.operators import dialog as D

TURNS = "conv_id long, turn long, role string, text string"


def context(turns, upto):
    said = [(r, " ".join(t.split())) for _, n, r, t in turns if n < upto and r in ("user", "assistant") and t]
    clipped = [(r, t if len(t) <= 600 else t[:599].rstrip() + "…") for r, t in said][-6:]
    while clipped and sum(len(t) for _, t in clipped) > 2000:
        clipped.pop(0)
    return clipped


@pytest.mark.parametrize("width", [1, 2, 7, 4096])
def test_recent_turns_in_long_conversations(spark, width):
    rng = random.Random(width)
    turns = []
    for conv, size in ((1, 60), (2, 7), (3, 1), (4, 25)):
        for n in range(size):
            role = rng.choice(["user", "user", "assistant", "system", "User"])
            text = rng.choice(["", "   ", "word " * rng.randrange(200), "x" * rng.choice([5, 599, 600, 601])])
            turns.append((conv, n * (3 if conv == 4 else 1), role, text))
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    got = {(r.conv_id, r.turn): [(t.role, t.content) for t in r.history] for r in D.recent_turns(df, width=width).collect()}
    want = {
        (c, n): context([t for t in turns if t[0] == c], n) for c, n, r, t in turns if r == "user" and t
    }
    assert got == want


def test_budget_forces_three_turns(spark):
    turns = [(1, i, "user", "y" * 600) for i in range(7)]
    got = D.recent_turns(spark.createDataFrame(turns, TURNS)).where("turn = 6").first()
    assert len(got.history) == 3


def test_blocks(spark):
    df = spark.createDataFrame([("q", [("user", "a"), ("assistant", "b")]), ("q", [])], "prompt string, h array<struct<role string, content string>>")
    block = D.question_block(F.col("prompt"), F.col("h"))
    rows = [r[0] for r in df.select(block).collect()]
    assert rows[1] == "q"
    assert rows[0] == (
        "Conversation so far:\nUser: a\nAssistant: b\n\n"
        "Using the conversation above for context, answer this question:\nq"
    )
    prompt = df.select(D.chat_prompt(F.lit("q"))).first()[0]
    assert prompt == f"### Instruction:\n{D.SYSTEM_PROMPT}\n\nq\n\n### Response:\n"


def test_top_labels(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0, 3.0])], "id int, scores array<double>")
    rows = D.top_k_labels(df, ["a", "b"], 2, keep=["id"]).orderBy("rank").collect()
    assert [(r["rank"], r.label) for r in rows] == [(1, "b"), (2, "2")]
    assert rows[0].score == rows[1].score == pytest.approx(0.4683, abs=1e-4)
    assert D.top_k_labels(df, ["a"], 0).count() == 1
    assert D.top_k_labels(df, ["a"], 9).count() == 3


def test_score_table_loads_once_per_task(spark):
    def load():
        seen = []

        def predict(batch):
            seen.append(len(batch))
            return pd.DataFrame({"id": batch["id"], "batches": len(seen)})

        return predict

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        scored = D.score_table(spark.range(0, 50, 1, 1), load, "id long, batches int")
        assert scored.agg(F.max("batches")).first()[0] == 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_head_learns(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(3 * (i % 3), 0.3), rng.gauss(-2 * (i % 3), 0.3)], i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    scored = D.apply_head(D.train_head(df), df)
    best = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    assert scored.agg(F.avg((best == F.col("label")).cast("double"))).first()[0] > 0.95
    assert len(scored.first().scores) == 3
