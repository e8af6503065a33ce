"""Conversation context, prompts, batch scoring and a trainable head on frozen features."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.arrays import let, softmax
from quillmill.functions.text import clip_text, render_template
from quillmill.operators.ranking import slices_with_carry

# Context limits and prompt texts.
MAX_TURNS, MAX_CONTEXT, MAX_TURN = 6, 2000, 600
CONTEXT_OPENING = "Conversation so far:\n"
CONTEXT_CLOSING = "\n\nUsing the conversation above for context, answer this question:\n"
SYSTEM_PROMPT = (
    "Answer the user's question directly. Output only the answer itself: no greeting, "
    "no introductory phrase (e.g. 'Sure,', 'Great question!', 'Here is the answer:'), "
    "no restating the question, and no closing remarks."
)
CHAT_TEMPLATE = "### Instruction:\n{system}\n\n{question}\n\n### Response:\n"


def recent_turns(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    max_turns: int = MAX_TURNS,
    max_context: int = MAX_CONTEXT,
    max_turn: int = MAX_TURN,
    width: int = 100_000,
) -> DataFrame:
    """The context of every user turn: ``history``, an array of (role, content) before it.

    Only non-empty user and assistant turns count; each is clipped, the last ``max_turns`` are
    taken, and the oldest are dropped until the rest fits ``max_context``. Conversations are cut
    into slices of ``width`` turns that carry over the few turns they look back on, so a
    conversation of any length is spread over many tasks. Answers are clipped before they are
    shuffled.
    """
    said = turns.where(F.col(role).isin("user", "assistant") & (F.col(text) != "")).select(
        conv,
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.when(F.col(role) == "user", F.col(text)).alias("said"),
        clip_text(F.col(text), max_turn).alias("clipped"),
    )
    everything = slices_with_carry(said, conv, "turn", max_turns, width)
    frame = Window.partitionBy(conv, "_slice").orderBy("turn").rowsBetween(-max_turns, -1)
    earlier = F.collect_list(
        F.struct(F.col("role"), F.col("clipped").alias("content"))
    ).over(frame)
    state = "struct<kept:int,used:int,full:boolean>"

    def fit(history: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            used = acc["used"] + F.length(t["content"])
            ends = acc["full"] | (used > max_context)
            return F.when(ends, F.struct(acc["kept"].alias("kept"), acc["used"].alias("used"), F.lit(True).alias("full")).cast(state)).otherwise(
                F.struct((acc["kept"] + 1).alias("kept"), used.alias("used"), F.lit(False).alias("full")).cast(state)
            )

        start = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full")).cast(state)
        kept = F.aggregate(F.reverse(history), start, step, lambda acc: acc["kept"])
        return let(
            kept,
            lambda k: F.when(k > 0, F.slice(history, F.greatest(F.size(history) - k + 1, F.lit(1)), k)).otherwise(
                F.slice(history, F.lit(1), F.lit(0))
            ),
        )

    asked = everything.withColumn("_history", earlier).where(
        (F.col("role") == "user") & ~F.col("_carried")
    )
    return asked.select(
        conv,
        F.col("turn").alias(turn),
        F.col("said").alias("prompt"),
        let(F.col("_history"), fit).alias("history"),
    )


def question_block(prompt: Column, history: Column) -> Column:
    """The prompt alone, or the transcript of the history followed by the prompt."""
    lines = F.transform(
        history,
        lambda t: F.concat(
            F.when(t["role"] == "user", "User: ").otherwise("Assistant: "), t["content"]
        ),
    )
    return F.when(F.coalesce(F.size(history), F.lit(0)) <= 0, prompt).otherwise(
        F.concat(F.lit(CONTEXT_OPENING), F.array_join(lines, "\n"), F.lit(CONTEXT_CLOSING), prompt)
    )


def chat_prompt(block: Column, template: str = CHAT_TEMPLATE, system: str = SYSTEM_PROMPT) -> Column:
    """The text given to a model; ``template`` may use ``{system}`` and ``{question}``."""
    return render_template(template, system=F.lit(system), question=block)


def top_k_labels(
    df: DataFrame, labels: Sequence[str], k: int = 5, scores: str = "scores", keep: Sequence[str] = ()
) -> DataFrame:
    """The ``k`` best labels of each row with softmax scores; ties go to the lower class id."""
    best = F.slice(
        F.sort_array(
            F.transform(
                softmax(F.col(scores)),
                lambda p, i: F.struct((-p).alias("order"), i.alias("class_id"), p.alias("score")),
            )
        ),
        F.lit(1),
        F.greatest(F.lit(1), F.least(F.lit(k), F.size(scores))),
    )
    names = F.array(*[F.lit(name) for name in labels])
    ranked = df.select(*keep, F.posexplode(best).alias("rank", "b"))
    return ranked.select(
        *keep,
        (F.col("rank") + 1).alias("rank"),
        F.coalesce(F.get(names, F.col("b.class_id")), F.col("b.class_id").cast("string")).alias("label"),
        F.col("b.score").alias("score"),
    )


def score_table(
    df: DataFrame,
    load_predictor: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Run a model over a table; ``load_predictor`` is called once per task.

    The predictor maps one Arrow batch of the input columns to a frame with ``schema``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load_predictor()
        for batch in batches:
            yield predict(batch)

    return df.mapInPandas(run, schema)


def centroid_head(
    train: DataFrame, features: str = "features", label: str = "label", key: str = "vec_id"
) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    """A head in closed form for :func:`score_table`: each class is the mean of its examples, and a
    row belongs to the nearest one, among equals to the lowest label.

    One row per class and dimension comes to the driver. The predictor returns ``key``,
    ``predicted`` and ``distance``.
    """
    cells = train.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.posexplode(features).alias("i", "v"))
    means = cells.groupBy("y", "i").agg(F.avg("v").alias("v")).toPandas().pivot(index="y", columns="i", values="v")
    labels, centres = means.index.to_numpy(), means.to_numpy()

    def load() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def predict(batch: pd.DataFrame) -> pd.DataFrame:
            rows = np.stack(batch[features].to_numpy())
            far = np.stack([np.sqrt(((rows - centre) ** 2).sum(axis=1)) for centre in centres], axis=1)
            return pd.DataFrame({key: batch[key], "predicted": labels[far.argmin(axis=1)], "distance": far.min(axis=1)})

        return predict

    return load


def train_head(
    train: DataFrame, features: str = "features", label: str = "label", max_iter: int = 20, reg: float = 0.01
):
    """Fit a classifier head on frozen features; returns the fitted Spark ML model.

    The optimiser is seeded by the data alone, so a fit is repeatable.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = train.select(
        array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label")
    )
    return LogisticRegression(maxIter=max_iter, regParam=reg).fit(rows)


def apply_head(model, df: DataFrame, features: str = "features") -> DataFrame:
    """Add ``scores``, the class probabilities of a fitted head."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.withColumn("_vector", array_to_vector(F.col(features)))
    scored = model.setFeaturesCol("_vector").transform(ready)
    return scored.withColumn("scores", vector_to_array("probability")).drop(
        "_vector", "rawPrediction", "probability", "prediction"
    )
