"""Column roles, task kind and text task subtype."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names by role, file classes, and the words that decide a task.
PROMPT_NAMES = ["instruction", "question", "query", "prompt", "input", "text", "context", "document"]
RESPONSE_NAMES = ["output", "answer", "response", "target", "completion", "label"]
TEXT_NAMES = ["text", "context", "document", "content", "body"]
IMAGE_NAMES = ["image", "image_path", "path", "file", "filename"]
CLASS_NAMES = ["label", "class", "category", "target"]
TEXT_SUFFIXES = ["txt", "md", "rst"]
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "bmp", "gif", "webp"]
IMAGE_GOAL = ["image", "photo", "picture", "classify", "classification", "defect"]
SUBTYPE_WORDS = [
    ("translation", ["translat", "tradui", "traduire"]),
    ("summarization", ["summar", "résumé", "abstract", "condensed"]),
    ("classification", ["classif", "sentiment", "categor", "label", "intent"]),
]


def find_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The column for a role: an exact name in role order, else the first that contains one."""
    tidy = {c.lower().strip(): c for c in columns}
    exact = next((tidy[n] for n in names if n in tidy), None)
    return exact or next((c for low, c in tidy.items() if any(n in low for n in names)), None)


def suffix_of(path: Column) -> Column:
    """Lower-case file suffix without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))


def detect_task(
    inventory: DataFrame,
    dataset: str = "dataset",
    container: str = "container",
    member: str = "path",
    user_task: str = "user_task",
    goal: str = "goal",
) -> DataFrame:
    """``text_qa`` or ``image_classification`` for every dataset of a file inventory at once.

    ``container`` is dir, zip, csv or another suffix. A goal word such as "classify" sends any
    zip, csv or directory to the image task, even a table of texts.
    """
    kind = suffix_of(F.col(member))
    counted = inventory.groupBy(dataset).agg(
        F.max(F.col(container)).alias("_container"),
        F.max(F.col(user_task)).alias("_task"),
        F.max(F.col(goal)).alias("_goal"),
        F.count_if(kind.isin(IMAGE_SUFFIXES)).alias("images"),
        F.count_if(kind.isin(TEXT_SUFFIXES)).alias("texts"),
    )
    asks_for_images = F.lower(F.coalesce("_goal", F.lit(""))).rlike("|".join(IMAGE_GOAL))
    task = (
        F.when(F.coalesce("_task", F.lit("")).isin("", "auto") == False, F.col("_task"))  # noqa: E712
        .when(asks_for_images & F.col("_container").isin("dir", "zip", "csv"), "image_classification")
        .when(
            F.col("_container").isin("dir", "zip")
            & (F.col("images") > F.greatest(F.lit(3), F.col("texts"))),
            "image_classification",
        )
        .otherwise("text_qa")
    )
    return counted.select(dataset, "images", "texts", task.alias("task"))


def tag_task_subtype(goal: Column) -> Column:
    """The kind of text task a goal names; the first rule that matches wins."""
    low = F.lower(F.coalesce(goal, F.lit("")))
    (first, words), *others = SUBTYPE_WORDS
    tagged = F.when(low.rlike("|".join(words)), first)
    for name, words in others:
        tagged = tagged.when(low.rlike("|".join(words)), name)
    return tagged.otherwise("generative_qa")
