"""Whole evaluations: a prediction table in, every metric that fits it out.

The functions run jobs: they write the table once below the shared folder, look at its shape, and
pass over the written copy for each group of metrics.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators import classification as M
from quillmill.operators import generation as G
from quillmill.operators.detect import tag_task_subtype
from quillmill.session import materialize

#: The text metrics of each kind of task, beside exact match and token F1.
OVERLAP_METRICS = {
    "summarization": ("rouge1", "rouge2", "rougeL"),
    "generative_qa": ("rouge1", "rouge2", "rougeL"),
    "translation": ("bleu",),
    "classification": (),
}


@dataclass(frozen=True)
class Evaluation:
    """``metrics(metric, value)`` and, unless ``skipped`` says why not, the tables behind it.

    ``matrix`` is the confusion matrix, or for multilabel tables the two-by-two cells of each label;
    ``areas`` and ``curves`` have a row, or the curve points, per class and for the pooled ``micro``.
    """

    task_type: str | None
    num_classes: int | None
    skipped: str | None
    metrics: DataFrame
    per_class: DataFrame | None = None
    matrix: DataFrame | None = None
    areas: DataFrame | None = None
    curves: DataFrame | None = None


def _long(row: DataFrame) -> DataFrame:
    """The columns of a one-row table as ``(metric, value)``; nulls are left out."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]
    return row.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def _stacked(rows: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, map(_long, rows))


def _named(df: DataFrame, labels: Sequence[str] | None) -> DataFrame:
    given = F.get(F.array(*[F.lit(n) for n in labels]), F.col("label")) if labels else F.lit(None).cast("string")
    return df.withColumn("name", F.coalesce(given, F.concat(F.lit("class_"), F.col("label").cast("string"))))


def evaluate_classification(
    df: DataFrame,
    y: str = "y",
    scores: str = "scores",
    kind: str = "auto",
    threshold: float = 0.5,
    labels: Sequence[str] | None = None,
) -> Evaluation:
    """Binary, multiclass or multilabel metrics, as the shapes of ``y`` and ``scores`` say.

    ``kind`` is ``auto``, ``probabilities`` or ``labels`` (``scores`` are already decided; arrays of
    single-label tables are always scores). Areas need scores: binary tables get ROC and PR area
    of class 1, multiclass ones one-vs-rest ROC areas with their mean and the pooled one, multilabel
    ones the means over labels. Top-5 accuracy needs five classes. Rows without truth or scores do
    not count; classes that hold no example, or nothing else, have no area.
    """
    held = materialize(df.select(F.col(y).alias("y"), F.col(scores).alias("scores")), "evaluated")
    status = M.metric_status(held).first()
    task, classes, skipped = status["task_type"], status["num_classes"], status["skipped"]
    size = held.select(F.count("y").alias("num_samples"))
    if skipped:
        return Evaluation(task, classes, skipped, _long(size))
    held = held.where(F.col("y").isNotNull() & F.col("scores").isNotNull())
    arrays = held.schema["scores"].dataType.typeName() == "array"
    if labels and not arrays:
        classes = max(2, len(labels))
        task = "binary" if classes == 2 else "multiclass"
    decided = kind == "labels" and (task == "multilabel" or not arrays)
    multilabel = task == "multilabel"
    kind = "auto" if kind == "labels" and not decided else kind
    scored = held if decided else M.normalize_scores(held, kind=kind, multilabel=multilabel, stored=True)
    guessed = M.predict_labels(scored, kind="labels" if decided else kind, threshold=threshold, multilabel=multilabel)
    if multilabel:
        report = materialize(M.multilabel_report(M.multilabel_counts(guessed)), "per-label")
        rows, matrix = [size, M.accuracy(guessed), M.multilabel_summary(report)], report.select("label", "tn", "fp", "fn", "tp")
        areas = None
        if not decided:
            areas = materialize(M.multilabel_auc(scored), "areas")
            rows.append(areas.agg(F.avg("roc_auc").alias("roc_auc"), F.avg("pr_auc").alias("pr_auc")))
        return Evaluation(task, classes, None, _stacked(rows), _named(report, labels), matrix, areas)

    matrix = materialize(M.confusion_matrix(guessed, classes, outside=True), "confusion-matrix")
    report = M.per_class_report(matrix)
    rows = [size, M.accuracy(guessed), M.averaged_prf(report, classes)]
    if arrays and classes >= 5:
        rows.append(M.top_k_accuracy(scored))
    areas = curves = None
    if not decided and (classes == 2 or arrays):
        cumulated = M.curve_counts(_single_label_counts(scored, classes, arrays))
        areas = materialize(M.curve_areas(cumulated), "areas")
        curves = M.roc_curve(cumulated)
        pooled = F.col("label") == "micro"
        if classes == 2:
            rows.append(areas.agg(F.max("roc_auc").alias("roc_auc"), F.max("pr_auc").alias("pr_auc")))
        else:
            rows.append(
                areas.agg(
                    F.avg(F.when(~pooled, F.col("roc_auc"))).alias("roc_auc"),
                    F.max(F.when(pooled, F.col("roc_auc"))).alias("roc_auc_micro"),
                )
            )
    return Evaluation(task, classes, None, _stacked(rows), _named(report, labels), matrix, areas, curves)


def _single_label_counts(scored: DataFrame, classes: int, arrays: bool) -> DataFrame:
    """Counts per score of class 1, or of every class and of all cells pooled under ``micro``."""
    if classes == 2:
        score = F.get("scores", F.lit(1)) if arrays else F.col("scores").cast("double")
        single = scored.select(F.lit("1").alias("label"), score.alias("score"), (F.col("y") == 1).alias("hit"))
        return M.score_counts(single, "label", "score", F.col("hit"))
    cells = M.one_vs_rest(scored).withColumn("label", F.col("label").cast("string"))
    counts = materialize(M.score_counts(cells, "label", "score", F.col("hit")), "class-counts")
    pooled = counts.groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return counts.unionByName(pooled.withColumn("label", F.lit("micro")))


def evaluate_generation(
    df: DataFrame,
    prediction: str = "prediction",
    reference: str = "reference",
    goal: str = "",
    subtype: str | None = None,
) -> DataFrame:
    """``(metric, value, skipped)`` over all pairs of generated and reference texts.

    Exact match and token F1 always; ROUGE for summaries and questions, BLEU for translations.
    ``subtype`` is read from ``goal`` if it is not given. A metric that does not apply has a null
    value and the reason. Texts that are null do not make a pair.
    """
    spark = df.sparkSession
    if subtype is None:
        subtype = spark.range(1).select(tag_task_subtype(F.lit(goal)).alias("t")).first()["t"]
    names = ["exact_match", "token_f1", "rouge1", "rouge2", "rougeL", "bleu"]

    def skips(reasons: dict[str, str]) -> DataFrame:
        return spark.createDataFrame([(m, None, why) for m, why in reasons.items()], "metric string, value double, skipped string")

    if prediction not in df.columns or reference not in df.columns:
        return skips(dict.fromkeys(names, "missing_references_or_generations"))
    pairs = df.select(F.col(prediction).alias("prediction"), F.col(reference).alias("reference"))
    pairs = materialize(pairs.where(F.col("prediction").isNotNull() & F.col("reference").isNotNull()), "generations")
    if pairs.isEmpty():
        return skips(dict.fromkeys(names, "empty_generation_sample"))
    means: list[Column] = [
        F.count(F.lit(1)).alias("generation_sample_size"),
        F.avg(G.exact_match(F.col("prediction"), F.col("reference"))).alias("exact_match"),
        F.avg(G.token_f1(F.col("prediction"), F.col("reference"))).alias("token_f1"),
    ]
    wanted = OVERLAP_METRICS[subtype]
    rows = [pairs.agg(*means)]
    if "rouge1" in wanted:
        rows.append(G.rouge_scores(pairs).agg(*[F.round(F.avg(m), 4).alias(m) for m in wanted]))
    if "bleu" in wanted:
        rows.append(G.corpus_bleu(pairs).select(F.round("bleu", 2).alias("bleu")))
    found = _stacked(rows).withColumn("skipped", F.lit(None).cast("string"))
    left_out = {m: f"not_for_{subtype}" for m in names[2:] if m not in wanted}
    return found.unionByName(skips(left_out)) if left_out else found
