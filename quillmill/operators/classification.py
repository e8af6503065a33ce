"""Classification metrics over prediction tables ``(id, y, scores)``.

Binary and multiclass rows carry an int ``y``; multilabel rows an int array. Scores are one double
per row, or an array with one double per class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.arrays import finite, sigmoid, softmax, sum_of
from quillmill.operators.ranking import running_counts
from quillmill.session import materialize

# The scalar metrics kept for each task.
SCALAR_METRICS = {
    "image": [
        "accuracy", "top_5_accuracy", "precision", "recall", "f1", "macro_f1", "weighted_f1", "roc_auc", "pr_auc",
    ],
    "text": ["token_accuracy"],
}


def _is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


# ---- scores and labels --------------------------------------------------------------------


def normalize_scores(df: DataFrame, scores: str = "scores", kind: str = "auto", multilabel: bool = False, stored: bool = False) -> DataFrame:
    """Turn scores into probabilities.

    ``auto`` looks at the whole table: scores are kept if all lie in [0, 1] and, for arrays, every
    row sums to 1 within 1e-3; otherwise softmax, or sigmoid for single scores and multilabel. The
    row-sum test also applies to multilabel arrays, so pass ``probabilities`` where they are known.
    The table is written first, so that what makes the scores runs once; ``stored`` says that it is a
    stored table already, of which the look only reads the scores.
    """
    if kind == "probabilities":
        return df
    df = df if stored else materialize(df, "scores")
    value = F.col(scores)
    if _is_array(df, scores):
        squashed = F.transform(value, sigmoid) if multilabel else softmax(value)
        in_range = F.forall(value, lambda s: (s >= 0) & (s <= 1))
        plain = in_range & (F.abs(sum_of(value) - 1.0) <= 1e-3 + 1e-5)
    else:
        squashed = sigmoid(value)
        plain = (value >= 0) & (value <= 1)
    already = df.agg(F.bool_and(plain).alias("already")).scalar()
    return df.withColumn(scores, F.when(already, value).otherwise(squashed))


def predict_labels(df: DataFrame, scores: str = "scores", kind: str = "auto", threshold: float = 0.5, multilabel: bool = False) -> DataFrame:
    """Add ``predicted``: the first maximum, or the scores at or above the threshold."""
    value = F.col(scores)
    if kind == "labels":
        dtype = "array<int>" if _is_array(df, scores) else "int"
        return df.withColumn("predicted", value.cast(dtype))
    if not _is_array(df, scores):
        picked = (value >= threshold).cast("int")
    elif multilabel:
        picked = F.transform(value, lambda s: (s >= threshold).cast("int"))
    else:
        picked = (F.array_position(value, F.array_max(value)) - 1).cast("int")
    return df.withColumn("predicted", picked)


def metric_status(df: DataFrame, y: str = "y", scores: str = "scores", by: str | None = None) -> DataFrame:
    """Sample count, task type, class count, and why metrics cannot be computed, if so."""
    keys = [by] if by else []
    y_is_array = _is_array(df, y)
    s_is_array = _is_array(df, scores)
    labels = F.size(y) if y_is_array else F.lit(None).cast("int")
    width = F.size(scores) if s_is_array else F.lit(None).cast("int")
    top_y = F.lit(None).cast("double") if y_is_array else F.col(y).cast("double")
    top_s = F.lit(None).cast("double") if s_is_array else F.col(scores).cast("double")
    seen = df.groupBy(*keys).agg(
        F.count(y).alias("n_y"),
        F.count(scores).alias("n_s"),
        F.max(labels).alias("labels"),
        F.max(width).alias("width"),
        F.greatest(F.max(top_y), F.max(top_s)).alias("top"),
        F.bool_and(F.coalesce(labels == F.coalesce(width, F.lit(1)), F.lit(True))).alias("matched"),
    )
    multilabel = F.coalesce(F.col("labels") > 1, F.lit(False))
    classes = (
        F.when(multilabel, F.col("labels"))
        .when(F.col("width").isNotNull(), F.col("width"))
        .otherwise(F.greatest(F.lit(2), (F.floor("top") + 1).cast("int")))
    )
    skipped = (
        F.when(F.col("n_y") == 0, "empty_targets")
        .when(F.col("n_s") == 0, "empty_predictions")
        .when(multilabel & ~F.col("matched"), "shape_mismatch")
    )
    task = (
        F.when((F.col("n_y") == 0) | (F.col("n_s") == 0), F.lit(None))
        .when(multilabel, "multilabel")
        .when(classes == 2, "binary")
        .otherwise("multiclass")
    )
    return seen.select(
        *keys,
        F.col("n_y").alias("num_samples"),
        task.alias("task_type"),
        F.when(task.isNotNull(), classes).cast("long").alias("num_classes"),
        skipped.alias("skipped"),
    )


# ---- single-label reports -----------------------------------------------------------------


def confusion_matrix(
    df: DataFrame, num_classes: int, y: str = "y", predicted: str = "predicted", outside: bool = False
) -> DataFrame:
    """The full ``num_classes`` by ``num_classes`` matrix as ``(actual, predicted, n)``.

    Zero cells come from a generated grid added before the count; nothing is joined. Rows with a
    label outside 0..num_classes-1 are left out, or with ``outside`` counted under label -1, which
    the reports need: such a row is still a prediction, or an example, of its other label.
    """
    spark = df.sparkSession
    cells = spark.range(0, num_classes * num_classes, 1, 1).select(
        F.floor(F.col("id") / num_classes).cast("int").alias("actual"),
        (F.col("id") % num_classes).cast("int").alias("predicted"),
        F.lit(0).cast("long").alias("n"),
    )
    seen = df.select(
        F.col(y).cast("int").alias("actual"),
        F.col(predicted).cast("int").alias("predicted"),
        F.lit(1).cast("long").alias("n"),
    )
    inside = {c: F.col(c).between(0, num_classes - 1) for c in ("actual", "predicted")}
    if outside:
        seen = seen.withColumns({c: F.when(ok, F.col(c)).otherwise(-1) for c, ok in inside.items()})
    else:
        seen = seen.where(inside["actual"] & inside["predicted"])
    return seen.unionByName(cells).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def _prf(tp: Column, predicted: Column, support: Column) -> list[Column]:
    """Precision, recall and F1 with 0 for a zero denominator."""

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    return [
        ratio(tp, predicted).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, predicted + support).alias("f1"),
    ]


def per_class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1, support and predicted count per class, from a confusion matrix.

    Pass a matrix made with ``outside`` where labels may lie outside the classes.
    """
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed")),
    )
    hit = F.when((F.col("actual") == F.col("predicted")) & (F.col("support") > 0), F.col("n")).otherwise(0)
    sums = (
        matrix.select("actual", "predicted", "n", F.inline(sides))
        .groupBy("label")
        .agg(F.sum(hit).alias("tp"), F.sum("support").alias("support"), F.sum("guessed").alias("predicted"))
    )
    report = sums.select("label", *_prf(F.col("tp"), F.col("predicted"), F.col("support")), "support", "predicted")
    return report.where("label >= 0")


def accuracy(df: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """Share of exact matches; for label arrays the whole array must match."""
    return df.agg(F.avg((F.col(y) == F.col(predicted)).cast("double")).alias("accuracy"))


def averaged_prf(per_class: DataFrame, num_classes: int) -> DataFrame:
    """The summary row: precision, recall, f1, macro_f1, weighted_f1.

    Binary tables report class 1. With more classes precision, recall and f1 average over the
    labels seen as truth or prediction, while macro_f1 and weighted_f1 use every label.
    """
    seen = (F.col("label") == 1) if num_classes == 2 else (F.col("support") + F.col("predicted") > 0)
    return per_class.agg(
        *[F.avg(F.when(seen, F.col(m))).alias(m) for m in ("precision", "recall", "f1")],
        F.avg("f1").alias("macro_f1"),
        F.coalesce(
            F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0)), F.lit(0.0)
        ).alias("weighted_f1"),
    )


def top_k_accuracy(df: DataFrame, k: int = 5, y: str = "y", scores: str = "scores") -> DataFrame:
    """Share of rows whose class is among the ``k`` best; on ties the higher index leads.

    Tables with fewer than five classes give a null.
    """
    own = F.get(scores, F.col(y))
    ahead = F.aggregate(
        F.transform(
            scores,
            lambda s, i: ((s > own) | ((s == own) & (i > F.col(y)))).cast("int"),
        ),
        F.lit(0),
        lambda acc, v: acc + v,
    )
    hit = (ahead < F.least(F.lit(k), F.size(scores))).cast("double")
    return df.agg(
        F.when(F.max(F.size(scores)) >= 5, F.avg(hit)).alias(f"top_{k}_accuracy")
    )


# ---- curves -------------------------------------------------------------------------------


def score_counts(df: DataFrame, label: str, score: str, positive: Column) -> DataFrame:
    """``(label, score, p, n)``: positives and negatives at each distinct score."""
    hit = positive.cast("boolean")
    return df.groupBy(F.col(label).alias("label"), F.col(score).alias("score")).agg(
        F.count_if(hit).alias("p"), F.count_if(~hit).alias("n")
    )


def curve_counts(counts: DataFrame, slice_rows: int = 1_000_000) -> DataFrame:
    """Add true and false positives at each threshold, ``upto_p`` and ``upto_n``.

    The counts are written once: prefix sums pass over them three times, and what leads to them
    (scoring, exploding, the first shuffle) must not run again.
    """
    return running_counts(materialize(counts, "score-counts"), ["label"], "score", ["p", "n"], slice_rows)


def corner_points(cumulated: DataFrame) -> DataFrame:
    """``cumulated`` without the thresholds at which its curve goes straight on: those between two
    others that add positives and negatives in the same steps. The first and last stay.

    A point needs its neighbours only, so beside its own slice it sees the border rows of the others,
    of which there are two per slice and label.
    """
    here = Window.partitionBy("label", "_slice").orderBy(F.desc("score"))
    border = cumulated.withColumns(
        {"_next": F.lead("score").over(here), "_last": F.lag("score").over(here), "_p": F.lead("p").over(here), "_n": F.lead("n").over(here)}
    )
    first = border.where(F.col("_last").isNull()).select("label", "_slice", F.struct("p", "n").alias("step"))
    after = first.select("label", "_slice", F.lead("step").over(Window.partitionBy("label").orderBy("_slice")).alias("_over"))
    joined = border.join(after, ["label", "_slice"])
    inner = F.col("_next").isNotNull()
    p = F.when(inner, F.col("_p")).otherwise(F.col("_over.p"))
    n = F.when(inner, F.col("_n")).otherwise(F.col("_over.n"))
    begins = (F.col("upto_p") == F.col("p")) & (F.col("upto_n") == F.col("n"))
    straight = F.coalesce((F.col("p") == p) & (F.col("n") == n), F.lit(False))
    return joined.where(begins | ~straight).select(*cumulated.columns)


def roc_curve(cumulated: DataFrame) -> DataFrame:
    """Curve points per label: the origin and one point per distinct score.

    Points on a straight line are kept unless ``cumulated`` comes from :func:`corner_points`; the area
    is the same without them. Labels with one class only are left out.
    """
    point = F.struct(
        F.col("score").alias("threshold"),
        (F.col("upto_n") / F.col("total_n")).alias("fpr"),
        (F.col("upto_p") / F.col("total_p")).alias("tpr"),
    )
    two_classes = (F.col("total_p") > 0) & (F.col("total_n") > 0)
    usable = cumulated.where(two_classes)
    origin = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    origins = usable.select("label").distinct().select("label", F.inline(F.array(origin)))
    return usable.select("label", F.inline(F.array(point))).unionByName(origins)


def curve_areas(cumulated: DataFrame) -> DataFrame:
    """``roc_auc`` and ``pr_auc`` per label; labels with one class only are left out."""
    tp, fp, p, n = (F.col(c).cast("double") for c in ("upto_p", "upto_n", "p", "n"))
    hits, misses = F.col("total_p").cast("double"), F.col("total_n").cast("double")
    return (
        cumulated.where((F.col("total_p") > 0) & (F.col("total_n") > 0))
        .groupBy("label")
        .agg(
            F.sum(n * (tp - p / 2) / hits / misses).alias("roc_auc"),
            F.sum(F.when(p > 0, p / hits * tp / (tp + fp)).otherwise(0.0)).alias("pr_auc"),
        )
    )


def one_vs_rest(df: DataFrame, y: str = "y", scores: str = "scores") -> DataFrame:
    """One row per sample and class: ``(label, score, hit)``."""
    # An inner explode would add a filter on the array's size, and with it a second evaluation.
    cells = df.select(F.col(y).alias("_y"), F.posexplode_outer(scores).alias("label", "score"))
    return cells.where(F.col("label").isNotNull()).select(
        "label", "score", (F.col("label") == F.col("_y")).alias("hit")
    )


def ovr_auc(df: DataFrame, y: str = "y", scores: str = "scores") -> DataFrame:
    """One-vs-rest ROC AUC of every class that occurs and is not the only one."""
    counts = score_counts(one_vs_rest(df, y, scores), "label", "score", F.col("hit"))
    return curve_areas(curve_counts(counts)).select("label", "roc_auc")


def macro_auc(per_label: DataFrame) -> DataFrame:
    return per_label.agg(F.avg("roc_auc").alias("roc_auc"))


def micro_auc(df: DataFrame, y: str = "y", scores: str = "scores") -> DataFrame:
    """ROC AUC of the pooled one-hot truth against the pooled scores."""
    pooled = one_vs_rest(df, y, scores).withColumn("label", F.lit("micro"))
    counts = score_counts(pooled, "label", "score", F.col("hit"))
    return curve_areas(curve_counts(counts)).select(F.col("roc_auc").alias("roc_auc_micro"))


# ---- multilabel ---------------------------------------------------------------------------


def multilabel_counts(df: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """``(label, tn, fp, fn, tp)``: the two-by-two matrix of each label."""
    cells = df.select(
        F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(predicted).alias("g"))).alias("label", "c")
    )
    truth, guess = F.col("c.y") == 1, F.col("c.g") == 1
    return cells.groupBy("label").agg(
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(truth & guess).alias("tp"),
    )


def multilabel_report(counts: DataFrame) -> DataFrame:
    """Per-label precision, recall, F1 and support, with the matrix cells."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("label", *_prf(tp, tp + fp, tp + fn), (tp + fn).alias("support"), "tn", "fp", "fn", "tp")


def multilabel_summary(report: DataFrame) -> DataFrame:
    """Micro precision, recall and F1; macro and support-weighted F1."""
    sums = report.agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        F.avg("f1").alias("macro_f1"),
        F.coalesce(
            F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0)), F.lit(0.0)
        ).alias("weighted_f1"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(*_prf(tp, tp + fp, tp + fn), "macro_f1", "weighted_f1")


def multilabel_auc(df: DataFrame, y: str = "y", scores: str = "scores") -> DataFrame:
    """ROC AUC and PR AUC per label; labels with one class only are left out."""
    cells = df.select(
        F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(scores).alias("s"))).alias("label", "c")
    )
    counts = score_counts(
        cells.select("label", F.col("c.s").alias("score"), (F.col("c.y") == 1).alias("hit")),
        "label",
        "score",
        F.col("hit"),
    )
    return curve_areas(curve_counts(counts))


def multilabel_auc_summary(areas: DataFrame) -> DataFrame:
    """Macro ROC AUC and macro PR AUC: plain means over the labels of :func:`multilabel_auc`."""
    return areas.agg(F.avg("roc_auc").alias("macro_roc_auc"), F.avg("pr_auc").alias("macro_pr_auc"))


def scalar_metrics(metrics: DataFrame, task: str = "image", metric: str = "metric", value: str = "value") -> DataFrame:
    """The finite numbers among the named metrics of a long metric table."""
    return metrics.withColumn(value, finite(F.col(value))).where(
        F.col(metric).isin(SCALAR_METRICS[task]) & F.col(value).isNotNull()
    )
