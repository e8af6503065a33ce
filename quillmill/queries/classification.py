"""Metric queries over prediction tables made from embeddings, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions.arrays import sum_of
from quillmill.operators import classification as M
from quillmill.operators.dialog import top_k_labels
from quillmill.plans.evaluate import evaluate_classification
from quillmill.queries.registry import ORACLES, query, rounded, table

CLASSES = 10
NAMES = [f"class_{i}" for i in range(CLASSES)]

# Score of class k: the sum of all embedding values at places whose number ends in k.
LOGITS = """
logits AS (SELECT vec_id, label AS y,
  list_transform(range(10), lambda k: list_sum(list_transform(list_filter(range(1, len(embedding) + 1), lambda i: (i - 1) % 10 = k), lambda i: embedding[i]::DOUBLE))) AS z
  FROM embeddings)
"""
PROBS = f"""
{LOGITS},
shifted AS (SELECT vec_id, y, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM logits),
probs AS (SELECT vec_id, y, list_transform(e, lambda v: v / list_sum(e)) AS p FROM shifted)
"""
PREDICTED = f"""
{PROBS},
predicted AS (SELECT vec_id, y, p, CAST(list_position(p, list_max(p)) - 1 AS INT) AS g FROM probs)
"""
MATRIX = f"""
{PREDICTED},
matrix AS (SELECT a.i AS actual, b.i AS predicted, count(vec_id) AS n
  FROM range(10) a(i) CROSS JOIN range(10) b(i) LEFT JOIN predicted t ON t.y = a.i AND t.g = b.i GROUP BY ALL)
"""
PER_CLASS = f"""
{MATRIX},
sides AS (SELECT l.i AS label,
    sum(n) FILTER (WHERE actual = l.i AND predicted = l.i) AS tp,
    sum(n) FILTER (WHERE actual = l.i) AS support, sum(n) FILTER (WHERE predicted = l.i) AS guessed
  FROM matrix, range(10) l(i) GROUP BY l.i),
per_class AS (SELECT label,
    CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
    CASE WHEN support + guessed > 0 THEN 2 * tp / (support + guessed) ELSE 0 END AS f1, support, guessed
  FROM sides)
"""
CELLS = f"{PROBS}, cells AS (SELECT y, unnest(range(10)) AS label, unnest(p) AS score FROM probs)"


def areas(rows: str) -> str:
    """CTE ``areas(label, roc_auc, pr_auc)`` for ``rows(label, score, hit)``."""
    return f"""
points AS (SELECT label, score, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS n
           FROM {rows} GROUP BY ALL),
cumulated AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM points
           WINDOW w AS (PARTITION BY label ORDER BY score DESC)),
areas AS (SELECT label, sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS roc_auc,
                 sum(p * tp / (tp + fp)) / sum(p) AS pr_auc
          FROM cumulated GROUP BY label HAVING sum(p) > 0 AND sum(n) > 0)
"""


def logits(spark, sf):
    """``(vec_id, y, scores)`` with ten raw scores per row."""
    def of_class(k: int):
        return sum_of(F.filter("embedding", lambda v, i: i % CLASSES == k))

    sums = [of_class(k) for k in range(CLASSES)]
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y"), F.array(*sums).alias("scores"))


def probabilities(spark, sf):
    return M.normalize_scores(logits(spark, sf))


def predictions(spark, sf):
    return M.predict_labels(probabilities(spark, sf))


def matrix(spark, sf):
    return M.confusion_matrix(predictions(spark, sf), CLASSES)


def full_matrix(spark, sf):
    """With the rows whose label or prediction lies outside the classes."""
    return M.confusion_matrix(predictions(spark, sf), CLASSES, outside=True)


@query(
    "normalize_scores",
    f"WITH {PROBS} SELECT vec_id, y, CAST(unnest(range(10)) AS INT) AS class_id, round(unnest(p), 9) AS score FROM probs",
)
def _normalize(spark, sf):
    return rounded(probabilities(spark, sf).select("vec_id", "y", F.posexplode_outer("scores").alias("class_id", "score")), "score")


@query("predict_labels", f"WITH {PREDICTED} SELECT vec_id, y, g AS predicted FROM predicted")
def _predict(spark, sf):
    return predictions(spark, sf).select("vec_id", "y", "predicted")


@query("confusion_matrix", f"WITH {MATRIX} SELECT CAST(actual AS INT) AS actual, CAST(predicted AS INT) AS predicted, n FROM matrix")
def _matrix(spark, sf):
    return matrix(spark, sf)


@query(
    "per_class_report",
    f"""WITH {PER_CLASS} SELECT CAST(label AS INT) AS label, round(precision, 9) AS precision, round(recall, 9) AS recall,
round(f1, 9) AS f1, CAST(support AS BIGINT) AS support, CAST(guessed AS BIGINT) AS predicted FROM per_class""",
)
def _per_class(spark, sf):
    return rounded(M.per_class_report(full_matrix(spark, sf)), "precision", "recall", "f1")


@query("accuracy", f"WITH {PREDICTED} SELECT round(avg(CASE WHEN y = g THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM predicted")
def _accuracy(spark, sf):
    return rounded(M.accuracy(predictions(spark, sf)), "accuracy")


@query(
    "averaged_prf",
    f"""WITH {PER_CLASS} SELECT round(avg(precision) FILTER (WHERE support + guessed > 0), 9) AS precision,
round(avg(recall) FILTER (WHERE support + guessed > 0), 9) AS recall, round(avg(f1) FILTER (WHERE support + guessed > 0), 9) AS f1,
round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM per_class""",
)
def _averaged(spark, sf):
    summary = M.averaged_prf(M.per_class_report(full_matrix(spark, sf)), CLASSES)
    return rounded(summary, *summary.columns)


@query(
    "top_k_accuracy",
    f"""WITH {PROBS}, ahead AS (SELECT len(list_filter(range(1, 11), lambda i: p[i] > p[y + 1] OR (p[i] = p[y + 1] AND i > y + 1))) AS a
FROM probs) SELECT round(avg(CASE WHEN a < 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS top_5_accuracy FROM ahead""",
)
def _top_k(spark, sf):
    return rounded(M.top_k_accuracy(probabilities(spark, sf)), "top_5_accuracy")


@query(
    "ovr_auc",
    f"""WITH {CELLS}, hits AS (SELECT label, score, y = label AS hit FROM cells), {areas('hits')}
SELECT CAST(label AS VARCHAR) AS label, round(roc_auc, 9) AS roc_auc FROM areas
UNION ALL SELECT 'macro', round(avg(roc_auc), 9) FROM areas""",
)
def _ovr(spark, sf):
    per_label = M.ovr_auc(probabilities(spark, sf)).withColumn("label", F.col("label").cast("string"))
    # A grouping set gives the macro mean without computing the curves twice.
    both = per_label.rollup("label").agg(F.avg("roc_auc").alias("roc_auc"))
    return rounded(both.withColumn("label", F.coalesce("label", F.lit("macro"))), "roc_auc")


@query(
    "micro_auc",
    f"""WITH {CELLS}, hits AS (SELECT 'micro' AS label, score, y = label AS hit FROM cells), {areas('hits')}
SELECT round(roc_auc, 9) AS roc_auc_micro FROM areas""",
)
def _micro(spark, sf):
    return rounded(M.micro_auc(probabilities(spark, sf)), "roc_auc_micro")


@query(
    "top_k_labels",
    f"""WITH {PROBS}, cells AS (SELECT vec_id, unnest(range(10)) AS c, unnest(p) AS score FROM probs),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, c) AS rank FROM cells)
SELECT vec_id, CAST(rank AS INT) AS rank, 'class_' || c AS label, round(score, 9) AS score FROM r WHERE rank <= 5""",
)
def _top_labels(spark, sf):
    return rounded(top_k_labels(logits(spark, sf), NAMES, 5, keep=["vec_id"]), "score")


# ---- curves: quality of a document by its length ------------------------------------------

JUDGED = """
judged AS (SELECT doc_id, 0 AS label, quality, toxic, n_chars / (SELECT max(n_chars) FROM documents) AS score
           FROM labels JOIN documents USING (doc_id)),
hits AS (SELECT label, score, quality = 1 AS hit FROM judged)
"""


def judged(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    longest = docs.agg(F.max("n_chars").alias("m"))
    return (
        table(spark, sf, "labels")
        .join(docs, "doc_id")
        .withColumns({"score": F.col("n_chars") / longest.scalar(), "label": F.lit(0)})
    )


def judged_counts(spark, sf):
    return M.score_counts(judged(spark, sf), "label", "score", F.col("quality") == 1)


@query(
    "roc_curve",
    f"""WITH {JUDGED}, {areas('hits')} SELECT label, round(score, 9) AS threshold,
round(fp / (SELECT sum(n) FROM points), 9) AS fpr, round(tp / (SELECT sum(p) FROM points), 9) AS tpr FROM cumulated
UNION ALL SELECT 0, NULL, 0.0, 0.0""",
)
def _roc_curve(spark, sf):
    return rounded(M.roc_curve(M.curve_counts(judged_counts(spark, sf))), "threshold", "fpr", "tpr")


@query(
    "roc_curve_corners",
    f"""WITH {JUDGED}, {areas('hits')}, steps AS (SELECT *, lead(p) OVER w AS next_p, lead(n) OVER w AS next_n, row_number() OVER w AS place
  FROM cumulated WINDOW w AS (PARTITION BY label ORDER BY score DESC))
SELECT label, round(score, 9) AS threshold,
round(fp / (SELECT sum(n) FROM points), 9) AS fpr, round(tp / (SELECT sum(p) FROM points), 9) AS tpr FROM steps
WHERE place = 1 OR next_p IS NULL OR next_p <> p OR next_n <> n
UNION ALL SELECT 0, NULL, 0.0, 0.0""",
)
def _roc_corners(spark, sf):
    """The curve without the points on its straight parts, from slices far smaller than the table."""
    corners = M.corner_points(M.curve_counts(judged_counts(spark, sf), slice_rows=50))
    return rounded(M.roc_curve(corners), "threshold", "fpr", "tpr")


@query("roc_auc", f"WITH {JUDGED}, {areas('hits')} SELECT label, round(roc_auc, 9) AS roc_auc FROM areas")
def _roc_auc(spark, sf):
    return rounded(M.curve_areas(M.curve_counts(judged_counts(spark, sf))).select("label", "roc_auc"), "roc_auc")


@query("average_precision", f"WITH {JUDGED}, {areas('hits')} SELECT label, round(pr_auc, 9) AS pr_auc FROM areas")
def _pr_auc(spark, sf):
    return rounded(M.curve_areas(M.curve_counts(judged_counts(spark, sf))).select("label", "pr_auc"), "pr_auc")


@query(
    "evaluate_classification",
    f"""WITH a AS ({ORACLES['accuracy']}), b AS ({ORACLES['averaged_prf']}), c AS ({ORACLES['top_k_accuracy']}), d AS ({ORACLES['micro_auc']}),
e AS (SELECT roc_auc FROM ({ORACLES['ovr_auc']}) WHERE label = 'macro'), found AS (
SELECT 'num_samples' AS metric, count(*)::DOUBLE AS value FROM embeddings
UNION ALL FROM (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL FROM (UNPIVOT b ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL FROM (UNPIVOT c ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL FROM (UNPIVOT d ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL FROM (UNPIVOT e ON COLUMNS(*) INTO NAME metric VALUE value))
SELECT metric, round(value, 6) AS value FROM found""",
)
def _evaluate(spark, sf):
    return rounded(evaluate_classification(logits(spark, sf)).metrics, "value", places=6)


# ---- multilabel: quality and toxicity of a document ---------------------------------------

TWO_LABELS = """
scored AS (SELECT doc_id, [quality, toxic] AS y,
             [n_chars / (SELECT max(n_chars) FROM documents), (doc_id % 97) / 97.0::DOUBLE] AS s
           FROM labels JOIN documents USING (doc_id)),
cells AS (SELECT CAST(unnest(range(2)) AS INT) AS label, unnest(y) = 1 AS hit, unnest(s) AS score FROM scored)
"""
TWO_BY_TWO = f"""
{TWO_LABELS},
counts AS (SELECT label, count(*) FILTER (WHERE NOT hit AND score < 0.5) AS tn, count(*) FILTER (WHERE NOT hit AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE hit AND score < 0.5) AS fn, count(*) FILTER (WHERE hit AND score >= 0.5) AS tp FROM cells GROUP BY label),
per_label AS (SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, tp + fn AS support, tn, fp, fn, tp FROM counts)
"""


def two_labels(spark, sf):
    scores = F.array("score", (F.col("doc_id") % 97) / F.lit(97.0))
    return judged(spark, sf).select("doc_id", F.array("quality", "toxic").alias("y"), scores.alias("scores"))


def two_by_two(spark, sf):
    predicted = M.predict_labels(two_labels(spark, sf), multilabel=True)
    return M.multilabel_counts(predicted)


@query(
    "multilabel_report",
    f"""WITH {TWO_BY_TWO} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
support, tn, fp, fn, tp FROM per_label""",
)
def _multilabel(spark, sf):
    return rounded(M.multilabel_report(two_by_two(spark, sf)), "precision", "recall", "f1")


@query(
    "multilabel_summary",
    f"""WITH {TWO_BY_TWO} SELECT round(sum(tp) / nullif(sum(tp + fp), 0), 9) AS precision, round(sum(tp) / nullif(sum(tp + fn), 0), 9) AS recall,
round(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 9) AS f1, round(avg(f1), 9) AS macro_f1,
round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM per_label""",
)
def _multilabel_summary(spark, sf):
    summary = M.multilabel_summary(M.multilabel_report(two_by_two(spark, sf)))
    return rounded(summary, *summary.columns)


@query(
    "multilabel_auc",
    f"""WITH {TWO_LABELS}, {areas('cells')}
SELECT label, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM areas""",
)
def _multilabel_auc(spark, sf):
    return rounded(M.multilabel_auc(two_labels(spark, sf)), "roc_auc", "pr_auc")


@query(
    "multilabel_auc_summary",
    f"""WITH {TWO_LABELS}, {areas('cells')}
SELECT round(avg(roc_auc), 9) AS macro_roc_auc, round(avg(pr_auc), 9) AS macro_pr_auc FROM areas""",
)
def _multilabel_auc_summary(spark, sf):
    summary = M.multilabel_auc_summary(M.multilabel_auc(two_labels(spark, sf)))
    return rounded(summary, *summary.columns)


# ---- status and scalar metrics per source -------------------------------------------------


@query(
    "metric_status",
    """SELECT source, count(quality) AS num_samples,
  CASE WHEN count(quality) > 0 THEN 'binary' END AS task_type,
  CASE WHEN count(quality) > 0 THEN CAST(greatest(2, floor(greatest(max(quality), max(n_chars / 200000)) + 1)) AS BIGINT) END AS num_classes,
  CASE WHEN count(quality) = 0 THEN 'empty_targets' END AS skipped
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def _status(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") / 200000).alias("scores"))
    rows = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return M.metric_status(rows, "quality", "scores", "source")


@query(
    "scalar_metrics",
    """WITH m AS (SELECT source, avg(quality) AS accuracy, avg(toxic) / nullif(avg(quality), 0) AS f1, avg(n_chars) AS mean_chars
                  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
l AS (SELECT source, unnest(['accuracy', 'f1', 'mean_chars']) AS metric, unnest([accuracy, f1, mean_chars]) AS value FROM m)
SELECT source, metric, round(value, 9) AS value FROM l WHERE metric <> 'mean_chars' AND value IS NOT NULL""",
)
def _scalars(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    per_source = (
        docs.join(table(spark, sf, "labels"), "doc_id", "left")
        .groupBy("source")
        .agg(F.avg("quality").alias("accuracy"), F.avg("toxic").alias("t"), F.avg("n_chars").alias("mean_chars"))
        .withColumn("f1", F.col("t") / F.nullif(F.col("accuracy"), F.lit(0.0)))
    )
    long = per_source.unpivot(["source"], ["accuracy", "f1", "mean_chars"], "metric", "value")
    return rounded(M.scalar_metrics(long), "value")
