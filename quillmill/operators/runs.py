"""Training logs, run tables, verdicts and capacity matching, for many runs at once."""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators.matching import as_of, level_answers
from quillmill.operators.ranking import BROADCAST_ROWS, two_level_rank
from quillmill.session import materialize

# Log patterns, thresholds, verdict order, metric names and display rules.
OOM_PATTERN = r"cuda out of memory|out of memory|\boom\b|cudaerroroutofmemory"
NAN_PATTERN = r"\bnan\b|loss.*nan|gradient.*nan|overflow"
LOSS_PATTERN = r"""['"]?(?:train_)?loss['"]?\s*[=:]\s*([\d.]+)"""
PERPLEXITY_WARN, PERPLEXITY_RETRAIN, TOKEN_ACCURACY_WARN = 20.0, 50.0, 0.50
ACCURACY_WARN, ACCURACY_RETRAIN, F1_WARN = 0.70, 0.55, 0.50
VERDICTS = ["pass", "warn", "suggest_retrain"]
KEY_METRICS = {
    "text": ["eval_loss", "perplexity", "token_accuracy"],
    "image": ["accuracy", "f1", "macro_f1", "weighted_f1", "precision", "recall"],
}
METRIC_SPECS = [
    ("accuracy", "Accuracy", "Quality", "percent"),
    ("top_5_accuracy", "Top-5 Accuracy", "Quality", "percent"),
    ("precision", "Precision", "Quality", "percent"),
    ("recall", "Recall", "Quality", "percent"),
    ("f1", "F1 Score", "Quality", "percent"),
    ("roc_auc", "ROC AUC", "Quality", "percent"),
    ("roc_auc_micro", "ROC AUC (micro)", "Quality", "percent"),
    ("pr_auc", "PR AUC", "Quality", "percent"),
    ("token_accuracy", "Token Accuracy", "Quality", "percent"),
    ("eval_loss", "Eval Loss", "Loss & Perplexity", "float"),
    ("perplexity", "Perplexity", "Loss & Perplexity", "float"),
    ("bleu", "BLEU", "Text Generation", "raw"),
    ("rouge1", "ROUGE-1", "Text Generation", "raw"),
    ("rouge2", "ROUGE-2", "Text Generation", "raw"),
    ("rougeL", "ROUGE-L", "Text Generation", "raw"),
    ("rougeLsum", "ROUGE-Lsum", "Text Generation", "raw"),
    ("token_count", "Tokens Evaluated", "Other", "int"),
    ("generation_sample_size", "Samples Evaluated", "Other", "int"),
    ("task_type", "Task Type", "Other", "raw"),
]


# ---- logs ---------------------------------------------------------------------------------


def log_signals(msg: Column) -> list[Column]:
    """``oom``, ``nan`` and ``loss`` of one log line; a number that cannot be read is null."""
    low = F.lower(msg)
    number = F.regexp_extract(low, LOSS_PATTERN, 1)
    return [
        low.rlike(OOM_PATTERN).alias("oom"),
        low.rlike(NAN_PATTERN).alias("nan"),
        F.nullif(number, F.lit("")).try_cast("double").alias("loss"),
    ]


def line_signals(
    logs: DataFrame, run: str = "run_id", seq: str = "seq", msg: str = "msg", keep: Sequence[str] = ()
) -> DataFrame:
    """``(run, seq, oom, nan, loss, head)`` per line and the ``keep`` columns; ``head`` is kept only where
    it is reported."""
    return logs.select(run, *keep, F.col(seq).alias("seq"), msg, *log_signals(F.col(msg))).select(
        run,
        *keep,
        "seq",
        "oom",
        "nan",
        "loss",
        F.when(F.col("oom") | F.col("nan"), F.left(msg, F.lit(120))).alias("head"),
    )


def _events(signals: DataFrame, run: str) -> DataFrame:
    def first(flag: str, prefix: str) -> Column:
        hit = F.col(flag)
        head = F.min_by(F.when(hit, F.col("head")), F.when(hit, F.col("seq")))
        return F.concat(F.lit(prefix), head)

    # Flags have fixed widths and aggregate by hash; texts are only compared on the lines reported.
    flags = signals.groupBy(run).agg(
        F.bool_or("oom").alias("oom_detected"),
        F.bool_or("nan").alias("nan_loss_detected"),
        F.count("loss").alias("losses"),
    )
    heads = signals.where(F.col("oom") | F.col("nan")).groupBy(F.col(run).alias("_run")).agg(
        first("oom", "OOM: ").alias("oom_event"), first("nan", "NaN: ").alias("nan_event")
    )
    return flags.join(heads, F.col(run).eqNullSafe(F.col("_run")), "left").select(
        run, "oom_detected", "nan_loss_detected", "oom_event", "nan_event", "losses"
    )


def _trends(losses: DataFrame, run: str, width: int) -> DataFrame:
    ranked = two_level_rank(losses, [run], "seq", width)
    early = F.col("rank") <= F.floor(F.col("total") / 2)
    halves = ranked.groupBy(run).agg(
        F.count(F.lit(1)).alias("losses"),
        F.avg(F.when(early, F.col("loss"))).alias("first_half"),
        F.avg(F.when(~early, F.col("loss"))).alias("second_half"),
    )
    delta = F.col("second_half") - F.col("first_half")
    return halves.withColumn(
        "trend",
        F.when(F.col("losses") < 4, "unknown")
        .when(delta < -0.05, "improving")
        .when(delta > 0.10, "diverging")
        .otherwise("stable"),
    )


def extract_log_events(logs: DataFrame, run: str = "run_id", seq: str = "seq", msg: str = "msg") -> DataFrame:
    """Per run: OOM and NaN flags, their first messages, and the number of losses.

    One pass over the log writes the signals of its lines, a few bytes each.
    """
    return _events(materialize(line_signals(logs, run, seq, msg), "signals"), run)


def loss_trend(
    logs: DataFrame, run: str = "run_id", seq: str = "seq", msg: str = "msg", width: int = 100_000
) -> DataFrame:
    """Per run with losses: means of the earlier and later half, and the trend.

    The losses are read off the log once and written, a few bytes each; runs of more than ``width``
    losses are ranked in even ranges of ``seq``, so one run may hold any share of the log.
    """
    losses = line_signals(logs, run, seq, msg).where(F.col("loss").isNotNull())
    return _trends(materialize(losses.select(run, "seq", "loss"), "losses"), run, width)


def training_health(
    logs: DataFrame, metrics: DataFrame, run: str = "run_id", width: int = 100_000
) -> DataFrame:
    """One row per run of ``metrics(run, eval_loss, train_loss)`` with flags, events and trend.

    One pass over the log writes the lines that carry a signal; everything else reads those.
    """
    telling = F.col("oom") | F.col("nan") | F.col("loss").isNotNull()
    signals = materialize(line_signals(logs, run).where(telling), "signals")
    events = _events(signals, run)
    trends = _trends(signals.where(F.col("loss").isNotNull()).select(run, "seq", "loss"), run, width)
    final = F.coalesce(F.nullif(F.col("eval_loss"), F.lit(0.0)), F.col("train_loss"))
    return (
        metrics.join(events, run, "left")
        .join(trends.select(run, "trend"), run, "left")
        .select(
            run,
            F.lit("success").alias("status"),
            F.coalesce("oom_detected", F.lit(False)).alias("oom_detected"),
            F.coalesce("nan_loss_detected", F.lit(False)).alias("nan_loss_detected"),
            final.alias("final_loss"),
            F.coalesce("trend", F.lit("unknown")).alias("loss_trend"),
            F.array_compact(F.array("oom_event", "nan_event")).alias("events"),
        )
    )


# ---- verdicts -----------------------------------------------------------------------------


def _verdict(points: list[tuple[Column, int]], ranks: list[Column], codes: list[Column]) -> list[Column]:
    score = F.lit(100.0)
    for hit, loss in points:
        score = score - F.when(hit, float(loss)).otherwise(0.0)
    worst = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    name = F.get(F.array(*[F.lit(v) for v in VERDICTS]), worst)
    return [
        name.alias("verdict"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"),
        F.array_compact(F.array(*codes)).alias("issues"),
        (worst == 2).alias("retrain_suggested"),
    ]


def text_verdict(runs: DataFrame, keep: Sequence[str] = ("run_id",)) -> DataFrame:
    """Verdict, score and issue codes of text runs (perplexity, token_accuracy, generated_qa, train_rows)."""
    ppl, acc = F.col("perplexity"), F.col("token_accuracy")
    high = F.coalesce(ppl > PERPLEXITY_RETRAIN, F.lit(False))
    mid = F.coalesce(ppl > PERPLEXITY_WARN, F.lit(False)) & ~high
    low = F.coalesce(acc < TOKEN_ACCURACY_WARN, F.lit(False))
    made = F.coalesce("generated_qa", F.lit(False))
    few = F.coalesce("train_rows", F.lit(0)) < 100
    return runs.select(
        *keep,
        *_verdict(
            [(high, 40), (mid, 20), (low, 15), (made, 10), (few, 15)],
            [F.when(high, 2).when(mid, 1).otherwise(0), F.when(low, 1).otherwise(0)],
            [
                F.when(high, "high_perplexity"),
                F.when(mid, "moderate_perplexity"),
                F.when(low, "low_token_accuracy"),
                F.when(few, "few_training_rows"),
            ],
        ),
        F.array_compact(
            F.array(
                F.when(high, "train_longer"),
                F.when(high, "check_pairs"),
                F.when(mid, "add_diverse_examples"),
                F.when(low, "align_questions_and_answers"),
                F.when(made, "replace_generated_pairs"),
            )
        ).alias("recommendations"),
    )


def image_verdict(runs: DataFrame, keep: Sequence[str] = ("run_id",)) -> DataFrame:
    """Verdict, score and issue codes of image runs (accuracy, f1, macro_f1, num_images, num_classes)."""
    acc = F.col("accuracy")
    f1 = F.coalesce(F.nullif(F.col("f1"), F.lit(0.0)), F.col("macro_f1"))
    bad = F.coalesce(acc < ACCURACY_RETRAIN, F.lit(False))
    fair = F.coalesce(acc < ACCURACY_WARN, F.lit(False)) & ~bad
    low = F.coalesce(f1 < F1_WARN, F.lit(False))
    few = F.coalesce("num_images", F.lit(0)) < 200
    many = F.coalesce("num_classes", F.lit(2)) > 5
    return runs.select(
        *keep,
        *_verdict(
            [(bad, 45), (fair, 20), (low, 15), (few, 20)],
            [F.when(bad, 2).when(fair, 1).otherwise(0)],
            [
                F.when(bad, "low_accuracy"),
                F.when(fair, "moderate_accuracy"),
                F.when(low, "low_f1"),
                F.when(few, "small_dataset"),
            ],
        ),
        F.array_compact(
            F.array(
                F.when(bad, "collect_images"),
                F.when(bad & many, "merge_classes"),
                F.when(fair, "add_diverse_images"),
                F.when(low, "balance_classes"),
                F.when(few, "collect_100_per_class"),
            )
        ).alias("recommendations"),
    )


def key_metrics(metrics: DataFrame, task: str = "task", metric: str = "metric") -> DataFrame:
    """The rows of a long metric table that matter for each row's task."""
    wanted = F.when(F.col(task).startswith("text"), F.col(metric).isin(KEY_METRICS["text"])).otherwise(
        F.col(metric).isin(KEY_METRICS["image"])
    )
    return metrics.where(wanted)


def verdict_rank(verdict: Column) -> Column:
    """2 for pass, 1 for warn, 0 for anything else."""
    return F.when(verdict == "pass", 2).when(verdict == "warn", 1).otherwise(0)


def best_attempt(runs: DataFrame, original: str = "original_id", attempt: str = "attempt", verdict: str = "verdict") -> DataFrame:
    """Per original run (attempt 0), the first retry with a better verdict than the original.

    One pass: the first attempt of each verdict is kept per group, and the original's rank then
    decides which of them counts.
    """
    rank = verdict_rank(F.col(verdict))
    no = F.col(attempt)
    retry = no > 0

    def first(at_rank: int) -> Column:
        return F.min(F.when(retry & (rank == at_rank), no))

    firsts = runs.groupBy(original).agg(
        F.max(F.when(no == 0, rank)).alias("base"),
        first(1).alias("first_warn"),
        first(2).alias("first_pass"),
    )
    better = (
        F.when(F.col("base") == 0, F.least("first_warn", "first_pass"))
        .when(F.col("base") == 1, F.col("first_pass"))
    )
    chosen = F.coalesce(better, F.lit(0))
    won = F.when(better.isNull(), F.col("base")).otherwise(
        F.when(better == F.col("first_pass"), 2).otherwise(1)
    )
    return firsts.where(F.col("base").isNotNull()).select(
        original,
        chosen.alias("best_attempt"),
        F.get(F.array(F.lit("suggest_retrain"), F.lit("warn"), F.lit("pass")), won).alias("best_verdict"),
    )


# ---- metric tables ------------------------------------------------------------------------


def unpivot_metrics(runs: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide run metrics as long rows with label, group, kind and display text.

    The display rules are a few literals in a CASE, so nothing is joined or shuffled.
    """
    specs = {m: (label, group, kind) for m, label, group, kind in METRIC_SPECS}

    def spec(name: str) -> tuple[str, str, str]:
        return specs.get(name, (name.replace("_", " ").title(), "Other", "raw"))

    def number(name: str) -> Column:
        if isinstance(runs.schema[name].dataType, T.NumericType):
            return F.col(name).cast("double")
        return F.lit(None).cast("double")

    def display(name: str, kind: str) -> Column:
        """Whole numbers and texts show as they are, unless the kind asks for more."""
        own, value, dtype = F.col(name), number(name), runs.schema[name].dataType
        if isinstance(dtype, T.BooleanType):
            text = F.initcap(own.cast("string"))
        elif not isinstance(dtype, T.NumericType):
            text = own.cast("string")
        elif kind == "percent":
            text = F.format_string("%.2f%%", F.bround(value * 100, 2))
        elif kind == "int" or (kind == "raw" and isinstance(dtype, T.IntegralType)):
            text = own.cast("long").cast("string")
        else:
            text = F.format_string("%.4f", F.bround(value, 4))
        return F.when(own.isNull(), "—").otherwise(text)

    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.lit(spec(name)[0]).alias("label"),
                F.lit(spec(name)[1]).alias("metric_group"),
                F.lit(spec(name)[2]).alias("kind"),
                number(name).alias("value"),
                display(name, spec(name)[2]).alias("display"),
            )
            for name in metrics
        ]
    )
    return runs.select(*ids, F.inline(rows))


def run_diagnostics(
    data: DataFrame,
    training: DataFrame,
    evaluation: DataFrame,
    plans: DataFrame | None = None,
    optimization: DataFrame | None = None,
    run: str = "run_id",
) -> DataFrame:
    """One JSON record per run with its data, training, evaluation and (if given) model and
    optimization parts. Every table has at most a row per run."""

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select(run, F.struct(*[c for c in df.columns if c != run]).alias(name))

    joined = part(data, "data")
    parts = ["data"]
    for df, name in ((plans, "model"), (optimization, "optimization"), (training, "training"), (evaluation, "evaluation")):
        if df is not None:
            joined = joined.join(part(df, name), run, "left")
            parts.append(name)
    return joined.select(run, F.to_json(F.struct(*parts)).alias("diagnostics"))


# ---- capacity matching --------------------------------------------------------------------

def catalog_items(catalog: DataFrame) -> DataFrame:
    """``id, need, size, position, cpu_ok`` of catalog rows in their given ``position`` order; an
    unknown size stays null."""
    cpu = (F.coalesce("params_b", F.lit(1.0)) <= 0.6) | F.coalesce(F.array_contains("recommended_for", "cpu"), F.lit(False))
    return catalog.select(
        "id",
        F.coalesce("vram_qlora_gb", "vram_min_gb", F.lit(999.0)).cast("double").alias("need"),
        F.col("params_b").cast("double").alias("size"),
        "position",
        cpu.alias("cpu_ok"),
    )


def _level_answers(items: pd.DataFrame) -> pd.DataFrame:
    """Per requirement level: the largest, smallest and middle item at or below it."""
    by_size: list[tuple] = []
    largest, smallest, rows = None, None, []
    for need, level in items.sort_values(["need", "position"]).groupby("need", sort=True):
        for size, position, name in zip(level["size"], level["position"], level["id"]):
            known = size == size  # not NaN
            insort(by_size, (size if known else 0.0, position, name))
            largest = max(filter(None, (largest, (size if known else 0.0, -position, name))))
            smallest = min(filter(None, (smallest, (size if known else 999.0, position, name))))
        rows.append((items["on"].iloc[0], need, largest[2], smallest[2], by_size[len(by_size) // 2][2]))
    return pd.DataFrame(rows, columns=["on", "need", "largest", "smallest", "middle"])


def best_fit_match(requests: DataFrame, catalog: DataFrame, small_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Choose a catalog item for every request; adds ``choice``.

    ``requests``: request_id, tier, capacity, objective (performance, memory or other), override.
    ``catalog``: id, need, size, position, cpu_ok. CPU requests may take the ``cpu_ok`` items,
    others those with ``need <= capacity``; with none the first item is taken. Performance takes
    the largest on mid and high tiers, memory the smallest, others the middle one by size; ties
    go to the earlier position. An unknown size counts as 0, or as 999 among the smallest. An
    override wins.

    The choice depends on the capacity only through the highest requirement level it reaches, so the
    answers are worked out per level and no pair of request and item is formed. A catalog of up to
    ``small_rows`` items, counted first, is one bounded group, and its answers reach the requests as one
    list, in which a request finds its level by bisection; requests are not shuffled. For larger ones
    see :mod:`quillmill.operators.matching`.
    """
    offers = catalog.select("id", "need", "size", "position", F.lit("gpu").alias("on")).unionByName(
        catalog.where("cpu_ok").select("id", F.lit(0.0).alias("need"), "size", "position", F.lit("cpu").alias("on"))
    )
    fields = "on string, need double, largest string, smallest string, middle string"
    answers = offers.withColumns({"id": F.col("id").cast("string"), "need": F.col("need").cast("double")})
    if catalog.count() > small_rows:
        return _match_large(requests, answers, catalog)
    answers = answers.groupBy("on").applyInPandas(_level_answers, fields)
    level = F.struct("need", F.struct("largest", "smallest", "middle").alias("answer"))
    lists = answers.agg(
        F.sort_array(F.collect_list(F.when(F.col("on") == "gpu", level))).alias("levels"),
        F.first(F.when(F.col("on") == "cpu", level["answer"]), ignorenulls=True).alias("cpu"),
    ).select(F.struct("levels", "cpu").alias("all"))
    first = catalog.agg(F.min_by("id", "position").alias("id"))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(24))])
    reached = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(F.col("_all.levels"), at + step - 1)["need"] <= F.col("capacity"), at + step).otherwise(at),
    )
    fitted = requests.withColumn("_all", lists.scalar()).withColumn(
        "_fit",
        F.when(F.col("tier") == "cpu", F.col("_all.cpu")).otherwise(F.get(F.col("_all.levels"), reached - 1)["answer"]),
    )
    return fitted.withColumn("choice", _choice(first)).drop("_fit", "_all")


def _choice(first: DataFrame) -> Column:
    """The item of the answer ``_fit`` that the objective of a request asks for."""
    big = (F.col("objective") == "performance") & F.col("tier").isin("mid_gpu", "high_gpu")
    picked = (
        F.when(big, F.col("_fit.largest"))
        .when(F.col("objective") == "memory", F.col("_fit.smallest"))
        .otherwise(F.col("_fit.middle"))
    )
    return F.coalesce(F.nullif(F.col("override"), F.lit("")), picked, first.scalar())


def _match_large(requests: DataFrame, offers: DataFrame, catalog: DataFrame) -> DataFrame:
    levels = materialize(level_answers(offers), "levels")
    answer = F.struct("largest", "smallest", "middle").alias("_fit")
    # Requests meet the answers by their capacity; those on CPUs, which have one level, by none.
    asked = F.when(F.col("tier") != "cpu", F.col("capacity").cast("double"))
    capacities = requests.select(asked.alias("need")).where("need IS NOT NULL")
    reached = as_of(levels.where("on = 'gpu'").select("need", answer), capacities, "need", "_fit")
    # As a table, this side is broadcast if it is small, and brings no partitioning otherwise.
    reached = materialize(reached.withColumnRenamed("need", "_need"), "reached")
    first = catalog.agg(F.min_by("id", "position").alias("id"))
    cpu = levels.where("on = 'cpu'").agg(F.first(answer))
    fitted = requests.withColumn("_asked", asked).join(reached, F.col("_asked") == F.col("_need"), "left")
    fitted = fitted.withColumn("_fit", F.when(F.col("tier") == "cpu", cpu.scalar()).otherwise(F.col("_fit")))
    return fitted.withColumn("choice", _choice(first)).select(*requests.columns, "choice")
