"""Text-generation and token metrics over tables of predictions and references."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from quillmill.functions.arrays import finite, let, multiset_overlap, ngrams
from quillmill.functions.text import normalize_answer, words_of

IGNORED = -100
BLEU_ORDER = 4


def exact_match(prediction: Column, reference: Column) -> Column:
    """1.0 if both answers are equal once normalised, else 0.0."""
    return (normalize_answer(prediction) == normalize_answer(reference)).cast("double")


def _f_measure(overlap: Column, left: Column, right: Column) -> Column:
    """Harmonic mean of overlap/left and overlap/right, 0 without overlap."""
    return F.when(overlap > 0, 2 * overlap / (left + right)).otherwise(0.0)


def token_f1(prediction: Column, reference: Column) -> Column:
    """Multiset F1 of the answer words: 1 if both sides are empty, 0 if one is."""
    sides = F.struct(
        words_of(normalize_answer(prediction)).alias("p"),
        words_of(normalize_answer(reference)).alias("r"),
    )

    def score(s: Column) -> Column:
        p, r = s["p"], s["r"]
        return (
            F.when((F.size(p) == 0) & (F.size(r) == 0), 1.0)
            .when((F.size(p) == 0) | (F.size(r) == 0), 0.0)
            .otherwise(
                let(multiset_overlap(p, r), lambda o: _f_measure(o, F.size(p), F.size(r)))
            )
        )

    return let(sides, score)


def perplexity(loss: Column) -> Column:
    """``exp(loss)``, null where the loss is not finite or the result overflows."""
    return finite(F.exp(finite(loss)))


def token_accuracy(predicted: Column, labels: Column, shifted: bool = False) -> Column:
    """``struct<hits, tokens>`` of one row; labels of -100 do not count.

    ``shifted`` is for next-token predictions: the prediction at position i is for label i+1.
    Sum both fields over the table and divide.
    """
    guess = F.slice(predicted, F.lit(1), F.greatest(F.size(predicted) - 1, F.lit(0))) if shifted else predicted
    truth = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))) if shifted else labels
    counted = F.filter(
        F.arrays_zip(guess.alias("g"), truth.alias("t")), lambda z: z["t"] != IGNORED
    )
    return let(
        counted,
        lambda c: F.struct(
            F.size(F.filter(c, lambda z: z["g"] == z["t"])).cast("long").alias("hits"),
            F.size(c).cast("long").alias("tokens"),
        ),
    )


def rouge_words(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs, without stemming."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " ")
    return words_of(F.trim(clean))


@pandas_udf(IntegerType())
def _common_subsequence(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Longest common subsequence of two word lists, one machine word of cells at a time.

    Each row of the dynamic programme is one big integer, so a pair of n and m words costs n
    additions of m bits; whole texts are compared, whatever their length.
    """

    def length(a: list[str], b: list[str]) -> int:
        places: dict[str, int] = {}
        for i, word in enumerate(a):
            places[word] = places.get(word, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for word in b:
            hits = row & places.get(word, 0)
            row = ((row + hits) | (row - hits)) & full
        return len(a) - row.bit_count()

    for left, right in batches:
        yield pd.Series([length(list(a), list(b)) for a, b in zip(left, right)], dtype="int32")


def rouge_scores(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Add ``rouge1``, ``rouge2`` and ``rougeL`` F-measures to every pair.

    The corpus score is the plain mean, rounded to 4 places by the caller.
    """
    p, r = F.col("_p"), F.col("_r")

    def overlap(n: int) -> Column:
        sides = F.struct(ngrams(p, n).alias("p"), ngrams(r, n).alias("r"))
        return let(
            sides,
            lambda s: _f_measure(
                multiset_overlap(s["p"], s["r"]), F.size(s["p"]), F.size(s["r"])
            ),
        )

    worded = df.withColumns({"_p": rouge_words(F.col(prediction)), "_r": rouge_words(F.col(reference))})
    common = worded.withColumn("_lcs", _common_subsequence("_p", "_r"))
    return common.withColumns(
        {
            "rouge1": overlap(1),
            "rouge2": overlap(2),
            "rougeL": _f_measure(F.col("_lcs"), F.size(p), F.size(r)),
        }
    ).drop("_p", "_r", "_lcs")


def bleu_tokens(text: Column) -> Column:
    """Words after the usual language-independent punctuation split of BLEU scorers."""
    # Replacements and split rules of the standard 13a tokenisation.
    plain = F.coalesce(text, F.lit(""))
    for mark, put in (
        ("<skipped>", ""),
        ("-\n", ""),
        ("&quot;", '"'),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
    ):
        plain = F.replace(plain, F.lit(mark), F.lit(put))
    spaced = F.concat(F.lit(" "), plain, F.lit(" "))
    for pattern, put in (
        (r"\s+", " "),
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
        (r"([^0-9])([\.,])", "$1 $2 "),
        (r"([\.,])([^0-9])", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ):
        spaced = F.regexp_replace(spaced, pattern, put)
    return F.filter(F.split(spaced, r"\s+", -1), lambda w: w != "")


def corpus_bleu(df: DataFrame, prediction: str = "prediction", reference: str = "reference", by: str | None = None) -> DataFrame:
    """Corpus BLEU, 0 to 100: clipped n-gram precisions up to 4, brevity penalty.

    An order without matches is smoothed as 1 / (2**k * possible) for the k-th such order.
    Counting is row-local; one partial aggregate carries ten numbers per task.
    """
    sides = df.select(
        *([by] if by else []),
        bleu_tokens(F.col(prediction)).alias("p"),
        bleu_tokens(F.col(reference)).alias("r"),
    )
    orders = range(1, BLEU_ORDER + 1)
    p, r = F.col("p"), F.col("r")
    counted = sides.select(
        *([by] if by else []),
        F.size(p).cast("long").alias("sys"),
        F.size(r).cast("long").alias("ref"),
        *[multiset_overlap(ngrams(p, n), ngrams(r, n)).cast("long").alias(f"m{n}") for n in orders],
        *[F.greatest(F.size(p) - (n - 1), F.lit(0)).cast("long").alias(f"t{n}") for n in orders],
    )
    names = ["sys", "ref", *[f"m{n}" for n in orders], *[f"t{n}" for n in orders]]
    sums = counted.groupBy(*([by] if by else [])).agg(*[F.sum(c).alias(c) for c in names])
    logs, misses = F.lit(0.0), F.lit(0)
    for n in orders:
        misses = misses + (F.col(f"m{n}") == 0).cast("int")
        smoothed = F.when(F.col(f"m{n}") > 0, F.col(f"m{n}").cast("double")).otherwise(
            F.lit(1.0) / F.pow(F.lit(2.0), misses)
        )
        logs = logs + F.log(smoothed / F.col(f"t{n}")) / BLEU_ORDER
    penalty = F.when(F.col("sys") >= F.col("ref"), 1.0).otherwise(
        F.exp(1 - F.col("ref") / F.col("sys"))
    )
    usable = (F.col("m1") > 0) & (F.col(f"t{BLEU_ORDER}") > 0)
    bleu = F.when(usable, 100 * penalty * F.exp(logs)).otherwise(0.0)
    return sums.select(*([by] if by else []), "sys", "ref", *[f"m{n}" for n in orders], bleu.alias("bleu"))


#: The modulus of the multiplicative hash that resampling weights come from.
PRIME = 2**31 - 1


def _drawn(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def replicate_factors(replicates: int, seed: int) -> list[tuple[int, int]]:
    """The hash ``(a * key + b) % PRIME`` of each replicate."""
    return [
        (1 + _drawn(f"a{r}-{seed}") % (PRIME - 1), _drawn(f"b{r}-{seed}") % PRIME) for r in range(replicates)
    ]


def poisson_steps() -> list[float]:
    """How often a row is drawn is the number of these that its uniform value reaches: a Poisson
    variable of mean 1."""
    steps, chance, total = [], math.exp(-1), 0.0
    for k in range(1, 15):
        total += chance
        steps.append(total)
        chance /= k
    return steps


def bootstrap_means(
    df: DataFrame, key: Sequence[str], metrics: Sequence[str], replicates: int = 1000, confidence: float = 0.95, seed: int = 42
) -> DataFrame:
    """``(metric, low, mid, high, mean)``: the mean of each metric over all rows, and the median and the
    confidence interval of its bootstrap means.

    A row enters a replicate as often as a Poisson variable says that is hashed from its unique
    ``key`` and the replicate, so nothing is drawn twice differently and no row meets another one. All
    replicates are summed up in one pass, each task sends ``replicates`` rows of fixed width. Rows
    with a null among the metrics are left out.
    """
    factors = np.array(replicate_factors(replicates, seed), np.int64)
    steps = np.array(poisson_steps())
    hashed = F.conv(F.left(F.md5(F.concat_ws("\x01", *[F.col(c).cast("string") for c in key])), F.lit(8)), 16, 10)
    rows = df.select((hashed.cast("long") % PRIME).alias("h"), *[F.col(m).cast("double").alias(m) for m in metrics]).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row counts every row once.
        sums = np.zeros((replicates + 1, 1 + len(metrics)))
        for batch in batches:
            keys = batch.column("h").to_numpy()
            values = np.column_stack([np.ones(len(keys)), *[batch.column(m).to_numpy() for m in metrics]])
            for at in range(0, len(keys), 1_000):
                uniform = ((factors[:, :1] * keys[None, at : at + 1_000] + factors[:, 1:]) % PRIME) / PRIME
                sums[:-1] += np.searchsorted(steps, uniform, side="right") @ values[at : at + 1_000]
            sums[-1] += values.sum(axis=0)
        numbers = pa.array(range(replicates + 1), pa.int32())
        yield pa.RecordBatch.from_arrays([numbers, *map(pa.array, sums.T)], ["r", "w", *metrics])

    fields = "r int, w double, " + ", ".join(f"`{m}` double" for m in metrics)
    drawn = rows.mapInArrow(run, fields).groupBy("r").agg(*[F.sum(c).alias(c) for c in ("w", *metrics)])
    at = [(1 - confidence) / 2, 0.5, (1 + confidence) / 2]
    is_plain = F.col("r") == replicates
    mean = lambda m: F.col(m) / F.nullif("w", F.lit(0.0))
    spans = drawn.agg(
        *[F.percentile(F.when(~is_plain, mean(m)), at).alias(m) for m in metrics],
        *[F.max(F.when(is_plain, mean(m))).alias(f"_{m}") for m in metrics],
    )
    named = lambda m: [F.get(m, F.lit(i)).alias(n) for i, n in enumerate(("low", "mid", "high"))]
    listed = [F.struct(F.lit(m).alias("metric"), *named(m), F.col(f"_{m}").alias("mean")) for m in metrics]
    return spans.select(F.inline(F.array(*listed)))


def generation_sample(df: DataFrame, order_by: str, limit: int | None = None) -> DataFrame:
    """The first ``limit`` pairs, a top-k to which each task sends at most ``limit`` rows; all
    pairs without a limit."""
    return df if limit is None else df.orderBy(order_by).limit(limit)
