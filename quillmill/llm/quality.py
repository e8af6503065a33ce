"""Quality classifier by Bradley-Terry pairwise ranking.

A document of label 1 is preferred to one of label 0. From such preference pairs logistic loss on
the difference of their features learns one weight per feature; the weighted sum ranks documents.
The cut lies at the score quantile that the share of label 0 sets, and scores are shifted so that
the cut is at CUT and squashed to 0..1.

The model is fitted on every labelled row that may be learned from: each takes part in the pairs and
in the quantile. Features, pairs and sums over them are Spark's work; the driver gets the sums of one
step, which have the size of the model. Scores depend on the text alone. Null texts are empty and get a score like any other;
documents whose labels contradict each other, and labels other than 0 and 1, are not learned from;
rows with one id are learned from once. If a label is missing there is nothing to compare: every
document then scores 1.0 (no label 0) or 0.0 (no label 1, but label 0). Other columns are kept, and
empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm import common
from quillmill.operators.ranking import broadcast_if

#: Preference pairs per document of the rarer label, at least; the others have one each, at least.
PAIRS = 24
#: Weights are rounded to so many places: the order of a sum changes those behind them.
PLACES = 10
CUT = 0.7
_SYMBOLS = np.frombuffer(b"#*$%&|<>~^=_{}[]\\", np.uint8)
_MARKS = np.frombuffer(b".,;:?'\"-()", np.uint8)


def features(text: str) -> list[float]:
    """Shares that hardly depend on the length or the language of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = max(1, len(words))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    letters = max(1, upper + lower + int(counts[128:].sum()) // 2)
    lines = [line for line in data.split(b"\n") if line.strip()]
    per_word = lambda found: min(float(found) / n, 2.0)
    distinct = len(set(words))
    return [
        upper / letters,
        lower / letters,
        per_word(counts[_SYMBOLS].sum()),
        per_word(counts[124]),
        per_word(counts[33]),
        per_word(counts[_MARKS].sum()),
        per_word(counts[46]),
        sum(map(eq, words, words[1:])) / n,
        distinct / n,
        float(np.log1p(distinct) / np.log1p(n)),
        min(letters / n, 20.0) / 20.0,
        int(counts[48:58].sum()) / max(1, len(data)),
        1.0 - len(set(lines)) / max(1, len(lines)),
        float(len(words) < 5),
    ]


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _sums(gaps: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, summed over pairs."""
    lost = 1.0 / (1.0 + np.exp(np.clip(gaps @ weights, -30, 30)))
    return gaps.T @ lost, (gaps * (lost * (1.0 - lost))[:, None]).T @ gaps


def _newton(sums: Callable, width: int, pairs: int) -> np.ndarray:
    """Weights of the logistic loss over preference pairs, by Newton steps with a small ridge."""
    weights, ridge = np.zeros(width), 1e-3 * pairs
    for _ in range(30):
        slope, curve = sums(weights)
        step = np.linalg.solve(curve + ridge * np.eye(width), slope - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def _rank(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The weights from feature rows at hand."""
    pick = np.random.default_rng(7)
    pairs = PAIRS * min(len(good), len(bad))
    gaps = good[pick.permutation(pairs) % len(good)] - bad[pick.permutation(pairs) % len(bad)]
    return _newton(lambda weights: _sums(gaps, weights), gaps.shape[1], pairs)


def preference_pairs(features_of: DataFrame, good: int, bad: int) -> DataFrame:
    """``gap``: the features of a label 1 document less those of a label 0 one, for pairs that every
    row of ``features_of(l_id, label, x)`` takes part in.

    Both labels are numbered in the order of a hash. A document of the more frequent one meets the same
    number of rarer ones, next to each other and going round, so these are met equally often.
    """
    often, rare = (1, 0) if good >= bad else (0, 1)
    n_often, n_rare = max(good, bad), min(good, bad)
    each = max(1, -(-PAIRS * n_rare // n_often))

    def numbered(label: int) -> DataFrame:
        rows = features_of.where(F.col("label") == label).select("l_id", F.col("x").alias(f"x{label}"))
        return common.global_rank(rows, [F.xxhash64("l_id"), F.col("l_id")], f"at{label}", f"label-{label}")

    at = F.explode(F.sequence(F.col(f"at{often}") * each, F.col(f"at{often}") * each + (each - 1)))
    many = numbered(often).select(f"x{often}", at.alias("at")).withColumn("at", F.col("at") % n_rare)
    few = numbered(rare).select(f"x{rare}", F.col(f"at{rare}").alias("at"))
    met = many.join(broadcast_if(few, n_rare), "at")
    return met.select(F.zip_with("x1", "x0", lambda one, zero: one - zero).alias("gap"))


def _rows_of(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(pairs: DataFrame, spread: np.ndarray) -> Callable:
    """The sums over a table of pairs, by tasks; a row of the size of the model comes from each."""
    width = len(spread)

    def sums(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, curve = np.zeros(width), np.zeros((width, width))
            for batch in batches:
                more = _sums(_rows_of(batch.column(0), width) / spread, weights)
                slope, curve = slope + more[0], curve + more[1]
            yield pa.RecordBatch.from_pydict({"slope": [slope.tolist()], "curve": [curve.ravel().tolist()]})

        rows = pairs.mapInArrow(run, "slope array<double>, curve array<double>").collect()
        return np.sum([r["slope"] for r in rows], axis=0), np.sum([r["curve"] for r in rows], axis=0).reshape(width, width)

    return sums


def values_at(values: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values at ``ranks`` (from 0) of a column in rising order, exactly; copies are counted, not sorted."""
    counts = values.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    parts = common.partitions(values.sparkSession)
    ranged = common.staged(counts.repartitionByRange(parts, value).withColumn("_range", F.spark_partition_id()), "values")
    inside = F.sum("_c").over(Window.partitionBy("_range").orderBy(value))
    begin, found = 0, {}
    for part in sorted(ranged.groupBy("_range").agg(F.sum("_c").alias("rows")).collect(), key=lambda r: r["_range"]):
        here = [r for r in ranks if begin <= r < begin + part["rows"]]
        if here:
            upto = ranged.where(F.col("_range") == part["_range"]).select(value, "_c", (inside + begin).alias("_upto"))
            at = [(F.col("_upto") - F.col("_c") <= r) & (F.col("_upto") > r) for r in here]
            row = upto.agg(*[F.max(F.when(hit, F.col(value))) for hit in at]).first()
            found |= dict(zip(here, row))
        begin += part["rows"]
    return [found[r] for r in ranks]


class Model:
    """``score = squash(weights . features + shift)``."""

    def __init__(self, weights: np.ndarray, shift: float) -> None:
        self.weights, self.shift = weights, shift

    @classmethod
    def cut_at(cls, weights: np.ndarray, edge: np.ndarray) -> Model:
        """With the cut in the widest gap between the neighbouring scores of ``edge``."""
        gap = int(np.argmax(np.diff(edge)))
        return cls(weights, float(np.log(CUT / (1 - CUT)) - (edge[gap] + edge[gap + 1]) / 2))

    @classmethod
    def fit(cls, good: np.ndarray, bad: np.ndarray, good_rows: int, bad_rows: int) -> Model:
        """From feature rows of both labels at hand and the number of rows that they stand for."""
        both = np.concatenate([good, bad])
        spread = np.maximum(both.std(axis=0), 1e-3)
        weights = _rank(good / spread, bad / spread) / spread
        scores = both @ weights
        mass = np.repeat([good_rows / len(good), bad_rows / len(bad)], [len(good), len(bad)])
        order = np.argsort(scores, kind="stable")
        below = np.searchsorted(np.cumsum(mass[order]), bad_rows, side="left")
        return cls.cut_at(weights, scores[order][max(0, below - 1) : below + 2])

    def score(self, text: str) -> float:
        raw = float(np.dot(self.weights, features(text))) + self.shift
        return 1.0 / (1.0 + float(np.exp(-max(-500.0, min(500.0, raw)))))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | float:
    """The model, or the constant score if a label is missing. Runs a few jobs and one per Newton step."""
    known = (
        labels.select(F.col(id_col).alias("l_id"), F.col("quality").cast("int").alias("label"))
        .where(F.col("l_id").isNotNull() & F.col("label").isin(0, 1))
        .where(~held_out("l_id"))
        .groupBy("l_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where(F.col("label") == F.col("other"))
        .select("l_id", "label")
    )
    # Features are taken before the join: they are shuffled, not texts.
    measure, width = common.per_value(features, "array<double>"), len(features(""))
    shares = df.where(~held_out(id_col)).select(F.col(id_col).alias("d_id"), measure(common.text_of(text_col)).alias("x"))
    learned = shares.join(known, F.col("d_id") == F.col("l_id")).groupBy("l_id", "label").agg(F.min("x").alias("x"))
    learned = common.staged(learned, "label-features")
    of_x = [F.col("x")[i] for i in range(width)]
    facts = learned.agg(
        F.count_if(F.col("label") == 1).alias("good"),
        F.count_if(F.col("label") == 0).alias("bad"),
        F.array(*[F.stddev_pop(x) for x in of_x]).alias("spread"),
    ).first()
    good, bad = facts["good"], facts["bad"]
    if not bad:
        return 1.0
    if not good:
        return 0.0
    spread = np.maximum(np.array(facts["spread"], dtype=float), 1e-3)
    pairs = common.staged(preference_pairs(learned, good, bad), "preference-pairs")
    weights = _newton(_summed(pairs, spread), width, pairs.count()) / spread
    weights = np.round(weights, PLACES)
    score = common.per_value(lambda x: float(np.dot(weights, x)), "double")
    # The scores around the last of as many as have label 0.
    ranks = list(range(max(0, bad - 2), bad + 1))
    return Model.cut_at(weights, np.array(values_at(learned.select(score("x").alias("s")), "s", ranks)))


def with_score(df: DataFrame, model: Model | float, text_col: str = "text", score: str = "score") -> DataFrame:
    """Add the score of every whole text; row-local."""
    if isinstance(model, float):
        return df.withColumn(score, F.lit(model))
    return df.withColumn(score, common.per_value(lambda text: model.score(text), "double")(common.text_of(text_col)))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents at or above the cut, with the columns of ``df``."""
    scored = with_score(df, train(df, labels, id_col, text_col), text_col, "_quality_score")
    return scored.where(F.col("_quality_score") >= CUT).select(*df.columns)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs, model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
