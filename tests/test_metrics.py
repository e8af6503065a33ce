"""Classification and generation metrics against brute-force definitions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.operators import classification as M
from quillmill.operators import generation as G
from quillmill.operators.ranking import running_counts


def auc(pairs):
    hits, misses = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in hits for b in misses)
    return wins / (len(hits) * len(misses))


def average_precision(pairs):
    total = sum(y for _, y in pairs)
    area = 0.0
    for cut in {s for s, _ in pairs}:
        above = [y for s, y in pairs if s >= cut]
        area += sum(y for s, y in pairs if s == cut) / total * sum(above) / len(above)
    return area


def binary(spark, pairs, label="x"):
    df = spark.createDataFrame([(label, float(s), bool(y)) for s, y in pairs], "label string, score double, hit boolean")
    return M.score_counts(df, "label", "score", F.col("hit"))


@pytest.mark.parametrize("kind", ["ties", "distinct", "one_value", "clustered"])
def test_areas(spark, kind):
    rng = random.Random(3)
    draw = {
        "ties": lambda: rng.randrange(7) / 7,
        "distinct": rng.random,
        "one_value": lambda: 0.5,
        "clustered": lambda: 1e-9 * rng.random() if rng.random() < 0.9 else rng.random(),
    }[kind]
    pairs = [(draw(), rng.random() < 0.3) for _ in range(400)]
    for slice_rows in (30, 1_000_000):
        got = M.curve_areas(M.curve_counts(binary(spark, pairs), slice_rows)).first()
        assert got.roc_auc == pytest.approx(auc(pairs), abs=1e-12)
        assert got.pr_auc == pytest.approx(average_precision(pairs), abs=1e-12)
    flipped = M.curve_areas(M.curve_counts(binary(spark, [(-s, y) for s, y in pairs]))).first()
    assert flipped.roc_auc == pytest.approx(1 - got.roc_auc, abs=1e-12)


def test_one_class_is_left_out(spark):
    assert M.curve_areas(M.curve_counts(binary(spark, [(0.1, 1), (0.2, 1)]))).count() == 0


@pytest.mark.parametrize("slice_rows", [1, 20, 1000])
def test_running_counts_by_slice(spark, slice_rows):
    rng = random.Random(slice_rows)
    data = [(k, rng.random(), rng.randrange(5)) for k in "ab" for _ in range(150)]
    df = spark.createDataFrame(data, "k string, score double, v long")
    got = {(r.k, r.score): r.upto_v for r in running_counts(df, ["k"], "score", ["v"], slice_rows).collect()}
    assert got == {(k, s): sum(v2 for k2, s2, v2 in data if k2 == k and s2 >= s) for k, s, _ in data}


def test_scores_are_exploded_once(spark):
    rows = [(i % 3, [0.1 * i % 1, 0.2, 0.3]) for i in range(30)]
    plan = M.ovr_auc(multiclass(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "BroadcastNestedLoop" not in plan


def plain_corners(pairs):
    """``(fpr, tpr)`` per threshold, but for those at which both counts go on in equal steps."""
    steps = [(sum(s == t and y for s, y in pairs), sum(s == t and not y for s, y in pairs)) for t in sorted({s for s, _ in pairs}, reverse=True)]
    hits, misses = (sum(step[i] for step in steps) for i in (0, 1))
    points, p, n = [(0.0, 0.0)], 0, 0
    for i, step in enumerate(steps):
        p, n = p + step[0], n + step[1]
        if i in (0, len(steps) - 1) or steps[i + 1] != step:
            points.append((n / misses, p / hits))
    return sorted(points)


@pytest.mark.parametrize("slice_rows", [1, 7, 1000])
def test_corners_of_curves(spark, slice_rows):
    rng = random.Random(slice_rows)
    runs = [(rng.randrange(200) / 200, rng.random() < 0.5) for _ in range(90)] + [(2 + i / 64, i > 20) for i in range(60)]
    counts = binary(spark, runs, "a").unionByName(binary(spark, [(1, True), (0, False)], "b")).unionByName(binary(spark, [(1, True)], "c"))
    cumulated = M.curve_counts(counts, slice_rows)
    assert cumulated.select("_slice").distinct().count() >= {1: 30, 7: 2, 1000: 1}[slice_rows]
    got = M.roc_curve(M.corner_points(cumulated)).collect()
    assert sorted((r.fpr, r.tpr) for r in got if r.label == "a") == plain_corners(runs)
    assert sorted((r.fpr, r.tpr) for r in got if r.label == "b") == [(0, 0), (0, 1), (1, 1)]
    assert len(got) < M.roc_curve(cumulated).count() - 30 and {r.label for r in got} == {"a", "b"}


def test_a_million_scores(spark):
    """Slices follow the number of scores, and the areas are those of one pass over them."""
    scores = spark.range(1_000_000).select(
        F.lit("x").alias("label"), F.expr("pmod(id * 7919, 1000003) / 1000003").alias("score"), (F.xxhash64("id") % 3 == 0).alias("hit")
    )
    cumulated = M.curve_counts(M.score_counts(scores, "label", "score", F.col("hit")), slice_rows=10_000)
    sizes = [r["count"] for r in cumulated.groupBy("_slice").count().collect()]
    assert sum(sizes) == 1_000_000 and len(sizes) >= 100 and max(sizes) < 30_000
    rows = sorted(((r.score, r.hit) for r in scores.select("score", "hit").toLocalIterator()), reverse=True)
    hits, area = 0, 0
    for _, hit in rows:
        hits += hit
        area += 0 if hit else hits
    want = area / hits / (len(rows) - hits)
    assert M.curve_areas(cumulated).first().roc_auc == pytest.approx(want, abs=1e-9)


def test_curve_points(spark):
    counts = binary(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)])
    points = {(r.fpr, r.tpr) for r in M.roc_curve(M.curve_counts(counts)).collect()}
    assert points == {(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)}


def multiclass(spark, rows):
    return spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(rows)], "id long, y int, scores array<double>")


def test_normalize_looks_at_the_whole_table(spark):
    probs = [(0, [0.2, 0.8]), (1, [0.5, 0.5])]
    kept = M.normalize_scores(multiclass(spark, probs)).orderBy("id").collect()
    assert [r.scores for r in kept] == [s for _, s in probs]
    mixed = M.normalize_scores(multiclass(spark, [*probs, (0, [2.0, 0.0])])).orderBy("id").collect()
    assert mixed[0].scores == pytest.approx([1 / (1 + math.exp(0.6)), 1 / (1 + math.exp(-0.6))])
    one = spark.createDataFrame([(0.2,), (3.0,)], "scores double")
    assert sorted(r.scores for r in M.normalize_scores(one).collect()) == pytest.approx([1 / (1 + math.exp(-0.2)), 1 / (1 + math.exp(-3.0))])
    two = spark.createDataFrame([([0.9, 0.8],)], "scores array<double>")
    assert M.normalize_scores(two, multilabel=True).first().scores == pytest.approx([1 / (1 + math.exp(-v)) for v in (0.9, 0.8)])


def test_predict(spark):
    df = multiclass(spark, [(0, [0.4, 0.4, 0.2]), (2, [0.1, 0.2, 0.7])])
    assert [r.predicted for r in M.predict_labels(df).orderBy("id").collect()] == [0, 2]
    assert M.predict_labels(spark.createDataFrame([(0.5,)], "scores double")).first().predicted == 1
    assert M.predict_labels(spark.createDataFrame([([0.5, 0.4],)], "scores array<double>"), multilabel=True).first().predicted == [1, 0]


def test_reports_with_missing_classes(spark):
    truth, guess = [0, 0, 1, 1, 3], [0, 1, 1, 1, 1]
    df = spark.createDataFrame(list(zip(truth, guess)), "y int, predicted int")
    matrix = M.confusion_matrix(df, 5)
    assert matrix.count() == 25 and matrix.agg(F.sum("n")).first()[0] == 5
    rows = {r.label: r for r in M.per_class_report(matrix).collect()}
    assert (rows[0].precision, rows[0].recall, rows[1].precision, rows[1].recall) == (1.0, 0.5, 0.5, 1.0)
    assert (rows[2].f1, rows[2].support, rows[3].f1, rows[3].support) == (0.0, 0, 0.0, 1)
    summary = M.averaged_prf(M.per_class_report(matrix), 5).first()
    f1 = [2 / 3, 2 / 3, 0.0, 0.0, 0.0]
    assert summary.f1 == pytest.approx(sum(f1) / 3)
    assert summary.macro_f1 == pytest.approx(sum(f1) / 5)
    assert summary.weighted_f1 == pytest.approx((2 * f1[0] + 2 * f1[1]) / 5)
    two = M.averaged_prf(M.per_class_report(M.confusion_matrix(df.where("y < 2"), 2)), 2).first()
    assert (two.precision, two.recall) == (pytest.approx(2 / 3), 1.0)


def test_top_k_with_ties(spark):
    rows = [(0, [0.2] * 5 + [0.0]), (4, [0.2] * 5 + [0.0]), (5, [0.2] * 5 + [0.0])]
    assert M.top_k_accuracy(multiclass(spark, rows)).first()[0] == pytest.approx(2 / 3)
    assert M.top_k_accuracy(multiclass(spark, [(0, [1.0, 0.0])])).first()[0] is None


def test_one_vs_rest_and_micro(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), [rng.randrange(5) / 5 for _ in range(4)]) for _ in range(120)]
    df = multiclass(spark, rows)
    got = {r.label: r.roc_auc for r in M.ovr_auc(df).collect()}
    assert set(got) == {0, 1, 2}
    for k in got:
        assert got[k] == pytest.approx(auc([(s[k], y == k) for y, s in rows]))
    pooled = [(s[k], y == k) for y, s in rows for k in range(4)]
    assert M.micro_auc(df).first()[0] == pytest.approx(auc(pooled))


def test_multilabel(spark):
    rows = [([1, 0], [0.9, 0.6]), ([0, 0], [0.7, 0.1]), ([1, 0], [0.2, 0.3])]
    df = spark.createDataFrame([(y, s) for y, s in rows], "y array<int>, scores array<double>")
    predicted = M.predict_labels(df, multilabel=True)
    report = {r.label: r for r in M.multilabel_report(M.multilabel_counts(predicted)).collect()}
    assert (report[0].tn, report[0].fp, report[0].fn, report[0].tp) == (0, 1, 1, 1)
    assert M.accuracy(predicted).first()[0] == 0.0
    summary = M.multilabel_summary(M.multilabel_report(M.multilabel_counts(predicted))).first()
    assert (summary.precision, summary.recall, summary.macro_f1) == (pytest.approx(1 / 3), 0.5, 0.25)
    assert {r.label for r in M.multilabel_auc(df).collect()} == {0}


def test_status(spark):
    def status(rows, schema):
        return tuple(M.metric_status(spark.createDataFrame(rows, schema)).first())

    assert status([(1, 0.2), (0, 0.7)], "y int, scores double") == (2, "binary", 2, None)
    assert status([(3, 0.2)], "y int, scores double") == (1, "multiclass", 4, None)
    assert status([(None, 0.2)], "y int, scores double")[3] == "empty_targets"
    assert status([(1, None)], "y int, scores double") == (1, None, None, "empty_predictions")
    assert status([([1, 0], [0.1, 0.2, 0.3])], "y array<int>, scores array<double>") == (1, "multilabel", 2, "shape_mismatch")


def test_scalar_metrics(spark):
    rows = [("accuracy", 0.5), ("f1", float("nan")), ("roc_auc", float("inf")), ("other", 1.0), ("recall", None)]
    df = spark.createDataFrame(rows, "metric string, value double")
    assert [r.metric for r in M.scalar_metrics(df).collect()] == ["accuracy"]


def pairs_of(spark, rows):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(rows)], "id long, prediction string, reference string")


def test_token_f1_and_match(spark):
    rows = [("the", "an"), ("the", "cat"), ("a cat cat dog", "cat dog dog"), ("Yes!", "yes"), (None, "")]
    df = pairs_of(spark, rows)
    p, r = F.col("prediction"), F.col("reference")
    got = df.orderBy("id").select(G.token_f1(p, r), G.exact_match(p, r)).collect()
    assert [x[0] for x in got] == pytest.approx([1.0, 0.0, 2 / 3, 1.0, 1.0])
    assert [x[1] for x in got] == [1.0, 0.0, 0.0, 1.0, 1.0]


def test_perplexity(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1000.0), (2, float("nan")), (3, None)], "i int, loss double")
    got = [r[0] for r in df.orderBy("i").select(G.perplexity(F.col("loss"))).collect()]
    assert got == [pytest.approx(math.e), None, None, None]


def test_token_accuracy(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], [1, 5, -100, 7])], "p array<int>, l array<int>")
    shifted = df.select(G.token_accuracy(F.col("p"), F.col("l"), True)).first()[0]
    plain = df.select(G.token_accuracy(F.col("p"), F.col("l"))).first()[0]
    assert tuple(shifted) == (2, 2) and tuple(plain) == (0, 3)


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_rouge(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choices("abcd", k=rng.randrange(90))), " ".join(rng.choices("abce", k=rng.randrange(90)))) for _ in range(40)]
    rows += [("", ""), ("Hello, World!", "hello world"), ("x", "")]
    for got, (p, r) in zip(G.rouge_scores(pairs_of(spark, rows)).orderBy("id").collect(), rows):
        a, b = (["".join(c for c in w if c.isalnum()) for w in t.lower().split()] for t in (p, r))

        def f(common, m, n):
            return 2 * common / (m + n) if common else 0.0

        two = [Counter(zip(t, t[1:])) for t in (a, b)]
        assert got.rouge1 == pytest.approx(f(sum((Counter(a) & Counter(b)).values()), len(a), len(b)))
        assert got.rouge2 == pytest.approx(f(sum((two[0] & two[1]).values()), max(len(a) - 1, 0), max(len(b) - 1, 0)))
        assert got.rougeL == pytest.approx(f(lcs(a, b), len(a), len(b)))


def test_bleu(spark):
    same = pairs_of(spark, [("the cat sat on the mat .", "the cat sat on the mat.")])
    assert G.corpus_bleu(same).first().bleu == pytest.approx(100.0)
    short = pairs_of(spark, [("a b c d e", "a b c d e f g h")])
    assert G.corpus_bleu(short).first().bleu == pytest.approx(100 * math.exp(1 - 8 / 5))
    # Two orders without a match are smoothed by a half and a quarter.
    mixed = pairs_of(spark, [("a b x c d", "a b y c d")])
    want = 100 * math.exp((math.log(4 / 5) + math.log(2 / 4) + math.log(0.5 / 3) + math.log(0.25 / 2)) / 4)
    assert G.corpus_bleu(mixed).first().bleu == pytest.approx(want)
    assert G.corpus_bleu(pairs_of(spark, [("x", "y")])).first().bleu == 0.0
    df = spark.createDataFrame([("He said &quot;3.5%&quot; -\nno, x-y.",)], "t string")
    assert df.select(G.bleu_tokens(F.col("t"))).first()[0] == ["He", "said", '"', "3.5", "%", '"', "no", ",", "x-y", "."]


def test_bootstrap_means(spark):
    rng = random.Random(1)
    rows = [(f"k{i}", rng.gauss(0.4, 0.1), float(i % 2)) for i in range(900)]
    df = spark.createDataFrame([*rows, ("none", None, 1.0)], "id string, a double, b double")
    got = {r.metric: r for r in G.bootstrap_means(df, ["id"], ["a", "b"], 400).collect()}
    again = {r.metric: r for r in G.bootstrap_means(df.repartition(7), ["id"], ["a", "b"], 400).collect()}
    for metric, spread in (("a", 0.1), ("b", 0.5)):
        r, error = got[metric], spread / 30
        assert r.mean == pytest.approx(sum(row[1 if metric == "a" else 2] for row in rows) / 900, abs=1e-12)
        assert abs(r.mid - r.mean) < error / 3
        # 95 % of the means lie within 1.96 standard errors.
        assert r.high - r.low == pytest.approx(2 * 1.96 * error, rel=0.2)
        assert tuple(again[metric])[1:] == pytest.approx(tuple(r)[1:], abs=1e-12)
    other = G.bootstrap_means(df, ["id"], ["a"], 400, seed=7).first()
    assert other.low != got["a"].low and other.mean == pytest.approx(got["a"].mean)
    assert tuple(G.bootstrap_means(df.limit(0), ["id"], ["a"], 10).first()) == ("a", None, None, None, None)
