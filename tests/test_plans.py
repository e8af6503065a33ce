"""End-to-end evaluation and image preparation against values worked out by hand."""

import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import classification as M
from quillmill.operators import dialog as D
from quillmill.operators import heads
from quillmill.plans.evaluate import evaluate_classification, evaluate_generation
from quillmill.plans.images import prepare_image_dataset
from quillmill.plans.prepare import prepare_text_dataset


def metrics(found):
    return {r["metric"]: round(r["value"], 6) for r in found.metrics.collect()}


def test_binary_uses_the_second_probability(spark):
    rows = [(0, [0.9, 0.1]), (0, [0.4, 0.6]), (1, [0.3, 0.7]), (1, [0.2, 0.8]), (None, [0.5, 0.5])]
    found = evaluate_classification(spark.createDataFrame(rows, "y int, scores array<double>"))
    got = metrics(found)
    assert (found.task_type, found.num_classes, found.skipped) == ("binary", 2, None)
    assert (got["num_samples"], got["accuracy"], got["precision"], got["recall"]) == (4, 0.75, 0.666667, 1)
    assert (got["roc_auc"], got["pr_auc"]) == (1, 1) and "top_5_accuracy" not in got and "roc_auc_micro" not in got
    assert found.curves.count() == 5


def test_single_scores_and_names(spark):
    rows = [(0, -2.0), (1, 3.0), (1, -1.0)]
    found = evaluate_classification(spark.createDataFrame(rows, "y int, scores double"), labels=["no", "yes"])
    got = metrics(found)
    assert (got["accuracy"], got["recall"], got["roc_auc"]) == (0.666667, 0.5, 1)
    assert {(r["label"], r["name"], r["support"]) for r in found.per_class.collect()} == {(0, "no", 1), (1, "yes", 2)}
    decided = evaluate_classification(spark.createDataFrame([(0, 0), (2, 1), (7, 2)], "y int, scores int"), kind="labels")
    got = metrics(decided)
    assert (decided.task_type, decided.num_classes, got["accuracy"]) == ("multiclass", 8, 0.333333)
    assert "roc_auc" not in got and decided.curves is None


def test_multiclass_curves_hold_the_pooled_one(spark):
    rows = [(0, [5.0, 1.0, 0.0]), (1, [0.0, 4.0, 1.0]), (1, [3.0, 2.0, 0.0]), (9, [0.0, 0.0, 2.0])]
    found = evaluate_classification(spark.createDataFrame(rows, "y int, scores array<double>"))
    assert {r["label"] for r in found.curves.collect()} == {"0", "1", "micro"}
    assert {r["label"] for r in found.areas.collect()} == {"0", "1", "micro"}
    got = metrics(found)
    assert got["accuracy"] == 0.5 and 0 < got["roc_auc_micro"] <= 1 and got["roc_auc"] > 0.5
    # The row of an unknown class is still a wrong guess of class 2.
    assert {r["label"]: r["predicted"] for r in found.per_class.collect()} == {0: 2, 1: 1, 2: 1}


def test_multilabel_and_skips(spark):
    schema = "y array<int>, scores array<double>"
    rows = [([1, 0], [0.9, 0.2]), ([0, 1], [0.1, 0.4]), ([1, 1], [0.8, 0.7])]
    found = evaluate_classification(spark.createDataFrame(rows, schema))
    got = metrics(found)
    assert found.task_type == "multilabel" and (got["roc_auc"], got["pr_auc"]) == (1, 1)
    wrong = evaluate_classification(spark.createDataFrame([([1, 0], [0.9])], schema))
    assert wrong.skipped == "shape_mismatch" and metrics(wrong) == {"num_samples": 1}
    empty = evaluate_classification(spark.createDataFrame([], "y int, scores double"))
    assert empty.skipped == "empty_targets" and metrics(empty) == {"num_samples": 0}


def test_generation_gate(spark):
    pairs = spark.createDataFrame([("The cat sat.", "cat sat"), ("no", "yes"), (None, "x")], "prediction string, reference string")
    found = {r["metric"]: (r["value"], r["skipped"]) for r in evaluate_generation(pairs, goal="Summarize it").collect()}
    assert found["generation_sample_size"][0] == 2 and found["exact_match"][0] == 0.5
    assert found["rouge1"][0] == 0.4 and found["bleu"] == (None, "not_for_summarization")
    labels = {r["metric"]: r["skipped"] for r in evaluate_generation(pairs, subtype="classification").collect()}
    assert labels["rougeL"] == labels["bleu"] == "not_for_classification" and labels["token_f1"] is None
    for df, why in ((pairs.limit(0), "empty_generation_sample"), (pairs.drop("reference"), "missing_references_or_generations")):
        assert {r["skipped"] for r in evaluate_generation(df).collect()} == {why}


def rows_of(bundle):
    return sorted((r["label"], r["path"].rsplit("/", 1)[-1]) for r in bundle.images.collect())


def test_image_folder_table_and_archives(spark, tmp_path):
    names = ["set/cat/1.png", "set/cat/deep/2.JPG", "set/dog/3.gif", "set/dog/note.txt", "4.png", "read.me"]
    top = tmp_path / "top"
    for name in names:
        os.makedirs((top / name).parent, exist_ok=True)
        (top / name).write_bytes(b"x")
    wanted = [("cat", "1.png"), ("cat", "2.JPG"), ("dog", "3.gif")]
    for path in (str(top), f"file:{top}/"):
        bundle = prepare_image_dataset(spark, path)
        assert rows_of(bundle) == wanted
        assert [r["label"] for r in bundle.labels.collect()] == ["cat", "dog"]
        assert bundle.report.first()[1:] == (3, 2)
    (top / "sheet.csv").write_text("image,label\nset/cat/1.png,A b\nset/dog/3.gif,c\nset/gone.png,d\n")
    assert rows_of(prepare_image_dataset(spark, f"{top}/sheet.csv")) == [("A_b", "1.png"), ("c", "3.gif")]
    zips = tmp_path / "zips"
    zips.mkdir()
    for stem in ("cat", "dog.v1"):
        with zipfile.ZipFile(zips / f"{stem}.zip", "w") as archive:
            archive.writestr("a/x.png", b"x")
            archive.writestr("b/y.png", b"x")
            archive.writestr("b/y.txt", b"x")
    each = prepare_image_dataset(spark, str(zips), "zip")
    assert rows_of(each) == [("a", "x.png")] * 2 + [("b", "y.png")] * 2 and each.report.count() == 2
    classes = prepare_image_dataset(spark, str(zips), "zip", class_from_archive=True)
    assert {r["label"] for r in classes.labels.collect()} == {"cat", "dog.v1"}
    assert rows_of(prepare_image_dataset(spark, f"{zips}/cat.zip")) == [("a", "x.png"), ("b", "y.png")]
    with pytest.raises(ValueError):
        prepare_image_dataset(spark, f"{top}/set/cat")


def test_heads_learn(spark):
    df = spark.range(60).select(
        "id", (F.col("id") % 3).cast("int").alias("label"),
        F.array(*[F.when(F.col("id") % 3 == k, 3.0).otherwise(0.0) + (F.col("id") % 7) / 10 for k in range(3)]).alias("features"),
    )
    guessed = M.predict_labels(D.apply_head(D.train_head(df), df))
    assert guessed.where("predicted <> label").isEmpty()
    nearest = D.score_table(df, D.centroid_head(df, key="id"), "id long, predicted int, distance double")
    assert nearest.join(df, "id").where("predicted <> label").isEmpty() and nearest.count() == 60


def test_accounts_of_what_is_lost(spark):
    texts = [("long", "Word number one. " * 200 + "x" * 2_000), ("short", "too short"), ("copy", "Word number one. " * 200 + "x" * 2_000)]
    raw = spark.createDataFrame(texts, "id string, text string")
    plain = prepare_text_dataset(raw, "id", account=True).report.first()
    kept = prepare_text_dataset(raw, "id", account=True, lossless=True, limits=(None, None, None)).report.first()
    assert plain.lost_chars > 1_000 and plain.dropped_pairs == 0
    assert (kept.lost_chars, kept.dropped_pairs) == (0, 0)
    pairs = spark.createDataFrame([(1, "q" * 9, "a" * 9), (2, "q" * 9, "a" * 20), (3, "q" * 9, "a" * 20)], "id int, question string, answer string")
    report = prepare_text_dataset(pairs, "id", account=True).report.first()
    assert (report.dropped_pairs, report.duplicates) == (1, 1) and "lost_chars" not in report.asDict()
    assert prepare_text_dataset(pairs, "id", limits=(None, None, 25)).all_rows.count() == 1


def test_two_layers_learn_a_ring(spark):
    """What no linear head can tell apart, the same way in every fit."""
    pick = np.random.default_rng(5)
    angles, far = pick.uniform(0, 2 * np.pi, 400), np.where(np.arange(400) % 2, 1.0, 3.0) + pick.normal(0, 0.2, 400)
    points = [(i, [float(r * np.cos(a)), float(r * np.sin(a)), float(pick.normal())], "in" if i % 2 else "out") for i, (a, r) in enumerate(zip(angles, far))]
    df = spark.createDataFrame([*points, (900, None, "in"), (901, [0.0, 0.0, 0.0], None)], "id int, features array<double>, label string")
    head = heads.train_two_layer_head(df, hidden=16, steps=50)
    told = {r.id: r.scores and head.labels[int(np.argmax(r.scores))] for r in heads.apply_two_layer_head(head, df).collect()}
    assert told[900] is None and told[901] == "in"
    assert sum(told[i] == label for i, _, label in points) > 0.97 * len(points)
    assert head.losses[-1] < 0.3 * head.losses[0]
    linear = D.apply_head(D.train_head(df.where("features IS NOT NULL AND label IS NOT NULL").withColumn("label", (F.col("label") == "in").cast("int"))), df.where("id < 900"))
    right = sum((r.scores[1] > 0.5) == (r.label == "in") for r in linear.collect())
    assert right < 0.8 * len(points)
    again = heads.train_two_layer_head(df, hidden=16, steps=50)
    assert np.array_equal(again.weights, head.weights)


def test_gradients():
    pick = np.random.default_rng(2)
    rows, truth = pick.normal(size=(7, 3)), pick.integers(0, 4, 7)
    weights = pick.normal(size=(3 + 1) * 5 + (5 + 1) * 4)
    found = heads.gradient(weights, rows, truth, 5, 4)
    for i in range(len(weights)):
        step = np.zeros_like(weights)
        step[i] = 1e-6
        slope = (heads.gradient(weights + step, rows, truth, 5, 4)[-1] - heads.gradient(weights - step, rows, truth, 5, 4)[-1]) / 2e-6
        assert found[i] == pytest.approx(slope, abs=1e-5)


def test_batches_of_a_head(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("int").alias("label"), F.array((F.col("id") % 2) * 2.0 + F.col("id") / 300).alias("features"))
    head = heads.train_two_layer_head(df, hidden=4, steps=24, batches=3)
    assert len(head.losses) == 24 and head.losses[-1] < head.losses[0]
    with pytest.raises(ValueError):
        heads.train_two_layer_head(df.limit(0))
