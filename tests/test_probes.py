"""Inputs on which an earlier version gave a wrong answer."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.operators import classification as M
from quillmill.operators import corpus as C
from quillmill.operators import runs as R
from quillmill.sources import images, readers, sinks


def test_rows_may_own_a_data_list(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"q": "a", "data": [1, 2]}, {"q": "b", "data": [3]}]')
    got = readers.read_json_documents(spark, str(tmp_path / "a.json")).orderBy("q").collect()
    assert [(r["q"], r["data"]) for r in got] == [("a", [1, 2]), ("b", [3])]


def test_wrapped_rows_beside_a_text_of_that_name(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"q": "a"}, {"q": "b"}]}')
    (tmp_path / "b.json").write_text('{"data": "plain", "q": "c"}')
    got = readers.read_json_documents(spark, str(tmp_path)).collect()
    assert sorted(r["q"] for r in got) == ["a", "b", "c"]


def test_json_lines_in_an_archive_are_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as out:
        out.writestr("x.jsonl", '{"q": "a", "data": [1, 2]}\n{"q": "b", "data": [3]}\n')
    got = readers.read_any(spark, str(tmp_path / "a.zip")).orderBy("q").collect()
    assert [(r["q"], r["data"]) for r in got] == [("a", [1, 2]), ("b", [3])]


def test_images_below_a_plain_path(spark, tmp_path):
    for name in ("cat/1.jpg", "dog/2.png", "dog/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = readers.list_files(spark, str(tmp_path))
    for root in (str(tmp_path), f"file:{tmp_path}"):
        got = images.image_inventory(files, root).collect()
        assert sorted(r["label"] for r in got) == ["cat", "dog"]
    table = spark.createDataFrame([("cat/1.jpg", "a"), ("missing.jpg", "b")], "image string, label string")
    assert [r["label"] for r in images.image_manifest(table, files, str(tmp_path)).collect()] == ["a"]


def test_labels_outside_the_classes_still_count(spark):
    rows = spark.createDataFrame([(0, 0), (7, 0), (1, 1), (1, 9)], "y int, predicted int")
    report = M.per_class_report(M.confusion_matrix(rows, 2, outside=True)).orderBy("label").collect()
    assert [(r["label"], r["precision"], r["recall"]) for r in report] == [(0, 0.5, 1.0), (1, 1.0, 0.5)]
    assert M.confusion_matrix(rows, 2).agg(F.sum("n")).first()[0] == 2


def test_metrics_show_whole_numbers_and_texts(spark):
    runs = spark.createDataFrame([(1, 67, "binary", 0.5, None)], "run_id int, train_rows long, task_type string, accuracy double, f1 double")
    got = R.unpivot_metrics(runs, ["run_id"], ["train_rows", "task_type", "accuracy", "f1"]).collect()
    assert {r["metric"]: r["display"] for r in got} == {"train_rows": "67", "task_type": "binary", "accuracy": "50.00%", "f1": "—"}


def test_the_id_is_no_prompt(spark):
    rows = spark.createDataFrame([("c1", "What is it?", "A long enough answer.")], "context_id string, question string, answer string")
    pairs, used, _ = C.to_instruction_output(rows, "context_id")
    assert used["prompt"] == "question" and pairs.first()["instruction"] == "What is it?"


def test_nan_at_every_depth(spark, tmp_path):
    row = spark.range(1).select(
        F.expr("named_struct('a', double('NaN'), 'b', 1.0D)").alias("s"),
        F.expr("array(named_struct('c', double('Infinity')))").alias("l"),
        F.expr("map('k', double('NaN'))").alias("m"),
    )
    sinks.write_metrics_json(row, str(tmp_path / "out"))
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {"s": {"a": None, "b": 1.0}, "l": [{"c": None}], "m": {"k": None}}


def test_unknown_sizes(spark):
    items = spark.createDataFrame(
        [("a", 0.5, 1.0, None, None, 0), ("b", None, 1.0, None, None, 1)],
        "id string, params_b double, vram_min_gb double, vram_qlora_gb double, recommended_for array<string>, position int",
    )
    asks = [(1, "high_gpu", 8.0, "performance", None), (2, "high_gpu", 8.0, "memory", None)]
    requests = spark.createDataFrame(asks, "request_id int, tier string, capacity double, objective string, override string")
    got = {r.request_id: r.choice for r in R.best_fit_match(requests, R.catalog_items(items)).collect()}
    assert got == {1: "a", 2: "a"}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quillmill import session

    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.shared_dir(Unset)
