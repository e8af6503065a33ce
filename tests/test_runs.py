"""Logs, verdicts, attempts, metric tables, matching."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import runs as R

LOGS = "run_id long, seq long, msg string"


def test_log_events(spark):
    lines = [
        (1, 3, "CUDA out of memory. " + "x" * 200),
        (1, 2, "worker OOM"),
        (1, 5, "boom room banana"),
        (2, 1, "loss is NaN"),
        (2, 2, "{'train_loss': 0.5}"),
        (2, 3, "eval_loss: 2 loss=9"),
        (2, 4, "loss=1.2.3"),
        (2, 5, "loss=1e-5"),
        (3, 1, "nanny financial"),
    ]
    rows = {r.run_id: r for r in R.extract_log_events(spark.createDataFrame(lines, LOGS)).collect()}
    assert rows[1].oom_detected and rows[1].oom_event == "OOM: worker OOM" and not rows[1].nan_loss_detected
    assert rows[2].nan_event == "NaN: loss is NaN" and rows[2].losses == 3
    assert not rows[3].nan_loss_detected and not rows[3].oom_detected
    losses = spark.createDataFrame(lines, LOGS).select("seq", R.log_signals(F.col("msg"))[2]).where("loss is not null")
    assert {(r.seq, r.loss) for r in losses.collect()} == {(2, 0.5), (3, 2.0), (5, 1.0)}


def trend(losses):
    if len(losses) < 4:
        return "unknown"
    mid = len(losses) // 2
    delta = sum(losses[mid:]) / (len(losses) - mid) - sum(losses[:mid]) / mid
    return "improving" if delta < -0.05 else "diverging" if delta > 0.10 else "stable"


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_trends(spark, width):
    rng = random.Random(width)
    series = {1: [1.0] * 3, 2: [1, 1, 0.9, 0.9], 3: [1, 1, 1.2, 1.2], 4: [1, 1, 1, 1.1, 1.1], 5: [round(rng.random(), 2) for _ in range(41)]}
    lines = [(k, i * 2, f"loss={v}") for k, vs in series.items() for i, v in enumerate(vs)]
    got = {r.run_id: r.trend for r in R.loss_trend(spark.createDataFrame(lines, LOGS), width=width).collect()}
    assert got == {k: trend(v) for k, v in series.items()}


def test_health(spark):
    logs = spark.createDataFrame([(1, i, "loss=0.5") for i in range(4)], LOGS)
    metrics = spark.createDataFrame([(1, 0.0, 0.7), (2, 0.3, 0.9), (3, None, None)], "run_id long, eval_loss double, train_loss double")
    rows = {r.run_id: r for r in R.training_health(logs, metrics).collect()}
    assert (rows[1].final_loss, rows[1].loss_trend) == (0.7, "stable")
    assert (rows[2].final_loss, rows[2].loss_trend, rows[2].events) == (0.3, "unknown", [])
    assert rows[3].final_loss is None


def test_text_verdict(spark):
    cases = [(20.0, 0.5, False, 100), (20.01, 0.49, True, 99), (50.0, None, False, 500), (50.01, 0.4, True, 10), (None, None, None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "run_id int, perplexity double, token_accuracy double, generated_qa boolean, train_rows long")
    rows = [(r.verdict, r.score, r.retrain_suggested) for r in R.text_verdict(df).orderBy("run_id").collect()]
    assert rows == [("pass", 100.0, False), ("warn", 40.0, False), ("warn", 80.0, False), ("suggest_retrain", 20.0, True), ("pass", 85.0, False)]


def test_image_verdict(spark):
    cases = [(0.55, 0.9, None, 200, 3), (0.70, 0.0, 0.4, 200, 3), (0.54, 0.1, None, 10, 9), (None, None, None, None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "run_id int, accuracy double, f1 double, macro_f1 double, num_images long, num_classes int")
    rows = R.image_verdict(df).orderBy("run_id").collect()
    assert [(r.verdict, r.score) for r in rows] == [("warn", 80.0), ("pass", 85.0), ("suggest_retrain", 20.0), ("pass", 80.0)]
    assert "merge_classes" in rows[2].recommendations


def test_best_attempt(spark):
    bad, warn, good = "suggest_retrain", "warn", "pass"
    table = {1: [bad, bad, warn], 2: [bad, warn, good], 3: [warn, warn, bad], 4: [good], 5: [warn, bad, good], 6: [bad, good, warn]}
    rows = [(k, i, v) for k, vs in table.items() for i, v in enumerate(vs)]
    got = R.best_attempt(spark.createDataFrame(rows, "original_id int, attempt int, verdict string")).collect()
    assert {(r.original_id, r.best_attempt, r.best_verdict) for r in got} == {
        (1, 2, warn), (2, 1, warn), (3, 0, warn), (4, 0, good), (5, 2, good), (6, 1, good)
    }


def test_display(spark):
    df = spark.createDataFrame([(1, 0.12345, 2.0, 7.0, None, 0.5)], "run_id int, accuracy double, perplexity double, token_count double, f1 double, my_metric double")
    rows = {r.metric: r for r in R.unpivot_metrics(df, ["run_id"], df.columns[1:]).collect()}
    assert [rows[m].display for m in df.columns[1:]] == ["12.34%", "2.0000", "7", "—", "0.5000"]
    assert (rows["my_metric"].label, rows["my_metric"].metric_group, rows["my_metric"].kind) == ("My Metric", "Other", "raw")


def test_diagnostics(spark):
    data = spark.createDataFrame([(1, 99.5), (2, 50.0)], "run_id int, quality_score double")
    training = spark.createDataFrame([(1, "stable")], "run_id int, loss_trend string")
    verdicts = spark.createDataFrame([(1, "pass")], "run_id int, verdict string")
    plans = spark.createDataFrame([(1, "m")], "run_id int, model string")
    rows = {r.run_id: json.loads(r.diagnostics) for r in R.run_diagnostics(data, training, verdicts, plans).collect()}
    assert rows[1] == {"data": {"quality_score": 99.5}, "model": {"model": "m"}, "training": {"loss_trend": "stable"}, "evaluation": {"verdict": "pass"}}
    assert rows[2] == {"data": {"quality_score": 50.0}}


def choose(items, tier, capacity, objective, override):
    if override:
        return override
    fit = [i for i in items if (i["cpu_ok"] if tier == "cpu" else i["need"] <= capacity)] or items[:1]
    if objective == "performance" and tier in ("mid_gpu", "high_gpu"):
        return max(fit, key=lambda i: i["size"])["id"]
    if objective == "memory":
        return min(fit, key=lambda i: i["size"])["id"]
    return sorted(fit, key=lambda i: i["size"])[len(fit) // 2]["id"]


@pytest.mark.parametrize("seed", range(4))
def test_matching(spark, seed):
    rng = random.Random(seed)
    items = [
        {"id": f"m{i}", "need": float(rng.randrange(1, 9)), "size": rng.choice([0.5, 1.0, 3.0, 7.0]), "position": i, "cpu_ok": rng.random() < 0.3 * (seed > 0)}
        for i in range(12)
    ]
    catalog = spark.createDataFrame([tuple(i.values()) for i in items], "id string, need double, size double, position int, cpu_ok boolean")
    asks = [
        (n, rng.choice(["cpu", "low_gpu", "mid_gpu", "high_gpu"]), rng.choice([0.0, 1.0, 2.5, 8.0, 50.0]), rng.choice(["performance", "memory", "balanced"]), rng.choice([None, None, None, "mine", ""]))
        for n in range(80)
    ]
    requests = spark.createDataFrame(asks, "request_id int, tier string, capacity double, objective string, override string")
    got = {r.request_id: r.choice for r in R.best_fit_match(requests, catalog).collect()}
    assert got == {n: choose(items, *rest) for n, *rest in asks}


@pytest.mark.parametrize("least_rows", [1, 7, 1000])
def test_matching_of_catalogs_in_slices(spark, monkeypatch, least_rows):
    """Slices and buckets of any size choose as the plain rules do."""
    monkeypatch.setattr("quillmill.operators.matching.LEAST_ROWS", least_rows)
    rng = random.Random(least_rows)
    names = ["id", "need", "size", "position", "cpu_ok"]
    items = [
        (f"m{i}", rng.choice([1.0, 2.5, 4.0, rng.random() * 9]), rng.choice([None, 1.0, 2.0, rng.random() * 5]), i, rng.random() < 0.3)
        for i in range(60)
    ]
    catalog = spark.createDataFrame(items, "id string, need double, size double, position int, cpu_ok boolean")
    asks = [
        (n, rng.choice(["cpu", "low_gpu", "mid_gpu", "high_gpu"]), rng.choice([0.1, 2.5, rng.random() * 10, 4.0]), rng.choice(["performance", "memory", "x"]), rng.choice([None, None, "", "own"]))
        for n in range(150)
    ]
    requests = spark.createDataFrame(asks, "request_id int, tier string, capacity double, objective string, override string")
    got = {r.request_id: r.choice for r in R.best_fit_match(requests, catalog, small_rows=0).collect()}
    small = {r.request_id: r.choice for r in R.best_fit_match(requests, catalog).collect()}
    # An unknown size counts as 0, or as 999 among the smallest.
    known = lambda objective: [
        dict(zip(names, i)) | {"size": (999.0 if objective == "memory" else 0.0) if i[2] is None else i[2]} for i in items
    ]
    assert got == small == {n: choose(known(rest[2]), *rest) for n, *rest in asks}


def test_matching_takes_a_large_catalog(spark):
    big = spark.range(5000).selectExpr("cast(id as string) id", "id * 1.0D need", "if(id = 7, null, id * 1.0D) size", "id position", "id < 9 cpu_ok")
    asks = [(1, "high_gpu", 4000.5, "performance", None), (2, "high_gpu", 4000.5, "memory", None), (3, "low_gpu", 10.0, "other", None), (4, "cpu", 0.0, "memory", None)]
    requests = spark.createDataFrame(asks, "request_id int, tier string, capacity double, objective string, override string")
    got = {r.request_id: r.choice for r in R.best_fit_match(requests, big).collect()}
    assert got == {1: "4000", 2: "0", 3: "4", 4: "0"}


def test_catalog_rows(spark):
    raw = spark.createDataFrame(
        [("a", 0.5, 2.0, 1.0, ["demo"], 0), ("b", 7.0, 16.0, None, ["cpu"], 1), ("c", 14.0, None, None, None, 2)],
        "id string, params_b double, vram_min_gb double, vram_qlora_gb double, recommended_for array<string>, position int",
    )
    got = [(r.need, r.cpu_ok) for r in R.catalog_items(raw).orderBy("position").collect()]
    assert got == [(1.0, True), (16.0, True), (999.0, False)]


def test_levels_of_a_bucket_are_dealt(spark):
    """A bucket that all levels ask for is worked on in pieces; its items are in each of them."""
    from quillmill.operators.matching import deal_levels

    fields = "on string, bucket long, n long, rank long, place long"
    held = spark.createDataFrame([("gpu", 3, n, n, -1) for n in range(1, 11)], fields)
    asked = spark.createDataFrame([("gpu", 3, n, None, 0) for n in range(1, 201)], fields)
    rows = deal_levels(held, asked, 10).collect()
    pieces = {r.piece for r in rows}
    assert sorted(r.n for r in rows if r.place == 0) == list(range(1, 201))
    for piece in pieces:
        mine = [r for r in rows if r.piece == piece]
        assert len(mine) <= 30 and sum(r.place == -1 for r in mine) == 10
