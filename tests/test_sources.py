"""Readers, image tables, sinks and streams on small hand-made files."""

import glob
import os
import datetime as dt
import json
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmill.operators import runs as R
from quillmill.sources import images, readers, sinks
from quillmill.streaming import jobs, monitor


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv_cells(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'id,text\n007,"two\nlines, ""quoted"""\nNA,nan\n1,\n')
    assert rows(readers.read_delimited(spark, path)) == sorted([("007", 'two\nlines, "quoted"'), (None, None), ("1", None)], key=repr)


def test_latin_1_and_unlike_headers(spark, tmp_path):
    put(tmp_path / "a.csv", "id,text\n1,été\n")
    put(tmp_path / "b b.CSV", "id,text\n2,été\n".encode("latin-1"))
    put(tmp_path / "sub/c.csv", "text,extra\nx,y\n")
    got = {(r.id, r.text, r.extra) for r in readers.read_dataset_dir(spark, str(tmp_path)).collect()}
    assert got == {("1", "été", None), ("2", "été", None), (None, "x", "y")}


def test_only_cells_that_span_lines_stop_splitting(spark, tmp_path):
    put(tmp_path / "a.csv", 'id,text\n1,"x, ""y"""\n')
    put(tmp_path / "b.csv", 'id,text\n2,"x\ny"\n')
    files = readers._profile_lines(spark, str(tmp_path), "csv").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.spans) for r in files) == [("a.csv", False), ("b.csv", True)]
    got = {(r.id, r.text) for r in readers.read_delimited(spark, str(tmp_path), "csv").collect()}
    assert got == {("1", 'x, "y"'), ("2", "x\ny")}


def test_known_schema_reads_once(spark, tmp_path):
    path = put(tmp_path / "a.csv", "id,text\n1,x\n")
    assert readers.read_delimited(spark, path, encoding="UTF-8", schema="id long, text string").first().id == 1


def test_tab_files(spark, tmp_path):
    assert rows(readers.read_any(spark, put(tmp_path / "a.tab", "a\tb\n1\t2\n"))) == [("1", "2")]


@pytest.mark.parametrize(
    "payload",
    [[{"a": 1}, {"a": 2}], {"data": [{"a": 1}, {"a": 2}], "note": "n"}, {"records": [{"a": 1}, {"a": 2}]}],
)
def test_json_shapes(spark, tmp_path, payload):
    path = put(tmp_path / "a.json", json.dumps(payload, indent=1))
    assert rows(readers.read_json_documents(spark, path).select("a")) == [(1,), (2,)]


def test_json_object_and_scalar(spark, tmp_path):
    assert readers.read_json_documents(spark, put(tmp_path / "o.json", '{"a": 1, "b": "x"}')).count() == 1
    with pytest.raises(Exception):
        readers.read_json_documents(spark, put(tmp_path / "s.json", "5")).collect()


def test_jsonl(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    assert rows(readers.read_any(spark, path)) == [(1,), (2,)]
    bad = put(tmp_path / "b.jsonl", '{"a": 1}\nnope\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, bad).collect()
    assert rows(readers.read_jsonl(spark, bad, strict=False)) == sorted([(None, 1), ("nope", None)], key=repr)


def test_texts(spark, tmp_path):
    put(tmp_path / "a.txt", "  two\n words ")
    put(tmp_path / "b.MD", "été".encode("latin-1"))
    put(tmp_path / "c.rst", " \n ")
    put(tmp_path / "d.bin", "no")
    assert sorted(r.text for r in readers.read_any(spark, str(tmp_path)).collect()) == ["two words", "été"]


def test_tables_win_over_texts(spark, tmp_path):
    put(tmp_path / "a.txt", "text")
    put(tmp_path / "b.jsonl", '{"a": 1}\n')
    assert rows(readers.read_any(spark, str(tmp_path))) == [(1,)]


def test_what_cannot_be_read(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_any(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        readers.read_any(spark, put(tmp_path / "a.xyz", "x"))


def archive(path, members):
    with zipfile.ZipFile(path, "w") as out:
        for name, data in members.items():
            out.writestr(name, data)
    return str(path)


def test_zip(spark, tmp_path):
    path = archive(tmp_path / "a.zip", {"x/a.txt": " one ", "b.md": "two", "c.png": b"\x89"})
    assert readers.read_zip_members(spark, path).count() == 3
    assert sorted(r.text for r in readers.read_any(spark, path).collect()) == ["one", "two"]


def test_zip_with_tables(spark, tmp_path):
    members = {"a.csv": "id,text\n1,x\nNA,y\n", "b.json": '{"data": [{"id": "2", "n": 1.5}]}', "c.jsonl": '{"id": "3"}\n\n{"id": "4"}\n', "d.txt": "no"}
    got = readers.read_any(spark, archive(tmp_path / "a.zip", members))
    assert rows(got.select("id", "text", "n")) == sorted([("1", "x", None), (None, "y", None), ("2", None, 1.5), ("3", None, None), ("4", None, None)], key=repr)


@pytest.mark.parametrize("name", ["../evil.txt", "/abs.txt", "a/../../b.txt"])
def test_zip_that_leads_outside(spark, tmp_path, name):
    with pytest.raises(Exception, match="unsafe path"):
        readers.read_zip_members(spark, archive(tmp_path / "a.zip", {name: "x"})).collect()


def test_union_sources(spark, tmp_path):
    one, two = put(tmp_path / "p/a.csv", "id,t\n1,x\n"), put(tmp_path / "q/a.csv", "id,u\n2,y\n")
    got = readers.union_sources(spark, [one, two])
    assert rows(got.select("source_id", "id", "t", "u")) == [(0, "1", "x", None), (1, "2", None, "y")]


def test_uploads_of_archives_are_classes(spark, tmp_path):
    (tmp_path / "p").mkdir(), (tmp_path / "q").mkdir()
    paths = [archive(tmp_path / p / "cats.zip", {f"in/{p}.txt": p}) for p in "pq"] + [put(tmp_path / "own.md", "mine")]
    got = readers.union_sources(spark, paths).select("source_id", "class", "member", "text")
    assert rows(got) == [(0, "cats", "in/p.txt", "p"), (1, "cats_1", "in/q.txt", "q"), (2, None, "own.md", "mine")]


def test_images(spark, tmp_path):
    for name in ("wrap/cat/1.jpg", "wrap/cat/deep/2.PNG", "wrap/dog/3.webp", "wrap/readme.txt", "wrap/top.jpg"):
        put(tmp_path / name, b"x")
    listing = readers.list_files(spark, str(tmp_path))
    root = f"file:{tmp_path}/wrap"
    found = images.image_inventory(listing, root)
    assert sorted(r.label for r in found.collect()) == ["cat", "cat", "dog"]
    assert tuple(images.image_report(found).first()) == (3, 2)
    assert images.require_classes(found) is found
    with pytest.raises(ValueError):
        images.require_classes(found.where("label = 'cat'"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    local = listing.select(F.lit("d").alias("dataset"), F.expr(f"substring(path, {len(f'file:{tmp_path}/') + 1})").alias("path"))
    # Counting nested folders alone would pick the folder above the wrapper.
    assert tuple(images.image_root(local.where("path <> 'wrap/top.jpg'")).first()) == ("d", "wrap", 3, 2)


def test_image_manifest(spark, tmp_path):
    put(tmp_path / "1.jpg", b"x"), put(tmp_path / "2.txt", b"x")
    sheet = spark.createDataFrame(
        [("1.jpg", " Big Cat! "), ("missing.jpg", "a"), ("2.txt", "a"), (f"file:{tmp_path}/1.jpg", None)], "image string, label string"
    )
    got = rows(images.image_manifest(sheet, readers.list_files(spark, str(tmp_path)), f"file:{tmp_path}"))
    assert got == [(f"file:{tmp_path}/1.jpg", "Big_Cat_"), (f"file:{tmp_path}/1.jpg", "unknown")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é", None, float("nan"), [1.0, float("inf")])], "instruction string, output string, v double, vs array<double>")
    sinks.write_instruction_jsonl(df, f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").first()[0] == '{"instruction":"é","output":null}'
    sinks.write_metrics_json(df.select("v", "vs"), f"{tmp_path}/m")
    assert spark.read.text(f"{tmp_path}/m").first()[0] == '{"v":null,"vs":[1.0,null]}'
    sinks.write_csv_report(spark.createDataFrame([('a"b,c', 1)], "x string, y int"), f"{tmp_path}/c")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c").first().x == 'a"b,c'
    split = spark.createDataFrame([("i", "o", "train"), ("j", "o", "eval")], "instruction string, output string, split string")
    sinks.write_bundle(split, split.drop("split"), f"{tmp_path}/b", {"prompt": "p"}, True)
    back = sinks.read_bundle(spark, f"{tmp_path}/b")
    assert back["train"].first().instruction == "i" and back["all_rows"].count() == 2
    assert back["facts"].first().mapping == {"prompt": "p"} and back["facts"].first().generated_qa


def test_log_stream_drops_late_lines(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    schema = "run_id long, ts timestamp, msg string"

    def arrive(name, lines):
        spark.createDataFrame([(1, day + dt.timedelta(minutes=m), t) for m, t in lines], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        jobs.run_available(jobs.log_health_stream(stream, "1 hour", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/marks")

    arrive("a", [(5, "loss=1.0"), (15, "loss=2.0"), (70, "CUDA out of memory"), (200, "ok")])
    arrive("b", [(6, "loss=100"), (400, "ok")])
    got = {r.window_start: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[day].mean_loss == 1.5 and got[day].lines == 2
    assert got[day + dt.timedelta(hours=1)].oom_detected
    assert day + dt.timedelta(hours=3) in got and len(got) == 3


def test_incremental_prepare(spark, tmp_path):
    text = "A sentence that is long enough to be kept as a chunk of text. " * 4
    schema = "doc_id long, text string, source string, arrived timestamp"
    start = dt.datetime(2024, 1, 1)
    for batch in range(2):
        docs = [(batch * 10 + i, text if i < 5 else text + f"Number {batch} {i}.", "s", start) for i in range(8)]
        spark.createDataFrame(docs, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        jobs.run_available(jobs.incremental_prepare(stream, "doc_id", "arrived"), f"{tmp_path}/out", f"{tmp_path}/marks")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("instruction", "output").distinct().count() == 7
    assert {r.split for r in got.collect()} <= {"train", "eval"}


def test_first_arrivals(spark, tmp_path, monkeypatch):
    """Copies that come in later batches, however late, and batches that run again add nothing."""
    monkeypatch.setattr(jobs, "LEDGER_BATCHES", 3)
    out, ledger = f"{tmp_path}/out", f"{tmp_path}/ledger"
    rng, sent, kept = random.Random(2), [], {}
    schema = "id long, a string, b string"
    for n in range(8):
        rows = [(n * 100 + i, rng.choice([None, "x", "y", f"z{rng.randrange(30)}"]), rng.choice(["", "w", None])) for i in range(40)]
        for row in rows:
            kept.setdefault(row[1:], row[0])
        batch = spark.createDataFrame(rows, schema).repartition(3)
        sent.append(batch)
        jobs.add_first_arrivals(batch, n, out, ledger, ["a", "b"], ["id"])
        jobs.add_first_arrivals(sent[n], n, out, ledger, ["a", "b"], ["id"])
    got = {(r.a, r.b): r.id for r in spark.read.parquet(out).collect()}
    assert got == kept and spark.read.parquet(out).count() == len(kept)
    assert {p.name for p in (tmp_path / "ledger").iterdir() if "base" in p.name} == {"base=3", "base=6"}


def test_first_arrivals_of_a_stream(spark, tmp_path):
    schema = "id long, t string"
    for n in range(3):
        spark.createDataFrame([(n * 10 + i, f"t{i % 4 + n}") for i in range(8)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        jobs.keep_first_arrivals(stream, f"{tmp_path}/out", f"{tmp_path}/ledger", f"{tmp_path}/marks", ["t"], ["id"])
    assert sorted((r.t, r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(f"t{i}", i if i < 4 else i + 9 if i < 5 else 23) for i in range(6)]


def test_monitor_of_runs(spark, tmp_path, monkeypatch):
    """Runs that come in several batches and out of order are reported once, as the closed log says."""
    monkeypatch.setattr(monitor, "BLOCK_LINES", 4)
    day, rng = dt.datetime(2024, 1, 1), random.Random(3)
    lines = []
    for run in range(5):
        for seq in range(rng.choice([1, 3, 9, 30])):
            text = rng.choice(["loss=%.2f" % (3 - seq / 20), "CUDA out of memory %d" % seq, "loss is nan at %d" % seq, "ok", "train_loss: %.1f" % rng.random()])
            lines.append((run, seq, day + dt.timedelta(minutes=seq + run), text))
    schema = "run_id long, seq long, ts timestamp, msg string"
    late = [(9, 0, day + dt.timedelta(days=3), "ok")]
    shuffled = rng.sample(lines, len(lines))
    for n, part in enumerate((shuffled[::2], shuffled[1::2], late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        monitor.run_monitor(monitor.monitor_runs(stream, "2 hours", "10 hours"), f"{tmp_path}/out", f"{tmp_path}/marks")
    logs = spark.createDataFrame(lines, schema)
    events = R.extract_log_events(logs).join(R.loss_trend(logs).drop("losses"), "run_id", "left").collect()
    got = {r.run_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(got) == {r.run_id for r in events} and spark.read.parquet(f"{tmp_path}/out").count() == len(got)
    for want in events:
        found = got[want.run_id]
        for name in ("oom_detected", "nan_loss_detected", "oom_event", "nan_event", "losses", "trend"):
            assert found[name] == want[name], name
        for name in ("first_half", "second_half"):
            assert (found[name] is None) == (want[name] is None) and (want[name] is None or abs(found[name] - want[name]) < 1e-9)


def test_arriving_files_follow_the_splits(spark, tmp_path):
    """No file of the arriving documents, and so no task, has the whole table or a third of it."""
    from quillmill.queries import QUERIES

    docs = spark.range(1_200).select(F.col("id").alias("doc_id"), F.format_string("A text of some length, number %d. ", "id").alias("text"), F.lit("s").alias("source"))
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        made = QUERIES["first_arrivals"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert made.count() == made.distinct().count()
    folder = max(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/arriving-*"), key=os.path.getmtime)
    sizes = [r["count"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 2_400 and max(sizes) <= 200


def test_monitor_calls_its_store_a_few_times():
    """A run whose lines lie far apart costs no call of the state store per line."""
    calls = []

    class Store:
        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                return False if name in ("exists", "containsKey") else iter([])

            return call

    class Handle(Store):
        def getValueState(self, *_):
            return Store()

        getMapState = getListState = getValueState

    processor = monitor.RunMonitor(1_000)
    processor.init(Handle())
    lines = {"seq": [n * 50_000 for n in range(60)], "oom": False, "nan": False, "loss": 1.0, "head": "x", "ts_ms": 5}
    processor.handleInputRows((1,), iter([pd.DataFrame(lines)]), None)
    assert len(calls) <= 6
