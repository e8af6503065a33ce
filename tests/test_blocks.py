"""Listings, archives, tables and JSON documents read by blocks, against their plain readers."""

import csv
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.sources import archives, csv_blocks, json_blocks, readers, storage


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


# Listings.


@pytest.mark.parametrize("folders_per_task", [1, 3, 256])
def test_listing_equals_spark(spark, tmp_path, folders_per_task):
    pick = random.Random(folders_per_task)
    for i in range(40):
        folder = "/".join(f"d {pick.randrange(3)}" for _ in range(pick.randrange(5)))
        put(tmp_path / folder / f"file+{i}%20.txt", "x" * i)
    for name in ("_hidden/a.txt", ".git/b", "_SUCCESS", "part=1/_c=2/d.txt", "é/ü.txt"):
        put(tmp_path / name, "y")
    (tmp_path / "empty").mkdir()
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length")
    got = storage.list_files(spark, str(tmp_path), folders_per_task)
    # Spark's reader leaves empty files out.
    assert sorted(got.where("length > 0").collect()) == sorted(want.collect())
    assert got.count() == 42 and got.where("length = 0").count() == 1


def test_listing_of_a_file_and_of_nothing(spark, tmp_path):
    path = put(tmp_path / "a.txt", "abc")
    assert [tuple(r) for r in storage.list_files(spark, path).collect()] == [(f"file:{path}", 3)]
    (tmp_path / "none").mkdir()
    assert storage.list_files(spark, str(tmp_path / "none")).count() == 0


# Archives.


@pytest.fixture
def zips(tmp_path):
    pick = random.Random(3)
    data = {}
    methods = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]
    for a in range(3):
        (tmp_path / "z" / str(a % 2)).mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(tmp_path / "z" / str(a % 2) / f"x{a // 2}.zip", "w") as out:
            for m in range(9):
                name = f"in {m}/é{m}.bin"
                content = bytes(pick.choices(b"ab\x00\xff", k=pick.choice([0, 1, 10, 5_000, 300_000])))
                out.writestr(zipfile.ZipInfo(name), content, compress_type=methods[m % 4])
                data[f"{a % 2}/x{a // 2}.zip", name] = content
    return str(tmp_path / "z"), data


@pytest.mark.parametrize("piece", [7_000, 64 << 20])
def test_members_in_pieces(spark, zips, piece):
    path, data = zips
    found = archives.read_zip_pieces(archives.zip_index(spark, path), piece).collect()
    got = {}
    for row in sorted(found, key=lambda r: (r.archive, r.member, r.piece)):
        key = row.archive.split("/z/")[1], row.member
        assert row.piece == 0 or len(got[key]) == piece * row.piece
        got[key] = got.get(key, b"") + bytes(row.content)
        assert len(row.content) <= piece
    assert got == data


def test_members_of_an_archive_are_many_tasks(spark, zips, monkeypatch):
    path, data = zips
    monkeypatch.setattr(archives, "SLICE_BYTES", 1_000)
    members = archives.read_zip_members(spark, path)
    tasks = members.select(F.spark_partition_id()).distinct().count()
    assert members.count() == len(data) and tasks > 3
    assert archives.read_zip_members(spark, path, ["txt"]).count() == 0


def test_members_too_large_for_a_cell(spark, zips, monkeypatch):
    monkeypatch.setattr(archives, "CELL_BYTES", 1_000)
    with pytest.raises(ValueError, match="in pieces"):
        archives.read_zip_members(spark, zips[0])


def test_damaged_and_encrypted_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as out:
        out.writestr("m", b"abcdefgh" * 100)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[200] ^= 1
    (tmp_path / "a.zip").write_bytes(data)
    with pytest.raises(Exception, match="damaged member"):
        archives.read_zip_members(spark, str(tmp_path / "a.zip")).collect()
    directory = data.rindex(b"PK\x01\x02")
    data[directory + 8] |= 1
    (tmp_path / "a.zip").write_bytes(data)
    with pytest.raises(Exception, match="encrypted"):
        archives.zip_index(spark, str(tmp_path / "a.zip"))


def test_unpacking(spark, zips, tmp_path):
    path, data = zips
    done = archives.extract_zip(archives.zip_index(spark, path), f"file:{tmp_path}/out").collect()
    assert len(done) == len(data)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"x0", "x0_1", "x1"}
    for row in done:
        with open(row.path.removeprefix("file:"), "rb") as file:
            assert file.read() == data[row.archive.split("/z/")[1], row.member]


# Tables.


def random_table(pick, rows, end):
    cells = ["", "a", "é", 'q"uote', "two\nlines", "dos\r\nline", "a,b", '"', '""', "\n", " sp ", "x" * 90, ',"\n,"']
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end)
    table = [[pick.choice(cells) for _ in range(3)] for _ in range(rows)]
    table = [[f"r{i}", *row] for i, row in enumerate(table)]
    writer.writerows([["id", "a\nb", "c", "d"], *table])
    return out.getvalue(), table


@pytest.mark.parametrize("block,end", [(1, "\n"), (13, "\r\n"), (40, "\n"), (1 << 20, "\r\n")])
def test_rows_that_span_lines_in_blocks(spark, tmp_path, block, end):
    text, table = random_table(random.Random(block), 40 if block < 40 else 400, end)
    got = readers.read_delimited(spark, put(tmp_path / "a.csv", text), block_bytes=block)
    assert got.columns == ["id", "a\nb", "c", "d"]
    want = sorted([tuple(v or None for v in row) for row in table], key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_blocks_equal_the_one_task_reader(spark, tmp_path):
    text, _ = random_table(random.Random(9), 500, "\n")
    path = put(tmp_path / "a.csv", text)
    whole = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    got = readers.read_delimited(spark, path, block_bytes=100)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_blocks_are_many_tasks(spark, tmp_path):
    text, _ = random_table(random.Random(1), 300, "\n")
    files = spark.createDataFrame([(put(tmp_path / "a.csv", text), len(text.encode()), True)], "path string, length long, utf8 boolean")
    states = csv_blocks.block_states(files, ",", 200)
    assert {r.state for r in states.collect()} == {0, 1}
    records = csv_blocks.read_records(files, states, ",", 200)
    assert records.count() == 300 and records.select(F.spark_partition_id()).distinct().count() > 10


def test_quotes_inside_plain_cells(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'id,t\n1,5" disk\n2,"a\nb" c\n3,x"y"\n')
    got = readers.read_delimited(spark, path, block_bytes=6)
    assert {r.id for r in got.collect()} == {"1", "2", "3"}


def test_unlike_headers_and_encodings_in_blocks(spark, tmp_path):
    put(tmp_path / "a.csv", '﻿id,Text,text,\n1,"é\nx",y,z\n')
    put(tmp_path / "b 1+.csv", 'id,extra\n2,"é\ny"\n'.encode("latin-1"))
    put(tmp_path / "c.csv", "id,extra\n\n3,é\n  \n")
    put(tmp_path / "d.csv", "id,extra\n")
    put(tmp_path / "e.csv", "")
    rows = readers.read_delimited(spark, str(tmp_path), "csv", block_bytes=5).collect()
    got = {(r["id"], r["Text1"], r["text2"], r["_c3"], r["extra"]) for r in rows}
    assert got == {("1", "é\nx", "y", "z", None), ("2", None, None, None, "é\ny"), ("3", None, None, None, "é")} and len(rows) == 3
    with pytest.raises(ValueError, match="no rows"):
        readers.read_delimited(spark, str(tmp_path / "e.csv"))


def test_a_cell_longer_than_many_blocks(spark, tmp_path):
    cell = "line, with ''quotes'' and\n" * 500
    path = put(tmp_path / "a.csv", f'id,t\n1,"{cell}"\n2,"{cell}"\n3,z\n')
    got = readers.read_delimited(spark, path, block_bytes=64).collect()
    assert {(r.id, r.t) for r in got} == {("1", cell), ("2", cell), ("3", "z")}


# JSON documents.


def random_value(pick, depth=0):
    kind = pick.randrange(7 if depth < 3 else 4)
    if kind < 3:
        return "".join(pick.choice('a"\\[]{},: \n\té ') for _ in range(pick.randrange(12)))
    if kind == 3:
        return pick.choice([1, -2.5, True, None])
    if kind == 4:
        return [random_value(pick, depth + 1) for _ in range(pick.randrange(4))]
    return {pick.choice(['a', 'data', '"data"', 'x\\']) + str(i): random_value(pick, depth + 1) for i in range(pick.randrange(4))}


def json_rows(spark, path, block):
    files = storage.files_of(spark, path)
    return sorted((json.dumps(json.loads(r.value), sort_keys=True) for r in json_blocks.json_lines(files, block).collect()))


def documents_of(payload):
    for key in ("data", "records"):
        if isinstance(payload, dict) and isinstance(payload.get(key), list):
            return payload[key]
    return payload if isinstance(payload, list) else [payload]


@pytest.mark.parametrize("block", [3, 17, 100, 1 << 20])
def test_json_documents_in_blocks(spark, tmp_path, block):
    pick = random.Random(block)
    want = []
    for i in range(12):
        rows = [{"id": n, "v": random_value(pick)} for n in range(pick.choice([0, 1, 25]))]
        if block < 10:
            rows = rows[:6]
        aside = {"note": random_value(pick), "deep": {"data": [1, [2]]}, "list": [[1], {"records": [3]}]}
        payload = pick.choice(
            [rows, {"data": rows}, aside | {"records": rows}, {"data": "text"} | aside, {"data": {"x": [1]}, "records": rows}, {"data": rows} | aside]
        )
        text = json.dumps(payload, indent=pick.choice([None, 1]), ensure_ascii=pick.random() < 0.5)
        put(tmp_path / f"{i}.json", ("﻿" if i % 5 == 0 else "") + " \n" * (i % 3) + text + "\n")
        want += documents_of(payload)
    assert json_rows(spark, str(tmp_path), block) == sorted(json.dumps(w, sort_keys=True) for w in want)


def test_json_keys_that_repeat_and_blank_files(spark, tmp_path):
    put(tmp_path / "a.json", '{"data": [1], "x": [2, 3], "data": [{"q": 4}, {"q": 5}], "y": {"z": [6, 7]}}')
    put(tmp_path / "b.json", " \n ")
    for block in (4, 1 << 20):
        assert json_rows(spark, str(tmp_path), block) == ['{"q": 4}', '{"q": 5}']


def test_one_json_list_is_many_tasks(spark, tmp_path):
    rows = [{"id": i, "t": "x" * (i % 50)} for i in range(2_000)]
    path = put(tmp_path / "a.json", json.dumps({"meta": {"n": 1}, "data": rows}))
    lines = json_blocks.json_lines(storage.files_of(spark, path), 2_000)
    assert lines.select(F.spark_partition_id()).distinct().count() > 10
    got = readers.read_json_documents(spark, path, block_bytes=2_000)
    assert sorted(map(tuple, got.collect())) == [(r["id"], r["t"]) for r in rows]


def test_rounds_of_a_listing(spark, tmp_path, monkeypatch):
    """A wide tree takes as many rounds as it has levels, whatever its number of folders."""
    for n in range(300):
        (tmp_path / f"a{n}" / "b").mkdir(parents=True)
        (tmp_path / f"a{n}" / "b" / "x.txt").write_text("x" * n)
    rounds, plain = [], storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df, name: rounds.append(name) or plain(df, name))
    got = storage.list_files(spark, str(tmp_path), folders_per_task=2)
    assert sorted(r.length for r in got.collect()) == list(range(300))
    assert len(rounds) <= 3
