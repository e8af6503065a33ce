"""Corpus operators: pairs, exact choices, splits, reports."""

import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.operators import corpus as C
from quillmill.operators import detect, sequences
from quillmill.operators.ranking import slices_with_carry, two_level_rank
from quillmill.operators.sequences import label_quotas
from quillmill.plans.prepare import prepare_text_dataset, prepare_text_path

SMALL = "/root/testdata/sf0.001"


def rows_of(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("question "), "id").alias("instruction"), F.lit("answer text").alias("output"))


def test_messages(spark):
    rows = [
        '[1, {"role": "user", "content": "a  b"}, {"role": "Human", "content": "c"}, {"role": "gpt", "content": 5}]',
        '[{"role":"user","content":"1"},{"role":"user","content":"2"},{"role":"user","content":"3"},{"role":"bot","content":"x"},{"role":"assistant","content":"y"}]',
        '{"role": "user", "content": "x"}',
        "not json",
        None,
        '[{"role": "user", "content": null}, {"role": "bot", "content": "z"}]',
        '[{"role": "system", "content": "s"}, {"role": "user", "content": "q"}]',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, m string")
    got = [r.p for r in df.select("i", C.messages_to_pair(F.col("m")).alias("p")).orderBy("i").collect()]
    assert [tuple(p) if p else None for p in got] == [("a b\nc", "5"), ("2\n3", "y"), None, None, None, None, None]


def test_messages_as_structs(spark):
    df = spark.createDataFrame([([("user", "q"), ("assistant", " a ")],)], "m array<struct<role string, content string>>")
    assert tuple(df.select(C.messages_to_pair(F.col("m"), False)).first()[0]) == ("q", "a")


@pytest.mark.parametrize("partitions", [1, 7])
def test_turns_with_a_hot_conversation(spark, partitions):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(501)]
    turns += [(2, 0, "user", "only"), (3, 0, "assistant", "only"), (4, 0, "HUMAN", "q"), (4, 1, "bot", "a"), (4, 2, "user", "  ")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(partitions)
    got = {r.conv_id: (r.instruction, r.output) for r in C.turns_to_pair(df).collect()}
    assert got == {1: ("t498\nt500", "t499"), 4: ("q", "a")}


def test_turn_limit_is_pushed_below_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = C.turns_to_pair(df)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_find_column():
    assert detect.find_column(["Answer", " Question "], detect.PROMPT_NAMES) == " Question "
    assert detect.find_column(["user_answer", "final_output"], detect.RESPONSE_NAMES) == "user_answer"
    assert detect.find_column(["x"], detect.PROMPT_NAMES) is None
    assert C.pair_columns(["output_text"]) is None


def test_columns_with_extra_input(spark):
    df = spark.createDataFrame(
        [("q", "more", "a"), ("q", None, "a"), ("", "more", "a"), ("q", "", None)], "instruction string, input string, output string"
    )
    got = {(r.instruction, r.output) for r in C.columns_to_pair(df).collect()}
    assert got == {("q\nmore", "a"), ("q", "a"), ("more", "a")}


def test_choice_of_conversion(spark):
    chats = spark.createDataFrame([(1, "bad", "q", "a")], "id int, messages string, question string, answer string")
    _, mapping, made = C.to_instruction_output(chats, "id")
    assert mapping == {"prompt": "question", "response": "answer"} and not made
    plain = spark.createDataFrame([(7, "x" * 50)], "id int, body string")
    pairs, mapping, made = C.to_instruction_output(plain, "id")
    assert made and mapping["prompt"] == "synthetic_question"
    assert pairs.first().source == "row_7#chunk0"
    with pytest.raises(ValueError):
        C.to_instruction_output(plain.where("false"), "id")


def test_filter_edges(spark):
    cases = [(4, 10), (5, 9), (5, 10), (5, 7995), (5, 7996)]
    df = spark.createDataFrame([("i" * a, "o" * b) for a, b in cases], "instruction string, output string")
    assert {(len(r.instruction), len(r.output)) for r in C.filter_pairs(df).collect()} == {(5, 10), (5, 7995)}


@pytest.mark.parametrize("partitions", [1, 4, 20])
def test_dedupe_keeps_the_first(spark, partitions):
    data = [(i, "same question", "same answer", f"s{i}") for i in range(300)] + [(500, "other q", "other a", "z")]
    df = spark.createDataFrame(data[::-1], "id long, instruction string, output string, source string").repartition(partitions)
    got = {(r.id, r.source, r.copies) for r in C.dedupe_pairs(df, ["id"], "copies").collect()}
    assert got == {(0, "s0", 300), (500, "z", 1)}


def plain_dedupe(data, order):
    """First row of each pair by the order columns, nulls first, with its number of copies."""
    groups = {}
    for row in data:
        groups.setdefault(row[-2:], []).append(row)
    key = lambda r: tuple((v is not None, v) for v in r[:order])
    return sorted(((*min(g, key=key), len(g)) for g in groups.values()), key=repr)


@pytest.mark.parametrize("kinds", ["long, int", "long, long", "string, int"])
def test_dedupe_of_any_order(spark, kinds):
    """Nulls, empty texts, signs and extremes of the order keys, whether they pack into one number or not."""
    first, second = kinds.split(", ")
    lows = ["a", "b", None, "", "B"] if first == "string" else [-(2**63), 2**63 - 1, None, 0, -1]
    texts = [None, "", "x", "1:x", ":", "xx", "+"]
    data = [
        (lows[i % 5], None if i % 11 == 0 else i - 60, texts[i * 7 % 5], texts[i * i % 7]) for i in range(120)
    ]
    data = list({row[:2]: row for row in data}.values())
    df = spark.createDataFrame(data, f"a {first}, b {second}, instruction string, output string").repartition(5)
    got = sorted((tuple(r) for r in C.dedupe_pairs(df, ["a", "b"], "copies").collect()), key=repr)
    assert got == plain_dedupe(data, 2)


def test_dedupe_of_rows_that_tie_and_of_none(spark):
    twice = spark.createDataFrame([(1, "q", "a", "s")] * 3 + [(1, "q2", "a", "s")], "id long, instruction string, output string, source string")
    assert sorted(tuple(r) for r in C.dedupe_pairs(twice, ["id"], "copies").collect()) == [(1, "q", "a", "s", 3), (1, "q2", "a", "s", 1)]
    assert C.dedupe_pairs(twice.where("false"), ["id"], "copies").count() == 0


def test_dedupe_with_many_repeated_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", 3)
    data = [(i, i % 3, f"q{i % 20}", "a") for i in range(200)] + [(1000, 0, "alone", "a")]
    df = spark.createDataFrame(data, "a long, b int, instruction string, output string").repartition(3)
    got = sorted((tuple(r) for r in C.dedupe_pairs(df, ["a", "b"], "copies").collect()), key=repr)
    assert got == plain_dedupe(data, 2)


def test_dedupe_moves_digests_not_texts(spark):
    """Digests are counted by hash aggregates; with few repeated pairs the rows stay where they are."""
    data = [(i, 0, f"question {i // 2}", "answer") for i in range(60)]
    df = spark.createDataFrame(data, "id long, chunk int, instruction string, output string")
    keyed = df.select(F.unhex(F.sha2("instruction", 256)).alias("_pair"), C._packed(df, ["id", "chunk"]).alias("_order"))
    plan = C.repeated_pairs(keyed)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHash" not in plan
    kept = C.dedupe_pairs(df, ["id", "chunk"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortAggregate" not in plan and "SortMergeJoin" not in plan
    assert kept.count() == 30


@pytest.mark.parametrize("n", [0, 1, 37, 400, 401, 1000])
def test_sample_is_exact_and_repeatable(spark, n):
    df = rows_of(spark, 400)
    first = {r.id for r in C.sample_n(df, n, ["id"]).collect()}
    again = {r.id for r in C.sample_n(df.repartition(9), n, ["id"]).collect()}
    assert len(first) == min(n, 400) and first == again


def expected_eval(n):
    target = min(50, n // 2)
    return math.ceil(0.1 * n) if 0.1 * n > target else target


@pytest.mark.parametrize("n", [2, 3, 85, 99, 100, 151, 500, 501, 1200])
def test_split_sizes(spark, n):
    split = C.split_train_eval(rows_of(spark, n), ["id"]).select("id", "split").collect()
    evals = {r.id for r in split if r.split == "eval"}
    assert len(split) == n and len({r.id for r in split}) == n and len(evals) == expected_eval(n)


def test_split_of_one_and_none(spark):
    assert sorted(r.split for r in C.split_train_eval(rows_of(spark, 1), ["id"]).collect()) == ["eval", "train"]
    assert C.split_train_eval(rows_of(spark, 0), ["id"]).count() == 0


def test_examples_give_way_to_user_data(spark):
    df = spark.createDataFrame([("  Hello ", "my own", "eval"), ("x", "y", "train")], "instruction string, output string, split string")
    added = C.augment_with_examples(df)
    assert added.count() == 2 + 11 * 3
    assert added.where("instruction = 'hello'").count() == 0


def test_quality_report(spark):
    df = spark.createDataFrame([("g", "q", "o" * 60), ("g", "q", "o" * 60), ("g", "p", "short"), ("h", "", "")], "k string, instruction string, output string")
    got = {r.k: r for r in C.quality_report(df, ["k"]).collect()}
    assert (got["g"].rows, got["g"].duplicates, got["g"].quality_score) == (3, 1, round((0.4 + 0.4 * 2 / 3 + 0.2 * 2 / 3) * 100, 1))
    assert got["h"].quality_score == 20.0 and got["g"].short_responses_pct == 33.3
    empty = C.quality_report(df.where("false")).collect()
    assert [(r.rows, r.quality_score, r.avg_prompt_chars) for r in empty] == [(0, 0.0, 0.0)]


def test_golden_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert C.synthesize_qa(docs, "doc_id").count() == 464
    bundle = prepare_text_dataset(docs.select("doc_id", "text", "source"), "doc_id")
    report = bundle.report.first()
    assert (report.rows, report.train_rows, report.eval_rows, report.quality_score) == (436, 422, 50, 99.5)
    assert (report.duplicates, report.raw_rows, report.generated_qa) == (28, 200, True)
    limited = prepare_text_dataset(docs.select("doc_id", "text", "source"), "doc_id", max_samples=120)
    assert limited.all_rows.count() == 120


@pytest.mark.parametrize("sizes", [{"a": 90, "b": 7, "c": 3}, {"a": 2, "b": 2}, {"a": 30, "b": 1}, {"a": 3}])
def test_stratified_split(spark, sizes):
    data = [(i, k) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(n, k) for n, (_, k) in enumerate(data)], "id long, label string")
    rows = sequences.stratified_split(df, "label", ["id"]).collect()
    total = len(data)
    tests = [r for r in rows if r.split == "test"]
    if total < 4:
        assert len(rows) == 2 * total and len(tests) == total
        return
    assert len(rows) == total and len(tests) == math.ceil(0.15 * total)
    if min(sizes.values()) >= 2 and len(tests) >= len(sizes):
        share = {k: sum(r.label == k for r in tests) for k in sizes}
        assert all(abs(share[k] - len(tests) * n / total) < 1 for k, n in sizes.items())


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_two_level_rank(spark, width):
    df = spark.createDataFrame([("k", p) for p in (3, 9, 4, 27, 100, 5)] + [("m", 1)], "k string, p long")
    got = {(r.k, r.p): (r["rank"], r.total) for r in two_level_rank(df, ["k"], "p", width).collect()}
    assert got == {("k", 3): (1, 6), ("k", 4): (2, 6), ("k", 5): (3, 6), ("k", 9): (4, 6), ("k", 27): (5, 6), ("k", 100): (6, 6), ("m", 1): (1, 1)}


def test_subtype_and_task(spark):
    goals = ["Translate it", "RÉSUMÉ", "intent of label", "abstract label", None, "chat"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(goals)], "i int, g string")
    got = [r[0] for r in df.orderBy("i").select(detect.tag_task_subtype(F.col("g"))).collect()]
    assert got == ["translation", "summarization", "classification", "summarization", "generative_qa", "generative_qa"]
    listing = [("a", "dir", f"x/{i}.JPG", "auto", "") for i in range(4)] + [("a", "dir", "r.txt", "auto", "")]
    listing += [("b", "dir", f"x/{i}.jpg", "auto", "") for i in range(3)]
    listing += [("c", "csv", "t.csv", "auto", "Classify tickets"), ("d", "csv", "t.csv", "text_qa", "classify")]
    table = spark.createDataFrame(listing, "dataset string, container string, path string, user_task string, goal string")
    got = {r.dataset: r.task for r in detect.detect_task(table).collect()}
    assert got == {"a": "image_classification", "b": "text_qa", "c": "image_classification", "d": "text_qa"}


@pytest.mark.parametrize("width", [2, 4, 1000])
@pytest.mark.parametrize("step", [1, 10_000_000_000])
def test_slices_carry_what_a_window_looks_back_on(spark, width, step):
    """One key holds most rows; positions are dense or sparse, and some keys are null."""
    rows = [("hot", p * step) for p in range(41)] + [("b", 5), ("b", 2), ("c", 7), (None, 1), (None, 3)]
    df = spark.createDataFrame(rows, "k string, p long")
    sliced = slices_with_carry(df, "k", "p", 2, width)
    w = Window.partitionBy("k", "_slice").orderBy("p").rowsBetween(-2, -1)
    got = sliced.withColumn("seen", F.collect_list("p").over(w)).where("not _carried").collect()
    expected = {}
    for key in {k for k, _ in rows}:
        own = sorted(p for k, p in rows if k == key)
        expected |= {(key, p): own[max(0, i - 2) : i] for i, p in enumerate(own)}
    assert len(got) == len(rows) and {(r.k, r.p): r.seen for r in got} == expected
    sizes = Counter((r.k, r["_slice"]) for r in got)
    assert max(sizes.values()) <= max(width, 2)


def test_rank_of_tied_positions(spark):
    df = spark.createDataFrame([("k", 1)] * 9 + [("k", 2)] * 9 + [(None, 4)], "k string, p long")
    got = two_level_rank(df, ["k"], "p", 3).collect()
    assert sorted(r["rank"] for r in got if r.k) == list(range(1, 19))
    assert all((r["rank"] <= 9) == (r.p == 1) and r.total == 18 for r in got if r.k)
    assert [(r["rank"], r.total) for r in got if r.k is None] == [(1, 1)]


def test_quotas_of_very_many_rows(spark):
    sizes = {"a": 70_000_000_001, "b": 29_999_999_999, "c": 3}
    got = {r["_label"]: r for r in label_quotas(spark.createDataFrame(list(sizes.items()), "_label string, rows long"), 0.15).collect()}
    total = sum(sizes.values())
    want = math.ceil(0.15 * total)
    assert sum(r.quota for r in got.values()) == want
    assert all(abs(got[k].quota - Fraction(want * n, total)) < 1 for k, n in sizes.items())
    assert {r.total for r in got.values()} == {total}


def test_prepare_without_an_id(spark, tmp_path):
    answer = "A sufficiently long answer about topic number"
    lines = [f'{{"instruction": "What about topic {i % 30}?", "output": "{answer} {i % 30}."}}' for i in range(60)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    bundle = prepare_text_path(spark, str(tmp_path / "a.jsonl"))
    report = bundle.report.first()
    assert bundle.all_rows.count() == 30 and report.raw_rows == 60 and report.duplicates == 30
    assert report.train_rows + report.eval_rows >= 30
    (tmp_path / "b.jsonl").write_text('{"instruction": "a", "output": ""}\n')
    with pytest.raises(ValueError, match="no instruction"):
        prepare_text_path(spark, str(tmp_path / "b.jsonl"))


def _long_chats(spark, path):
    turns = [(1, n, "system", "s") for n in range(200)]
    turns[10], turns[60], turns[70] = (1, 10, "user", "a"), (1, 60, "User", "b"), (1, 70, "bot", "c")
    turns += [(2, 0, "user", "q"), (2, 64, "assistant", "r"), (2, 65, "user", " "), (3, 0, "user", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")


def test_pair_of_a_chat_in_parts(spark, tmp_path):
    """The pair of a long chat is that of all its turns, wherever its parts begin."""
    from quillmill.queries import QUERIES

    _long_chats(spark, tmp_path)
    got = {(r.record, r.instruction, r.output) for r in QUERIES["messages_to_pair"](spark, str(tmp_path)).collect()}
    assert got == {(1, "a\nb", "c"), (2, "q", "r")}


def test_conversion_of_chats_in_parts(spark, tmp_path):
    from quillmill.queries import QUERIES

    _long_chats(spark, tmp_path)
    got = {(r.record, r.instruction, r.output) for r in QUERIES["to_instruction_output"](spark, str(tmp_path)).collect()}
    assert got == {(1, "a\nb", "c"), (2, "q", "r")}
    parts = [(7, 1, '[{"role": "user", "content": "y"}, 3, {"role": "bot", "content": "z"}]', "two"), (7, 0, '[{"role": "user", "content": "x"}]', "one"), (7, 2, "bad", None)]
    df = spark.createDataFrame(parts, "id long, part long, messages string, source string")
    pairs, used, made = C.to_instruction_output(df, "id", part="part")
    assert [tuple(r) for r in pairs.collect()] == [(7, 0, "x\ny", "z", "one")]
    assert used == {"prompt": "messages", "response": "messages"} and not made
