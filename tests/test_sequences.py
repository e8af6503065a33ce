"""Rendering, masking and packing."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import sequences as S
from quillmill.operators.packing import pack_whole_table, slice_map

TOKENS = "id long, input_ids array<int>, attention_mask array<int>, labels array<int>"


def pack(records, limit):
    blocks, held = [], []
    for record in records:
        if held and len(held) + len(record) > limit:
            blocks.append(held)
            held = []
        held = held + record
        while len(held) >= limit:
            blocks.append(held[:limit])
            held = held[limit:]
    return blocks + [held] if held else blocks


def records(rng, n):
    return [[rng.randrange(1000) for _ in range(rng.choice([0, 1, 5, 9, 10, 11, 27]))] for _ in range(n)]


@pytest.mark.parametrize("shards, batch", [(1, 10000), (1, 3), (4, 3)])
def test_packing(spark, shards, batch):
    rows = records(random.Random(shards), 80)
    df = spark.createDataFrame([(i, r, [1] * len(r), [-v for v in r]) for i, r in enumerate(rows)], TOKENS).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = S.pack_sequences(df, "id", 10, shards).orderBy("shard", "block").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.labels == [-v for v in r.input_ids] and len(r.attention_mask) == len(r.input_ids) <= 10 for r in got)
    assert sorted(v for r in got for v in r.input_ids) == sorted(v for r in rows for v in r)
    if shards == 1:
        assert [r.input_ids for r in got] == pack(rows, 10)
    else:
        assert len({(r.shard, r.block) for r in got}) == len(got)


def test_empty_input_packs_to_nothing(spark):
    assert S.pack_sequences(spark.createDataFrame([], TOKENS), "id", 8, 2).count() == 0


def words(text):
    """A stand-in tokenizer: one id per space-separated piece."""
    return F.transform(F.split(text, " "), lambda w: F.length(w))


def test_masking(spark):
    df = spark.createDataFrame([(1, "a b", "cc dd ee"), (2, "a " * 20, "x")], "id int, instruction string, output string")
    plain = S.tokenize_and_mask(df.where("id = 1"), words, 100, template="{instruction} ").first()
    # The prompt "a b " has three pieces, the last one empty.
    assert plain.input_ids == [1, 1, 2, 2, 2] and plain.labels == [-100, -100, -100, 2, 2]
    cut = S.tokenize_and_mask(df.where("id = 2"), words, 9, template="{instruction} ").first()
    assert len(cut.input_ids) == 9 and cut.labels == [-100] * 7 + [1, 1]
    assert cut.attention_mask == [1] * 9


def test_default_tokenizer(spark):
    df = spark.createDataFrame([("Été, a_b!  c",)], "t string")
    ids = df.select(S.word_ids(F.col("t"), 1000)).first()[0]
    assert len(ids) == 5 and all(0 <= i < 1000 for i in ids)


def test_render(spark):
    df = spark.createDataFrame([("q", "a")], "i string, o string")
    prompt, full = S.render_chat(F.col("i"), F.col("o"), eos="</s>")
    assert tuple(df.select(prompt, full).first()) == (
        "### Instruction:\nq\n\n### Response:\n",
        "### Instruction:\nq\n\n### Response:\na</s>",
    )


def test_label_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string")
    assert {(r.label, r.label_id) for r in S.label_index(df).collect()} == {("a", 0), ("b", 1)}


@pytest.mark.parametrize("slice_rows, limit", [(1000, 10), (7, 10), (1, 10), (20, 64), (3, 1)])
def test_packing_of_the_whole_table(spark, slice_rows, limit):
    """Any slices give the blocks of one fold."""
    rng = random.Random(slice_rows)
    rows = records(rng, 150) + [[rng.randrange(9)] * rng.choice([1, 2]) for _ in range(60)]
    data = [(f"k{i:04}", r, [1] * len(r), [-v for v in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, TOKENS.replace("id long", "id string")).repartition(5)
    got = pack_whole_table(df, "id", limit, slice_rows).orderBy("block").collect()
    assert [r.input_ids for r in got] == pack(rows, limit)
    assert [r.block for r in got] == list(range(len(got)))
    assert all(r.labels == [-v for v in r.input_ids] and r.attention_mask == [1] * len(r.input_ids) for r in got)


def test_packing_of_an_empty_table(spark):
    assert pack_whole_table(spark.createDataFrame([], TOKENS), "id", 8).count() == 0


def test_slice_maps():
    rng = random.Random(4)
    for limit in (1, 2, 9, 30):
        for _ in range(40):
            sizes = [rng.choice([0, 1, 2, 5, 9, 10, 31]) for _ in range(rng.randrange(12))]
            left, closed = slice_map(sizes, limit)
            for used in range(limit):
                blocks = pack([[0] * used] + [[0] * s for s in sizes], limit)
                held = sum(map(len, blocks))
                # The fold's last block is open unless it is full.
                open_size = len(blocks[-1]) if blocks and len(blocks[-1]) < limit else 0
                assert (left[used], closed[used]) == (open_size, len(blocks) - bool(open_size)), (sizes, limit, used, held)
