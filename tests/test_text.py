"""Text expressions against plain definitions and edge rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.functions import arrays, text
from quillmill.functions.text import chunk_text
from quillmill.operators import corpus as C


def one(spark, rows, expr, name="t"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r[0] for r in df.select(F.col("i"), expr(F.col(name)).alias("o")).orderBy("i").select("o").collect()]


def chunks_of(value, low=180, high=1300):
    tidy = " ".join(value.split())
    done, held = [], ""
    for part in re.split(r"(?<=[.!?])\s+", tidy):
        if not part:
            continue
        if len(held) + len(part) + 1 <= high:
            held = f"{held} {part}".strip()
            continue
        if len(held) >= low:
            done.append(held)
        held = part[:high]
    if len(held) >= low:
        done.append(held)
    return done or ([tidy[:high]] if len(tidy) >= 40 else [])


def test_clean_text(spark):
    rows = [None, "", " \t\n", "a  b", "x\x1cy\x1f\x1fz", " é😀 　"]
    assert one(spark, rows, text.clean_text) == ["", "", "", "a b", "x y z", "é😀"]


def test_chunk_edges(spark):
    rows = ["", "x" * 39, "x" * 40]
    rows += ["s" * (n - 1) + "." for n in (1299, 1300, 1301)]
    rows += ["a" * 99 + ". " + "b" * 1249 + ".", "a" * 200 + ". " + "b" * 1299 + "! " + "c" * 30]
    rows += ["no stop " * 400, "😀" * 1400]
    assert one(spark, rows, text.chunk_text) == [chunks_of(r) for r in rows]


def test_chunk_random(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            parts.append("w" * rng.choice([3, 80, 300, 1290, 1310]) + rng.choice([".", "!", "?", ","]))
        rows.append(rng.choice([" ", "\n", "  "]).join(parts))
    assert one(spark, rows, text.chunk_text) == [chunks_of(r) for r in rows]


def test_keywords(spark):
    rows = ["", "the and for", "Beta alpha beta, gamma-ray x1y ab the Été été ÉTÉ", "b" * 3 + " ccc aaa ddd eee fff ggg hhh"]
    assert one(spark, rows, text.keywords) == [
        "this document",
        "this document",
        "été, beta, alpha, gamma-ray, x1y",
        "aaa, bbb, ccc, ddd, eee, fff",
    ]


def test_normalize_answer(spark):
    rows = ["The cat, a  dog & an éan!", "the", "Theatre a1 (a)b", None]
    assert one(spark, rows, text.normalize_answer) == ["cat dog an", "", "theatre a1 b", ""]


def test_clip(spark):
    rows = ["short", "a b" * 50, "x" * 9 + " yy", "x" * 10]
    got = one(spark, rows, lambda c: text.clip_text(c, 10))
    assert got == ["short", "a ba ba b…", "x" * 9 + "…", "x" * 10]


def test_strip_preamble(spark):
    rows = ["Sure! Paris", "Here's the answer to your question: 42", "Okay.", "Great question, this is the response - yes", "surely not", "Of course"]
    assert one(spark, rows, text.strip_preamble) == ["Paris", "42", "Okay.", "yes", "surely not", "Of course"]


@pytest.mark.parametrize("size", [0, 1, 40])
def test_multiset_overlap(spark, size):
    rng = random.Random(size)
    pairs = [([rng.choice("abc b") for _ in range(rng.randrange(size + 1))], [rng.choice("abd") for _ in range(size)]) for _ in range(20)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = df.orderBy("i").select(arrays.multiset_overlap(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [sum((Counter(a) & Counter(b)).values()) for a, b in pairs]


def test_ngrams_and_counts(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(arrays.ngrams(F.col("t"), 2)).collect()] == [["a\x01b", "b\x01a"], [], []]
    counts = df.select(arrays.value_counts(F.col("t")).alias("c")).collect()
    assert [[tuple(e) for e in r.c] for r in counts] == [[("a", 2), ("b", 1)], [("a", 1)], []]


def test_template(spark):
    df = spark.createDataFrame([("i", "o")], "a string, b string")
    got = df.select(text.render_template("<{b}|{a}|{b}>", a=F.col("a"), b=F.col("b"))).first()[0]
    assert got == "<o|i|o>"


def test_lossless_chunks(spark):
    rng = random.Random(6)
    texts = ["", " ", "short.", "x" * 3000, "a b " * 900, ("Word. " * 40 + "y" * 1400 + " end. ") * 3]
    texts += ["".join(rng.choice(["ab", " ", ". ", "é! ", "longer" * 9]) for _ in range(rng.randrange(300))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    bare = lambda t: "".join(t.split())
    for limit in (20, 1300):
        rows = df.select("id", chunk_text(F.col("text"), max_chars=limit, lossless=True).alias("c")).collect()
        for r in rows:
            assert bare("".join(r.c or [])) == bare(texts[r.id]) and all(0 < len(c) <= limit for c in r.c or [])
    lost = C.text_loss(df).first()
    kept = {r.id: r.c or [] for r in df.select("id", chunk_text(F.col("text")).alias("c")).collect()}
    assert lost.chars == sum(len(bare(t)) for t in texts) and lost.documents == len(texts)
    assert lost.lost_chars == sum(len(bare(t)) - len(bare("".join(kept[i]))) for i, t in enumerate(texts)) > 0
    assert lost.documents_lost == sum(bool(bare(t)) and not kept[i] for i, t in enumerate(texts)) > 0
    assert C.text_loss(df, lossless=True).first().lost_chars == 0
