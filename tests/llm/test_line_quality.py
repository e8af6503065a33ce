"""Documents without boilerplate lines, against a plain definition."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillmill.llm import line_quality

SPACE = "[\\x20\\x09-\\x0D]"


def normal(line):
    return re.sub(SPACE + "+", " ", line.lower()).strip(" ")


def plain_cleaned(rows, limit, share):
    """(id, text) of the rows that stay; ``rows`` are (id, text, host)."""
    holders = defaultdict(set)
    for n, (_, text, host) in enumerate(rows):
        for line in (text or "").split("\n"):
            if normal(line):
                holders[host, normal(line)].add(n)
    out = []
    for key, text, host in rows:
        lines = (text or "").split("\n")
        words = [w for w in re.split(SPACE + "+", text or "") if w]
        windows = defaultdict(list)
        for i in range(len(words) - 2):
            windows[tuple(words[i : i + 3])].append(i)
        hit = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
        gone = [bool(normal(l)) and len(holders[host, normal(l)]) > limit for l in lines]
        left = len(words) - sum(len(normal(l).split(" ")) for l, g in zip(lines, gone) if g)
        if len(words) >= 50 and 100 * len(hit) <= 50 * len(words) and left >= share * len(words):
            out.append((key, "\n".join(l for l, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    common = [" ".join(f"c{k}w{i}" for i in range(12)) for k in range(6)]
    out = []
    for n in range(160):
        lines = [" ".join(f"d{n}l{j}w{i}" for i in range(14)) for j in range(rng.randrange(1, 6))]
        for k in range(rng.randrange(0, 7)):
            line = common[rng.randrange(6)]
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([line, "  " + line.upper() + "\t", line.replace(" ", "  ", 1)]))
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "  \t", "own"]))
        out.append((n % 150, "\n".join(lines), rng.choice(["a", "a", "b", None])))
    return [*out, (None, None, None), (None, "", "a"), out[0], (7, "\n".join(common * 2000), "a")]


@pytest.mark.parametrize("limit,share", [(20, 0.3), (3, 0.6), (0, 0.0), (1000, 1.0)])
def test_cleaned(spark, rows, limit, share):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    clashing = df.withColumns({c: F.lit("x") for c in ("row", "doc", "id", "places", "lines", "doc_row", "at")})
    got = line_quality.cleaned(clashing, line_limit=limit, kept_share=share)
    assert got.columns == clashing.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == plain_cleaned(rows, limit, share)
    judged = line_quality.judge(clashing, line_limit=limit, kept_share=share)
    assert sorted(map(str, (r.doc_id for r in judged.where("kept").collect()))) == sorted(str(k) for k, _ in plain_cleaned(rows, limit, share))


def test_cleaned_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_quality.cleaned(df).collect() == []
