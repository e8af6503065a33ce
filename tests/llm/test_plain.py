"""Whole operators against independent plain versions."""

import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import fingerprints, line_dedup, mixing, pii, quality
from quillmill.llm.queries import QUERIES

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fingerprints, byte by byte.


def plain_fingerprint(text):
    data = text.encode()
    if not data:
        return "2::"
    cuts = []  # (end, doublings of the block size at which the place is a cut)
    for i in range(len(data)):
        rolled = sum((b + 1) * pow(0x2F0B4C47, j, 2**32) for j, b in enumerate(reversed(data[max(0, i - 6) : i + 1]))) % 2**32
        rolled ^= rolled >> 15
        rolled = rolled * 0x9E3779B1 % 2**32
        rolled ^= rolled >> 13
        zeros = 32 if rolled == 0 else (rolled & -rolled).bit_length() - 1
        if zeros:
            cuts.append((i + 1, zeros))
    if len(data) < 7:
        assert all(end <= len(data) for end, _ in cuts)

    def signature(level):
        out, start = [], 0
        for end in [e for e, zeros in cuts if zeros >= level] + [len(data)]:
            if end > start:
                code = xxhash.xxh32_intdigest(data[start:end]) & 0xFFF
                out += [] if out[-3:] == [code] * 3 else [code]
                start = end
        return out

    level = 1
    while 2 ** (level + 1) <= len(data) // 32:
        level += 1
    while level > 1 and sum(zeros >= level for _, zeros in cuts) < 16:
        level -= 1
    while len(signature(level)) > 128:
        level += 1
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    spell = lambda codes: "".join(letters[c // 64] + letters[c % 64] for c in codes)
    return f"{2**level}:{spell(signature(level))}:{spell(signature(level + 1))}"


def plain_likeness(left, right):
    if left == right:
        return 1.0

    def alike(a, b):
        a, b = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
        if not a or not b:
            return 0.0
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(last[j] if x == y else 1 + min(last[j + 1], row[j]))
        return 1 - row[-1] / (len(a) + len(b))

    one, two = (dict(zip((int(s[0]), 2 * int(s[0])), s[1:])) for s in (left.split(":"), right.split(":")))
    return max((alike(one[size], two[size]) for size in one.keys() & two.keys()), default=0.0)


def test_fingerprints_byte_by_byte(texts):
    pick = random.Random(1)
    some = [*list(texts.values())[:25], "", "a", "abcdef", "ab" * 4_000, "é" * 900, *("".join(pick.choices("ab \n", k=n)) for n in (7, 60, 3_000))]
    for text in some:
        assert fingerprints.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_query(spark, texts):
    ids = sorted(texts)
    rows = {r.doc_id: r for r in QUERIES["op1_document_fingerprints"](spark, SF).collect()}
    for i, after in list(zip(ids, ids[1:] + ids[:1]))[::7]:
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[after][:half]
        marks = [plain_fingerprint(t) for t in (texts[i], edited, texts[after])]
        got = rows[i]
        assert (got.fingerprint, got.edited_fingerprint) == (marks[0], marks[1])
        assert got.near_edited == pytest.approx(plain_likeness(marks[0], marks[1]))
        assert got.near_next == pytest.approx(plain_likeness(marks[0], marks[2]))


# Personal data.


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        found += [(m.start(), 1, m.end())] * all(int(p) <= 255 for p in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        found += [(m.start(), 2, m.end())] * (12 <= len(digits) <= 19 and luhn(digits))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        found += [(m.start(), 3, m.end())] * (9 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return sorted(found)


def test_personal_data_of_the_whole_table(spark, texts):
    kinds = ("email", "ip", "card", "phone")
    for r in QUERIES["op2_personal_data"](spark, SF).collect():
        spans = plain_base(texts[r.doc_id])
        assert [r[f"n_{kind}"] for kind in kinds] == [sum(s[1] == k for s in spans) for k in range(4)]
        listed = [f"{kinds[k]}:{start}:{end}" for start, k, end in spans]
        assert r.base_sha256 == sha(",".join(listed)) and set(listed) <= set(r.spans.split(",")) | {""}


def plain_trust(edges):
    """Patterns accepted, by plain rounds until nothing changes."""
    held = defaultdict(dict)
    for pattern, value, seed in edges:
        held[pattern][value] = seed
    trust = {}
    while True:
        seen = {}
        for pattern, values in held.items():
            for kind in range(5):
                parts = []
                for value, seed in values.items():
                    if seed >= 0:
                        parts.append(float(seed == kind))
                    else:
                        doubt = 1.0
                        for other in held:
                            if value in held[other] and trust.get((other, kind), (0, 0))[1] >= pii.TRUST and trust[other, kind][0] >= pii.SUPPORT:
                                doubt *= max(1 - trust[other, kind][1], 1e-9)
                        parts.append(1 - doubt)
                seen[pattern, kind] = (sum(parts), sum(parts) / len(parts))
        if all(abs(seen[k][1] - trust.get(k, (0, 0))[1]) < 1e-9 for k in seen):
            return {k: v[1] for k, v in seen.items() if v[0] >= pii.SUPPORT and v[1] >= pii.TRUST}
        trust = seen


def test_trust_on_random_graphs(spark):
    for seed in range(3):
        pick = random.Random(seed)
        kinds = {v: pick.choice([-1, -1, 0, 4, 4, 4]) for v in range(40)}
        edges = [(f"p{p}", v, kinds[v]) for p in range(14) for v in pick.sample(range(40), pick.randrange(3, 12)) if pick.random() < 0.9 or kinds[v] == 4]
        edges += [("good", v, 4) for v in range(100, 109)] + [("good", 200, -1), ("next", 200, -1), *[("next", v, 4) for v in range(100, 103)]]
        got = pii.trusted_patterns(spark.createDataFrame(edges, "pattern string, value long, seed int")).collect()
        want = plain_trust(edges)
        assert {(r.pattern, r.kind) for r in got} == set(want) and ("good", 4) in want
        assert all(r.trust == pytest.approx(want[r.pattern, r.kind], abs=0.01) for r in got)


def test_identifiers_many_steps_from_a_seed(spark):
    """Every context holds the six values of one group and one of the next; only the first are seeds."""
    groups = [[hashlib.sha1(f"{i}".encode()).hexdigest() for i in range(6)]]
    groups += [[f"u{step}x{i}y9" for i in range(6)] for step in range(4)]
    rows = []
    for step, (known, new) in enumerate(zip(groups, groups[1:])):
        for i, value in enumerate(new):
            context = f"{'abcd'[step]}{'uvwxyz'[i]}"
            rows += [(len(rows) + j, f"{context}p {context}q {v}") for j, v in enumerate([*known, value])]
    rows.append((999, "za zb u7x7y7"))
    found = {r.id: r.added for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(found[i]) == 1 for i, _ in rows[:-1]) and not found[999]


def test_what_follows_a_value_is_a_pattern(spark):
    rows = [(i, f"{w} {hashlib.sha1(w.encode()).hexdigest()} is secret") for i, w in enumerate("abcdef")]
    rows += [(10, "x ab12cd is secret"), (11, "x ab12ce is public")]
    found = {r.id: len(r.added) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[10] == 1 and found[11] == 0


# Pairwise ranking.


def test_ranking_minimises_its_loss():
    pick = np.random.default_rng(3)
    good, bad = pick.normal(0.4, 1, (80, 5)), pick.normal(0, 1, (50, 5))
    weights = quality._rank(good, bad)
    order = np.random.default_rng(7)
    pairs = quality.PAIRS * 50
    gaps = good[order.permutation(pairs) % 80] - bad[order.permutation(pairs) % 50]
    loss = lambda w: np.log1p(np.exp(-gaps @ w)).sum() + 0.5 * 1e-3 * pairs * (w @ w)
    best = loss(weights)
    for _ in range(200):
        assert loss(weights + pick.normal(0, 0.02, 5)) >= best - 1e-9
    # The cut is the quantile that has as many rows below it as have the low label.
    model = quality.Model.fit(good, bad, 800, 500)
    scores = np.concatenate([good, bad]) @ model.weights + model.shift
    cut = np.log(quality.CUT / (1 - quality.CUT))
    mass = np.repeat([800 / 80, 500 / 50], [80, 50])
    assert abs(mass[scores < cut].sum() - 500) <= 10


def test_scores_do_not_see_ids_or_labels(spark):
    rows = [(i, ("Good words stand in a sentence. " if i % 2 else "x|x #### 1 1 1 ") * (3 + i % 5), "en", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.train(docs, labels)
    one = quality.with_score(docs, model).collect()
    two = quality.with_score(docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).alias("source")), model).collect()
    assert [r.score for r in one] == [r.score for r in two]
    assert all((r.score >= quality.CUT) == bool(r.doc_id % 2) for r in one)
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, flipped)
    assert np.array_equal(model.weights, again.weights) and model.shift == again.shift


# Lines of documents without an id.


def test_line_dedup_without_ids(spark):
    """Rows without an id are documents told apart by their texts, and lower than any id."""
    line, other = "This line is shared by many of the documents.", "Another line that only unnamed ones share."
    rows = [(None, f"{line}\n{other}\nown {i}") for i in range(6)] + [(None, f"{line}\n{other}\nown 0")] * 3
    rows += [(i, f"{line}\nown {i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("clash"))
    out = [(r.doc_id, r.text.split("\n")) for r in line_dedup.dedupe_lines(docs).collect()]
    assert len(out) == 13 and [i for i, lines in out if line in lines] == [3]
    keepers = {lines[-1] for i, lines in out if other in lines}
    assert len(keepers) == 1 and all(i is None for i, lines in out if other in lines)
    # Four documents are too few.
    few = spark.createDataFrame([(None, f"{line}\nown 0")] * 9 + [(i, line) for i in range(3)], "doc_id long, text string")
    assert all(line in r.text for r in line_dedup.dedupe_lines(few).collect())


def test_mixing_without_ids(spark):
    """Rows without an id take part like others, and reruns agree."""
    rows = [(None, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(400)] + [(i, "w w w", "a") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    first = mixing.plan_mix(docs).collect()
    for source in {(r.source_size, r.target) for r in first}:
        own = [r for r in first if (r.source_size, r.target) == source]
        assert abs(sum(r.taken for r in own) - source[1]) <= 1 and len({r.before for r in own}) > 20
    key = lambda r: (r.row, r.taken, r.before)
    assert sorted(map(key, first)) == sorted(map(key, mixing.plan_mix(docs).collect()))


def test_every_labelled_row_is_learned_from(spark):
    """Every row is in a pair, with copies too, and the cut is a quantile of all scores."""
    good, bad = 45, 7
    rows = [(i, 1, [float(i), 0.0]) for i in range(good)] + [(good + i, 0, [0.0, float(-i)]) for i in range(bad)]
    table = spark.createDataFrame(rows, "l_id long, label int, x array<double>")
    gaps = [tuple(r.gap) for r in quality.preference_pairs(table, good, bad).collect()]
    each = -(-quality.PAIRS * bad // good)
    assert len(set(gaps)) == len(gaps) == good * each
    assert sorted(a for a, _ in gaps) == sorted([*range(good)] * each) and {b for _, b in gaps} == set(range(bad))
    pick = random.Random(1)
    picked = [pick.choice([0.5, -1.0, 2.0, 7.25]) for _ in range(50)] + [float(i) for i in range(30)]
    values = spark.createDataFrame([(v,) for v in picked], "s double")
    assert quality.values_at(values, "s", [0, 40, 55, 79]) == [sorted(picked)[r] for r in (0, 40, 55, 79)]


def test_no_labelled_row_is_left_out(spark, monkeypatch):
    """More rows of a label than a sample would hold are all weighed."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Some words "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 40 != 0).cast("int").alias("quality"))
    seen, plain = {}, quality.common.staged

    def counted(df, name, row=None):
        out = plain(df, name, row)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(quality.common, "staged", counted)
    quality.train(docs, labels)
    assert seen["label-features"] == labels.where(~quality.held_out()).count() > 8_000
    assert seen["preference-pairs"] >= seen["label-features"] - seen["label-0"]
