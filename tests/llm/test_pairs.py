"""Tokenizer alignment, decontamination and resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmill.llm import alignment, decontaminate, resample, token_counts

CLASH = "row pos head size words item window_no gram_no key first past rank score segment eligible a b chunk plane bits weight run place id".split()


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).withColumns({name: F.lit("clash") for name in CLASH})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Alignment.

SAID = [
    "The quick brown fox jumps over the lazy dog.",
    "the the the the the the the",
    "Déjà vu: 1999,  two  spaces \t tab\nline   ",
    "日本語のテキスト and \U0001f642 emoji",
    "▁ is not kept",
    "<|endoftext|> <s> <0x41> are plain",
    "x" * 300,
    " ",
    "",
    None,
]


def plain_alignment(texts):
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def bytes_b(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()

    rows, links = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a = one.encode(" " + text, add_special_tokens=False).ids
            b = two.encode(text)
            spelled_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
            spelled_b = [bytes_b(i) for i in b]
            if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
                a = b = []
        groups, found = [], []
        if a:
            i = j = 0
            at_a, at_b = len(spelled_a[0]), len(spelled_b[0])
            start_a = start_b = 0
            while True:
                if at_a == at_b:
                    groups.append(",".join(map(str, a[start_a : i + 1])) + "|" + ",".join(map(str, b[start_b : j + 1])))
                    found.append((a[i], b[j]))
                    start_a, start_b = i + 1, j + 1
                    if start_a == len(a):
                        break
                    i, j = start_a, start_b
                    at_a += len(spelled_a[i])
                    at_b += len(spelled_b[j])
                elif at_a < at_b:
                    i += 1
                    at_a += len(spelled_a[i])
                else:
                    j += 1
                    at_b += len(spelled_b[j])
        links.update(found)
        rows.append((len(a), len(b), groups, found))
    best = defaultdict(int)
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    return [
        (n_a, n_b, len(groups), len(found), sum(links[p] == best[p[1]] for p in found), sum(links[p] for p in found),
         sha(";".join(groups)) if groups else "")
        for n_a, n_b, groups, found in rows
    ]


def aligned(spark, texts):
    docs = table(spark, list(enumerate(texts))).repartition(3)
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return [tuple(r[n] for n in names) for r in sorted(alignment.align(docs).collect(), key=lambda r: r["doc_id"])]


def test_alignment(spark):
    pick = random.Random(5)
    texts = SAID + [" ".join(pick.choice(SAID[:4]).split()[0] + pick.choice("abc ") for _ in range(40)) for _ in range(60)]
    want = plain_alignment(texts)
    assert aligned(spark, texts) == want
    assert sum(w[2] for w in want) > 500 and want[4] == (0, 0, 0, 0, 0, 0, "") and max(w[5] for w in want) > 1000


def test_alignment_of_parts_and_small_chunks(spark, monkeypatch):
    whole = alignment.aligner(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    pick = random.Random(8)
    texts = ["One two, three.  Four\n five " * 30 + "y" * 100]
    for letters in ("ab \n", "aé'1.  \t", "the, cat\x1c\u3000\x85 ", "x日 \r\n"):
        texts += ["".join(pick.choice(letters) for _ in range(pick.choice([1, 5, 80]))) for _ in range(60)]
    want = [[ids.tolist() for ids in found] for found in whole.encode(texts)]
    assert sum(bool(found[0]) for found in want) > 200
    for size in (1, 10, 100):
        monkeypatch.setattr(alignment, "PART_CHARS", size)
        assert all("".join(alignment.parts_of(text)) == " " + text for text in texts)
        assert [[ids.tolist() for ids in found] for found in whole.encode(texts)] == want
    assert len(alignment.parts_of(texts[0])) > 5


def test_ranks_give_the_tokens_of_the_list_of_merges():
    own = token_counts.transducer(alignment.VOCABULARY_A)
    tokens = alignment.aligner(alignment.VOCABULARY_A, alignment.VOCABULARY_B).a
    plain = [s for i, s in enumerate(tokens.spelled.tolist()) if s != b"<|endoftext|>"]
    assert len(plain) == 50_256 and {len(own.merge(s)) for s in plain} == {1}
    library = Tokenizer.from_file(public_tokenizers.path(alignment.VOCABULARY_A))
    library.encode_special_tokens = True
    pick = random.Random(3)
    texts = SAID[:-2] + ["".join(pick.choice("sreaveldmt 'ABé1.,\n日\x00") for _ in range(400)) for _ in range(200)]
    texts += [space * 100_000 + "x" for space in " \n\t"] + [" " * 999 + "a", "x" * 100_000]
    assert tokens.encode(texts) == [library.encode(text, add_special_tokens=False).ids for text in texts]


def test_pair_documents(spark):
    docs = table(spark, [(i, "the the cat" if i % 3 else "the dog") for i in range(90)])
    heads, postings = alignment.index(docs)
    counts = alignment.pair_counts(postings).collect()
    by_size = sorted((r["documents"], r["links"]) for r in counts)
    assert by_size == [(30, 30), (60, 60), (90, 150)] and heads.count() == 90


def test_bitmaps():
    pick = np.random.default_rng(1)
    pairs = np.concatenate([pick.integers(0, 50, 3000), np.full(9000, 7), np.full(256, 99)])
    docs = np.concatenate([pick.integers(0, alignment.CHUNK, 12_000), np.arange(256)])
    links = Counter(zip(pairs.tolist(), docs.tolist()))
    got = Counter()
    forms = set()
    for plane, found, counts, bits in alignment.bitmaps(pairs, docs):
        for part in (bits, bits.slice(3)):
            places, sizes = alignment.places_of(part)
            assert sizes.tolist() == counts.tolist()[len(bits) - len(part) :] and len(places) == sizes.sum()
        places, sizes = alignment.places_of(bits)
        for pair, doc in zip(np.repeat(found, sizes).tolist(), places.tolist()):
            got[pair, doc] += 1 << max(0, plane - 1)
        forms |= {len(b) == alignment.PLAIN_BYTES for b in bits.to_pylist()}
    assert got == links and forms == {True, False}
    assert list(alignment.bitmaps(pairs[:0], docs[:0])) == []


def test_alignment_of_an_empty_table(spark):
    assert aligned(spark, []) == []
    assert aligned(spark, [None, "", None]) == [(0, 0, 0, 0, 0, 0, "")] * 3


# Decontamination.

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_leaks(docs, items, window):
    windows = defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1):
            if size:
                windows[tuple(words[i : i + size])].add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                owners = windows.get(tuple(words[i : i + size]))
                if owners:
                    hit |= set(range(i, i + size))
                    found |= {str(o) for o in owners if o is not None}
        yield doc, len(words), hit, sorted(found)


def check_leaks(spark, docs, items, **settings):
    got = decontaminate.find_leaks(table(spark, docs), table(spark, items, "item_id long, text string"), **settings).collect()
    found = sorted((r["doc_id"] or -1, r["n_words"], [i for s in r["spans"] for i in range(s["first"], s["past"])], r["items"]) for r in got)
    want = sorted((d or -1, n, sorted(hit), items) for d, n, hit, items in plain_leaks(docs, items, settings.get("window", 10)))
    assert found == want
    for r in got:
        ends = [(s["first"], s["past"]) for s in r["spans"]]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    return found


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", block)
    pick = random.Random(2)
    letters = ["the", "of", "A", "é", "x1", "日本", "and"]
    text = lambda n: " ".join(pick.choice(letters) for _ in range(n))
    items = [(i, text(pick.choice([10, 12, 25]))) for i in range(6)]
    items += [(9, items[0][1]), (None, items[1][1] + " extra"), (11, "Of, THE; x1!"), (12, "zebra"), (13, None), (14, " ,. "), (11, items[2][1])]
    docs = [(i, text(pick.choice([0, 3, 9, 40]))) for i in range(20)]
    docs += [(100 + i, f"{text(5)}, {(t or '').upper()}. {text(pick.randrange(4))} {t}") for i, (_, t) in enumerate(items)]
    docs += [(None, "of the x1"), (None, None), (5, ""), (100, items[0][1]), (7, (items[3][1] + " ") * 50), (8, "zebra")]
    found = check_leaks(spark, docs, items)
    assert sum(bool(f[2]) for f in found) > 10 and not all(f[2] for f in found)


def test_decontamination_of_other_windows(spark):
    items = [(1, "a b c d e f g h"), (2, "c d e"), (3, "a a a a a a")]
    docs = [(1, "x a b c d e f y"), (2, "a a a a"), (3, "b c d e"), (4, "a b c d f g h")]
    for window, shingle in ((4, 2), (4, 4), (3, 2), (1, 1), (6, 5)):
        check_leaks(spark, docs, items, window=window, shingle=shingle)
    with pytest.raises(ValueError):
        check_leaks(spark, docs, items, window=10, shingle=4)


def test_decontamination_of_empty_tables(spark):
    assert check_leaks(spark, [], [(1, "a b")]) == []
    assert [f[2] for f in check_leaks(spark, [(1, "a b"), (2, None)], [])] == [[], []]


# Resampling.


def plain_features(text):
    words = plain_words(text)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_draw(docs, target, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, text in docs for f in plain_features(text)[1])
    t = Counter(bucket(f) for text in target for f in plain_features(text)[1])
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    rows = []
    for place, (doc, text) in enumerate(docs):
        n, features = plain_features(text)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(sha(f"42:{'' if doc is None else doc}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([n >= least, (-score, doc is None, doc or 0, place), doc, len(features), weight, score, None])
    fit = sorted((r for r in rows if r[0]), key=lambda r: r[1])
    for rank, r in enumerate(fit[: share[0] * len(fit) // share[1]]):
        r[-1] = rank + 1
    return sorted((tuple(r[2:]) for r in rows), key=repr)


def check_draw(spark, docs, target, share=(5, 100), least=20, parts=1):
    source = table(spark, docs).coalesce(1) if parts == 1 else table(spark, docs).repartition(parts)
    got = resample.resample(source, table(spark, [(t,) for t in target], "text string"), share=share, least_words=least)
    found = sorted((tuple(r[n] for n in "doc_id n_features weight score rank".split()) for r in got.collect()), key=repr)
    assert found == plain_draw(docs, target, share, least)
    return found


@pytest.mark.parametrize("segment", [1_000_000, 3])
def test_resampling(spark, monkeypatch, segment):
    monkeypatch.setattr(resample, "SEGMENT_ROWS", segment)
    monkeypatch.setattr(resample, "CHUNK_BYTES", 30)
    pick = random.Random(4)
    words = ["the", "Cat", "sät", "on", "MAT", "x9", "日本"]
    text = lambda n: "-".join(pick.choice(words) for _ in range(n))
    docs = [(i, text(pick.choice([0, 1, 2, 19, 20, 60]))) for i in range(400)]
    docs += [(i, "copy " * 30) for i in range(500, 600)] + [(7000, None), (7001, " "), (None, None)]
    target = [text(30) for _ in range(5)] + [None, "the cat"]
    found = check_draw(spark, docs, target)
    assert sum(r[-1] is not None for r in found) == 5 * sum(len(plain_words(t)) >= 20 for _, t in docs) // 100
    check_draw(spark, docs, target, share=(9, 10), least=1, parts=4)
    check_draw(spark, docs, target, share=(1, 1), least=0, parts=3)


def test_resampling_of_ties_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(resample, "SEGMENT_ROWS", 4)
    # One text and one id: equal scores throughout, told apart by their place in the table.
    found = check_draw(spark, [(1, "a b c d")] * 50 + [(None, "a b c d")] * 50, ["a b"], share=(1, 2), least=1)
    assert sorted(r[-1] for r in found if r[-1]) == list(range(1, 51))


def test_resampling_of_empty_tables(spark):
    assert check_draw(spark, [], ["a b c"]) == []
    check_draw(spark, [(i, "w " * i) for i in range(60)], [])


def test_features_of_long_texts(monkeypatch):
    text = " ".join(f"w{i * i % 91}" for i in range(3000))
    whole = Counter(b for _, found in resample.feature_buckets(text) for b in found.tolist())
    monkeypatch.setattr(resample, "CHUNK_BYTES", 5)
    parts = Counter(b for _, found in resample.feature_buckets(text) for b in found.tolist())
    assert whole == parts == Counter(zlib.crc32(f.encode()) % 10_000 for f in plain_features(text)[1])
