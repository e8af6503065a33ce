"""The training-data operators against plain definitions, SQL, and on awkward tables."""

import base64
import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from quillmill.llm import bpe, components, fingerprints, line_dedup, mixing, pii, quality, simhash, token_counts, warc
from quillmill.llm.queries import ORACLES, QUERIES

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
NAMES = "k f row low key id size h t range carried host line words first digest bytes label l_id score place".split()


def docs_of(spark, rows):
    """Documents with columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({name: F.lit("clash") for name in NAMES})


EDGES = [
    (1, "Some line that is long enough to be counted as a repeat.\nown 1", "en", "a", 1),
    (1, "Some line that is long enough to be counted as a repeat.\nown 1", "en", "a", 1),
    (None, None, None, None, None),
    (2, "", None, "a", 0),
    (3, LONG, "en", "b", None),
    (4, " \n\t\n", "en", None, 4),
    (5, "é \U0001f642 \x1c <|endoftext|> 't 'll", "en", "b", 3),
]


@pytest.fixture(scope="module")
def edge_dirs(spark, tmp_path_factory):
    found = {}
    for name, rows in (("full", EDGES), ("empty", [])):
        top = tmp_path_factory.mktemp(name)
        docs_of(spark, rows).write.parquet(f"{top}/documents.parquet")
        labels = [(1, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, None), (5, 1, 0)] if rows else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
        pages = [(1, "http://a.b/x#y", "p" * 200), (2, None, "p" * 200), (None, "u\r\n", None), (2, None, "p" * 200), (9, "", "a\r\n\r\nb")]
        schema = "page_id long, url string, html string"
        spark.createDataFrame(pages if rows else [], schema).withColumn("k", F.lit(1)).write.parquet(f"{top}/pages.parquet")
        items = [(1, "Some line that is long enough to be counted as a repeat."), (None, LONG[:900]), (2, None), (2, ""), (3, "one")]
        items = spark.createDataFrame(items if rows else [], "item_id long, text string")
        items.withColumns({n: F.lit("clash") for n in NAMES}).write.parquet(f"{top}/benchmark.parquet")
        found[name] = str(top)
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_and_empty_tables(spark, edge_dirs, name):
    rows = QUERIES[name](spark, edge_dirs["full"]).collect()
    assert len(rows) == (5 if name == "op4_warc_index" else len(EDGES))
    assert QUERIES[name](spark, edge_dirs["empty"]).count() == 0


def test_stages_keep_columns(spark, edge_dirs):
    for kind in ("full", "empty"):
        docs = spark.read.parquet(f"{edge_dirs[kind]}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, edge_dirs[kind])
            assert out.columns == docs.columns, name
            ids = {r["doc_id"] for r in out.collect()}
            assert ids <= {None, 1, 2, 3, 4, 5} and bool(ids) == (kind == "full"), name
        assert corpus_pipeline.run(spark, edge_dirs[kind]).count() >= 0


def test_edge_values(spark, edge_dirs):
    """What the docstrings state for nulls, blanks, repeated rows and long texts."""
    rows = {name: QUERIES[name](spark, edge_dirs["full"]).collect() for name in QUERIES if name != "op4_warc_index"}
    of = lambda name, i: [r for r in rows[name] if r["doc_id"] == i]
    leaks = {i: of("op11_decontamination", i)[0] for i in (None, 1, 2, 3, 5)}
    assert [(r["n_items"], r["contaminated"]) for r in of("op11_decontamination", 1)] == [(1, True)] * 2
    # The item without an id marks words and lists nothing.
    assert (leaks[3]["n_items"], leaks[3]["contaminated"], leaks[3]["n_hit"] > 90) == (0, True, True)
    assert [tuple(leaks[i])[1:4] for i in (None, 2)] == [(0, 0, 0)] * 2
    drawn = {r["doc_id"]: r for r in rows["op12_importance_resampling"]}
    assert [drawn[i]["n_features"] for i in (None, 2, 4)] == [0, 0, 0] and drawn[3]["n_features"] == 3 * 60_000 - 3
    assert all(r["rank"] is None for r in drawn.values())
    aligned = {r["doc_id"]: r for r in rows["op13_tokenizer_alignment"]}
    assert all(tuple(aligned[i])[1:] == (0, 0, 0, 0, 0, 0, "") for i in (None, 2))
    assert aligned[3]["n_groups"] > 50_000 and aligned[4]["n_a"] > 0
    twins = of("op9_simhash_dedup", 1)
    assert len(twins) == 2 and twins[0] == twins[1] and of("op9_simhash_dedup", None)[0]["fingerprint"] == "0" * 16
    assert {r["component_id"] for i in (2, 4) for r in of("op9_simhash_dedup", i)} <= {None}
    kept = of("op10_line_dedup", None)[0]
    assert (kept["n_lines"], kept["n_dropped"], kept["kept_sha256"]) == (1, 0, sha(""))
    assert [r["n_lines"] for r in of("op10_line_dedup", 4)] == [3]
    for name in ("op7_byte_bpe", "op8_token_counts"):
        assert of(name, None)[0]["n_tokens"] == of(name, 2)[0]["n_tokens"] == 0 and of(name, 3)[0]["n_tokens"] > 60_000
    assert of("op8_token_counts", 3)[0]["n_bytes"] == len(LONG) and of("op8_token_counts", 3)[0]["over_limit"]
    assert of("op7_byte_bpe", 3)[0]["decoded_sha256"] == sha(LONG)
    assert [(r["n_words"], r["base_failed"]) for r in of("op3_line_quality", 2)] == [(0, True)]
    assert [r["size"] for r in of("op5_mixing", 3)] == [60_000] and of("op5_mixing", None)[0]["taken"] == 0
    assert [r["n_chars"] for r in of("op1_document_fingerprints", 2)] == [0]
    assert [r["spans"] for r in of("op2_personal_data", None)] == [""]
    assert all(0 <= r["score"] <= 1 for r in rows["op6_quality_classifier"])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints(spark, texts):
    ids = sorted(texts)
    rows = {r["doc_id"]: r for r in QUERIES["op1_document_fingerprints"](spark, SF).collect()}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[after][:half]
        row = rows[i]
        assert (row["n_chars"], row["edited_sha256"]) == (len(texts[i]), sha(edited))
        assert row["fingerprint"] == fingerprints.fingerprint(texts[i])
        assert row["near_next"] == fingerprints.likeness(row["fingerprint"], rows[after]["fingerprint"])
    above = sum(r["near_edited"] > r["near_next"] + 0.1 for r in rows.values())
    assert above > 0.97 * len(rows)


def plain_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = best[:]
        for j, y in enumerate(b):
            best[j + 1] = last[j] + 1 if x == y else max(last[j + 1], best[j])
    return best[-1]


def test_common_subsequence_and_local_edits():
    pick = random.Random(1)
    for _ in range(200):
        a, b = ([pick.choice("abcd") for _ in range(pick.randrange(20))] for _ in range(2))
        assert fingerprints._common(a, b) == plain_common(a, b)
    text = " ".join(str(pick.random()) for _ in range(500))
    assert fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint("x" + text)) > 0.9
    assert fingerprints.likeness(fingerprints.fingerprint(""), fingerprints.fingerprint("")) == 1.0
    assert len(fingerprints.fingerprint("be " * 50_000)) < 1000


def test_personal_data(spark, tmp_path):
    rows = [(i, f"filler {i} code id = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" end", "en", "a", 1) for i in range(9)]
    rows += [(20, 'other id = "ab12cd" end. mail me@x.org, 1.2.3.4 or 1.2.3.999', "en", "a", 1)]
    rows += [(21, "+1 (706) 555-3138 and 4111 1111 1111 1111 and 4111 1111 1111 1112", "en", "a", 1)]
    rows += [(22, "in 1999 the 1234567 th", "en", "a", 1)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op2_personal_data"](spark, str(tmp_path)).collect()}
    assert (got[20]["n_email"], got[20]["n_ip"], got[21]["n_card"], got[21]["n_phone"]) == (1, 1, 1, 1)
    assert got[20]["base_sha256"] == sha("email:30:38,ip:40:47")
    # The short value is found by its context alone.
    assert "secret:12:18" in got[20]["spans"].split(",")
    assert got[22]["spans"] == "" and all(got[i]["n_added"] == 1 for i in range(9))


def test_warc_round_trip(spark, tmp_path):
    html = ["same " * 40, "same " * 40, "short", "short", "a\r\n\r\nb" * 30, "same " * 40]
    pages = spark.createDataFrame([(i + 5, f"http://h.example/{i % 2}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w")
    rows = {r["page_id"]: r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert [rows[i + 5]["refers_to"] for i in range(6)] == [None, 5, None, None, None, 5]
    assert all(rows[i + 5]["payload_bytes"] == len(h) and rows[i + 5]["payload_digest"] == sha(h) for i, h in enumerate(html))
    captures = spark.createDataFrame(list(rows.values()), warc.CAPTURES)
    order = warc.merge_index(captures).orderBy("range_no", "range_place").collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in order]
    assert keys == sorted(keys) and len(keys) == 6


def test_loser_tree():
    pick = random.Random(3)
    for k in range(1, 12):
        runs = [sorted((pick.randrange(9),) for _ in range(pick.randrange(7))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_mixing_order_and_totals(spark):
    docs = docs_of(spark, [(i, "w " * (1 + i % 7), "en", "abc"[i % 3], 1) for i in range(300)])
    out = mixing.mix(docs).collect()
    words = Counter()
    for r in out:
        words[r["source"]] += len(r["text"].split())
    plan = {r["source"]: r for r in mixing.source_targets(docs.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("source_size"))).collect()}
    assert all(abs(words[s] - plan[s]["target"]) <= 7 for s in "abc")
    assert [r["doc_id"] for r in out] == [r["doc_id"] for r in mixing.mix(docs).collect()]


def test_classifier_on_held_out(spark, duck):
    got = {r["doc_id"]: r for r in QUERIES["op6_quality_classifier"](spark, SF.replace("0.001", "0.01")).collect()}
    labels = duck.execute(f"SELECT doc_id, quality FROM '{SF.replace('0.001', '0.01')}/labels.parquet'").fetchall()
    held = [(got[i]["predicted"], q) for i, q in labels if i in got and got[i]["held_out"]]
    assert len(held) > 50 and sum(p == q for p, q in held) > 0.95 * len(held)
    assert all((r["score"] >= quality.CUT) == (r["predicted"] == 1) for r in got.values())


def alphabets():
    return ["ab ", "'sreaveldmt \n", "aé 1٣　\x1c\x85. '!\r\n\t", "abcdefghijklmnop", "  \n", "0123 ", "\U0001f642a‍"]


def samples(seed):
    pick = random.Random(seed)
    for _ in range(600):
        letters = pick.choice(alphabets())
        yield "".join(pick.choice(letters) for _ in range(pick.choice([3, 20, 200, 1500])))


@pytest.mark.parametrize("leaf_chars,leaf_bytes", [(32_768, 6), (64, 4), (7, 1)])
def test_bpe_tree(monkeypatch, texts, leaf_chars, leaf_bytes):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf_chars)
    monkeypatch.setattr(bpe, "LEAF_BYTES", leaf_bytes)
    path = public_tokenizers.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec(path)
    for text in [*list(texts.values())[:60], *samples(leaf_chars)]:
        ids = own.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_query(spark, texts):
    for r in QUERIES["op7_byte_bpe"](spark, SF).collect():
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]])
        ids = bpe.codec(bpe.VOCABULARY).encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))


@pytest.mark.parametrize("chunk", [65_536, 50, 7])
def test_token_counts(monkeypatch, texts, chunk):
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", chunk)
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library, own = Tokenizer.from_file(path), token_counts.Transducer(path)
    for text in [*list(texts.values())[:60], *samples(chunk), "a<|endoftext|><|endoftext|> b", ""]:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def long_words(size):
    pick = random.Random(5)
    runs = ["a", "1", "!?", "é", "漢", " ", "\n"]
    return [run * (size // len(run)) for run in runs] + ["".join(pick.choices("abAB01", k=size))]


def test_long_words_as_the_libraries(monkeypatch):
    """One word without end: quick, and the tokens of the libraries, also when states are forgotten."""
    own, counts = bpe.codec(bpe.VOCABULARY), token_counts.Transducer(public_tokenizers.path(token_counts.VOCABULARY))
    ranks = {own.bytes_of[i]: i for i in own.bytes_of}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    for text in long_words(20_000):
        assert own.encode(text) == reference.encode(text, disallowed_special=())
        assert counts.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert len(counts.states) <= 50
        pii.scan(text + " @ 1.2")


def test_merging_by_heap(monkeypatch):
    own, pick = bpe.codec(bpe.VOCABULARY), random.Random(6)
    for _ in range(300):
        data = "".join(pick.choices("aab the1!", k=pick.randrange(200))).encode()
        monkeypatch.setattr("quillmill.llm.merges.SCANNED_BYTES", 10_000)
        plain = own.merge(data)
        monkeypatch.setattr("quillmill.llm.merges.SCANNED_BYTES", 0)
        assert own.merge(data) == plain == own.tokens(data)


def test_base_spans_of_crowded_texts():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    pick = random.Random(7)
    for _ in range(3_000):
        text = "".join(pick.choices("ab1.@_-", (2, 1, 4, 6, 3, 1, 1), k=40))
        wanted = [(m.start(), 0, m.end()) for m in email.finditer(text)]
        wanted += [
            (m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))
        ]
        assert [s for s in pii.base_spans(text) if s[1] < 2] == sorted(wanted)


def plain_fingerprint(text):
    words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2 and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def test_simhash_query(spark, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    expected = plain_components(prints)
    for r in QUERIES["op9_simhash_dedup"](spark, SF).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == expected[r["doc_id"]]


def test_vantage_point_shards(spark, monkeypatch):
    """Many shards, dense groups and far points: no link is lost at shard borders."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 40)
    monkeypatch.setattr(simhash, "LEAF", 8)
    pick = random.Random(5)
    values = {pick.getrandbits(64) for _ in range(400)}
    for _ in range(900):
        values.add(pick.choice(sorted(values)) ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)))
    prints = dict(enumerate(sorted(values)))
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in prints.items()]
    found = simhash.components(spark.createDataFrame([(i, 0, f) for i, f in signed], "k long, t long, f long"))
    got = {r["f"]: r["component"] for r in found.collect()}
    assert {i: got[f] for i, f in signed} == plain_components(prints)


def test_star_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = components.star_components(spark.createDataFrame(edges, "a long, b long"), "test-links").collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_keep_one_of_a_group(spark):
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(i, text, "en", "a", 1) for i in range(5)] + [(0, text, "en", "a", 1), (7, "quite another text here", "en", "a", 1)]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs_of(spark, rows)).collect()) == [0, 7]


def test_keep_one_without_ids(spark):
    """Rows without an id are no single document: each group of like texts keeps one of them."""
    copied = " ".join(f"w{i}" for i in range(90))
    others = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(None, copied, "en", "a", 1)] * 3 + [(None, t, "en", "a", 1) for t in others] + [(4, others[0], "en", "a", 1), (5, None, "en", "a", 0)]
    kept = simhash.keep_one(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(0, copied), *((0, t) for t in others), (5, "")])
    found = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.report(docs_of(spark, rows)).collect()}
    assert len(found) == 6 and all((c == 5) == (i == 5) for (i, _), c in found.items())


def test_line_dedup_with_saturated_filters(spark, monkeypatch):
    """Filters too small for their lines send more to be confirmed, and change no result."""
    monkeypatch.setattr(line_dedup, "MOST_BITS", 2**16)
    monkeypatch.setattr(line_dedup, "BLOCK", 50)
    shared = "This LINE is shared by several of the documents here."
    rows = [(i, f"{shared.upper() if i % 2 else '  ' + shared}\nown line of document number {i}, long enough to count", "en", "a", 1) for i in range(3000)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedupe_lines(docs_of(spark, rows)).collect()}
    assert out[2999].startswith(shared.upper()) and all(out[i].startswith("own line") for i in range(2999))


def near_copied(pick, bases, copies):
    """Texts, and copies of them with one to six words changed."""
    out = []
    for b in range(bases):
        words = [f"w{pick.randrange(3_000)}" for _ in range(pick.choice([4, 60, 130, 300, 900]))]
        out.append(" ".join(words))
        for _ in range(copies):
            changed = list(words)
            for _ in range(pick.randrange(0, 7)):
                changed[pick.randrange(len(changed))] = f"x{pick.randrange(10**6)}"
            out.append(" ".join(changed))
    pick.shuffle(out)
    return out


def test_keep_one_of_near_copies(spark):
    """One document of each component of the report stays, the one that names it."""
    texts = dict(enumerate([*near_copied(random.Random(8), 60, 4), "", " \n", "One two", "one  TWO"]))
    kept = simhash.keep_one(docs_of(spark, [(i, t, "en", "a", 1) for i, t in texts.items()])).collect()
    found = plain_components({i: plain_fingerprint(t) for i, t in texts.items()})
    assert sorted(r["doc_id"] for r in kept) == sorted(set(found.values()))
    assert 60 < len(kept) < len(texts) - 60


_ENDLESS = """
import resource, sys
import public_tokenizers
from quillmill.llm import token_counts

own = token_counts.Transducer(public_tokenizers.path(token_counts.VOCABULARY))
block, text = "Qx7abc12", "Qx7abc12" * 2_500_000
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
each, before = own.count(block), peak()
assert own.count(text) == 2_500_000 * each
word = "ab" * 10_000_000
assert own.count(word) == own.count_piece(word)
print((peak() - before) // 1024)
"""


def test_token_counts_of_a_text_without_spaces():
    """20 million characters without a sure cut: memory stays near that of the text."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", _ENDLESS], cwd=top, capture_output=True, text=True, check=True)
    assert int(ran.stdout) < 150
