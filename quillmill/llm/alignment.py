"""Cross-tokenizer alignment with inverted pair bitmaps.

Two tokenizers cut the same bytes; where a token of each ends at the same byte, the two are linked,
and the tokens between two such ends form a group. The links are kept as an inverted index. A pair
of ids has, per chunk of CHUNK documents, a bitmap of the documents that link it, and planes for
how often: plane n holds the documents whose further links have bit n - 1 set. A bitmap is a list of
places, or plain bits where that is shorter.

A task ORs the places of a chunk into its bitmaps while it reads the documents; chunks share no
document, so what is left of the OR-merge is that counts add up: the popcounts of the bitmaps give a
pair's documents, those of all planes, weighted, its links. The postings then return the scores:
each bitmap carries its pair's count back to its chunk, where one array per chunk sums them up.

A text that is null or empty, or whose tokens' bytes are not its own (the pieces spell a space as
U+2581, so a text that holds that character is not reproduced), has no tokens. Rows that repeat an id
or have none are documents of their own. Texts of more than PART_CHARS characters are encoded in
parts that end before a space behind another character, where neither vocabulary joins anything; a
longer run without one is encoded at once. Only the columns that are named are read; an empty table
gives an empty result.

The byte-level vocabulary is applied by rank, which gives the tokens of its list of merges as long as
every token is what its own bytes merge into; the tests go through all of them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from tokenizers import Tokenizer

from quillmill.llm import common
from quillmill.llm.token_counts import byte_letters

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Documents of a bitmap, as a power of two, and the bytes of its plain form.
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
PLAIN_BYTES = CHUNK // 8
#: Links that a task holds before it writes a chunk's bitmaps, if the chunk does not end earlier.
MOST_LINKS = 4_000_000
PART_CHARS = 200_000
#: Characters that are handed to the tokenizers at a time.
BATCH_CHARS = 500_000
_CUT = re.compile(r"(?<=\S) ")
_LONG_SPACE = re.compile(r"\s{1000}")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

HEAD = "row long, id long, n_a long, n_b long, n_groups long, groups_sha256 string"
POSTING = "a int, b int, chunk long, plane int, docs long, bits binary"


class Tokens:
    """One tokenizer's side: its ids for many texts, the bytes of each id, and how an id is written."""

    def __init__(self, encode: Callable[[list[str]], list], spelled: list[bytes], group_end: str) -> None:
        self.encode = encode
        self.spelled = np.array(spelled, object)
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        #: Two forms per id: inside a group, and as the last of its group.
        self.written = [f"{i}{mark}" for i in range(len(spelled)) for mark in (",", group_end)]


def _byte_level(path: str) -> Tokens:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    spelled = [b""] * (1 + max(spec["model"]["vocab"].values()))
    for token, i in spec["model"]["vocab"].items():
        spelled[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    ranks = {s: i for i, s in enumerate(spelled) if s and s.decode("utf-8", "replace") not in special}
    library = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @lru_cache(maxsize=1)
    def by_merges() -> Tokenizer:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True
        return found

    def encode(part: str) -> list[int]:
        # The pattern of the first library gives up on very long runs of white space.
        if _LONG_SPACE.search(part):
            return by_merges().encode(part, add_special_tokens=False).ids
        return library.encode_ordinary(part)

    return Tokens(lambda parts: [encode(part) for part in parts], spelled, "|")


def _pieces(path: str) -> Tokens:
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    space = library.piece_to_id("▁")

    def in_bytes(piece: str) -> bytes:
        one = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode()

    def encode(parts: list[str]) -> list[list[int]]:
        # The library adds the space that every part begins with, but not to an empty text.
        found = library.encode([part[1:] for part in parts], num_threads=1)
        return [ids if len(part) > 1 else [space] for part, ids in zip(parts, found)]

    return Tokens(encode, [in_bytes(library.id_to_piece(i)) for i in range(library.get_piece_size())], ";")


def parts_of(text: str) -> list[str]:
    """A space and the text, cut where no token crosses; every part begins with a space."""
    text = " " + text
    cuts = [0]
    while len(text) - cuts[-1] > PART_CHARS:
        found = _CUT.search(text, cuts[-1] + PART_CHARS)
        if found is None:
            break
        cuts.append(found.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


class Aligner:
    """Both tokenizers on one worker."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = _byte_level(path_a), _pieces(path_b)
        self.pairs_per_a = len(self.b.spelled)
        self.written = np.array(self.a.written + self.b.written, object)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of both for each text; none where the bytes of one are not the text's."""
        parts = [parts_of(text) if text else [] for text in texts]
        flat = [part for own in parts for part in own]
        ids_a, ids_b = self.a.encode(flat), self.b.encode(flat)
        at = 0
        for text, own in zip(texts, parts):
            a, b = (
                np.concatenate([np.array(ids, np.int64) for ids in side[at : at + len(own)] or [[]]]) for side in (ids_a, ids_b)
            )
            at += len(own)
            data = f" {text}".encode("utf-8", "surrogatepass")
            alike = all(b"".join(side.spelled[ids].tolist()) == data for side, ids in ((self.a, a), (self.b, b)))
            yield (a, b) if alike else (a[:0], b[:0])

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of the tokens of either side that end where one of the other ends."""
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        ending = np.zeros((2, 1 + int(ends_a[-1])) if len(a) else (2, 0), bool)
        ending[0, ends_a], ending[1, ends_b] = True, True
        return np.flatnonzero(ending[1, ends_a]), np.flatnonzero(ending[0, ends_b])

    def groups_text(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        forms_a, forms_b = 2 * a, 2 * b + len(self.a.written)
        forms_a[last_a] += 1
        forms_b[last_b] += 1
        # A group's tokens of B follow its tokens of A.
        before = np.repeat(np.concatenate([[0], last_b[:-1] + 1]), np.diff(last_a, prepend=-1))
        until = np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + before] = forms_a
        out[np.arange(len(b)) + until] = forms_b
        return "".join(self.written[out].tolist())[:-1]


@lru_cache(maxsize=2)
def aligner(vocabulary_a: str, vocabulary_b: str) -> Aligner:
    return Aligner(public_tokenizers.path(vocabulary_a), public_tokenizers.path(vocabulary_b))


# Bitmaps.


def _binary(parts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte strings of the given lengths, cut from one array."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(parts.tobytes())])


def bitmaps(pairs: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Per plane that is not empty its number, the pairs it has, their popcounts and their bitmaps, of
    all links of a chunk: one entry of ``pairs`` and ``docs`` (a place in the chunk) per link."""
    keys, links = np.unique(pairs << CHUNK_BITS | docs, return_counts=True)
    more = links - 1
    for plane in range(1 + int(more.max(initial=0)).bit_length()):
        held = keys if plane == 0 else keys[(more >> (plane - 1)) & 1 == 1]
        if not len(held):
            continue
        found, starts, counts = np.unique(held >> CHUNK_BITS, return_index=True, return_counts=True)
        places = (held & (CHUNK - 1)).astype(np.uint16)
        plain = counts >= PLAIN_BYTES // 2
        lengths = np.where(plain, PLAIN_BYTES, 2 * counts)
        data = np.empty(int(lengths.sum()), np.uint8)
        into = np.concatenate([[0], np.cumsum(lengths)])
        short = np.repeat(~plain, counts)
        data[np.repeat(~plain, lengths)] = places[short].view(np.uint8)
        for i in np.flatnonzero(plain).tolist():
            bits = np.zeros(CHUNK, bool)
            bits[places[starts[i] : starts[i] + counts[i]]] = True
            data[into[i] : into[i + 1]] = np.packbits(bits, bitorder="little")
        yield plane, found, counts, _binary(data, lengths)


def places_of(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places that bitmaps hold, one after the other, and how many each has."""
    offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
    lengths = np.diff(offsets)
    data = np.frombuffer(bits.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = lengths == PLAIN_BYTES
    in_plain = np.repeat(plain, lengths)
    of_plain, places_plain = np.nonzero(np.unpackbits(data[in_plain].reshape(-1, PLAIN_BYTES), axis=1, bitorder="little"))
    places_short = data[~in_plain].view(np.uint16)
    counts = lengths // 2
    counts[plain] = np.bincount(of_plain, minlength=int(plain.sum()))
    places = np.empty(int(counts.sum()), np.int64)
    is_plain = np.repeat(plain, counts)
    places[is_plain], places[~is_plain] = places_plain, places_short
    return places, counts


def _filled(names: dict[str, pa.Array], schema: pa.Schema, rows: int) -> pa.RecordBatch:
    """A batch of all columns; those without values are null."""
    columns = [names.get(f.name, pa.nulls(rows, f.type)).cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _indexed(vocabulary_a: str, vocabulary_b: str, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(vocabulary_a, vocabulary_b)
        pairs: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        held, chunk = 0, None

        def flushed() -> Iterator[pa.RecordBatch]:
            if held:
                for plane, found, counts, bits in bitmaps(np.concatenate(pairs), np.concatenate(docs)):
                    rows = len(found)
                    names = {
                        "a": pa.array(found // own.pairs_per_a),
                        "b": pa.array(found % own.pairs_per_a),
                        "chunk": pa.array(np.full(rows, chunk)),
                        "plane": pa.array(np.full(rows, plane)),
                        "docs": pa.array(counts),
                        "bits": bits,
                    }
                    yield _filled(names, schema, rows)
                pairs.clear()
                docs.clear()

        def heads(rows: list[int], ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal held, chunk
            facts = []
            for row, (a, b) in zip(rows, own.encode(texts)):
                last_a, last_b = own.align(a, b)
                digest = ""
                if len(a):
                    digest = hashlib.sha256(own.groups_text(a, b, last_a, last_b).encode()).hexdigest()
                facts.append((len(a), len(b), len(last_a), digest))
                if row >> CHUNK_BITS != chunk or held >= MOST_LINKS:
                    yield from flushed()
                    held, chunk = 0, row >> CHUNK_BITS
                pairs.append(a[last_a] * own.pairs_per_a + b[last_b])
                docs.append(np.full(len(last_a), row & (CHUNK - 1), np.int64))
                held += len(last_a)
            columns = [rows, ids, *zip(*facts)]
            names = ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256"]
            yield _filled({n: pa.array(list(c)) for n, c in zip(names, columns)}, schema, len(rows))

        for batch in batches:
            rows, ids, texts = (batch.column(name).to_pylist() for name in ("row", "id", "text"))
            start = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= BATCH_CHARS or i == len(texts) - 1:
                    yield from heads(rows[start : i + 1], ids[start : i + 1], texts[start : i + 1])
                    start, size = i + 1, 0
        yield from flushed()

    return run


def index(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_a: str = VOCABULARY_A,
    vocabulary_b: str = VOCABULARY_B,
) -> tuple[DataFrame, DataFrame]:
    """The documents ``row, id, n_a, n_b, n_groups, groups_sha256`` and the postings ``a, b, chunk, plane,
    docs, bits``, in one staged table that one pass over the texts writes."""
    kind = _parse_datatype_string(f"{HEAD}, {POSTING}")
    texts = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        common.text_of(text_col).alias("text"),
    )
    run = _indexed(vocabulary_a, vocabulary_b, to_arrow_schema(kind))
    written = common.staged(texts.mapInArrow(run, kind), "pair-index")
    name_of = lambda schema: [part.split()[0] for part in schema.split(", ")]
    return written.where("row IS NOT NULL").select(*name_of(HEAD)), written.where("a IS NOT NULL").select(*name_of(POSTING))


def _weight() -> Column:
    """How many links a document in a plane stands for."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.col("plane") - 1, F.lit(0)))


def pair_counts(postings: DataFrame) -> DataFrame:
    """The staged table ``a, b, documents, links, best``: per pair of ids in how many documents it is
    linked, how often, and whether no pair of its ``b`` is linked more often."""
    counted = postings.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("docs"))).alias("documents"),
        F.sum(_weight() * F.col("docs")).alias("links"),
    )
    highest = F.max("links").over(Window.partitionBy("b"))
    return common.staged(counted.withColumn("best", F.col("links") == highest), "pair-counts")


def _scored(table: pa.Table) -> pa.Table:
    """The sums that a chunk's bitmaps bring to its documents."""
    table = table.combine_chunks()
    chunk = table.column("chunk")[0].as_py()
    sums = np.zeros((2, CHUNK), np.int64)
    linked = np.zeros(CHUNK, bool)
    for batch in table.to_batches():
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        places, counts = places_of(column("bits"))
        for total, name in zip(sums, ("score", "best")):
            np.add.at(total, places, np.repeat(column(name).to_numpy(), counts))
        linked[places] = True
    docs = np.flatnonzero(linked)
    return pa.table({"s_row": (chunk << CHUNK_BITS) + docs, "count_sum": sums[0][docs], "n_best": sums[1][docs]})


def align(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_a: str = VOCABULARY_A,
    vocabulary_b: str = VOCABULARY_B,
) -> DataFrame:
    """Per row of ``df`` its id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    heads, postings = index(df, id_col, text_col, vocabulary_a, vocabulary_b)
    counts = pair_counts(postings).select(F.col("a").alias("c_a"), F.col("b").alias("c_b"), "links", "best")
    returned = postings.join(counts, (F.col("a") == F.col("c_a")) & (F.col("b") == F.col("c_b"))).select(
        "chunk", (_weight() * F.col("links")).alias("score"), (_weight() * F.col("best").cast("long")).alias("best"), "bits"
    )
    scores = returned.groupBy("chunk").applyInArrow(_scored, "s_row long, count_sum long, n_best long")
    zero = F.lit(0).cast("long")
    return heads.join(scores, F.col("row") == F.col("s_row"), "left").select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.documents(spark, sf_dir))
