"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes decides where a chunk ends, so the cuts move with the
content: an edit changes only the chunks around it. A fingerprint holds the chunk signatures at a
block size and at twice that size; two fingerprints are compared by edit distance at whichever
block sizes they share.

Nulls count as the empty text; equal texts have equal fingerprints whatever their length. Rows
with the same id follow each other in the order of their texts, a null id comes first, and in a
table of one row the next document is the document itself. An empty table gives an empty result;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import common

WINDOW = 7
#: Chunks a text is meant to have at the smaller block size, at least.
CHUNKS = 32
#: More signatures than this call for a larger block size.
MOST = 128
#: Letters of a signature: two of them hold the low twelve bits of a chunk's hash.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_FACTORS = [np.uint32(pow(0x2F0B4C47, j, 2**32)) for j in range(WINDOW)]


def _triggers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a chunk may end, and for how many doublings of the block size."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    rolled = codes.copy()
    for back in range(1, min(WINDOW, len(codes))):
        rolled[back:] += codes[:-back] * _FACTORS[back]
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x9E3779B1)
    rolled ^= rolled >> np.uint32(13)
    ends = np.flatnonzero((rolled & np.uint32(1)) == 0)
    low = rolled[ends]
    level = np.bitwise_count((low & (~low + np.uint32(1))) - np.uint32(1))
    return ends + 1, level


def _signature(data: memoryview, ends: np.ndarray) -> list[int]:
    """A twelve-bit hash per chunk; runs of more than three equal chunks are cut to three."""
    found: list[int] = []
    start = 0
    for end in [*ends.tolist(), len(data)]:
        if end > start:
            code = xxhash.xxh32_intdigest(data[start:end]) & 0xFFF
            if found[-3:] != [code] * 3:
                found.append(code)
            start = end
    return found


def fingerprint(text: str) -> str:
    """``block:signatures:signatures at twice the block``."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "2::"
    view = memoryview(data)
    ends, levels = _triggers(data)
    level = max(1, (len(data) // CHUNKS).bit_length() - 1)
    while level > 1 and np.count_nonzero(levels >= level) < CHUNKS // 2:
        level -= 1
    fine = _signature(view, ends[levels >= level])
    while len(fine) > MOST:
        level += 1
        fine = _signature(view, ends[levels >= level])
    coarse = _signature(view, ends[levels > level])
    spell = lambda codes: "".join(LETTERS[c >> 6] + LETTERS[c & 63] for c in codes)
    return f"{1 << level}:{spell(fine)}:{spell(coarse)}"


def _common(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence, a bit vector at a time."""
    places: dict[str, int] = {}
    for i, code in enumerate(left):
        places[code] = places.get(code, 0) | 1 << i
    full = (1 << len(left)) - 1
    open_ = full
    for code in right:
        hit = open_ & places.get(code, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(left) - open_.bit_count()


def _alike(left: str, right: str) -> float:
    if not left or not right:
        return 0.0
    a = [left[i : i + 2] for i in range(0, len(left), 2)]
    b = [right[i : i + 2] for i in range(0, len(right), 2)]
    # Insertions and deletions turn one into the other in len(a) + len(b) - 2 * common steps.
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(left: str, right: str) -> float:
    """1 less the edit distance over the summed lengths, at the best compatible block size."""
    if left == right:
        return 1.0
    (block, fine, coarse), (other, other_fine, other_coarse) = left.split(":"), right.split(":")
    if block == other:
        return max(_alike(fine, other_fine), _alike(coarse, other_coarse))
    if int(block) == 2 * int(other):
        return _alike(fine, other_coarse)
    if 2 * int(block) == int(other):
        return _alike(coarse, other_fine)
    return 0.0


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each own row with the row after it; the rows of a range end with a carried one."""
    last = None
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for carried, own_id, text in zip(*(batch.column(c).to_pylist() for c in ("carried", "id", "text"))):
            if carried and last is None:
                continue
            mark = fingerprint(text)
            if last is not None:
                before_id, before, before_mark = last
                half = len(before) // 2
                edited = before[: len(before) - half] + text[:half]
                edited_mark = fingerprint(edited)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                row = (
                    before_id, len(before), digest, before_mark, edited_mark,
                    likeness(before_mark, edited_mark), likeness(before_mark, mark),
                )
                for column, value in zip(out, row):
                    column.append(value)
            last = None if carried else (own_id, text, mark)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare them with the next document's.

    The edited text is the text whose last half is replaced by as many first characters of the
    next document in the order of ``id_col``; the first document follows the last. Documents are
    dealt once into even id ranges; each range also receives the first document of the range
    after it, so every row meets its successor in a sorted stream and no task holds more than two
    texts. Cutting the ranges runs two small jobs over the id column.
    """
    parts = common.partitions(df.sparkSession)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        common.text_of(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)).alias("k"),
    )
    cuts = common.even_cuts(rows, "k", parts)
    rows = rows.withColumn("range", common.range_of(F.col("k"), cuts))
    firsts = sorted((r["range"], r["k"]) for r in rows.groupBy("range").agg(F.min("k").alias("k")).collect())
    # The first key of each range goes to the range before it as well, the very first to the last.
    moves = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    own = F.struct(F.col("range").cast("int").alias("range"), F.lit(0).alias("carried"))
    if moves:
        keys, targets = list(moves), [int(r) for r in moves.values()]
        target = F.element_at(F.lit(targets), F.array_position(F.lit(keys), F.col("k")).cast("int"))
        is_first = F.col("k").isin(keys)
        places = F.when(is_first, F.array(own, F.struct(target.alias("range"), F.lit(1).alias("carried")))).otherwise(F.array(own))
    else:
        places = F.array(own)
    return (
        rows.withColumn("place", F.explode(places))
        .select("id", "text", "k", "place.range", "place.carried")
        .repartitionById(parts, F.col("range"))
        .sortWithinPartitions("range", "carried", "k", "text")
        .select("carried", "id", "text")
        .mapInArrow(
            _followed,
            "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
            " near_edited double, near_next double",
        )
        .withColumnRenamed("id", id_col)
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(common.documents(spark, sf_dir))
