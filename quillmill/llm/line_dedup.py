"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

One pass over the texts fills the filters, a second tests every line against the twice-seen one;
only suspected repeats are shuffled, where their documents are counted exactly and the document
that keeps the line is chosen. A filter errs on one side: a false alarm costs a shuffled hash.

A line's key is the line without white space at its ends, A-Z in lower case; keys are told apart by
a 128-bit hash. Null and empty texts are one empty line. Rows with the same id are one document. A null
id names no document: its rows are told apart by their texts, equal ones count once, and all are lower
than any id. All columns of the input are kept, whatever their names, apart from the
text, which is the only one that changes. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import common

MIN_CHARS = 40
MIN_DOCUMENTS = 5
#: The filters have a bit per this many bytes of text, in powers of two within these bounds. Past
#: the upper one (32 MB a filter, which bounds the broadcast) false alarms grow, not errors.
BYTES_PER_BIT = 16
LEAST_BITS, MOST_BITS = 2**16, 2**28
#: Bits of a filter that one task merges, at least.
SHARD_BITS = 2**16
#: Hashes that a task gathers before it sends their bits on.
BLOCK = 1_000_000
_SPACE = " \t\n\x0b\x0c\r"


def keyed_lines(text: str, min_chars: int) -> Iterator[tuple[str, bytes | None]]:
    """Each line with its key's hash; None for keys that are too short to count."""
    for line in text.split("\n"):
        key = line.strip(_SPACE)
        if len(key) < min_chars:
            yield line, None
        else:
            yield line, xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two bit numbers per 128-bit key, from its two halves."""
    return (keys.view(np.uint64) & np.uint64(bits - 1)).astype(np.uint32).reshape(-1, 2)


def _bit_blocks(bits: int, shards: int, min_chars: int) -> Callable:
    """Per task: the bits of hashes seen in a block of documents, and of those seen in two."""
    width = bits // shards

    def block(hashes: list[bytes]) -> pa.RecordBatch:
        keys, counts = np.unique(np.frombuffer(b"".join(hashes), dtype="V16"), return_counts=True)
        rows = []
        for places in (_probes(keys, bits), _probes(keys[counts > 1], bits)):
            marked = np.unique(places.ravel())
            rows.append(np.split(marked, np.searchsorted(marked, np.arange(1, shards) * width)))
        full = [s for s in range(shards) if len(rows[0][s])]
        pack = lambda found: pa.array([(found[s] % width).astype(np.uint32).tobytes() for s in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *map(pack, rows)], ["shard", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held += {key for _, key in keyed_lines(text, min_chars) if key}
                if len(held) >= BLOCK:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return run


def _merged(width: int) -> Callable:
    """Per shard: a bit is twice-seen if a block says so or two blocks have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for shard, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if shard not in filters:
                    filters[shard] = np.zeros(width, bool), np.zeros(width, bool)
                seen, repeated = filters[shard]
                places = np.frombuffer(once, np.uint32)
                repeated[places[seen[places]]] = True
                repeated[np.frombuffer(twice, np.uint32)] = True
                seen[places] = True
        for shard, (_, repeated) in filters.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([np.packbits(repeated).tobytes()], pa.binary())],
                ["shard", "bits"],
            )

    return run


def twice_seen(texts: DataFrame, min_chars: int) -> tuple[bytes, int]:
    """The packed twice-seen filter over a ``text`` column, and its number of bits."""
    length = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (length // BYTES_PER_BIT).bit_length()))
    # As many tasks merge the bits as the session deals rows to, in powers of two.
    shards = max(1, min(bits // SHARD_BITS, 1 << (common.partitions(texts.sparkSession) - 1).bit_length()))
    width = bits // shards
    merged = (
        texts.mapInArrow(_bit_blocks(bits, shards, min_chars), "shard int, once binary, twice binary")
        .repartitionById(shards, F.col("shard"))
        .mapInArrow(_merged(width), "shard int, bits binary")
        .collect()  # at most 32 MB
    )
    packed = bytearray(bits // 8)
    for shard, part in merged:
        packed[shard * width // 8 : (shard + 1) * width // 8] = part
    return bytes(packed), bits


def _document(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What names a document: its id, null as the lowest, and for a null id a hash of the text."""
    own = F.col(id_col).cast("long")
    t = F.when(own.isNull(), F.xxhash64(common.text_of(text_col))).otherwise(F.lit(0).cast("long"))
    return F.coalesce(own, F.lit(common.NULL_ID)), t


def dropped_keys(
    df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """``k`` (the id, null as the lowest), ``t`` (what tells rows without an id apart) and ``dropped``, the
    keys it loses, per document with any.

    Runs the jobs that fill the filter. A hot key sends one row per document that holds it; counts
    are taken before the shuffle, and the join with the confirmed keys has one row per key on its
    other side, so AQE can split it.
    """
    k, t = _document(id_col, text_col)
    texts = df.select(k.alias("k"), t.alias("t"), common.text_of(text_col).alias("text"))
    packed, bits = twice_seen(texts.select("text"), min_chars)
    shared = df.sparkSession.sparkContext.broadcast(packed)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            rows, keys = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = {key for _, key in keyed_lines(text, min_chars) if key}
                rows += [row] * len(own)
                keys += own
            places = _probes(np.frombuffer(b"".join(keys), dtype="V16"), bits)
            hit = (repeated[places >> 3] >> (7 - (places & 7))) & 1
            kept = np.flatnonzero(hit.all(axis=1)).tolist() if keys else []
            own_rows = pa.array([rows[i] for i in kept], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").take(own_rows), batch.column("t").take(own_rows), pa.array([keys[i] for i in kept], pa.binary())],
                ["k", "t", "key"],
            )

    found = common.staged(texts.mapInArrow(suspects, "k long, t long, key binary"), "line-suspects")
    confirmed = (
        found.distinct()
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("documents"), F.max("k").alias("keeper_k"), F.max("t").alias("keeper_t"))
        .where(F.col("documents") >= min_documents)
        .select(F.col("key").alias("c_key"), "keeper_k", "keeper_t")
    )
    # As a table, this side brings no partitioning that would tie a hot key to one task.
    confirmed = common.staged(confirmed, "line-confirmed")
    # Among documents without an id the highest hash keeps the line, if no id does.
    unnamed = (F.col("keeper_k") == common.NULL_ID) & (F.col("t") != F.col("keeper_t"))
    loses = (F.col("k") != F.col("keeper_k")) | unnamed
    return (
        found.join(confirmed, (F.col("key") == F.col("c_key")) & loses)
        .groupBy("k", "t")
        .agg(F.collect_set("key").alias("dropped"))
    )


def without(text: str, dropped: list[bytes] | None, min_chars: int = MIN_CHARS) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    if not dropped:
        lines = text.split("\n")
        return lines, len(lines)
    gone, kept, count = set(dropped), [], 0
    for line, key in keyed_lines(text, min_chars):
        count += 1
        if key not in gone:
            kept.append(line)
    return kept, count


def _joined(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_documents: int) -> DataFrame:
    drops = dropped_keys(df, id_col, text_col, min_chars, min_documents).select(
        F.col("k").alias("_drop_k"), F.col("t").alias("_drop_t"), F.col("dropped").alias("_drop_keys")
    )
    k, t = _document(id_col, text_col)
    return df.join(drops, (k == F.col("_drop_k")) & (t == F.col("_drop_t")), "left").drop("_drop_k", "_drop_t")


def dedupe_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``df`` with every repeated line kept in the largest id that holds it only."""
    clean = common.per_value(lambda text, dropped: "\n".join(without(text, dropped, min_chars)[0]), "string")
    return (
        _joined(df, id_col, text_col, min_chars, min_documents)
        .withColumn(text_col, clean(common.text_of(text_col), F.col("_drop_keys")))
        .select(*df.columns)
    )


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Line counts and the digest of the kept text per document."""

    def report(text: str, dropped: list[bytes] | None) -> dict:
        kept, count = without(text, dropped)
        digest = hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest()
        return {"n_lines": count, "n_dropped": count - len(kept), "kept_sha256": digest}

    run = common.per_value(report, "n_lines long, n_dropped long, kept_sha256 string")
    joined = _joined(df.select(id_col, text_col), id_col, text_col, MIN_CHARS, MIN_DOCUMENTS)
    return joined.select(id_col, run(common.text_of(text_col), F.col("_drop_keys")).alias("_r")).select(id_col, "_r.*")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(common.documents(spark, sf_dir))
