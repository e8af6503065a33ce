"""SimHash near-dedup with vantage-point trees.

A document's fingerprint has a bit where over half of its shingle hashes have it. Equal
fingerprints collapse first. The distinct ones are partitioned by a vantage-point tree: every inner
node splits by the Hamming distance to one fingerprint, at the median. A fingerprint belongs to the
leaf it falls into, its shard, and by the triangle inequality can only link to fingerprints in
leaves whose side of every split lies within the radius of its own distance; it visits those as a
query. Inside a shard another such tree finds the exact pairs, and only a spanning forest of them
leaves the shard. Components come from the forests of all shards.

The top of the tree is fitted on a bounded sample of the fingerprints; all fingerprints are placed
and searched, so the sample affects balance only, not results.

Null texts are empty; a text without words has fingerprint zero and links like any other. Rows
with the same id are one document. A null id names no document: its rows link by their fingerprints
alone, and it counts as the lowest id of a component, whose id is then null. Other columns are not
read by the report and all kept by ``keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm import common, shingles
from quillmill.llm.components import Forest, star_components

SHINGLE = 3
RADIUS = 2
#: The top of the tree has a leaf per SHARD_ROWS fingerprints, up to MOST_LEAVES, and is fitted on at
#: least LEAST_SAMPLE of them, and about LEAF_SAMPLE per leaf.
SHARD_ROWS = 2_048
MOST_LEAVES = 131_072
LEAST_SAMPLE = 16_384
LEAF_SAMPLE = 8
#: Fingerprints of a local leaf, which are compared with its queries one by one.
LEAF = 128
#: Pairs compared at once.
BLOCK = 2_000_000


def fingerprint(text: str) -> int:
    """64 bits as a signed number."""
    hashes = shingles.hashes(text, SHINGLE)
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        some = np.array(hashes[i : i + 65_536], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _distance(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right)


def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the largest distance of its near half; None if nothing parts the points.

    Of a few points, spread over the sorted array, the one with the fewest others close to the cut.
    """
    best = None
    for vantage in points[np.linspace(0, len(points) - 1, 5).astype(int)]:
        away = _distance(points, vantage)
        cut = int(np.median(away))
        if not (away > cut).any():
            cut = int(away.max()) - 1
        near = np.count_nonzero(away <= cut)
        if 0 < near < len(points):
            shared = np.count_nonzero((away > cut - RADIUS) & (away <= cut + RADIUS))
            cost = shared + abs(len(points) - 2 * near)
            if best is None or cost < best[0]:
                best = cost, vantage, cut
    return best and best[1:]


class Tree:
    """The top of the tree: splits by level order, leaves numbered from left to right."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.leaves = 0
        self.root = self._grow(np.unique(sample), leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> tuple:
        found = _split(points) if leaves > 1 and len(points) > 1 else None
        if found is None:
            self.leaves += 1
            return (self.leaves - 1,)
        near = _distance(points, found[0]) <= found[1]
        # Ties make the sides of a dense group uneven; each gets leaves for what it holds.
        share = min(leaves - 1, max(1, round(leaves * near.mean())))
        return (*found, self._grow(points[near], share), self._grow(points[~near], leaves - share))

    def place(self, points: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Per leaf, the points that belong to it and those that belong to an earlier leaf but may
        link to points in it. Of two linked points, one visits the other's leaf."""
        out: list = []

        def walk(node: tuple, own: np.ndarray, guests: np.ndarray) -> None:
            if not len(own) and not len(guests):
                return
            if len(node) == 1:
                out.append((node[0], own, guests))
                return
            vantage, cut, near, far = node
            away, away_guests = _distance(own, vantage), _distance(guests, vantage)
            walk(near, own[away <= cut], guests[away_guests <= cut + RADIUS])
            # Points of the near side are guests of the far side, not the other way round.
            crossing = own[(away <= cut) & (away > cut - RADIUS)]
            walk(far, own[away > cut], np.concatenate([guests[away_guests > cut - RADIUS], crossing]))

        walk(self.root, points, points[:0])
        return out


def shard_forest(own: np.ndarray, guests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs within the radius, of a shard's points with each
    other and with its guests, by a local vantage-point tree."""
    points = np.concatenate([own, guests])
    forest = Forest(len(points))

    def search(members: np.ndarray, queries: np.ndarray) -> None:
        """Members are compared with each other and with the queries."""
        if not len(members) or len(members) + len(queries) < 2:
            return
        found = _split(np.sort(points[members])) if len(members) > LEAF else None
        if found is None:
            every = np.concatenate([members, queries])
            step = max(1, BLOCK // len(every))
            for i in range(0, len(members), step):
                some = members[i : i + step]
                a, b = np.nonzero(_distance(points[some][:, None], points[every][None, :]) <= RADIUS)
                forest.link(some[a], every[b])
            return
        vantage, cut = found
        away, away_queries = _distance(points[members], vantage), _distance(points[queries], vantage)
        search(members[away <= cut], queries[away_queries <= cut + RADIUS])
        crossing = members[(away <= cut) & (away > cut - RADIUS)]
        search(members[away > cut], np.concatenate([queries[away_queries > cut - RADIUS], crossing]))

    search(np.arange(len(own)), np.arange(len(own), len(points)))
    linked = np.flatnonzero(forest.parent != np.arange(len(points)))
    return points[linked], points[forest.parent[linked]]


def _placed(tree: Tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("f").to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, own, guests in tree.place(points):
                rows = len(own) + len(guests)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, shard, np.int32)),
                        pa.array(np.concatenate([own, guests]).view(np.int64)),
                        pa.array(np.arange(rows) < len(own)),
                    ],
                    ["shard", "f", "own"],
                )

    return run


def _searched(table: pa.Table) -> pa.Table:
    points = table.column("f").to_numpy().view(np.uint64)
    own = table.column("own").to_numpy(zero_copy_only=False)
    a, b = shard_forest(points[own], points[~own])
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_links(distinct: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect the distinct fingerprints ``f`` within the radius.

    Runs two small jobs: a count, and the sample that the top of the tree is fitted on.
    """
    rows = distinct.count()
    leaves = max(1, min(rows // SHARD_ROWS, MOST_LEAVES))
    wanted = max(LEAST_SAMPLE, LEAF_SAMPLE * leaves)
    sample = distinct.select("f").sample(min(1.0, wanted / max(1, rows)), seed=7).toPandas()["f"].to_numpy()
    tree = Tree(sample.astype(np.int64).view(np.uint64), max(1, min(leaves, len(sample) // LEAF_SAMPLE)))
    placed = distinct.select("f").mapInArrow(_placed(tree), "shard int, f long, own boolean")
    return placed.groupBy("shard").applyInArrow(_searched, "a long, b long")


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The staged table ``k`` (the id, null as the lowest), ``t`` (a hash of the text), ``f``."""
    run = common.per_value(fingerprint, "long")
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)).alias("k")
    text = common.text_of(text_col)
    return common.staged(df.select(k, F.xxhash64(text).alias("t"), run(text).alias("f")), "simhash")


def labelled(prints: DataFrame) -> DataFrame:
    """The staged table ``f, k, t, label``: per fingerprint its first document, by ``k`` and ``t``, and
    the label of its component."""
    first = F.min(F.struct("k", "t")).alias("first")
    distinct = common.staged(prints.groupBy("f").agg(first).select("f", "first.*"), "simhash-distinct")
    # Documents with one id are one document: their fingerprints link to each other.
    named = prints.where(F.col("k") != common.NULL_ID)
    twins = named.groupBy("k").agg(F.min("f").alias("a"), F.max("f").alias("b")).where("a <> b")
    twins = named.join(twins.select(F.col("k").alias("t_k"), "a"), F.col("k") == F.col("t_k")).select("a", F.col("f").alias("b"))
    found = star_components(near_links(distinct).unionByName(twins), "simhash-links")
    return common.staged(
        distinct.join(found, F.col("f") == F.col("node"), "left").select(
            "f", "k", "t", F.coalesce("component", "f").alias("label")
        ),
        "simhash-labels",
    )


def components(prints: DataFrame) -> DataFrame:
    """``f, component``: the smallest ``k`` reachable from each fingerprint."""
    found = labelled(prints)
    lows = found.groupBy("label").agg(F.min("k").alias("component"))
    return found.select("f", F.col("label").alias("f_label")).join(
        lows, F.col("f_label") == F.col("label")
    ).select("f", "component")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component per document."""
    prints = fingerprints(df, id_col, text_col)
    found = components(prints).select(F.col("f").alias("c_f"), "component")
    null_id = F.lit(common.NULL_ID)
    return prints.join(found, F.col("f") == F.col("c_f")).select(
        F.nullif("k", null_id).alias(id_col),
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        F.nullif("component", null_id).alias("component_id"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the document of the smallest id of each component, and one row of it.

    A component holds any number of rows without an id, so documents are told apart by the hash of
    their text as well.
    """
    found = labelled(fingerprints(df, id_col, text_col))
    kept = found.groupBy("label").agg(F.min(F.struct("k", "t")).alias("first"))
    kept = kept.select(F.col("first.k").alias("_kept_k"), F.col("first.t").alias("_kept_t"))
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID))
    t = F.xxhash64(common.text_of(text_col))
    # Spark prunes to the first row of each window in every map task.
    first = Window.partitionBy("_kept_k", "_kept_t").orderBy("_kept_t")
    return (
        df.join(kept, (k == F.col("_kept_k")) & (t == F.col("_kept_t")))
        .withColumn("_kept_no", F.row_number().over(first))
        .where("_kept_no = 1")
        .select(*df.columns)
    )


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.documents(spark, sf_dir))
