"""Exact next-fit packing of a whole table into token blocks, by many tasks.

Packing is a fold: how full the open block is decides what the next record does. But a run of
records only maps the ``max_length`` states it can be entered in to states it is left in, and the
states soon meet, since all that overflow on a record go on alike. So the table is cut into slices
in its order; every slice works out its map from lengths alone; the maps are followed once, one
small row per slice; and then all slices pack at once, each from the state it is really entered in.
Blocks that cross slices come out in parts, which are put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.ranking import broadcast_if, cuts_below
from quillmill.operators.sequences import TOKEN_COLUMNS
from quillmill.session import materialize

#: Sampled order keys per slice that the cuts are taken from.
_SAMPLES = 32


def slice_map(sizes: list[int], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of tokens the open block may hold on entry: how many it holds at the end, and how
    many blocks were closed."""
    states, closed = np.arange(limit), np.zeros(limit, np.int64)
    group = np.arange(limit)  # which of the states an entry has come to
    ended = np.zeros(limit, np.int64)  # per entry, blocks closed before its state met another one
    for at, size in enumerate(sizes):
        if len(states) == 1:
            used, done = int(states[0]), int(closed[0])
            for later in sizes[at:]:
                if used and used + later > limit:
                    used, done = 0, done + 1
                used += later
                done += used // limit
                used %= limit
            states, closed = np.array([used]), np.array([done])
            break
        overflow = (states > 0) & (states + size > limit)
        total = np.where(overflow, 0, states) + size
        closed += overflow + total // limit
        states = total % limit
        if overflow.any():
            met, inverse = np.unique(states, return_inverse=True)
            if len(met) < len(states):
                ended += closed[group]
                group, states, closed = inverse[group], met, np.zeros(len(met), np.int64)
    return states[group], ended + closed[group]


def _maps(limit: int, order_by: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (order_by, "size", "mark")])
        left, closed = slice_map(table.column("size").to_pylist(), limit)
        one = [table.column("slice")[0].as_py()]
        lists = lambda v: pa.array([v.tolist()], pa.list_(pa.int64()))
        return pa.table({"slice": pa.array(one, pa.int32()), "left": lists(left), "closed": lists(closed)})

    return run


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state and block number each slice is entered with; the maps arrive in order."""
    used = block = 0
    for batch in batches:
        rows = []
        for one, left, closed in zip(*(batch.column(c) for c in ("slice", "left", "closed"))):
            rows.append({"e_slice": one.as_py(), "used": used, "block": block})
            block += closed[used].as_py()
            used = left[used].as_py()
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("e_slice", pa.int32()), ("used", pa.int64()), ("block", pa.int64())]))


def _packed(limit: int) -> Callable:
    ids = pa.list_(pa.int32())
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("whole", pa.bool_()), *[(c, ids) for c in TOKEN_COLUMNS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32) for _ in TOKEN_COLUMNS]
        current, block, lead = None, 0, 0  # ``lead``: tokens of the open block that earlier slices hold
        for batch in [*batches, None]:
            if batch is None:
                flat, rows = held, []
            else:
                lists = [batch.column(c) for c in TOKEN_COLUMNS]
                flat = [np.concatenate([h, v.flatten().to_numpy(zero_copy_only=False)]).astype(np.int32) for h, v in zip(held, lists)]
                sizes = pc.list_value_length(lists[0]).to_pylist()
                rows = zip(*(batch.column(c).to_pylist() for c in ("slice", "used", "block")), sizes)
            start, end, out = 0, len(held[0]), []
            for one, used, first_block, size in rows:
                if one != current:
                    if end > start:
                        out.append((block, current, False, end))
                    start, current, block, lead = end, one, first_block, used
                if lead + end - start and lead + end - start + size > limit:
                    if end > start:
                        out.append((block, current, lead == 0, end))
                    start, lead, block = end, 0, block + 1
                end += size
                while lead + end - start >= limit:
                    start += limit - lead
                    out.append((block, current, lead == 0, start))
                    lead, block = 0, block + 1
            if batch is None and end > start:
                out.append((block, current, False, end))
                start = end
            if out:
                blocks, parts, whole, ends = zip(*out)
                offsets = pa.array([0, *ends], pa.int32())
                columns = [pa.ListArray.from_arrays(offsets, pa.array(v[: ends[-1]])) for v in flat]
                heads = [pa.array(blocks, pa.int64()), pa.array(parts, pa.int32()), pa.array(whole)]
                yield pa.RecordBatch.from_arrays(heads + columns, schema=schema)
            held = [v[start:] for v in flat]

    return run


def pack_whole_table(df: DataFrame, order_by: str, max_length: int = 512, slice_rows: int = 100_000) -> DataFrame:
    """``block`` and the token columns: the blocks of one fold over all records in the order of
    ``order_by``, which must be unique, whatever the partitions.

    A block closes when the next record would overflow it; longer records are cut at ``max_length``.
    The tokens are shuffled once, to slices of about ``slice_rows`` records.
    """
    keyed = df.select(F.col(order_by), F.size("input_ids").alias("size"), F.xxhash64("input_ids").alias("mark"))
    keyed = materialize(keyed, "pack-sizes")
    rows = keyed.count()
    slices = max(1, rows // slice_rows)
    cuts: list = []
    if slices > 1:
        sampled = keyed.select(order_by).sample(min(1.0, _SAMPLES * slices / rows), seed=7).dropna().collect()
        found = sorted({r[0] for r in sampled})
        cuts = sorted({found[len(found) * i // slices] for i in range(1, slices)}) if found else []
    own = cuts_below(F.lit(cuts), F.col(order_by), len(cuts).bit_length()) if cuts else F.lit(0)
    maps = keyed.withColumn("slice", own).groupBy("slice").applyInArrow(
        _maps(max_length, order_by), "slice int, left array<long>, closed array<long>"
    )
    # One row per slice, as long as a block, passes through one task.
    entered = materialize(maps, "pack-maps").repartition(1).sortWithinPartitions("slice")
    entered = materialize(entered.mapInArrow(_followed, "e_slice int, used long, block long"), "pack-states")
    tokens = df.select(F.col(order_by).alias("_order"), own.alias("slice"), *TOKEN_COLUMNS)
    dealt = (
        tokens.join(broadcast_if(entered, len(cuts) + 1), F.col("slice") == F.col("e_slice"))
        .repartition(len(cuts) + 1, "slice")
        .sortWithinPartitions("slice", "_order", F.size("input_ids"), F.xxhash64("input_ids"))
        .select("slice", "used", "block", *TOKEN_COLUMNS)
    )
    lists = ", ".join(f"{c} array<int>" for c in TOKEN_COLUMNS)
    parts = materialize(dealt.mapInArrow(_packed(max_length), f"block long, part int, whole boolean, {lists}"), "packed")
    crossing = parts.where("NOT whole").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("part", *TOKEN_COLUMNS))).alias("parts")
    )
    joined = [F.flatten(f"parts.{c}").alias(c) for c in TOKEN_COLUMNS]
    return parts.where("whole").select("block", *TOKEN_COLUMNS).unionByName(crossing.select("block", *joined))
