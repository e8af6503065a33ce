"""Training sequences: render, tokenise, mask, pack; label ids and stratified splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.arrays import let
from quillmill.functions.text import render_template
from quillmill.operators.ranking import broadcast_if, distinct_bound, hash_key

# The fallback chat template and the label that is ignored in a loss.
PROMPT_TEMPLATE = "### Instruction:\n{instruction}\n\n### Response:\n"
IGNORED = -100
TOKEN_COLUMNS = ("input_ids", "attention_mask", "labels")


def render_chat(
    instruction: Column, output: Column, template: str = PROMPT_TEMPLATE, eos: str = ""
) -> tuple[Column, Column]:
    """The prompt text and the full text (prompt, output, end mark)."""
    prompt = render_template(template, instruction=instruction)
    return prompt, F.concat(prompt, output, F.lit(eos))


def word_ids(text: Column, vocab: int = 65_536) -> Column:
    """Default tokenizer: words and single marks, hashed into ``vocab`` ids inside the JVM."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1))
    return F.transform(
        pieces,
        lambda w: (F.conv(F.left(F.md5(w), F.lit(7)), 16, 10).cast("int") % vocab).cast("int"),
    )


def tokenize_and_mask(
    df: DataFrame,
    tokenizer: Callable[[Column], Column] = word_ids,
    max_length: int = 512,
    template: str = PROMPT_TEMPLATE,
    eos: str = "",
) -> DataFrame:
    """Replace instruction and output by token ids, an attention mask and masked labels.

    Prompt positions get -100. If that masks everything, the last quarter (1 to 32 tokens) is
    restored. ``tokenizer`` maps a text column to an int array column, e.g. a pandas UDF.
    """
    prompt, full = render_chat(F.col("instruction"), F.col("output"), template, eos)
    others = [c for c in df.columns if c not in ("instruction", "output")]
    coded = df.select(
        *others,
        F.struct(
            F.slice(tokenizer(full), 1, max_length).alias("ids"),
            F.least(F.size(tokenizer(prompt)), F.lit(max_length)).alias("prompt"),
        ).alias("t"),
    )

    def masked(t: Column) -> Column:
        size = F.size(t["ids"])
        tail = F.greatest(F.lit(1), F.least(F.lit(32), F.floor(size / 4).cast("int")))
        first_open = F.when(t["prompt"] >= size, size - tail).otherwise(t["prompt"])
        return let(
            first_open,
            lambda start: F.transform(
                t["ids"], lambda v, i: F.when(i < start, F.lit(IGNORED)).otherwise(v)
            ),
        )

    return coded.select(
        *others,
        F.col("t.ids").alias("input_ids"),
        F.transform("t.ids", lambda _: F.lit(1)).alias("attention_mask"),
        let(F.col("t"), masked).alias("labels"),
    )


def pack_sequences(
    df: DataFrame,
    order_by: str,
    max_length: int = 512,
    shards: int | None = None,
    shard_rows: int = 100_000,
    shard_key: Sequence[str] = (),
) -> DataFrame:
    """Concatenate token records into blocks of at most ``max_length`` tokens, next-fit.

    A block closes when the next record would overflow it; longer records are cut exactly at
    ``max_length``. Packing is sequential by nature, so the table is cut into ``shards`` by a hash
    of the unique row key (one per ``shard_rows`` rows, counted here, unless given) and each shard is packed
    on its own: one shard equals one global fold, more shards give other neighbours but the same
    tokens. Rows stream through a shard in Arrow
    batches; only the open block is held, so a shard may have any size.
    """
    keys = list(shard_key) or [order_by]
    if shards is None:
        shards = max(1, df.count() // shard_rows)
    shard = (F.conv(F.left(F.md5(F.concat_ws("\x01", *[F.col(c).cast("string") for c in keys])), F.lit(7)), 16, 10).cast("long") % shards).cast("int")
    ordered = (
        df.select(shard.alias("shard"), F.col(order_by).alias("_order"), *TOKEN_COLUMNS)
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "_order")
        .drop("_order")
    )
    fields = "shard int, block int, " + ", ".join(f"{c} array<int>" for c in TOKEN_COLUMNS)
    ids = pa.int32()
    schema = pa.schema(
        [("shard", ids), ("block", ids), *[(c, pa.list_(ids)) for c in TOKEN_COLUMNS]]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks are consecutive runs of tokens, so packing only moves list boundaries: one step
        # per record, none per token. ``held`` is the open block, already part of no batch.
        held = [np.empty(0, dtype="int32") for _ in TOKEN_COLUMNS]
        current, block = -1, 0

        def emit(shard_of: list[int], number: list[int], ends: list[int], flat: list[np.ndarray]):
            starts = pa.array([0, *ends], type=pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(v[: ends[-1]])) for v in flat]
            head = [pa.array(shard_of, type=pa.int32()), pa.array(number, type=pa.int32())]
            return pa.RecordBatch.from_arrays(head + lists, schema=schema)

        for batch in batches:
            lists = [batch.column(c) for c in TOKEN_COLUMNS]
            flat = [
                np.concatenate([h, v.flatten().to_numpy(zero_copy_only=False)]).astype("int32")
                for h, v in zip(held, lists)
            ]
            sizes = pc.list_value_length(lists[0]).to_pylist()
            start, end = 0, len(held[0])
            shard_of, number, ends = [], [], []
            for shard_id, size in zip(batch.column("shard").to_pylist(), sizes):
                moves_on = shard_id != current
                if end > start and (moves_on or end - start + size > max_length):
                    shard_of.append(current), number.append(block), ends.append(end)
                    start, block = end, block + 1
                if moves_on:
                    current, block = shard_id, 0
                end += size
                while end - start >= max_length:
                    start += max_length
                    shard_of.append(current), number.append(block), ends.append(start)
                    block += 1
            if ends:
                yield emit(shard_of, number, ends, flat)
            held = [v[start:] for v in flat]
        if len(held[0]):
            yield emit([current], [block], [len(held[0])], held)

    return ordered.mapInArrow(pack, fields)


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, label_id)``: ids are positions among the sorted distinct labels.

    The ordering window sees one row per label; class lists are small by nature.
    """
    names = df.select(F.col(label).alias("label")).where(F.col(label).isNotNull()).distinct()
    return names.withColumn("label_id", F.row_number().over(Window.orderBy("label")) - 1)


def label_quotas(sizes: DataFrame, ratio: float) -> DataFrame:
    """``(_label, quota, total, least, want)`` from ``(_label, rows)``: largest remainders of
    ``ceil(ratio * total)`` rows. One row per label; products of counts are decimals."""
    whole = lambda name: F.col(name).cast("decimal(19,0)")
    all_labels = Window.partitionBy()
    by_rest = Window.orderBy(F.desc("rest"), "_label")
    return (
        sizes.withColumns({"total": F.sum("rows").over(all_labels), "least": F.min("rows").over(all_labels)})
        .withColumn("want", F.ceil(F.lit(ratio) * F.col("total")))
        .withColumns({"share": whole("want") * whole("rows"), "all": whole("total")})
        .withColumns({"base": F.expr("share div all"), "rest": F.col("share") % F.col("all")})
        .withColumn("spare", F.col("want") - F.sum("base").over(all_labels))
        .withColumn("quota", F.col("base") + (F.row_number().over(by_rest) <= F.col("spare")).cast("long"))
        .select("_label", "quota", "total", "least", "want")
    )


def _quota_cuts(
    df: DataFrame,
    label: str,
    ids: Sequence[str],
    ratio: float,
    seed: int,
    digits: int,
    labels_bound: int | None,
) -> DataFrame:
    """Per label, the last hash key of its share of the evaluation rows.

    Shares are largest remainders of ``ceil(ratio * total)`` rows. As in the unstratified cut,
    only the rows of one hash prefix per label are ordered.
    """
    key = df.select(F.col(label).alias("_label"), hash_key(ids, seed).alias("h"), *ids)
    prefix = F.substring("h", 1, digits)
    counts = key.groupBy("_label", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    quotas = label_quotas(counts.groupBy("_label").agg(F.sum("n").alias("rows")), ratio)
    upto = Window.partitionBy("_label").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        counts.withColumn("upto", F.sum("n").over(upto))
        .join(quotas, "_label")
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select("_label", "prefix", (F.col("quota") - F.col("upto") + F.col("n")).alias("need"))
    )
    in_edge = key.withColumn("prefix", prefix).join(
        broadcast_if(edges, labels_bound), ["_label", "prefix"]
    )
    order = Window.partitionBy("_label", "prefix").orderBy("h", *ids)
    return (
        in_edge.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") == F.col("need"))
        .select("_label", F.struct("h", *ids).alias("cut"))
    )


def stratified_split(
    df: DataFrame,
    label: str,
    ids: Sequence[str],
    ratio: float = 0.15,
    max_rows: int | None = None,
    seed: int = 42,
    digits: int = 3,
    labels_bound: int | None = None,
) -> DataFrame:
    """Add ``split`` (train or test) with exact per-label shares of the test rows.

    Fewer than four rows: every row is in both. A label with a single row, or fewer test or train
    rows than labels: a plain exact split. ``labels_bound`` is a proven bound on the number of
    labels; without one it is measured, so that the table is joined without a shuffle.
    """
    from quillmill.operators.corpus import sample_n
    from quillmill.operators.ranking import at_or_below_cut, lowest_hash_cut

    if max_rows is not None:
        df = sample_n(df, max_rows, ids, seed)
    if labels_bound is None:
        labels_bound = distinct_bound(df, label)
    facts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.min("n"), F.lit(0)).alias("least"),
        F.count(F.lit(1)).alias("labels"),
    )
    total, labels = F.col("total"), F.col("labels")
    test = F.ceil(F.lit(ratio) * total)
    plain = facts.select((F.col("least") < 2) | (test < labels) | (total - test < labels))
    tiny = facts.select(total < 4)
    plain_cut, _ = lowest_hash_cut(df, ids, lambda t: F.ceil(F.lit(ratio) * t), seed)
    cuts = broadcast_if(_quota_cuts(df, label, ids, ratio, seed, digits, labels_bound), labels_bound)
    own = F.struct(hash_key(ids, seed).alias("h"), *[F.col(c) for c in ids])
    chosen = F.when(plain.scalar(), at_or_below_cut(plain_cut, ids, seed)).otherwise(
        F.coalesce(own <= F.col("cut"), F.lit(False))
    )
    names = (
        F.when(tiny.scalar(), F.array(F.lit("train"), F.lit("test")))
        .when(chosen, F.array(F.lit("test")))
        .otherwise(F.array(F.lit("train")))
    )
    return (
        df.join(cuts, df[label].eqNullSafe(cuts["_label"]), "left")
        .withColumn("split", F.explode(names))
        .select(*df.columns, "split")
    )
