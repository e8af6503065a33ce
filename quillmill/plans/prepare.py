"""The whole way from a raw table to a split instruction corpus with its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.corpus import (
    MAX_PAIR,
    MIN_INSTRUCTION,
    MIN_OUTPUT,
    augment_with_examples,
    bundle_report,
    dedupe_pairs,
    filter_pairs,
    quality_report,
    sample_n,
    split_train_eval,
    text_loss,
    to_instruction_output,
)
from quillmill.operators.detect import TEXT_NAMES, find_column
from quillmill.session import materialize
from quillmill.sources.readers import read_any


@dataclass(frozen=True)
class TextBundle:
    """``split`` holds train (with the added examples) and eval rows; ``all_rows`` the corpus."""

    split: DataFrame
    all_rows: DataFrame
    mapping: dict[str, str]
    generated_qa: bool
    report: DataFrame


ROW_DIGEST = "_row_digest"


def with_row_digest(raw: DataFrame) -> DataFrame:
    """Add a digest of the whole row, an id for tables that have none.

    Equal rows share it; the pairs they give are equal too and collapse when pairs are deduplicated.
    """
    if not raw.columns:
        raise ValueError("a table without columns has no pairs")
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns]), {"ignoreNullFields": "false"})
    return raw.withColumn(ROW_DIGEST, F.sha2(row, 256))


def prepare_text_path(spark: SparkSession, path: str, **options) -> TextBundle:
    """:func:`prepare_text_dataset` from a file, folder or archive; the options are its own.

    Raises ``ValueError`` if no pair is found.
    """
    bundle = prepare_text_dataset(read_any(spark, path), **options)
    if bundle.all_rows.isEmpty():
        raise ValueError(f"no instruction/output pairs found in {path}")
    return bundle


def prepare_text_dataset(
    raw: DataFrame,
    id_col: str | None = None,
    goal: str = "",
    eval_ratio: float = 0.1,
    max_samples: int | None = None,
    seed: int = 42,
    lossless: bool = False,
    limits: tuple[int | None, int | None, int | None] = (MIN_INSTRUCTION, MIN_OUTPUT, MAX_PAIR),
    account: bool = False,
) -> TextBundle:
    """Convert, clean, filter, dedupe, sample, split and augment.

    The deduplicated corpus is written once; sampling, splitting and reporting then read only
    the columns they need from it. ``duplicates`` counts the rows that deduplication removed.
    Without ``id_col``, a unique column, rows are told apart by their digest.

    ``lossless`` makes chunks that lose no character, and ``limits`` are those of
    :func:`filter_pairs`, each off where it is None. With ``account`` the report also has
    ``dropped_pairs``, which a limit dropped, and, where questions are generated, ``lost_chars`` of the
    texts; that takes a second pass over them.
    """
    if id_col is None:
        raw, id_col = with_row_digest(raw), ROW_DIGEST
    pairs, mapping, generated = to_instruction_output(raw, id_col, goal, lossless)
    unique = dedupe_pairs(filter_pairs(pairs, *limits), [id_col, "chunk"], copies="copies")
    corpus = materialize(unique, "corpus")
    removed = corpus.select(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("removed"))
    kept = corpus.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] if account else 0
    corpus = corpus.drop("copies")
    if max_samples is not None:
        corpus = sample_n(corpus, max_samples, [id_col, "chunk"], seed)
    split = augment_with_examples(split_train_eval(corpus, [id_col, "chunk"], eval_ratio, seed))
    report = bundle_report(
        quality_report(corpus),
        split,
        raw.select(F.count(F.lit(1)).alias("n")),
        corpus.select(F.count(F.lit(1)).alias("n")),
    ).withColumns({"duplicates": removed.scalar(), "generated_qa": F.lit(generated)})
    if account:
        report = report.withColumn("dropped_pairs", F.lit(pairs.count() - kept).cast("long"))
        if generated:
            text = find_column([c for c in raw.columns if c != ROW_DIGEST], TEXT_NAMES) or raw.columns[0]
            lost = text_loss(raw, text, lossless=lossless).first()["lost_chars"]
            report = report.withColumn("lost_chars", F.lit(lost).cast("long"))
    return TextBundle(split, corpus, mapping, generated, report)
