"""Quality rules from cross-document line frequency, in built-in functions only.

A line that many documents of one host repeat is boilerplate. Lines are normalised and hashed,
distinct documents are counted per host and hash, lines above the limit are removed, and a
document that keeps too small a share of its words is rejected: ``judge`` gives figures and verdicts,
``cleaned`` the documents that stay. The base rules come first: too few
words, or too many words inside repeated three-word windows.

Null texts count as empty and fail the base rule; a null host is a host of its own. Every row
counts as one document, also where ids or whole rows repeat. Other columns are not read, and an
empty table gives an empty result. Windows and lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.arrays import let
from quillmill.llm import common

#: A line is boilerplate if more documents of its host than this hold it.
LINE_LIMIT = 20
#: Share of the words that must be left.
KEPT_SHARE = 0.3
MIN_WORDS = 50
SYMBOLS = r"[^#*$%&|<>]+"
#: A line that is not blank.
WORDED = r"[^\x20\x09-\x0D]"


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, common.SPACE + "+"), lambda w: w != "")


def normal_line(line: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), common.SPACE + "+", " "))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array.

    Window hashes are sorted together with their positions, so that repeats become neighbours; the
    marked positions are sorted again and the union of their spans is measured. Texts without a
    repeated window stop after a distinct count.
    """

    def union(starts: Column) -> Column:
        spans = F.transform(
            starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1), p + 3) - p)
        )
        return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, n: acc + n)

    def marked(pairs: Column) -> Column:
        hits = F.filter(
            pairs,
            lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"]),
        )
        return let(F.sort_array(F.transform(hits, lambda p: p["at"])), union)

    def repeats(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(pairs), marked)
        )

    def windows(w: Column) -> Column:
        hashes = F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda first, i: F.xxhash64(first, F.get(w, i + 1), F.get(w, i + 2)),
        )
        return let(hashes, repeats)

    return let(words, windows)


def line_digest(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One small row per document: its base figures, and hash and words of each distinct line."""
    text = F.col("text")
    kept = df.select(
        F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), common.text_of(text_col).alias("text")
    )
    figures = kept.select(
        "id",
        "host",
        let(
            words_of(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(
            F.filter(F.split(text, "\n"), lambda l: F.regexp_like(l, F.lit(WORDED))),
            lambda ls: F.struct(
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.transform(
                    ls,
                    lambda l: let(
                        normal_line(l),
                        lambda k: F.struct(F.xxhash64(k).alias("line"), F.size(F.split(k, " ")).alias("words")),
                    ),
                ).alias("lines"),
            ),
        ).alias("l"),
    )
    return figures.select("id", "host", "w.*", "n_symbols", "l.*")


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    line_limit: int = LINE_LIMIT,
    kept_share: float = KEPT_SHARE,
) -> DataFrame:
    """Base figures and verdict per document; ``words_left`` are the words outside removed lines.

    The text is read once: figures and line hashes are staged as a small table (this runs a job),
    and only hashes are shuffled. Counting sends one row per task for a hot line; the join that
    marks removed lines has one row per frequent line on its other side, so AQE can split it.
    """
    digest = common.staged(line_digest(df, id_col, text_col, host_col), "line-digest", row="row")
    removed = removed_lines(digest, line_limit).groupBy("row").agg(F.sum("words").alias("removed"))
    return (
        digest.drop("lines", "host")
        .join(removed, "row", "left")
        .select(
            F.col("id").alias(id_col),
            *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
            base_failed().alias("base_failed"),
            (~base_failed() & (words_left() >= kept_share * F.col("n_words"))).alias("kept"),
            words_left().alias("words_left"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def words_left() -> Column:
    return F.col("n_words") - F.coalesce("removed", F.lit(0))


def removed_lines(digest: DataFrame, line_limit: int) -> DataFrame:
    """Row, place among the row's lines that are not blank, and words of every line above the limit."""
    lines = digest.select("row", "host", F.posexplode("lines").alias("at", "l")).select("row", "host", "at", "l.line", "l.words")
    per_document = digest.select("host", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    frequent = (
        per_document.groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("documents"))
        .where(F.col("documents") > line_limit)
        .select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    )
    # As a table, this side brings no partitioning that would tie a hot line to one task.
    frequent = common.staged(frequent, "frequent-lines")
    return lines.join(frequent, (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host"))).select("row", "at", "words")


def without_lines(text: Column, places: Column) -> Column:
    """The text without some of its lines, given by their rising places among those that are not blank."""

    def cut(lines: Column) -> Column:
        marked = F.transform(lines, lambda l, i: F.when(F.regexp_like(l, F.lit(WORDED)), i).otherwise(-1))
        return let(F.filter(marked, lambda i: i >= 0), lambda worded: let(F.transform(places, lambda p: F.get(worded, p)), lambda gone: between(lines, gone)))

    def between(lines: Column, gone: Column) -> Column:
        starts = F.concat(F.array(F.lit(-1)), gone)
        runs = F.transform(starts, lambda p, i: F.slice(lines, p + 2, F.coalesce(F.get(gone, i), F.size(lines)) - p - 1))
        return F.array_join(F.flatten(runs), "\n")

    return let(F.split(text, "\n"), cut)


def cleaned(
    df: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    line_limit: int = LINE_LIMIT,
    kept_share: float = KEPT_SHARE,
) -> DataFrame:
    """The rows that :func:`judge` keeps, in the columns of ``df``, their texts without the removed lines.

    The rows are staged once with a number. Only places of removed lines are shuffled to it, and texts
    once to their verdicts.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")
    docs = common.staged(df.select(whole), "documents", row="doc_row")
    read = docs.select("doc_row", F.col(f"doc.`{text_col}`").alias("text"), F.col(f"doc.`{host_col}`").alias("host"))
    digest = common.staged(line_digest(read, "doc_row", "text", "host"), "line-digest", row="row")
    removed = removed_lines(digest, line_limit).groupBy("row")
    removed = removed.agg(F.sum("words").alias("removed"), F.sort_array(F.collect_list("at")).alias("places"))
    judged = digest.drop("lines", "host").join(removed, "row", "left")
    kept = judged.where(~base_failed() & (words_left() >= kept_share * F.col("n_words"))).select("id", "places")
    left = F.when(F.col("places").isNull(), F.col(f"doc.`{text_col}`")).otherwise(
        without_lines(F.col(f"doc.`{text_col}`"), F.col("places"))
    )
    columns = [left.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in df.columns]
    return docs.join(kept, F.col("doc_row") == F.col("id")).select(*columns)


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir))
