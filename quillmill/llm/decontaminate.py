"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows, and a window is a set of placed shingles, runs of words. To
hold a window, a text has to hold all of its shingles, so by the prefix principle one of them is
enough to find every candidate: the first in an order of all shingles by rarity in the corpus.

- One pass over the texts finds the places of all benchmark shingles. The shingles are broadcast in
  blocks of bounded size; a match is confirmed on its words, not on a hash of them.
- Counts of those places order the shingles. Windows of which a shingle never occurs are gone.
- Places of a window's rarest shingle give its candidates. A candidate must lie inside the text:
  it has to start at its first word or later, and the text must be long enough for its end.
- Two shingles cover a window from its first word to its last. A candidate of which both are found
  at their places holds the window word for word.

Only places travel, never texts; those of one shingle in many documents are joined with a table that
has a row per window, so a frequent passage can be split. Everything up to the result is made of
built-in functions.

Null texts and items have no words. Every row of the documents is a document of its own, whatever
its id; the rows of one item id are one item, and windows of items without an id hit words but list
no item. An item of fewer words than a window is one window. Only the two columns that are named are
read. An empty table gives an empty result, empty items leave every document clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm import common

WINDOW = 10
#: Words of a shingle; a window of fewer is one shingle. At least half a window, so that two cover it.
SHINGLE = 5
#: Shingles of the items, and their bytes, that are broadcast at a time.
BLOCK_SHINGLES = 500_000
BLOCK_BYTES = 32_000_000
#: What separates words once A-Z is in lower case.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    lowered = F.translate(text, _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, SEPARATOR), "")


def _gram_key(words: list[Column], size: int) -> Column:
    return F.xxhash64(F.lit(size), *words[:size])


def _numbered(df: DataFrame, row: str, name: str) -> DataFrame:
    return common.staged(df, name, row=row)


class Items:
    """The benchmark's side: windows, their items and their shingles, as staged tables."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> None:
        if not 0 < shingle <= window <= 2 * shingle:
            raise ValueError("a shingle needs at least half the words of a window")
        words = items.select(
            F.col(id_col).cast("string").alias("item"), words_of(common.text_of(text_col)).alias("words")
        ).where(F.size("words") > 0)
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.lit(window - 1)))
        listed = words.select("item", "words", F.explode(starts).alias("start")).select(
            "item", F.slice("words", F.col("start"), F.lit(window)).alias("words")
        )
        listed = common.staged(listed.distinct(), "leak-items")
        #: ``window_no, words``, without repeats.
        self.windows = _numbered(listed.select("words").distinct(), "window_no", "leak-windows")
        #: ``window_no, item``.
        self.owners = common.staged(
            listed.where("item IS NOT NULL").join(self.windows, "words").select("window_no", "item"), "leak-owners"
        )
        size = F.least(F.lit(shingle), F.size("words"))
        placed = self.windows.select(
            "window_no",
            "words",
            F.size("words").alias("length"),
            size.alias("size"),
            F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("offset"),
        ).select("window_no", "length", "size", "offset", F.slice("words", F.col("offset") + 1, F.col("size")).alias("gram"))
        #: ``gram_no, size, gram``, without repeats.
        self.grams = _numbered(placed.select("size", "gram").distinct(), "gram_no", "leak-grams")
        #: ``window_no, length, size, offset, gram_no``.
        self.placed = common.staged(
            placed.join(self.grams, ["size", "gram"]).select("window_no", "length", "size", "offset", "gram_no"),
            "leak-placed",
        )


def _places(docs: DataFrame, id_col: str, text_col: str, grams: DataFrame, shingle: int) -> DataFrame:
    """The staged table ``row, id, n_words, head, pos, gram_no``: a row for every place of a shingle
    of the items, and one with ``head`` for every document, which may be such a place as well."""
    stats = grams.agg(
        F.collect_set("size"), F.count(F.lit(1)), F.sum(F.octet_length(F.array_join("gram", " ")))
    ).first()
    sizes, rows, length = sorted(stats[0]) or [shingle], stats[1], stats[2] or 0
    blocks = max(1, -(-rows // BLOCK_SHINGLES), -(-length // BLOCK_BYTES))
    docs = docs.select(
        F.col(id_col).alias("id"),
        words_of(common.text_of(text_col)).alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    if blocks > 1:
        docs = common.staged(docs, "leak-words")
    next_words = [F.get("words", F.col("pos") + i) for i in range(max(sizes))]
    places = docs.select("row", "id", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    if len(sizes) > 1:
        places = places.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    else:
        places = places.withColumn("size", F.lit(sizes[0]))
    by_size = lambda of: F.coalesce(*[F.when(F.col("size") == s, of(s)) for s in sizes])
    places = places.withColumn("key", by_size(lambda s: _gram_key(next_words, s)))
    same = lambda s: reduce(
        lambda a, b: a & b, [next_words[i] == F.get("gram", F.lit(i)) for i in range(s)], F.size("gram") == s
    )
    head = (F.coalesce("pos", F.lit(0)) == 0) & (F.col("size") == sizes[0])

    def joined(block: int) -> DataFrame:
        keyed = grams.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block).select(
            "gram_no",
            "gram",
            by_size(lambda s: _gram_key([F.get("gram", F.lit(i)) for i in range(s)], s)).alias("g_key"),
        )
        match = (F.col("key") == F.col("g_key")) & by_size(same)
        # Bounded by BLOCK_SHINGLES and BLOCK_BYTES.
        found = places.join(F.broadcast(keyed), match, "inner" if block else "left")
        found = found.withColumn("head", head if block == 0 else F.lit(False))
        return found.where("head OR gram_no IS NOT NULL").select("row", "id", "n_words", "head", "pos", "gram_no")

    return common.staged(reduce(DataFrame.unionByName, map(joined, range(blocks))), "leak-places")


def _occurrences(places: DataFrame, items: Items) -> DataFrame:
    """The staged table ``row, window_no, first, past``: where in which text windows occur."""
    rarity = places.groupBy("gram_no").agg(F.count(F.lit(1)).alias("n"))
    found = items.placed.join(rarity, "gram_no", "left")
    last = F.col("offset") == F.col("length") - F.col("size")
    prefix = (
        found.groupBy("window_no", "length", "size")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram_no"), F.col("offset"))).alias("rarest"),
            F.max(F.when(F.col("offset") == 0, F.col("gram_no"))).alias("opens"),
            F.max(F.when(last, F.col("gram_no"))).alias("closes"),
        )
        .where("rarest.n > 0")
        .select("window_no", "length", "size", "opens", "closes", "rarest.gram_no", "rarest.offset")
    )
    # As a table, this side brings no partitioning that would tie a hot shingle to one task.
    prefix = common.staged(prefix, "leak-prefix")
    candidates = (
        places.join(prefix, "gram_no")
        .withColumn("first", F.col("pos") - F.col("offset"))
        .where("first >= 0 AND first + length <= n_words")
        .select("row", "window_no", "first", (F.col("first") + F.col("length")).alias("past"), "size", "opens", "closes")
    )
    at = lambda name: places.select(
        F.col("row").alias(f"{name}_row"), F.col("pos").alias(f"{name}_pos"), F.col("gram_no").alias(f"{name}_gram")
    )
    held = candidates.join(
        at("o"),
        (F.col("row") == F.col("o_row")) & (F.col("first") == F.col("o_pos")) & (F.col("opens") == F.col("o_gram")),
        "left_semi",
    ).join(
        at("c"),
        (F.col("row") == F.col("c_row"))
        & (F.col("past") - F.col("size") == F.col("c_pos"))
        & (F.col("closes") == F.col("c_gram")),
        "left_semi",
    )
    return common.staged(held.select("row", "window_no", "first", "past"), "leak-occurrences")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """Per row of ``docs`` its id, ``n_words``, ``spans`` (the word ranges ``first, past`` that windows of
    the items cover, merged and in order) and ``items`` (the ids of those items as sorted strings)."""
    known = Items(items, item_id_col, item_text_col, window, shingle)
    places = _places(docs, id_col, text_col, known.grams, shingle)
    occurrences = _occurrences(places.where("gram_no IS NOT NULL"), known)
    along = Window.partitionBy("row").orderBy("first")
    spans = (
        occurrences.groupBy("row", "first")
        .agg(F.max("past").alias("past"))
        .withColumn("reached", F.max("past").over(along.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("opened", F.coalesce(F.col("first") > F.col("reached"), F.lit(True)).cast("int"))
        .withColumn("span", F.sum("opened").over(along))
        .groupBy("row", "span")
        .agg(F.min("first").alias("first"), F.max("past").alias("past"))
        .groupBy(F.col("row").alias("s_row"))
        .agg(F.sort_array(F.collect_list(F.struct("first", "past"))).alias("spans"))
    )
    named = (
        occurrences.select("row", "window_no")
        .distinct()
        .join(known.owners, "window_no")
        .groupBy(F.col("row").alias("i_row"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    heads = places.where("head").select("row", F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<struct<first:int,past:int>>")
    return (
        heads.join(spans, F.col("row") == F.col("s_row"), "left")
        .join(named, F.col("row") == F.col("i_row"), "left")
        .select(
            id_col,
            "n_words",
            F.coalesce("spans", none).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["past"] - s["first"]))
    return leaks.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
