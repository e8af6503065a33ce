"""Instruction corpora: pairs from chats, columns or plain text; filter, dedupe, sample, split."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.arrays import let
from quillmill.functions.text import NOT_BLANK, chunk_text, clean_text, keywords
from quillmill.operators.detect import PROMPT_NAMES, RESPONSE_NAMES, TEXT_NAMES, find_column
from quillmill.operators.ranking import BROADCAST_ROWS, at_or_below_cut, broadcast_if, lowest_hash_cut
from quillmill.session import materialize

USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "gpt", "bot")

# Question templates and the limits of a usable pair.
GOAL_QUESTION = "For the goal '{goal}', what should the assistant know about {topic}?"
PLAIN_QUESTION = "What does the source document say about {topic}?"
MIN_INSTRUCTION, MIN_OUTPUT, MAX_PAIR = 5, 10, 8000
MIN_EVAL_ROWS = 50

# Greetings added to a training split.
GREETINGS = [
    ("hello", "Hello! How can I help you today?"),
    ("hi", "Hi there! What can I help you with?"),
    ("hey", "Hey! What would you like to know?"),
    ("hi there", "Hi! How can I assist you today?"),
    ("good morning", "Good morning! How can I help you today?"),
    ("good evening", "Good evening! How can I help you today?"),
    ("how are you?", "I'm doing well, thanks for asking! How can I help you today?"),
    (
        "who are you?",
        "I'm an assistant fine-tuned to help answer your questions. What would you like to know?",
    ),
    ("thanks", "You're welcome! Let me know if you need anything else."),
    ("thank you", "You're welcome! Happy to help with anything else you need."),
    ("bye", "Goodbye! Feel free to come back if you have more questions."),
    ("goodbye", "Goodbye! Feel free to come back if you have more questions."),
]


# ---- pairs from chats ---------------------------------------------------------------------


def _pair_of_turns(turns: Column) -> Column:
    """The pair of an ordered ``array<struct<role, content>>``, or null."""

    def texts(cleaned: Column, roles: Sequence[str]) -> Column:
        kept = F.filter(cleaned, lambda t: t["role"].isin(*roles) & (t["content"] != ""))
        return F.transform(kept, lambda t: t["content"])

    def pair(cleaned: Column) -> Column:
        both = F.struct(
            texts(cleaned, USER_ROLES).alias("asked"), texts(cleaned, ASSISTANT_ROLES).alias("told")
        )
        return let(
            both,
            lambda b: F.when(
                (F.size(b["asked"]) > 0) & (F.size(b["told"]) > 0),
                F.struct(
                    F.array_join(
                        F.slice(b["asked"], -F.least(F.size(b["asked"]), F.lit(2)), F.lit(2)), "\n"
                    ).alias("instruction"),
                    F.element_at(b["told"], -1).alias("output"),
                ),
            ),
        )

    tidy = F.transform(
        turns,
        lambda t: F.struct(
            F.lower(F.coalesce(t["role"], F.lit(""))).alias("role"),
            clean_text(t["content"]).alias("content"),
        ),
    )
    return let(tidy, pair)


def _turns_of(messages: Column, is_text: bool) -> Column:
    """The ``array<struct<role, content>>`` of a chat record; bad JSON, a bare object and list items that
    are no objects are passed over."""
    if not is_text:
        return messages

    def turns(parsed: Column) -> Column:
        is_list = F.schema_of_variant(parsed).startswith("ARRAY")
        items = F.when(is_list, parsed).cast("array<variant>")
        objects = F.filter(items, lambda m: F.schema_of_variant(m).startswith("OBJECT"))
        return F.transform(
            objects,
            lambda m: F.struct(
                F.try_variant_get(m, "$.role", "string").alias("role"),
                F.try_variant_get(m, "$.content", "string").alias("content"),
            ),
        )

    return let(F.try_parse_json(messages), turns)


def messages_to_pair(messages: Column, is_text: bool = True) -> Column:
    """``struct<instruction, output>`` of one chat record, null if it holds no pair.

    A text record is parsed as JSON; bad JSON, a bare object and list items that are no objects
    are passed over rather than failing the row.
    """
    if not is_text:
        return _pair_of_turns(messages)
    return let(_turns_of(messages, is_text), _pair_of_turns)


def message_parts_to_pair(
    records: DataFrame, id_col: str, part: str, messages: str = "messages", is_text: bool = True
) -> DataFrame:
    """``id_col, instruction, output`` of chat records that come in several rows, in the order of ``part``.

    The pair is that of the whole record, as :func:`messages_to_pair` finds it in one cell, but no
    cell or task has to hold a whole record: each part is parsed where it lies.
    """
    turns = records.select(id_col, part, F.posexplode(_turns_of(F.col(f"`{messages}`"), is_text)).alias("_at", "_m"))
    said = turns.select(id_col, F.struct(part, "_at").alias("_turn"), "_m.role", "_m.content")
    return turns_to_pair(said, id_col, "_turn", "role", "content")


def turns_to_pair(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One pair per conversation of an exploded turn table; a null ``turn`` is an input error.

    Only the last two user turns and the last assistant turn matter, so a rank limit prunes each
    map task to at most two rows per conversation and side before anything is shuffled.
    """
    speaker = F.lower(F.col(role))
    side = F.when(speaker.isin(*USER_ROLES), "asked").when(
        speaker.isin(*ASSISTANT_ROLES), "told"
    )
    said = turns.where(side.isNotNull() & F.col(text).rlike(NOT_BLANK)).select(
        F.col(conv), F.col(turn), side.alias("side"), clean_text(F.col(text)).alias("said")
    )
    latest = Window.partitionBy(conv, "side").orderBy(F.desc(turn))
    last = said.withColumn("back", F.row_number().over(latest)).where(F.col("back") <= 2)

    def pick(which: str, back: int) -> Column:
        return F.max(F.when((F.col("side") == which) & (F.col("back") == back), F.col("said")))

    return (
        last.groupBy(conv)
        .agg(
            pick("asked", 2).alias("earlier"),
            pick("asked", 1).alias("asked"),
            pick("told", 1).alias("output"),
        )
        .where(F.col("asked").isNotNull() & F.col("output").isNotNull())
        .select(conv, F.concat_ws("\n", "earlier", "asked").alias("instruction"), "output")
    )


# ---- pairs from columns and from plain text -----------------------------------------------


def pair_columns(columns: Sequence[str]) -> tuple[str, str] | None:
    """The prompt and response columns of a table, if it has two different ones."""
    prompt = find_column(columns, PROMPT_NAMES)
    response = find_column(columns, RESPONSE_NAMES)
    return (prompt, response) if prompt and response and prompt != response else None


def columns_to_pair(df: DataFrame, keep: Sequence[str] = (), ids: Sequence[str] = ()) -> DataFrame:
    """Pairs from a prompt and a response column; an extra ``input`` column joins the prompt.

    Columns named in ``ids`` are never taken for a prompt or response.
    """
    found = pair_columns([c for c in df.columns if c not in ids])
    if found is None:
        raise ValueError("no prompt and response columns")
    prompt, response = found
    extra = {c.lower(): c for c in df.columns}.get("input")
    parts = [F.nullif(clean_text(F.col(f"`{prompt}`")), F.lit(""))]
    if extra and extra not in found:
        parts.append(F.nullif(clean_text(F.col(f"`{extra}`")), F.lit("")))
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.concat_ws("\n", *parts).alias("instruction"),
        clean_text(F.col(f"`{response}`")).alias("output"),
    ).where((F.col("instruction") != "") & (F.col("output") != ""))


def synthesize_qa(
    df: DataFrame,
    id_col: str,
    goal: str = "",
    min_chars: int = 180,
    max_chars: int = 1300,
    keep: Sequence[str] = (),
    lossless: bool = False,
) -> DataFrame:
    """One question per text chunk, asking about the chunk's keywords.

    Keeps ``id_col`` and the ``keep`` columns and adds ``chunk``, the chunk number, so rows have a stable key. Row-local:
    no shuffle, and the chunk fold runs once per text.
    """
    text = find_column(df.columns, TEXT_NAMES) or df.columns[0]
    named = {c.lower(): c for c in df.columns}.get("source")
    row_name = F.concat(F.lit("row_"), F.col(id_col).cast("string"))
    source = clean_text(F.col(f"`{named}`")) if named else row_name
    mark = "\x00"
    opening, closing = (GOAL_QUESTION if goal else PLAIN_QUESTION).format(goal=goal, topic=mark).split(mark)
    chunks = df.select(
        F.col(id_col),
        *keep,
        source.alias("origin"),
        F.posexplode(chunk_text(F.col(f"`{text}`"), min_chars, max_chars, lossless)).alias("chunk", "output"),
    )
    return chunks.select(
        id_col,
        *keep,
        "chunk",
        F.concat(F.lit(opening), keywords(F.col("output")), F.lit(closing)).alias("instruction"),
        "output",
        F.concat("origin", F.lit("#chunk"), F.col("chunk").cast("string")).alias("source"),
    )


def to_instruction_output(
    df: DataFrame, id_col: str, goal: str = "", lossless: bool = False, part: str | None = None
) -> tuple[DataFrame, dict[str, str], bool]:
    """Pairs by the first way that fits: chat records, two columns, or generated questions.

    Returns the pairs with ``id_col``, a ``chunk`` number and ``source``; which columns were
    used; and whether questions were generated. The only job run here looks for one chat record
    that parses, and stops at the first. Where ``part`` names a column, a chat record is all the rows of
    one id in its order, with the source of the first; the pairs are then written once.
    """
    if df.select(id_col).limit(1).count() == 0:
        raise ValueError("text dataset is empty")
    lower = {c.lower(): c for c in df.columns}
    source = (
        clean_text(F.col(f"`{lower['source']}`")) if "source" in lower else F.lit(None).cast("string")
    )
    if "messages" in lower:
        name = lower["messages"]
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        if part is None:
            paired = df.select(
                F.col(id_col), messages_to_pair(F.col(f"`{name}`"), is_text).alias("pair"), source.alias("source")
            ).where(F.col("pair").isNotNull())
        else:
            whole = message_parts_to_pair(df, id_col, part, name, is_text)
            sources = df.groupBy(id_col).agg(F.min_by(source, part).alias("source"))
            whole = whole.join(sources, id_col, "left") if "source" in lower else whole.withColumn("source", source)
            paired = materialize(whole.select(id_col, F.struct("instruction", "output").alias("pair"), "source"), "record-pairs")
        pairs = paired.withColumn("chunk", F.lit(0))
        if pairs.limit(1).count():
            out = pairs.select(id_col, "chunk", "pair.instruction", "pair.output", "source")
            return out, {"prompt": "messages", "response": "messages"}, False
    found = pair_columns([c for c in df.columns if c != id_col])
    if found is not None:
        keep = [id_col, *([lower["source"]] if "source" in lower else [])]
        tagged = columns_to_pair(df, keep=keep, ids=[id_col])
        origin = F.col(f"`{lower['source']}`") if "source" in lower else F.lit(None).cast("string")
        out = tagged.select(
            id_col, F.lit(0).alias("chunk"), "instruction", "output", origin.alias("source")
        )
        return out, {"prompt": found[0], "response": found[1]}, False
    made = synthesize_qa(df, id_col, goal, lossless=lossless)
    return made, {"prompt": "synthetic_question", "response": "synthetic_answer"}, True


def text_loss(
    df: DataFrame, text: str = "text", min_chars: int = 180, max_chars: int = 1300, lossless: bool = False
) -> DataFrame:
    """One row: ``documents``, their ``chars`` without white space, the ``lost_chars`` that no chunk holds,
    and ``documents_lost``, those that have characters but no chunk."""
    bare = lambda t: F.length(F.regexp_replace(t, " ", "")).cast("long")
    chunks = chunk_text(F.col(f"`{text}`"), min_chars, max_chars, lossless)
    measured = df.select(
        bare(clean_text(F.col(f"`{text}`"))).alias("chars"),
        F.inline(F.array(F.struct(chunks.alias("chunks")))),
    ).select("chars", F.size("chunks").alias("n"), bare(F.array_join("chunks", "")).alias("kept"))
    return measured.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(F.col("chars") - F.col("kept")), F.lit(0)).alias("lost_chars"),
        F.count_if((F.col("chars") > 0) & (F.col("n") == 0)).alias("documents_lost"),
    )


# ---- filter, dedupe, sample, split --------------------------------------------------------


def filter_pairs(
    df: DataFrame,
    min_instruction: int | None = MIN_INSTRUCTION,
    min_output: int | None = MIN_OUTPUT,
    max_pair: int | None = MAX_PAIR,
) -> DataFrame:
    """Clean both texts; drop pairs that are too short or too long together. A limit of None is off.

    The test runs on a one-item array that is then unnested, so the texts are computed once. A
    plain ``where`` would be pushed below the projection and repeat every expression in it.
    """
    pair = F.struct(
        clean_text(F.col("instruction")).alias("instruction"),
        clean_text(F.col("output")).alias("output"),
    )
    usable = F.filter(
        F.array(pair),
        lambda p: (F.length(p["instruction"]) >= F.lit(min_instruction or 0))
        & (F.length(p["output"]) >= F.lit(min_output or 0))
        & (F.lit(max_pair is None) | (F.length(p["instruction"]) + F.length(p["output"]) <= F.lit(max_pair or 0))),
    )
    others = [c for c in df.columns if c not in ("instruction", "output")]
    return df.select(*others, F.inline(usable)).select(*df.columns)


def _packed(df: DataFrame, columns: Sequence[str]) -> Column:
    """One sort key for several columns, nulls first: a decimal where all are integers and fit, since the
    least of decimals is found by hash aggregation; else a struct."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
    widths = [bits.get(df.schema[c].dataType.simpleString(), 127) for c in columns]
    if sum(widths) + len(widths) > 126:
        return F.struct(*columns)
    key = F.lit(0).cast("decimal(38,0)")
    for c, width in zip(columns, widths):
        place = F.coalesce(F.col(c).cast("decimal(38,0)") + F.lit(Decimal(2 ** (width - 1) + 1)), F.lit(Decimal(0)))
        key = (key * F.lit(Decimal(2**width + 1)) + place).cast("decimal(38,0)")
    return key


def repeated_pairs(rows: DataFrame) -> DataFrame:
    """Digest, first order key and number of the pairs that occur more than once."""
    found = rows.groupBy("_pair").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_copies"))
    return found.where(F.col("_copies") > 1)


def dedupe_pairs(df: DataFrame, order_by: Sequence[str], copies: str | None = None) -> DataFrame:
    """Keep the first row, by ``order_by``, of each exact (instruction, output) pair; of rows that tie
    there, the first by a hash of the other columns.

    Pairs are told apart by SHA-256. The rows are written once with their digests; only digests and
    order keys are aggregated and shuffled, and a hot pair sends one row per task. Digests that occur once
    are then forgotten: rows meet a table of the repeated ones, which is broadcast if it has few rows,
    and then no text is shuffled. Runs the jobs that write these tables.
    """
    rest = [c for c in df.columns if c not in {"instruction", "output", *order_by}]
    # The length tells where the first text ends, and whether it is null.
    told = [F.coalesce(F.length("instruction"), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce("instruction", F.lit(""))]
    answered = F.when(F.col("output").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "output"))
    rows = df.withColumns(
        {
            "_pair": F.unhex(F.sha2(F.concat(*told, answered), 256)),
            "_order": _packed(df, order_by),
            "_rest": F.hash(*rest) if rest else F.lit(0),
            "_row": F.monotonically_increasing_id(),
        }
    )
    rows = materialize(rows, "pairs")
    repeated = materialize(repeated_pairs(rows), "repeated-pairs")
    # One row per pair here and among the keepers.
    found = repeated.limit(BROADCAST_ROWS + 1).count()
    if not found:
        kept = rows.withColumn("_copies", F.lit(1).cast("long"))
    else:
        # Rows of one pair with one order key: as a rule a single row.
        tied = rows.select("_pair", "_order", "_rest", "_row").join(broadcast_if(repeated, found), "_pair")
        tie = _packed(rows, ["_rest", "_row"])
        keepers = tied.where("_order <=> _first").groupBy("_pair", "_copies").agg(F.min(tie).alias("_keeper"))
        # As a table, the larger kind brings no partitioning that would tie a hot pair to one task.
        keepers = keepers if found <= BROADCAST_ROWS else materialize(keepers, "kept-pairs")
        kept = rows.join(broadcast_if(keepers, found), "_pair", "left")
        kept = kept.where(F.col("_keeper").isNull() | (tie == F.col("_keeper")))
        kept = kept.withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    counted = [F.col("_copies").alias(copies)] if copies else []
    return kept.select(*df.columns, *counted)


def sample_n(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones in every run.

    Only the id columns are read to find the cut; the table itself is filtered, not shuffled.
    """
    cut, total = lowest_hash_cut(df, ids, lambda t: F.least(t, F.lit(n)), seed)
    if n <= 0:
        return df.where(F.lit(False))
    return df.where((total.scalar() <= n) | at_or_below_cut(cut, ids, seed))


def eval_size(total: Column, ratio: float = 0.1) -> Column:
    """Evaluation rows for ``total`` rows: the clamped ratio, raised towards 50 rows."""
    base = min(max(ratio, 0.05), 0.3)
    target = F.least(F.lit(MIN_EVAL_ROWS), F.floor(total / 2))
    by_ratio = F.lit(base) * total
    return F.when(by_ratio > target, F.ceil(by_ratio)).otherwise(target).cast("long")


def eval_is_small(total: Column) -> Column:
    """True if the corpus cannot give a full-size evaluation split."""
    return (total >= 2) & (F.floor(total / 2) < MIN_EVAL_ROWS)


def split_train_eval(
    df: DataFrame, ids: Sequence[str], ratio: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split``; exact size, disjoint. With fewer than two rows both splits get them all."""
    cut, total = lowest_hash_cut(df, ids, lambda t: eval_size(t, ratio), seed)
    names = (
        F.when(total.scalar() < 2, F.array(F.lit("train"), F.lit("eval")))
        .when(at_or_below_cut(cut, ids, seed), F.array(F.lit("eval")))
        .otherwise(F.array(F.lit("train")))
    )
    return df.withColumn("split", F.explode(names))


def augment_with_examples(
    corpus: DataFrame,
    examples: Sequence[tuple[str, str]] = GREETINGS,
    repeats: int = 3,
) -> DataFrame:
    """Add ``repeats`` copies of each example to the train split unless the corpus asks it.

    The corpus is filtered to the example keys before ``distinct``, so it is never shuffled and
    the broadcast side has at most ``len(examples)`` rows.
    """
    spark = corpus.sparkSession
    given = spark.createDataFrame(list(examples), "instruction string, output string")
    asked = F.lower(F.regexp_replace("instruction", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    seen = (
        corpus.select(asked.alias("asked"))
        .where(F.col("asked").isin([i.lower() for i, _ in examples]))
        .distinct()
    )
    added = (
        given.join(F.broadcast(seen), F.lower("instruction") == F.col("asked"), "left_anti")
        .select(
            "instruction",
            "output",
            F.lit("train").alias("split"),
            F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("copy"),
        )
        .drop("copy")
    )
    return corpus.unionByName(added, allowMissingColumns=True)


# ---- reports ------------------------------------------------------------------------------


def quality_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row count, quality score, mean lengths, duplicates and short share, overall or per group.

    Counts per distinct pair, then per distinct instruction, then per group: each level partially
    aggregates before its shuffle, so neither a hot group nor a hot text lands in one task. Texts are
    told apart by their SHA-256; only digests and lengths are shuffled.
    """
    base = df.select(
        *by,
        *[F.unhex(F.sha2(c, 256)).alias(c) for c in ("instruction", "output")],
        *[F.length(F.coalesce(c, F.lit(""))).alias(f"{c}_len") for c in ("instruction", "output")],
    )
    pairs = base.groupBy(*by, "instruction", "output").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(f"{c}_len").alias(f"{c}_len") for c in ("instruction", "output")]
    )
    output_len, prompt_len = F.col("output_len"), F.col("instruction_len")
    n = F.col("n")
    asked = pairs.groupBy(*by, "instruction").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when((prompt_len > 0) & (output_len > 0), n).otherwise(0)).alias("filled"),
        F.sum(F.when(output_len >= 50, n).otherwise(0)).alias("rich"),
        F.sum(n * output_len).alias("output_chars"),
        F.sum(n * prompt_len).alias("prompt_chars"),
        F.count(F.lit(1)).alias("pairs"),
    )
    sums = asked.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("rows", "filled", "rich", "output_chars", "prompt_chars", "pairs")
        ],
        F.count("instruction").alias("instructions"),
    )
    rows = F.greatest(F.col("rows"), F.lit(1))
    score = (
        0.4 * (F.col("filled") / rows)
        + 0.4 * (F.col("rich") / rows)
        + 0.2 * F.least(F.lit(1.0), F.col("instructions") / rows)
    ) * 100
    return sums.select(
        *by,
        "rows",
        F.bround(score, 1).alias("quality_score"),
        (F.col("prompt_chars") / rows).alias("avg_prompt_chars"),
        (F.col("output_chars") / rows).alias("avg_response_chars"),
        (F.col("rows") - F.col("pairs")).alias("duplicates"),
        F.when(F.col("rows") == 0, F.lit(0.0))
        .otherwise(F.bround((F.col("rows") - F.col("rich")) / rows * 100, 1))
        .alias("short_responses_pct"),
    )


def bundle_report(
    quality: DataFrame, split: DataFrame, raw_rows: DataFrame, total: DataFrame
) -> DataFrame:
    """The quality row plus raw, train and evaluation row counts.

    ``raw_rows`` and ``total`` are one-row counts of the input and of the distinct pairs.
    """
    counts = split.groupBy().agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "eval").alias("eval"),
    )
    return quality.withColumns(
        {
            "raw_rows": raw_rows.scalar(),
            "train_rows": counts.select("train").scalar(),
            "eval_rows": counts.select("eval").scalar(),
            "eval_is_small": eval_is_small(total.scalar()),
        }
    )


def quality_label(score: Column) -> Column:
    return (
        F.when(score >= 80, "excellent")
        .when(score >= 60, "good")
        .when(score >= 40, "fair")
        .otherwise("poor")
    )


def text_data_warnings(reports: DataFrame) -> DataFrame:
    """Add ``warnings`` and ``advice`` codes to report rows, one row per corpus or source.

    Uses generated_qa, duplicates, train_rows, avg_response_chars and eval_is_small.
    """
    train = F.col("train_rows")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("eval_is_small"), "small_eval"),
            F.when(F.col("generated_qa"), "generated_qa"),
            F.when(F.col("duplicates") > 0, "duplicates"),
            F.when(train < 50, "very_small_train"),
            F.when(F.col("avg_response_chars") < 20, "short_responses"),
        )
    )
    advice = F.array_compact(
        F.array(
            F.when(F.col("generated_qa"), "provide_answers"),
            F.when(train < 50, "collect_200_rows").when(train < 200, "collect_more_rows"),
        )
    )
    return reports.withColumns({"warnings": warnings, "advice": advice})


def image_data_warnings(reports: DataFrame) -> DataFrame:
    """Add ``quality_score``, ``quality_label``, ``warnings`` and ``advice`` to image reports."""
    images, classes = F.col("num_images"), F.col("num_classes")
    score = (
        F.when(images >= 1000, 90.0)
        .when(images >= 500, 75.0)
        .when(images >= 200, 55.0)
        .when(images >= 50, 35.0)
        .otherwise(15.0)
    )
    return reports.withColumns(
        {
            "quality_score": score,
            "quality_label": quality_label(score),
            "warnings": F.array_compact(
                F.array(
                    F.when(images < 100, "few_images"), F.when(classes > 20, "many_classes")
                )
            ),
            "advice": F.array_compact(
                F.array(
                    F.when(images < 100, "collect_100_per_class").when(
                        images < 500, "collect_more_images"
                    )
                )
            ),
        }
    )
