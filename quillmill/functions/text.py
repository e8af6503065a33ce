"""Text expressions: cleaning, chunking, keywords, answer normalisation, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.arrays import let, value_counts

# Unicode white space plus the four ASCII separators the Java class leaves out.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"

# Keyword token pattern and the words that never count as keywords.
KEYWORD_PATTERN = r"[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9_-]{2,}"
STOP_WORDS = [
    "the", "and", "for", "with", "from", "that", "this", "are", "was", "were", "you", "your",
    "les", "des", "pour", "avec", "dans", "une", "est", "que", "qui", "sur", "par", "aux",
]
NO_KEYWORDS = "this document"

# Openers dropped from the front of an answer.
PREAMBLE = (
    r"^\s*"
    r"(?:(?:sure|okay|ok|certainly|of course|great question|good question|absolutely)[!,.\s]+)?"
    r"(?:(?:here'?s?|the following is|this is)\s+(?:is\s+)?(?:the\s+)?(?:answer|response)"
    r"(?:\s+to\s+(?:your|the)\s+question)?\s*[:\-]\s*)?"
)


def clean_text(text: Column) -> Column:
    """Null becomes empty, white space runs become one space, ends are trimmed."""
    value = F.coalesce(text.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(value, WHITE_SPACE, " "))


def chunk_text(text: Column, min_chars: int = 180, max_chars: int = 1300, lossless: bool = False) -> Column:
    """Pack sentences greedily into chunks of at most ``max_chars`` characters.

    On overflow the current chunk is kept if it has ``min_chars`` and dropped otherwise; the
    next one starts with at most ``max_chars`` characters of the sentence. A text of 40 or
    more characters that yields no chunk gives its first ``max_chars`` characters.

    ``lossless`` keeps every chunk, however short, and cuts longer sentences into parts of
    ``max_chars``, so that no character but white space is lost.
    """
    if lossless:
        min_chars = 1
    # The length of the open chunk travels along, so no step measures a growing text again.
    state = "struct<done:array<string>,open:string,size:int>"

    def closed(acc: Column) -> Column:
        return F.when(
            acc["size"] >= min_chars, F.concat(acc["done"], F.array(acc["open"]))
        ).otherwise(acc["done"])

    def pack(done: Column, opened: Column, size: Column) -> Column:
        return F.struct(done.alias("done"), opened.alias("open"), size.alias("size")).cast(state)

    def step(acc: Column, sentence: Column) -> Column:
        text, size = sentence["text"], sentence["size"]
        joined = F.trim(F.concat(acc["open"], F.lit(" "), text))
        # Only a cut chunk can end in a space, and nothing fits behind one of full length.
        kept = F.when(acc["size"] == 0, size).otherwise(acc["size"] + 1 + size)
        return F.when(acc["size"] + size + 1 <= max_chars, pack(acc["done"], joined, kept)).otherwise(
            pack(closed(acc), F.left(text, F.lit(max_chars)), F.least(size, F.lit(max_chars)))
        )

    start = pack(F.array().cast("array<string>"), F.lit(""), F.lit(0))

    def packed(clean: Column) -> Column:
        sentences = F.filter(F.split(clean, r"(?<=[.!?])\s+", -1), lambda s: s != "")
        if lossless:
            starts = lambda s: F.sequence(F.lit(1), F.length(s), F.lit(max_chars))
            parts = lambda s: F.transform(starts(s), lambda i: F.trim(F.substring(s, i, F.lit(max_chars))))
            sentences = F.filter(F.flatten(F.transform(sentences, parts)), lambda s: s != "")
        sized = F.transform(
            sentences, lambda s: F.struct(s.alias("text"), F.length(s).alias("size"))
        )
        return let(
            F.aggregate(sized, start, step, closed),
            lambda chunks: F.when(
                (F.size(chunks) == 0) & (F.length(clean) >= 40),
                F.array(F.left(clean, F.lit(max_chars))),
            ).otherwise(chunks),
        )

    return let(clean_text(text), packed)


def keywords(text: Column, limit: int = 6) -> Column:
    """The ``limit`` most frequent keywords, ties in word order, joined by comma."""
    words = F.filter(
        F.regexp_extract_all(F.lower(text), F.lit(f"({KEYWORD_PATTERN})"), F.lit(1)),
        lambda w: ~w.isin(STOP_WORDS),
    )
    ranked = F.sort_array(
        F.transform(
            value_counts(words), lambda e: F.struct((-e["n"]).alias("order"), e["value"].alias("w"))
        )
    )
    joined = F.array_join(F.transform(F.slice(ranked, 1, limit), lambda e: e["w"]), ", ")
    return let(joined, lambda j: F.when(j == "", F.lit(NO_KEYWORDS)).otherwise(j))


def normalize_answer(text: Column) -> Column:
    """Lower case, no English articles, only ``a-z0-9`` words, single spaces."""
    no_articles = F.regexp_replace(
        F.lower(F.coalesce(text, F.lit(""))), r"(?U)\b(?:a|an|the)\b", " "
    )
    return F.trim(F.regexp_replace(no_articles, r"[^a-z0-9]+", " "))


def words_of(normalized: Column) -> Column:
    """Split a single-spaced text; an empty text has no words."""
    return F.filter(F.split(normalized, " ", -1), lambda w: w != "")


def clip_text(text: Column, limit: int) -> Column:
    """Squeeze white space; cut longer texts to ``limit`` characters ending in an ellipsis."""
    return let(
        clean_text(text),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(
            F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("…"))
        ),
    )


def strip_preamble(answer: Column) -> Column:
    """Drop one leading filler phrase; an answer that is nothing else stays as it is."""
    rest = F.regexp_replace(answer, "(?i)" + PREAMBLE, "")
    trimmed = F.regexp_replace(rest, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return let(trimmed, lambda t: F.when(t == "", answer).otherwise(t))


def render_template(template: str, **parts: Column) -> Column:
    """Fill ``{name}`` holes of a template with columns, in one concat."""
    pieces: list[Column] = []
    rest = template
    while rest:
        holes = [(rest.find("{" + name + "}"), name) for name in parts]
        holes = [(at, name) for at, name in holes if at >= 0]
        if not holes:
            pieces.append(F.lit(rest))
            break
        at, name = min(holes)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(parts[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces) if pieces else F.lit("")
