"""Corpus queries over documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.functions.text import STOP_WORDS, chunk_text, clean_text, keywords
from quillmill.operators import corpus as C
from quillmill.operators.ranking import slices_with_carry
from quillmill.operators.sequences import label_index, stratified_split
from quillmill.plans.prepare import prepare_text_dataset
from quillmill.queries.registry import query, rounded, table, texts
from quillmill.session import materialize

GOAL = "support"

CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

CHUNKS = rf"""
docs AS (SELECT doc_id, {CLEAN.format('source')} AS origin, {CLEAN.format('text')} AS t FROM documents),
folded AS (
  SELECT doc_id, origin, t, list_reduce(
    list_transform(list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
                               lambda s: s <> ''),
                   lambda s: {{'done': []::VARCHAR[], 'cur': s}}),
    lambda a, b: CASE WHEN length(a.cur) + length(b.cur) + 1 <= 1300
      THEN {{'done': a.done, 'cur': trim(a.cur || ' ' || b.cur)}}
      ELSE {{'done': CASE WHEN length(a.cur) >= 180 THEN list_append(a.done, a.cur) ELSE a.done END,
            'cur': left(b.cur, 1300)}} END,
    {{'done': []::VARCHAR[], 'cur': ''}}) AS st
  FROM docs WHERE t <> ''),
packed AS (
  SELECT doc_id, origin, t,
         CASE WHEN length(st.cur) >= 180 THEN list_append(st.done, st.cur) ELSE st.done END AS cs
  FROM folded),
listed AS (
  SELECT doc_id, origin,
         CASE WHEN len(cs) = 0 AND length(t) >= 40 THEN [left(t, 1300)] ELSE cs END AS cs
  FROM packed),
chunks AS (
  SELECT doc_id, origin, CAST(unnest(range(len(cs))) AS INT) AS chunk, unnest(cs) AS body FROM listed)
"""


def topics(source: str, key: str, body: str) -> str:
    """CTEs that end in ``topics(key..., topic)`` for the rows of ``source``."""
    return rf"""
words AS (SELECT {key}, unnest(regexp_extract_all(lower({body}), '[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9_-]{{2,}}')) AS w
          FROM {source}),
counted AS (SELECT {key}, w, count(*) AS n FROM words WHERE w NOT IN ({STOPS}) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, w) AS place FROM counted),
topics AS (SELECT {key}, string_agg(w, ', ' ORDER BY n DESC, w) AS topic FROM placed WHERE place <= 6
           GROUP BY {key})
"""


def made(goal: str = "") -> str:
    opening = (
        f"'For the goal ''{goal}'', what should the assistant know about '"
        if goal
        else "'What does the source document say about '"
    )
    return rf"""
{CHUNKS},
{topics('chunks', 'doc_id, chunk', 'body')},
made AS (
  SELECT doc_id, chunk, {opening} || coalesce(topic, 'this document') || '?' AS instruction,
         body AS output, origin || '#chunk' || chunk AS source
  FROM chunks LEFT JOIN topics USING (doc_id, chunk))
"""


MADE = made()
PAIRS = rf"""
{MADE},
tidy AS (SELECT doc_id, chunk, {CLEAN.format('instruction')} AS instruction, {CLEAN.format('output')} AS output, source
         FROM made),
pairs AS (SELECT * FROM tidy WHERE length(instruction) >= 5 AND length(output) >= 10
            AND length(instruction) + length(output) <= 8000)
"""
CORPUS = rf"""
{PAIRS},
firsts AS (SELECT *, row_number() OVER (PARTITION BY instruction, output ORDER BY doc_id, chunk) AS copy_no,
                  count(*) OVER (PARTITION BY instruction, output) AS copies
           FROM pairs),
corpus AS (SELECT doc_id, chunk, instruction, output, source, copies FROM firsts WHERE copy_no = 1)
"""
# 0.1 of the rows, or 50 if that is more and half of the rows allow it.
EVAL_ROWS = """CASE WHEN 0.1::DOUBLE * n > least(50, n // 2) THEN ceil(0.1::DOUBLE * n) ELSE least(50, n // 2) END"""
SPLIT = rf"""
{CORPUS},
size AS (SELECT count(*) AS n FROM corpus),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(chr(1), doc_id, chunk, '42')), doc_id, chunk) AS r
           FROM corpus),
split AS (SELECT doc_id, chunk, instruction, output, source,
                 CASE WHEN r <= (SELECT {EVAL_ROWS} FROM size) THEN 'eval' ELSE 'train' END AS split
          FROM ranked)
"""
GREETING_ROWS = ", ".join(
    "({}, '{}', '{}')".format(i, a.replace("'", "''"), b.replace("'", "''"))
    for i, (a, b) in enumerate(C.GREETINGS)
)
AUGMENTED = rf"""
{SPLIT},
greetings(no, instruction, output) AS (VALUES {GREETING_ROWS}),
added AS (SELECT instruction, output FROM greetings g, range(3)
          WHERE NOT EXISTS (SELECT 1 FROM split s WHERE lower(trim(s.instruction)) = g.instruction)),
bundle AS (SELECT doc_id, chunk, instruction, output, source, split FROM split
           UNION ALL SELECT NULL, NULL, instruction, output, NULL, 'train' FROM added)
"""


def quality(rows: str, keys: str = "") -> str:
    """The quality report of a pair table as a SELECT."""
    lead = f"{keys}," if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {lead} count(*) AS rows,
  round_even((0.4::DOUBLE * avg(CASE WHEN length(instruction) > 0 AND length(output) > 0 THEN 1.0::DOUBLE ELSE 0 END)
       + 0.4::DOUBLE * avg(CASE WHEN length(output) >= 50 THEN 1.0::DOUBLE ELSE 0 END)
       + 0.2::DOUBLE * least(1.0::DOUBLE, count(DISTINCT instruction)::DOUBLE / count(*))) * 100, 1) AS quality_score,
  round(avg(length(instruction)), 6) AS avg_prompt_chars,
  round(avg(length(output)), 6) AS avg_response_chars,
  count(*) - count(DISTINCT instruction || chr(1) || output) AS duplicates,
  round_even(avg(CASE WHEN length(output) < 50 THEN 1.0::DOUBLE ELSE 0 END) * 100, 1) AS short_responses_pct
FROM {rows} {tail}"""


def documents(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text", "source")


def made_pairs(spark, sf):
    return C.filter_pairs(C.synthesize_qa(documents(spark, sf), "doc_id"))


def corpus(spark, sf, copies=None):
    return C.dedupe_pairs(made_pairs(spark, sf), ["doc_id", "chunk"], copies)


# ---- text columns -------------------------------------------------------------------------


@query("clean_text", f"SELECT doc_id, {CLEAN.format('text')} AS text FROM documents")
def _clean(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", clean_text(F.col("text")).alias("text"))


LOSSLESS = rf"""
docs AS (SELECT doc_id, {CLEAN.format('text')} AS t FROM documents),
folded AS (
  SELECT doc_id, t, list_reduce(
    list_transform(list_filter(flatten(list_transform(
        list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''),
        lambda s: list_transform(range(0, length(s), 1300), lambda i: trim(s[i + 1:i + 1300])))), lambda s: s <> ''),
                   lambda s: {{'done': []::VARCHAR[], 'cur': s}}),
    lambda a, b: CASE WHEN length(a.cur) + length(b.cur) + 1 <= 1300
      THEN {{'done': a.done, 'cur': trim(a.cur || ' ' || b.cur)}}
      ELSE {{'done': CASE WHEN a.cur <> '' THEN list_append(a.done, a.cur) ELSE a.done END, 'cur': b.cur}} END,
    {{'done': []::VARCHAR[], 'cur': ''}}) AS st
  FROM docs WHERE t <> ''),
listed AS (SELECT doc_id, t, list_append(st.done, st.cur) AS cs FROM folded),
chunks AS (SELECT doc_id, CAST(unnest(range(len(cs))) AS INT) AS chunk, unnest(cs) AS output FROM listed)
"""


@query("chunk_text_lossless", f"WITH {LOSSLESS} SELECT doc_id, chunk, output FROM chunks")
def _lossless(spark, sf):
    docs = texts(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(chunk_text(F.col("text"), lossless=True)).alias("chunk", "output"))


@query(
    "text_loss",
    f"""WITH {CHUNKS}, kept AS (SELECT doc_id, sum(length(replace(body, ' ', ''))) AS kept FROM chunks GROUP BY doc_id)
SELECT count(*) AS documents, CAST(sum(length(replace(t, ' ', ''))) AS BIGINT) AS chars,
  CAST(sum(length(replace(t, ' ', '')) - coalesce(kept, 0)) AS BIGINT) AS lost_chars,
  count(*) FILTER (t <> '' AND kept IS NULL) AS documents_lost FROM docs LEFT JOIN kept USING (doc_id)""",
)
def _loss(spark, sf):
    return C.text_loss(texts(spark, sf, "documents", "text"))


@query("chunk_text", f"WITH {CHUNKS} SELECT doc_id, chunk, body AS output FROM chunks")
def _chunk(spark, sf):
    docs = texts(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(chunk_text(F.col("text"))).alias("chunk", "output"))


@query(
    "keywords",
    f"""WITH {topics('documents', 'doc_id', 'text')}
SELECT doc_id, coalesce(topic, 'this document') AS topic FROM documents LEFT JOIN topics USING (doc_id)""",
)
def _keywords(spark, sf):
    docs = texts(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", keywords(F.col("text")).alias("topic"))


@query("synthesize_qa", f"WITH {made(GOAL)} SELECT * FROM made")
def _synthesize(spark, sf):
    return C.synthesize_qa(documents(spark, sf), "doc_id", GOAL)


@query("filter_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def _filter(spark, sf):
    return made_pairs(spark, sf)


@query("dedupe_pairs", f"WITH {CORPUS} SELECT * FROM corpus")
def _dedupe(spark, sf):
    return corpus(spark, sf, "copies")


# ---- sample and split ---------------------------------------------------------------------


@query(
    "sample_n",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(chr(1), doc_id, '42')), doc_id) AS r FROM documents)
SELECT * EXCLUDE (r) FROM r WHERE r <= 150""",
)
def _sample(spark, sf):
    return C.sample_n(table(spark, sf, "documents"), 150, ["doc_id"])


@query(
    "split_train_eval",
    f"""WITH size AS (SELECT count(*) AS n FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(chr(1), doc_id, '42')), doc_id) AS r FROM documents)
SELECT * EXCLUDE (r), CASE WHEN r <= (SELECT {EVAL_ROWS} FROM size) THEN 'eval' ELSE 'train' END AS split FROM r""",
)
def _split(spark, sf):
    return C.split_train_eval(table(spark, sf, "documents"), ["doc_id"])


@query(
    "stratified_split",
    """WITH d AS (SELECT * FROM documents),
sizes AS (SELECT lang, count(*) AS rows FROM d GROUP BY lang),
want AS (SELECT CAST(ceil(0.15::DOUBLE * sum(rows)) AS BIGINT) AS want, CAST(sum(rows) AS BIGINT) AS total FROM sizes),
shares AS (SELECT lang, (want * rows) // total AS base, (want * rows) % total AS rest, want FROM sizes, want),
quotas AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang)
                                         <= want - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(chr(1), doc_id, '42')), doc_id) AS r
      FROM d)
SELECT * EXCLUDE (r, quota), CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN quotas USING (lang)""",
)
def _stratified(spark, sf):
    return stratified_split(table(spark, sf, "documents"), "lang", ["doc_id"])


@query(
    "label_index",
    """SELECT source AS label, CAST(row_number() OVER (ORDER BY source) - 1 AS INT) AS label_id
FROM (SELECT DISTINCT source FROM documents)""",
)
def _label_index(spark, sf):
    return label_index(table(spark, sf, "documents"), "source")


@query("augment_examples", f"WITH {AUGMENTED} SELECT split, instruction, output, count(*) AS n FROM bundle GROUP BY ALL")
def _augment(spark, sf):
    written = materialize(corpus(spark, sf), "corpus")
    bundle = C.augment_with_examples(C.split_train_eval(written, ["doc_id", "chunk"]))
    return bundle.groupBy("split", "instruction", "output").agg(F.count(F.lit(1)).alias("n"))


# ---- reports ------------------------------------------------------------------------------


def _quality(df, by=()):
    return rounded(C.quality_report(df, by), "avg_prompt_chars", "avg_response_chars", places=6)


@query(
    "quality_report",
    f"WITH {PAIRS}, tagged AS (SELECT split_part(source, '#', 1) AS origin, * FROM pairs) {quality('tagged', 'origin')}",
)
def _quality_report(spark, sf):
    tagged = made_pairs(spark, sf).withColumn("origin", F.split_part(F.col("source"), F.lit("#"), F.lit(1)))
    return _quality(tagged, ["origin"])


@query(
    "quality_label",
    f"""WITH {PAIRS}, tagged AS (SELECT doc_id AS d, * FROM pairs), q AS ({quality('tagged', 'd')})
SELECT d, quality_score, CASE WHEN quality_score >= 80 THEN 'excellent' WHEN quality_score >= 60 THEN 'good'
  WHEN quality_score >= 40 THEN 'fair' ELSE 'poor' END AS quality_label FROM q""",
)
def _quality_label(spark, sf):
    per_doc = C.quality_report(made_pairs(spark, sf).withColumn("d", F.col("doc_id")), ["d"])
    return per_doc.select("d", "quality_score", C.quality_label(F.col("quality_score")).alias("quality_label"))


REPORT = f"""
facts AS ({quality('corpus')}),
report AS (SELECT rows, quality_score, avg_prompt_chars, avg_response_chars,
  CAST((SELECT sum(copies - 1) FROM corpus) AS BIGINT) AS duplicates, short_responses_pct,
  (SELECT count(*) FROM documents) AS raw_rows,
  (SELECT count(*) FROM bundle WHERE split = 'train') AS train_rows,
  (SELECT count(*) FROM bundle WHERE split = 'eval') AS eval_rows,
  rows >= 2 AND rows // 2 < 50 AS eval_is_small, TRUE AS generated_qa FROM facts)
"""


@query("bundle_report", f"WITH {AUGMENTED}, {REPORT} SELECT * FROM report")
def _bundle_report(spark, sf):
    bundle = prepare_text_dataset(documents(spark, sf), "doc_id")
    return rounded(bundle.report, "avg_prompt_chars", "avg_response_chars", places=6)


@query("prepare_without_id", f"WITH {AUGMENTED}, {REPORT} SELECT * FROM report")
def _prepare_without_id(spark, sf):
    bundle = prepare_text_dataset(documents(spark, sf).drop("doc_id"))
    return rounded(bundle.report, "avg_prompt_chars", "avg_response_chars", places=6)


@query(
    "text_data_warnings",
    f"""WITH {PAIRS}, tagged AS (SELECT doc_id AS d, * FROM pairs), q AS ({quality('tagged', 'd')})
SELECT d, array_to_string(list_filter([CASE WHEN rows >= 2 AND rows // 2 < 50 THEN 'small_eval' END, 'generated_qa',
   CASE WHEN duplicates > 0 THEN 'duplicates' END, CASE WHEN rows < 50 THEN 'very_small_train' END,
   CASE WHEN avg_response_chars < 20 THEN 'short_responses' END], lambda x: x IS NOT NULL), ',') AS warnings,
 array_to_string(list_filter(['provide_answers', CASE WHEN rows < 50 THEN 'collect_200_rows'
   WHEN rows < 200 THEN 'collect_more_rows' END], lambda x: x IS NOT NULL), ',') AS advice FROM q""",
)
def _text_warnings(spark, sf):
    per_doc = C.quality_report(made_pairs(spark, sf).withColumn("d", F.col("doc_id")), ["d"])
    reports = per_doc.withColumns(
        {
            "train_rows": F.col("rows"),
            "generated_qa": F.lit(True),
            "eval_is_small": C.eval_is_small(F.col("rows")),
        }
    )
    return C.text_data_warnings(reports).select(
        "d", F.array_join("warnings", ",").alias("warnings"), F.array_join("advice", ",").alias("advice")
    )


@query("prepare_text_dataset", f"WITH {AUGMENTED} SELECT * FROM bundle")
def _prepare(spark, sf):
    return prepare_text_dataset(documents(spark, sf), "doc_id").split


# ---- pairs from conversations -------------------------------------------------------------

CLEAN_TEXT = CLEAN.format("text")
SAID = f"""
said AS (SELECT conv_id, turn, CASE WHEN lower(role) IN ('user', 'human') THEN 'asked'
                WHEN lower(role) IN ('assistant', 'gpt', 'bot') THEN 'told' END AS side, {CLEAN_TEXT} AS said
         FROM conversations),
back AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn DESC) AS b
         FROM said WHERE said <> '' AND side IS NOT NULL),
turn_pairs AS (SELECT conv_id,
                 string_agg(said, chr(10) ORDER BY turn) FILTER (WHERE side = 'asked' AND b <= 2) AS instruction,
                 max(said) FILTER (WHERE side = 'told' AND b = 1) AS output
               FROM back GROUP BY conv_id)
"""
TURN_PAIRS = f"WITH {SAID} SELECT * FROM turn_pairs WHERE instruction IS NOT NULL AND output IS NOT NULL"


@query("turns_to_pair", TURN_PAIRS)
def _turns(spark, sf):
    return C.turns_to_pair(table(spark, sf, "conversations"))


def chat_records(spark, sf):
    """JSON chat records, as chat datasets come, one per conversation; long ones in several parts."""
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    messages = F.transform(listed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    keys = F.col("conv_id").alias("record"), F.expr("turn div 64").alias("part")
    return table(spark, sf, "conversations").groupBy(*keys).agg(F.to_json(messages).alias("messages"))


RECORD_PAIRS = f"""{SAID.replace('conv_id', 'record').replace('FROM conversations',
    'FROM (SELECT conv_id AS record, turn, role, text FROM conversations)')},
record_pairs AS (SELECT * FROM turn_pairs WHERE instruction IS NOT NULL AND output IS NOT NULL)"""


@query("messages_to_pair", f"WITH {RECORD_PAIRS} SELECT * FROM record_pairs")
def _messages(spark, sf):
    return C.message_parts_to_pair(chat_records(spark, sf), "record", "part")


@query(
    "to_instruction_output",
    f"WITH {RECORD_PAIRS} SELECT record, 0 AS chunk, instruction, output, CAST(NULL AS VARCHAR) AS source FROM record_pairs",
)
def _to_pairs(spark, sf):
    pairs, _, _ = C.to_instruction_output(materialize(chat_records(spark, sf), "chats"), "record", part="part")
    return pairs


NEXT_TURN = f"""
nexts AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text,
                 lag(role) OVER w AS input_role
          FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
asked AS (SELECT conv_id, turn, {CLEAN_TEXT} AS q, {CLEAN.format('input_role')} AS i, {CLEAN.format('next_text')} AS a
          FROM nexts WHERE role = 'user' AND next_role = 'assistant')
"""


@query(
    "columns_to_pair",
    f"""WITH {NEXT_TURN} SELECT conv_id, turn, CASE WHEN i <> '' THEN q || chr(10) || i ELSE q END AS instruction, a AS output
FROM asked WHERE (q <> '' OR i <> '') AND a <> ''""",
)
def _columns(spark, sf):
    """An answer with the question right before it; the role before that is the extra input."""
    turns = table(spark, sf, "conversations")
    seen = slices_with_carry(turns, "conv_id", "turn", 2)
    w = Window.partitionBy("conv_id", "_slice").orderBy("turn")
    asked = seen.select(
        "conv_id",
        F.lag("turn").over(w).alias("turn"),
        F.lag("text").over(w).alias("question"),
        F.lag("role").over(w).alias("asked_by"),
        F.lag("role", 2).over(w).alias("input"),
        F.col("text").alias("answer"),
        "role",
        "_carried",
    ).where("role = 'assistant' AND asked_by = 'user' AND NOT _carried")
    return C.columns_to_pair(asked, keep=["conv_id", "turn"])
