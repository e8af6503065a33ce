"""Dialog, sequence, scoring and training-head queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions.text import PREAMBLE, clip_text, strip_preamble
from quillmill.operators import classification as M
from quillmill.operators import dialog as D
from quillmill.operators import sequences as S
from quillmill.operators.corpus import turns_to_pair
from quillmill.operators.heads import apply_two_layer_head, train_two_layer_head
from quillmill.operators.packing import pack_whole_table
from quillmill.queries.corpus import SAID
from quillmill.queries.generation import IDS
from quillmill.queries.registry import query, rounded, table
from quillmill.session import materialize

SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def clip(x: str, limit: int) -> str:
    tidy = SQUEEZE.format(x)
    return f"CASE WHEN length({tidy}) <= {limit} THEN {tidy} ELSE rtrim(left({tidy}, {limit - 1})) || '…' END"


CONTEXT = f"""
spoken AS (SELECT conv_id, turn, role, text, {clip('text', 600)} AS clipped,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o
           FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''),
near AS (SELECT t.conv_id, t.turn, h.o, h.role, h.clipped,
                sum(length(h.clipped)) OVER (PARTITION BY t.conv_id, t.turn ORDER BY h.o DESC) AS used
         FROM spoken t JOIN spoken h ON h.conv_id = t.conv_id AND h.o BETWEEN t.o - 6 AND t.o - 1 WHERE t.role = 'user'),
kept AS (SELECT * FROM near WHERE used <= 2000),
lines AS (SELECT conv_id, turn, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || clipped, chr(10) ORDER BY o) AS said
          FROM kept GROUP BY ALL),
blocks AS (SELECT conv_id, turn, CASE WHEN said IS NULL THEN text ELSE 'Conversation so far:' || chr(10) || said || chr(10) || chr(10)
   || 'Using the conversation above for context, answer this question:' || chr(10) || text END AS block
   FROM spoken LEFT JOIN lines USING (conv_id, turn) WHERE role = 'user')
"""
SYSTEM = D.SYSTEM_PROMPT.replace("'", "''")


def contexts(spark, sf):
    return D.recent_turns(table(spark, sf, "conversations"))


def blocks(spark, sf):
    return contexts(spark, sf).select(
        "conv_id", "turn", D.question_block(F.col("prompt"), F.col("history")).alias("block")
    )


@query("clip_text", f"SELECT conv_id, turn, {clip('text', 120)} AS clipped FROM conversations")
def _clip(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", clip_text(F.col("text"), 120).alias("clipped"))


@query("recent_turns", f"WITH {CONTEXT} SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) AS INT) AS place, role, clipped AS content FROM kept")
def _recent(spark, sf):
    listed = contexts(spark, sf).select("conv_id", "turn", F.posexplode("history").alias("at", "t"))
    return listed.select("conv_id", "turn", (F.col("at") + 1).alias("place"), "t.role", "t.content")


@query("question_block", f"WITH {CONTEXT} SELECT * FROM blocks")
def _block(spark, sf):
    return blocks(spark, sf)


@query(
    "chat_prompt",
    f"""WITH {CONTEXT} SELECT conv_id, turn, '### Instruction:' || chr(10) || '{SYSTEM}' || chr(10) || chr(10) || block
|| chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM blocks""",
)
def _prompt(spark, sf):
    return blocks(spark, sf).select("conv_id", "turn", D.chat_prompt(F.col("block")).alias("prompt"))


# Answers with and without an opener, by turn number.
OPENED = """CASE turn % 4 WHEN 0 THEN 'Sure! ' || text WHEN 1 THEN 'Of course, here''s the answer to your question: ' || text
WHEN 2 THEN 'Okay.' ELSE text END"""
OPENER = "(?i)" + PREAMBLE.replace("'", "''")
CUT = r"regexp_replace(regexp_replace(answer, '{}', ''), '^\s+|\s+$', '', 'g')".format(OPENER)


@query(
    "strip_preamble",
    f"WITH a AS (SELECT conv_id, turn, {OPENED} AS answer FROM conversations) SELECT conv_id, turn, CASE WHEN {CUT} = '' THEN answer ELSE {CUT} END AS answer FROM a",
)
def _strip(spark, sf):
    answers = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(OPENED.replace("''", "\\'")).alias("answer"))
    return answers.withColumn("answer", strip_preamble(F.col("answer")))


# ---- sequences ----------------------------------------------------------------------------

PAIRED = f"{SAID}, asked_told AS (SELECT * FROM turn_pairs WHERE instruction IS NOT NULL AND output IS NOT NULL)"
TEMPLATE_SQL = "'### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10)"
CODED = f"""
{PAIRED},
rendered AS (SELECT conv_id, {TEMPLATE_SQL} AS prompt, {TEMPLATE_SQL} || output || '</s>' AS full_text FROM asked_told),
ids AS (SELECT conv_id, {IDS.format('full_text', 65536)}[1:384] AS ids, least(len({IDS.format('prompt', 65536)}), 384) AS masked FROM rendered),
opens AS (SELECT conv_id, ids, CASE WHEN masked >= len(ids) THEN len(ids) - greatest(1, least(32, len(ids) // 4)) ELSE masked END AS start FROM ids),
coded AS (SELECT conv_id, ids, list_transform(ids, lambda v, i: CASE WHEN i <= start THEN -100 ELSE v END) AS labels FROM opens)
"""


def chat_pairs(spark, sf):
    return turns_to_pair(table(spark, sf, "conversations"))


def coded(spark, sf):
    return S.tokenize_and_mask(chat_pairs(spark, sf), max_length=384, eos="</s>")


@query("render_chat", f"WITH {PAIRED} SELECT conv_id, {TEMPLATE_SQL} AS prompt, {TEMPLATE_SQL} || output || '</s>' AS full_text FROM asked_told")
def _render(spark, sf):
    prompt, full = S.render_chat(F.col("instruction"), F.col("output"), eos="</s>")
    return chat_pairs(spark, sf).select("conv_id", prompt.alias("prompt"), full.alias("full_text"))


def _joined(name: str):
    return F.array_join(name, ",").alias(name)


@query(
    "tokenize_and_mask",
    f"""WITH {CODED} SELECT conv_id, array_to_string(ids, ',') AS input_ids,
array_to_string(list_transform(ids, lambda v: 1), ',') AS attention_mask, array_to_string(labels, ',') AS labels FROM coded""",
)
def _tokenize(spark, sf):
    return coded(spark, sf).select("conv_id", *[_joined(c) for c in S.TOKEN_COLUMNS])


# A shard for this many conversations, so that their number follows the table.
SHARD_ROWS = 64


@query(
    "pack_sequences",
    f"""WITH {CODED},
lens AS (SELECT conv_id, CAST(('0x' || left(md5(conv_id::VARCHAR), 7))::BIGINT % (SELECT greatest(1, count(*) // {SHARD_ROWS}) FROM coded) AS INT) AS shard, len(ids) AS n, ids, labels FROM coded),
folded AS (SELECT shard, list_reduce(list(DISTINCT {{'at': conv_id, 'n': n, 'block': 0, 'used': 0, 'out': []::BIGINT[]}} ORDER BY {{'at': conv_id, 'n': n, 'block': 0, 'used': 0, 'out': []::BIGINT[]}}),
  lambda a, x: CASE WHEN a.used > 0 AND a.used + x.n > 384
     THEN {{'at': x.at, 'n': x.n, 'block': CASE WHEN x.n = 384 THEN a.block + 2 ELSE a.block + 1 END, 'used': CASE WHEN x.n = 384 THEN 0 ELSE x.n END, 'out': list_append(a.out, a.block + 1)}}
     ELSE {{'at': x.at, 'n': x.n, 'block': CASE WHEN a.used + x.n = 384 THEN a.block + 1 ELSE a.block END, 'used': CASE WHEN a.used + x.n = 384 THEN 0 ELSE a.used + x.n END, 'out': list_append(a.out, a.block)}} END,
  {{'at': -1::BIGINT, 'n': 0::BIGINT, 'block': 0, 'used': 0::BIGINT, 'out': []::BIGINT[]}}).out AS blocks,
  list(conv_id ORDER BY conv_id) AS convs FROM lens GROUP BY shard),
assigned AS (SELECT shard, unnest(blocks) AS block, unnest(convs) AS conv_id FROM folded)
SELECT shard, CAST(block AS INT) AS block, string_agg(array_to_string(ids, ','), ',' ORDER BY conv_id) AS input_ids,
  string_agg(array_to_string(labels, ','), ',' ORDER BY conv_id) AS labels FROM assigned JOIN lens USING (shard, conv_id) GROUP BY ALL""",
)
def _pack(spark, sf):
    rows = coded(spark, sf)
    packed = S.pack_sequences(rows, "conv_id", 384, shard_rows=SHARD_ROWS)
    return packed.select("shard", "block", _joined("input_ids"), _joined("labels"))


@query(
    "pack_whole_table",
    f"""WITH {CODED},
lens AS (SELECT conv_id, len(ids) AS n, ids, labels FROM coded),
folded AS (SELECT list_reduce(list(DISTINCT {{'at': conv_id, 'n': n, 'block': 0, 'used': 0, 'out': []::BIGINT[]}} ORDER BY {{'at': conv_id, 'n': n, 'block': 0, 'used': 0, 'out': []::BIGINT[]}}),
  lambda a, x: CASE WHEN a.used > 0 AND a.used + x.n > 384
     THEN {{'at': x.at, 'n': x.n, 'block': CASE WHEN x.n = 384 THEN a.block + 2 ELSE a.block + 1 END, 'used': CASE WHEN x.n = 384 THEN 0 ELSE x.n END, 'out': list_append(a.out, a.block + 1)}}
     ELSE {{'at': x.at, 'n': x.n, 'block': CASE WHEN a.used + x.n = 384 THEN a.block + 1 ELSE a.block END, 'used': CASE WHEN a.used + x.n = 384 THEN 0 ELSE a.used + x.n END, 'out': list_append(a.out, a.block)}} END,
  {{'at': -1::BIGINT, 'n': 0::BIGINT, 'block': 0, 'used': 0::BIGINT, 'out': []::BIGINT[]}}).out AS blocks,
  list(conv_id ORDER BY conv_id) AS convs FROM lens),
assigned AS (SELECT unnest(blocks) AS block, unnest(convs) AS conv_id FROM folded)
SELECT block, string_agg(array_to_string(ids, ','), ',' ORDER BY conv_id) AS input_ids,
  string_agg(array_to_string(labels, ','), ',' ORDER BY conv_id) AS labels FROM assigned JOIN lens USING (conv_id) GROUP BY ALL""",
)
def _pack_whole(spark, sf):
    packed = pack_whole_table(coded(spark, sf), "conv_id", 384, slice_rows=SHARD_ROWS)
    return packed.select("block", _joined("input_ids"), _joined("labels"))


# ---- models -------------------------------------------------------------------------------


def vectors(spark, sf):
    features = F.col("embedding").cast("array<double>").alias("features")
    return table(spark, sf, "embeddings").select("vec_id", features, F.col("label").alias("y"))


@query(
    "score_table",
    """WITH cells AS (SELECT vec_id, label AS y, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
centres AS (SELECT y AS label, i, avg(v) AS c FROM cells GROUP BY ALL),
far AS (SELECT vec_id, label, sqrt(sum((v - c) * (v - c))) AS d FROM cells JOIN centres USING (i) GROUP BY ALL)
SELECT vec_id, arg_min(label, d) AS predicted, round(min(d), 6) AS distance FROM far GROUP BY vec_id""",
)
def _score(spark, sf):
    rows = vectors(spark, sf)
    scored = D.score_table(rows, D.centroid_head(rows, label="y"), "vec_id long, predicted int, distance double")
    return rounded(scored, "distance", places=6)


@query(
    "train_head",
    """WITH sizes AS (SELECT label, count(*) AS rows FROM embeddings GROUP BY label),
want AS (SELECT CAST(ceil(0.15::DOUBLE * sum(rows)) AS BIGINT) AS want, CAST(sum(rows) AS BIGINT) AS total FROM sizes),
shares AS (SELECT label, rows, (want * rows) // total AS base, (want * rows) % total AS rest, want FROM sizes, want),
quotas AS (SELECT label, rows, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM shares)
SELECT label, CAST(rows - quota AS BIGINT) AS train_rows, CAST(quota AS BIGINT) AS test_rows,
  CAST(sum(quota) OVER () AS BIGINT) AS predictions FROM quotas""",
)
def _train(spark, sf):
    """Exact facts of a fit: rows per class on both sides, and predictions in the matrix. The labels
    of this table do not depend on its vectors, so there is no accuracy to compare; tests do."""
    split = materialize(S.stratified_split(vectors(spark, sf), "y", ["vec_id"]), "head-split")
    model = D.train_head(split.where(F.col("split") == "train"), label="y")
    scored = M.predict_labels(D.apply_head(model, split.where(F.col("split") == "test")))
    matrix = materialize(M.confusion_matrix(scored, model.numClasses, outside=True), "head-matrix")
    support = matrix.groupBy("actual").agg(F.sum("n").alias("test_rows"))
    total = matrix.agg(F.sum("n")).first()[0]
    learned = split.groupBy("y").agg(F.count_if(F.col("split") == "train").alias("train_rows"))
    return learned.join(support, F.col("y") == F.col("actual")).select(
        F.col("y").alias("label"), "train_rows", "test_rows", F.lit(total).cast("long").alias("predictions")
    )


RING = "embedding[1] * embedding[1] + embedding[2] * embedding[2] > 0.0218"


@query(
    "train_two_layer_head",
    f"SELECT CAST({RING} AS INT) AS label, count(*) AS rows, TRUE AS learned FROM (SELECT list_transform(embedding, lambda v: v::DOUBLE) AS embedding FROM embeddings) GROUP BY 1",
)
def _ring(spark, sf):
    """Labels that tell a ring from what it encloses: a class is learned if nine in ten of its rows are
    told right by the fitted head."""
    rows = vectors(spark, sf)
    inside = F.get("features", F.lit(0)) * F.get("features", F.lit(0)) + F.get("features", F.lit(1)) * F.get("features", F.lit(1))
    ringed = rows.select("features", (inside > 0.0218).cast("int").alias("label"))
    head = train_two_layer_head(ringed)
    told = apply_two_layer_head(head, ringed).withColumn("told", (F.get("scores", F.lit(1)) > 0.5).cast("int"))
    return told.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), (F.count_if(F.col("told") == F.col("label")) >= 0.9 * F.count(F.lit(1))).alias("learned")
    )
