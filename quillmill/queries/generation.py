"""Generation queries: an assistant turn against the assistant turn before it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.functions.text import normalize_answer
from quillmill.operators import generation as G
from quillmill.operators.ranking import slices_with_carry
from quillmill.operators.sequences import word_ids
from quillmill.plans.evaluate import evaluate_generation
from quillmill.queries.registry import ORACLES, query, rounded, table

# An answer and the earlier answer of the same conversation.
ANSWERS = """
answers AS (SELECT conv_id, turn, text AS prediction, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference
            FROM conversations WHERE role = 'assistant'),
gens AS (SELECT conv_id || '-' || turn AS id, prediction, reference FROM answers WHERE reference IS NOT NULL)
"""


def generations(spark, sf):
    answers = table(spark, sf, "conversations").where(F.col("role") == "assistant").drop("role")
    w = Window.partitionBy("conv_id", "_slice").orderBy("turn")
    paired = slices_with_carry(answers, "conv_id", "turn", 1).withColumn("reference", F.lag("text").over(w))
    return paired.where(F.col("reference").isNotNull() & ~F.col("_carried")).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("prediction"), "reference"
    )


def normal(x: str) -> str:
    """The answer normalisation in SQL; the texts hold no word character glued to an article."""
    spaced = f"regexp_replace(lower({x}), '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])', '\\1' || chr(1), 'g')"
    ended = f"regexp_replace({spaced}, '([^\\p{{L}}\\p{{N}}\\p{{M}}_\\x01]|$)', chr(2) || '\\1', 'g')"
    gone = f"regexp_replace({ended}, '\\x01(a|an|the)\\x02', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({gone}, '[\\x01\\x02]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


NORMAL = f"{ANSWERS}, normal AS (SELECT id, {normal('prediction')} AS p, {normal('reference')} AS r FROM gens)"


def overlap(rows: str, key: str = "id") -> str:
    """CTE ``common(id, o)``: multiset overlap of the lists ``a`` and ``b`` of ``rows``."""
    return f"""
left_n AS (SELECT {key}, g, count(*) AS k FROM (SELECT {key}, unnest(a) AS g FROM {rows}) GROUP BY ALL),
right_n AS (SELECT {key}, g, count(*) AS k FROM (SELECT {key}, unnest(b) AS g FROM {rows}) GROUP BY ALL),
common AS (SELECT {key}, sum(least(l.k, r.k)) AS o FROM left_n l JOIN right_n r USING ({key}, g) GROUP BY {key})
"""


@query("normalize_answer", f"WITH {NORMAL} SELECT id, p AS answer FROM normal")
def _normalize(spark, sf):
    return generations(spark, sf).select("id", normalize_answer(F.col("prediction")).alias("answer"))


@query(
    "exact_match",
    f"WITH {NORMAL} SELECT round(avg(CASE WHEN p = r THEN 1.0::DOUBLE ELSE 0 END), 9) AS exact_match, count(*) AS pairs FROM normal",
)
def _exact(spark, sf):
    matched = G.exact_match(F.col("prediction"), F.col("reference"))
    return rounded(
        generations(spark, sf).agg(F.avg(matched).alias("exact_match"), F.count(F.lit(1)).alias("pairs")), "exact_match"
    )


@query(
    "token_f1",
    f"""WITH {NORMAL}, lists AS (SELECT id, list_filter(string_split(p, ' '), lambda w: w <> '') AS a,
  list_filter(string_split(r, ' '), lambda w: w <> '') AS b FROM normal), {overlap('lists')}
SELECT id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN o IS NULL THEN 0
  ELSE 2 * o / (len(a) + len(b)) END, 9) AS token_f1 FROM lists LEFT JOIN common USING (id)""",
)
def _token_f1(spark, sf):
    f1 = G.token_f1(F.col("prediction"), F.col("reference"))
    return rounded(generations(spark, sf).select("id", f1.alias("token_f1")), "token_f1")


@query("perplexity", "SELECT event_id, round(exp(value / 100), 6) AS perplexity FROM events")
def _perplexity(spark, sf):
    return rounded(
        table(spark, sf, "events").select("event_id", G.perplexity(F.col("value") / 100).alias("perplexity")),
        "perplexity",
        places=6,
    )


IDS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda w: CAST(('0x' || left(md5(w), 7))::BIGINT % {1} AS INT))"


@query(
    "token_accuracy",
    f"""WITH {ANSWERS}, ids AS (SELECT id, {IDS.format('prediction', 64)} AS g, {IDS.format('reference', 64)} AS t FROM gens),
cut AS (SELECT id, g[1:len(g) - 1] AS g, t[2:] AS t FROM ids),
z AS (SELECT id, unnest(g) AS g, unnest(list_transform(t, lambda v: CASE WHEN v % 5 = 0 THEN -100 ELSE v END)) AS t FROM cut)
SELECT count(*) FILTER (WHERE t <> -100) AS token_count,
  round(avg(CASE WHEN g = t THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE t <> -100), 9) AS token_accuracy FROM z""",
)
def _token_accuracy(spark, sf):
    hidden = F.transform(
        word_ids(F.col("reference"), 64), lambda v: F.when(v % 5 == 0, F.lit(G.IGNORED)).otherwise(v)
    )
    counted = generations(spark, sf).select(
        G.token_accuracy(word_ids(F.col("prediction"), 64), hidden, shifted=True).alias("c")
    )
    hits, tokens = F.sum("c.hits"), F.sum("c.tokens")
    return rounded(
        counted.agg(tokens.alias("token_count"), (hits / F.nullif(tokens, F.lit(0))).alias("token_accuracy")),
        "token_accuracy",
    )


ROUGE_LISTS = f"""
{ANSWERS},
w AS (SELECT id,
  list_filter(string_split(trim(regexp_replace(lower(prediction), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS p,
  list_filter(string_split(trim(regexp_replace(lower(reference), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS r FROM gens),
grams AS (SELECT id, n, CASE WHEN n = 1 THEN p ELSE list_transform(range(1, len(p)), lambda i: p[i] || chr(1) || p[i + 1]) END AS a,
  CASE WHEN n = 1 THEN r ELSE list_transform(range(1, len(r)), lambda i: r[i] || chr(1) || r[i + 1]) END AS b
  FROM w, (VALUES (1), (2)) o(n))
"""


@query(
    "rouge",
    f"""WITH {ROUGE_LISTS}, {overlap('grams', 'id, n')},
f AS (SELECT id, n, CASE WHEN o IS NULL THEN 0 ELSE 2 * o / (len(a) + len(b)) END AS f FROM grams LEFT JOIN common USING (id, n))
SELECT round(avg(f) FILTER (WHERE n = 1), 4) AS rouge1, round(avg(f) FILTER (WHERE n = 2), 4) AS rouge2 FROM f""",
)
def _rouge(spark, sf):
    scored = G.rouge_scores(generations(spark, sf))
    return scored.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("rouge1", "rouge2")])


REPLICATES = 1000
_FACTORS = ", ".join(f"({a}, {b})" for a, b in G.replicate_factors(REPLICATES, 42))


@query(
    "rouge_bootstrap",
    f"""WITH {ROUGE_LISTS}, {overlap('grams', 'id, n')},
f AS (SELECT id, max(f) FILTER (WHERE n = 1) AS rouge1, max(f) FILTER (WHERE n = 2) AS rouge2 FROM (
  SELECT id, n, CASE WHEN o IS NULL THEN 0 ELSE 2 * o / (len(a) + len(b)) END AS f FROM grams LEFT JOIN common USING (id, n)) GROUP BY id),
keyed AS (SELECT *, ('0x' || left(md5(id), 8))::BIGINT % {G.PRIME} AS h FROM f),
drawn AS (SELECT r, rouge1, rouge2, len(list_filter({G.poisson_steps()}::DOUBLE[], lambda s: s <= u)) AS w
  FROM (SELECT *, ((a * h + b) % {G.PRIME}) / {G.PRIME}::DOUBLE AS u FROM keyed, (SELECT row_number() OVER () AS r, a::BIGINT AS a, b::BIGINT AS b FROM (VALUES {_FACTORS}) t(a, b)))),
means AS (SELECT r, sum(w * rouge1) / sum(w) AS rouge1, sum(w * rouge2) / sum(w) AS rouge2 FROM drawn GROUP BY r),
long AS (SELECT unnest(['rouge1', 'rouge2']) AS metric, unnest([rouge1, rouge2]) AS v FROM means)
SELECT metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.5), 6) AS mid, round(quantile_cont(v, 0.975), 6) AS high,
  round(any_value(CASE metric WHEN 'rouge1' THEN (SELECT avg(rouge1) FROM f) ELSE (SELECT avg(rouge2) FROM f) END), 6) AS mean FROM long GROUP BY metric""",
)
def _rouge_bootstrap(spark, sf):
    scored = G.rouge_scores(generations(spark, sf))
    return rounded(G.bootstrap_means(scored, ["id"], ["rouge1", "rouge2"], REPLICATES), "low", "mid", "high", "mean", places=6)


@query(
    "rouge_l",
    f"""WITH {ROUGE_LISTS},
lcs AS (SELECT id, len(p) AS np, len(r) AS nr,
  list_reduce(list_transform(p, lambda t: {{'row': []::INT[], 'word': t}}),
    lambda up, cur: {{'row': list_reduce(
        list_transform(range(1, len(r) + 1), lambda j: {{'out': []::INT[], 'j': CAST(j AS INT)}}),
        lambda acc, x: {{'out': list_append(acc.out,
            CASE WHEN r[x.j] = cur.word THEN (CASE WHEN x.j > 1 THEN up.row[x.j - 1] ELSE 0 END) + 1
                 ELSE greatest(up.row[x.j], CASE WHEN x.j > 1 THEN acc.out[x.j - 1] ELSE 0 END) END), 'j': x.j}},
        {{'out': []::INT[], 'j': 0::INT}}).out, 'word': cur.word}},
    {{'row': list_transform(r, lambda v: 0::INT), 'word': ''}}).row AS last FROM w)
SELECT id, round(CASE WHEN coalesce(last[-1], 0) > 0 THEN 2 * last[-1] / (np + nr) ELSE 0 END, 9) AS "rougeL" FROM lcs""",
)
def _rouge_l(spark, sf):
    return rounded(G.rouge_scores(generations(spark, sf)).select("id", "rougeL"), "rougeL")


def bleu_words(x: str) -> str:
    plain = f"replace(replace({x}, '<skipped>', ''), '-' || chr(10), '')"
    for name, mark in (("quot", '"'), ("amp", "&"), ("lt", "<"), ("gt", ">")):
        plain = f"replace({plain}, '&{name};', '{mark}')"
    value = f"' ' || {plain} || ' '"
    for pattern, put in (
        (r"\s+", " "),
        (r"([\{-\~\[-\x60 -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        value = f"regexp_replace({value}, '{pattern}', '{put}', 'g')"
    return f"list_filter(string_split_regex({value}, '\\s+'), lambda w: w <> '')"


@query(
    "corpus_bleu",
    f"""WITH {ANSWERS}, w AS (SELECT id, {bleu_words('prediction')} AS p, {bleu_words('reference')} AS r FROM gens),
grams AS (SELECT id, n, list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i : i + n - 1], chr(1))) AS a,
  list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i : i + n - 1], chr(1))) AS b
  FROM w, (VALUES (1), (2), (3), (4)) o(n)), {overlap('grams', 'id, n')},
by_n AS (SELECT n, coalesce(sum(o), 0)::DOUBLE AS m, sum(len(a))::DOUBLE AS t FROM grams LEFT JOIN common USING (id, n) GROUP BY n),
missed AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS k FROM by_n),
lens AS (SELECT sum(len(p))::DOUBLE AS s, sum(len(r))::DOUBLE AS f FROM w)
SELECT round(any_value(CASE WHEN s >= f THEN 1.0 ELSE exp(1 - f / s) END) * 100
  * exp(sum(ln(CASE WHEN m > 0 THEN m ELSE 1 / pow(2, k) END / t)) / 4), 6) AS bleu FROM missed, lens""",
)
def _bleu(spark, sf):
    return rounded(G.corpus_bleu(generations(spark, sf)).select("bleu"), "bleu", places=6)


TRANSLATED = """
SELECT 'generation_sample_size' AS metric, count(*)::DOUBLE AS value, NULL::VARCHAR AS skipped FROM normal
UNION ALL SELECT 'exact_match', round(avg(CASE WHEN p = r THEN 1.0::DOUBLE ELSE 0 END), 9), NULL FROM normal
UNION ALL SELECT 'token_f1', round(avg(f), 9), NULL FROM f1
UNION ALL SELECT 'bleu', round(bleu, 2), NULL FROM bleu
UNION ALL SELECT unnest(['rouge1', 'rouge2', 'rougeL']), NULL, 'not_for_translation'
"""


@query(
    "evaluate_generation",
    f"""WITH {NORMAL}, lists AS (SELECT id, list_filter(string_split(p, ' '), lambda w: w <> '') AS a,
  list_filter(string_split(r, ' '), lambda w: w <> '') AS b FROM normal), {overlap('lists')},
f1 AS (SELECT CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN o IS NULL THEN 0 ELSE 2 * o / (len(a) + len(b)) END AS f
  FROM lists LEFT JOIN common USING (id)),
bleu AS ({ORACLES['corpus_bleu']}) {TRANSLATED}""",
)
def _evaluate(spark, sf):
    return rounded(evaluate_generation(generations(spark, sf), goal="Translate the answers"), "value")


@query("generation_sample", f"WITH {ANSWERS} SELECT * FROM gens ORDER BY id LIMIT 16")
def _sample(spark, sf):
    return G.generation_sample(generations(spark, sf), "id", 16)
