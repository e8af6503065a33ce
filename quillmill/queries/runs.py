"""Run queries: each user of the event table is one training run, each event one log line."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import detect, runs as R
from quillmill.queries.registry import query, rounded, table

LOGS = """
logs AS (SELECT user_id AS run_id, event_id AS seq, ts, CASE event_type
    WHEN 'error' THEN CASE WHEN value > 50 THEN 'CUDA out of memory at ' || event_id ELSE 'worker OOM killed at ' || event_id END
    WHEN 'signup' THEN CASE WHEN value > 60 THEN 'gradient is NaN at ' || event_id ELSE 'step ' || event_id || ' ok' END
    WHEN 'view' THEN printf('{''loss'': %.2f}', value) WHEN 'click' THEN printf('train_loss = %.2f', value)
    ELSE printf('eval_loss: %.2f', value) END AS msg FROM events)
"""
SIGNALS = f"""
{LOGS},
signals AS (SELECT run_id, seq, ts, left(msg, 120) AS head,
  regexp_matches(lower(msg), 'cuda out of memory|out of memory|\\boom\\b|cudaerroroutofmemory') AS oom,
  regexp_matches(lower(msg), '\\bnan\\b|loss.*nan|gradient.*nan|overflow') AS nan,
  TRY_CAST(nullif(regexp_extract(lower(msg), '[''"]?(?:train_)?loss[''"]?\\s*[=:]\\s*([\\d.]+)', 1), '') AS DOUBLE) AS loss FROM logs)
""".replace("\\\\", "\\")
EVENTS = f"""
{SIGNALS},
found AS (SELECT run_id, bool_or(oom) AS oom_detected, bool_or(nan) AS nan_loss_detected,
  'OOM: ' || arg_min(head, seq) FILTER (WHERE oom) AS oom_event, 'NaN: ' || arg_min(head, seq) FILTER (WHERE nan) AS nan_event,
  count(loss) AS losses FROM signals GROUP BY run_id)
"""
TRENDS = f"""
{EVENTS},
ranked AS (SELECT run_id, loss, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS r, count(*) OVER (PARTITION BY run_id) AS n
           FROM signals WHERE loss IS NOT NULL),
halves AS (SELECT run_id, count(*) AS losses, avg(loss) FILTER (WHERE r <= n // 2) AS first_half, avg(loss) FILTER (WHERE r > n // 2) AS second_half
           FROM ranked GROUP BY run_id),
trends AS (SELECT *, CASE WHEN losses < 4 THEN 'unknown' WHEN second_half - first_half < -0.05 THEN 'improving'
           WHEN second_half - first_half > 0.10 THEN 'diverging' ELSE 'stable' END AS trend FROM halves)
"""
FINALS = f"""
{TRENDS},
finals AS (SELECT user_id AS run_id, avg(value) FILTER (WHERE event_type = 'purchase') AS eval_loss,
  avg(value) FILTER (WHERE event_type = 'click') AS train_loss FROM events GROUP BY user_id)
"""
HEALTH = f"""
{FINALS},
health AS (SELECT run_id, 'success' AS status, coalesce(oom_detected, FALSE) AS oom_detected, coalesce(nan_loss_detected, FALSE) AS nan_loss_detected,
  round(coalesce(nullif(eval_loss, 0), train_loss), 6) AS final_loss, coalesce(trend, 'unknown') AS loss_trend,
  concat_ws('; ', oom_event, nan_event) AS events
  FROM finals LEFT JOIN found USING (run_id) LEFT JOIN trends USING (run_id))
"""
RUNS = """
runs AS (SELECT user_id AS run_id, exp(avg(value) / 15) AS perplexity, count(*) FILTER (WHERE event_type = 'view') / count(*) * 2.99713137::DOUBLE AS token_accuracy,
  count(*) FILTER (WHERE event_type <> 'error') / count(*) * 0.79937193::DOUBLE AS accuracy,
  CASE WHEN user_id % 3 = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (WHERE event_type <> 'view') / count(*) * 0.69971719::DOUBLE END AS f1,
  CASE WHEN user_id % 5 <> 0 THEN count(*) FILTER (WHERE event_type <> 'click') / count(*) * 0.59893131::DOUBLE END AS macro_f1,
  user_id % 2 = 0 AS generated_qa, count(*) AS train_rows, count(*) * 3 AS num_images, user_id % 9 + 2 AS num_classes
  FROM events GROUP BY user_id)
"""
JOIN = "array_to_string(list_filter([{0}], lambda x: x IS NOT NULL), ',')"


def when(*pairs: tuple[str, str]) -> str:
    return JOIN.format(", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs))


TEXT_VERDICT = f"""
{RUNS},
flags AS (SELECT *, perplexity > 50 AS high, perplexity > 20 AND perplexity <= 50 AS mid, coalesce(token_accuracy < 0.5, FALSE) AS low, train_rows < 100 AS few FROM runs),
verdicts AS (SELECT run_id, CASE WHEN high THEN 'suggest_retrain' WHEN mid OR low THEN 'warn' ELSE 'pass' END AS verdict,
  greatest(0, 100.0::DOUBLE - CASE WHEN high THEN 40 WHEN mid THEN 20 ELSE 0 END - CASE WHEN low THEN 15 ELSE 0 END
    - CASE WHEN generated_qa THEN 10 ELSE 0 END - CASE WHEN few THEN 15 ELSE 0 END)::DOUBLE AS score,
  {when(('high', 'high_perplexity'), ('mid', 'moderate_perplexity'), ('low', 'low_token_accuracy'), ('few', 'few_training_rows'))} AS issues,
  high AS retrain_suggested,
  {when(('high', 'train_longer'), ('high', 'check_pairs'), ('mid', 'add_diverse_examples'), ('low', 'align_questions_and_answers'), ('generated_qa', 'replace_generated_pairs'))} AS recommendations
  FROM flags)
"""


def log_lines(events):
    value = F.col("value")
    at = F.col("event_id").cast("string")
    msg = (
        F.when(
            F.col("event_type") == "error",
            F.concat(F.when(value > 50, "CUDA out of memory at ").otherwise("worker OOM killed at "), at),
        )
        .when(
            F.col("event_type") == "signup",
            F.when(value > 60, F.concat(F.lit("gradient is NaN at "), at)).otherwise(
                F.concat(F.lit("step "), at, F.lit(" ok"))
            ),
        )
        .when(F.col("event_type") == "view", F.format_string("{'loss': %.2f}", value))
        .when(F.col("event_type") == "click", F.format_string("train_loss = %.2f", value))
        .otherwise(F.format_string("eval_loss: %.2f", value))
    )
    return events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", msg.alias("msg")
    )


def logs(spark, sf):
    return log_lines(table(spark, sf, "events"))


def finals(spark, sf):
    def mean(kind: str):
        return F.avg(F.when(F.col("event_type") == kind, F.col("value")))

    events = table(spark, sf, "events")
    return events.groupBy(F.col("user_id").alias("run_id")).agg(
        mean("purchase").alias("eval_loss"), mean("click").alias("train_loss")
    )


def run_table(spark, sf):
    kind, n, user = F.col("event_type"), F.count(F.lit(1)), F.col("run_id")

    def share(hit, scale: float):
        return F.count_if(hit) / n * scale

    runs = table(spark, sf, "events").withColumn("run_id", F.col("user_id")).groupBy("run_id").agg(
        F.exp(F.avg("value") / 15).alias("perplexity"),
        share(kind == "view", 2.99713137).alias("token_accuracy"),
        share(kind != "error", 0.79937193).alias("accuracy"),
        share(kind != "view", 0.69971719).alias("f1"),
        share(kind != "click", 0.59893131).alias("macro_f1"),
        n.alias("train_rows"),
    )
    return runs.withColumns(
        {
            "f1": F.when(user % 3 == 0, 0.0).otherwise(F.col("f1")),
            "macro_f1": F.when(user % 5 != 0, F.col("macro_f1")),
            "generated_qa": user % 2 == 0,
            "num_images": F.col("train_rows") * 3,
            "num_classes": user % 9 + 2,
        }
    )


def joined(df, *columns: str):
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@query("log_events", f"WITH {EVENTS} SELECT * FROM found")
def _events(spark, sf):
    return R.extract_log_events(logs(spark, sf))


@query(
    "loss_trend",
    f"WITH {TRENDS} SELECT run_id, losses, round(first_half, 6) AS first_half, round(second_half, 6) AS second_half, trend FROM trends",
)
def _trend(spark, sf):
    return rounded(R.loss_trend(logs(spark, sf)), "first_half", "second_half", places=6)


def health(spark, sf):
    found = R.training_health(logs(spark, sf), finals(spark, sf))
    return rounded(found, "final_loss", places=6)


@query("training_health", f"WITH {HEALTH} SELECT * FROM health")
def _health(spark, sf):
    return health(spark, sf).withColumn("events", F.array_join("events", "; "))


@query("text_verdict", f"WITH {TEXT_VERDICT} SELECT * FROM verdicts")
def _text_verdict(spark, sf):
    return joined(R.text_verdict(run_table(spark, sf)), "issues", "recommendations")


@query(
    "image_verdict",
    f"""WITH {RUNS},
flags AS (SELECT *, accuracy < 0.55 AS bad, accuracy >= 0.55 AND accuracy < 0.7 AS fair,
  coalesce(coalesce(nullif(f1, 0), macro_f1) < 0.5, FALSE) AS low, num_images < 200 AS few, num_classes > 5 AS many FROM runs)
SELECT run_id, CASE WHEN bad THEN 'suggest_retrain' WHEN fair THEN 'warn' ELSE 'pass' END AS verdict,
  greatest(0, 100.0::DOUBLE - CASE WHEN bad THEN 45 WHEN fair THEN 20 ELSE 0 END - CASE WHEN low THEN 15 ELSE 0 END - CASE WHEN few THEN 20 ELSE 0 END)::DOUBLE AS score,
  {when(('bad', 'low_accuracy'), ('fair', 'moderate_accuracy'), ('low', 'low_f1'), ('few', 'small_dataset'))} AS issues, bad AS retrain_suggested,
  {when(('bad', 'collect_images'), ('bad AND many', 'merge_classes'), ('fair', 'add_diverse_images'), ('low', 'balance_classes'), ('few', 'collect_100_per_class'))} AS recommendations
FROM flags""",
)
def _image_verdict(spark, sf):
    return joined(R.image_verdict(run_table(spark, sf)), "issues", "recommendations")


LONG = ["accuracy", "f1", "macro_f1", "perplexity", "token_accuracy", "train_rows"]
LONG_SQL = f"""
{RUNS},
long AS (SELECT run_id, CASE WHEN generated_qa THEN 'text_qa' ELSE 'image_classification' END AS task,
  unnest([{', '.join(f"'{m}'" for m in LONG)}]) AS metric, unnest([{', '.join(f'{m}::DOUBLE' for m in LONG)}]) AS value FROM runs)
"""


@query(
    "key_metrics",
    f"""WITH {LONG_SQL} SELECT run_id, task, metric, round(value, 6) AS value FROM long WHERE CASE WHEN task = 'text_qa' THEN metric IN ('eval_loss', 'perplexity', 'token_accuracy')
ELSE metric IN ('accuracy', 'f1', 'macro_f1', 'weighted_f1', 'precision', 'recall') END""",
)
def _key(spark, sf):
    task = F.when(F.col("generated_qa"), "text_qa").otherwise("image_classification").alias("task")
    wide = run_table(spark, sf).select("run_id", task, *[F.col(m).cast("double").alias(m) for m in LONG])
    return rounded(R.key_metrics(wide.unpivot(["run_id", "task"], LONG, "metric", "value")), "value", places=6)


@query(
    "unpivot_metrics",
    f"""WITH {LONG_SQL} SELECT run_id, metric,
  CASE metric WHEN 'accuracy' THEN 'Accuracy' WHEN 'f1' THEN 'F1 Score' WHEN 'macro_f1' THEN 'Macro F1' WHEN 'perplexity' THEN 'Perplexity'
    WHEN 'token_accuracy' THEN 'Token Accuracy' ELSE 'Train Rows' END AS label,
  CASE WHEN metric IN ('accuracy', 'f1', 'token_accuracy') THEN 'Quality' WHEN metric = 'perplexity' THEN 'Loss & Perplexity' ELSE 'Other' END AS metric_group,
  CASE WHEN metric IN ('accuracy', 'f1', 'token_accuracy') THEN 'percent' WHEN metric = 'perplexity' THEN 'float' ELSE 'raw' END AS kind,
  round(value, 6) AS value, CASE WHEN value IS NULL THEN '—' WHEN metric IN ('accuracy', 'f1', 'token_accuracy') THEN printf('%.2f%%', value * 100)
    WHEN metric = 'train_rows' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE printf('%.4f', value) END AS display FROM long""",
)
def _unpivot(spark, sf):
    return rounded(R.unpivot_metrics(run_table(spark, sf), ["run_id"], LONG), "value", places=6)


ATTEMPTS = f"""
{TEXT_VERDICT},
attempts AS (SELECT run_id // 3 AS original_id, run_id % 3 AS attempt, verdict,
   CASE verdict WHEN 'pass' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS rank FROM verdicts),
originals AS (SELECT original_id, rank, verdict FROM attempts WHERE attempt = 0),
better AS (SELECT a.original_id, min(a.attempt) AS attempt FROM attempts a JOIN originals o USING (original_id)
           WHERE a.attempt > 0 AND a.rank > o.rank GROUP BY ALL)
"""


@query(
    "best_attempt",
    f"""WITH {ATTEMPTS} SELECT o.original_id, coalesce(b.attempt, 0) AS best_attempt, coalesce(a.verdict, o.verdict) AS best_verdict
FROM originals o LEFT JOIN better b USING (original_id) LEFT JOIN attempts a ON a.original_id = o.original_id AND a.attempt = b.attempt""",
)
def _best(spark, sf):
    verdicts = R.text_verdict(run_table(spark, sf))
    attempts = verdicts.select(
        F.expr("run_id div 3").alias("original_id"), (F.col("run_id") % 3).alias("attempt"), "verdict"
    )
    return R.best_attempt(attempts)


@query(
    "run_diagnostics",
    f"""WITH {TEXT_VERDICT}, {HEALTH.strip().lstrip(',')}
SELECT r.run_id, r.train_rows, r.generated_qa, CASE WHEN r.generated_qa THEN 'small' ELSE 'base' END AS chosen,
  CASE WHEN r.train_rows < 100 THEN 'few_training_rows' ELSE '' END AS plan_warnings,
  CASE WHEN r.train_rows < 100 THEN 'epochs,' ELSE '' END || 'max_length' AS overrides_applied,
  h.status, h.oom_detected, h.nan_loss_detected, h.final_loss, h.loss_trend, h.events,
  v.verdict, v.score, v.issues, v.retrain_suggested, v.recommendations
FROM runs r LEFT JOIN health h USING (run_id) LEFT JOIN verdicts v USING (run_id)""",
)
def _diagnostics(spark, sf):
    """The JSON record is read back so that all of its fields can be compared."""
    runs, few = run_table(spark, sf), F.col("train_rows") < 100
    records = R.run_diagnostics(
        runs.select("run_id", "train_rows", "generated_qa"),
        health(spark, sf),
        R.text_verdict(runs),
        plans=runs.select("run_id", F.when(F.col("generated_qa"), "small").otherwise("base").alias("chosen")),
        optimization=runs.select(
            "run_id",
            F.when(few, F.array(F.lit("few_training_rows"))).otherwise(F.array()).alias("plan_warnings"),
            F.when(few, F.array(F.lit("epochs"), F.lit("max_length")))
            .otherwise(F.array(F.lit("max_length")))
            .alias("overrides_applied"),
        ),
    )
    parsed = F.from_json(
        "diagnostics",
        "data struct<train_rows:bigint,generated_qa:boolean>, model struct<chosen:string>, "
        "optimization struct<plan_warnings:array<string>,overrides_applied:array<string>>, "
        "training struct<status:string,oom_detected:boolean,nan_loss_detected:boolean,final_loss:double,"
        "loss_trend:string,events:array<string>>, "
        "evaluation struct<verdict:string,score:double,issues:array<string>,retrain_suggested:boolean,"
        "recommendations:array<string>>",
    )
    fields = records.select("run_id", parsed.alias("d")).select("run_id", "d.*")
    found = fields.select("run_id", "data.*", "model.*", "optimization.*", "training.*", "evaluation.*")
    found = found.withColumn("events", F.array_join("events", "; "))
    return joined(found, "plan_warnings", "overrides_applied", "issues", "recommendations")


# One catalog item per brand and type of part: its number does not grow with the table.
CATALOG = """
catalog AS (SELECT p_brand || '/' || p_type AS id, min(p_size)::DOUBLE AS need, max(p_retailprice) AS size,
   row_number() OVER (ORDER BY p_brand || '/' || p_type) AS position, min(p_size) <= 1 AS cpu_ok FROM part GROUP BY p_brand, p_type),
requests AS (SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'low_gpu' WHEN 2 THEN 'mid_gpu' ELSE 'high_gpu' END AS tier,
   c_acctbal / 2000 AS capacity, CASE c_mktsegment WHEN 'MACHINERY' THEN 'performance' WHEN 'FURNITURE' THEN 'memory' ELSE 'balanced' END AS objective,
   CASE WHEN c_custkey % 50 = 7 THEN 'own/' || c_custkey END AS override FROM customer)
"""


@query(
    "best_fit_match",
    f"""WITH {CATALOG},
fits AS (SELECT request_id, tier, objective, id, size, position FROM requests JOIN catalog ON CASE WHEN tier = 'cpu' THEN cpu_ok ELSE need <= capacity END),
numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY size, position) AS up,
   row_number() OVER (PARTITION BY request_id ORDER BY size DESC, position) AS down, count(*) OVER (PARTITION BY request_id) AS n FROM fits),
picked AS (SELECT request_id, id FROM numbered WHERE CASE WHEN objective = 'performance' AND tier IN ('mid_gpu', 'high_gpu') THEN down = 1
   WHEN objective = 'memory' THEN up = 1 ELSE up = n // 2 + 1 END)
SELECT request_id, coalesce(override, id, (SELECT id FROM catalog ORDER BY position LIMIT 1)) AS choice FROM requests LEFT JOIN picked USING (request_id)""",
)
def _match(spark, sf):
    from pyspark.sql import Window

    name = F.concat_ws("/", "p_brand", "p_type")
    items = table(spark, sf, "part").groupBy(name.alias("id")).agg(
        F.min("p_size").cast("double").alias("need"), F.max("p_retailprice").alias("size")
    )
    # A few rows per brand; the catalog's order is by name.
    catalog = items.select(
        "id", "need", "size", F.row_number().over(Window.orderBy("id")).alias("position"), (F.col("need") <= 1).alias("cpu_ok")
    )
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    tiers = F.array(*[F.lit(t) for t in ("cpu", "low_gpu", "mid_gpu", "high_gpu")])
    requests = table(spark, sf, "customer").select(
        key.alias("request_id"),
        F.get(tiers, (key % 4).cast("int")).alias("tier"),
        (F.col("c_acctbal") / 2000).alias("capacity"),
        F.when(segment == "MACHINERY", "performance").when(segment == "FURNITURE", "memory").otherwise("balanced").alias("objective"),
        F.when(key % 50 == 7, F.concat(F.lit("own/"), key.cast("string"))).alias("override"),
    )
    return R.best_fit_match(requests, catalog).select("request_id", "choice")


@query(
    "best_fit_match_large",
    """WITH catalog AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_size + p_partkey / 1000000.0::DOUBLE AS need, p_retailprice AS size, p_partkey AS position, p_size <= 2 AS cpu_ok FROM part),
requests AS (SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'low_gpu' WHEN 2 THEN 'mid_gpu' ELSE 'high_gpu' END AS tier,
   c_acctbal / 200 AS capacity, CASE c_mktsegment WHEN 'MACHINERY' THEN 'performance' WHEN 'FURNITURE' THEN 'memory' ELSE 'balanced' END AS objective FROM customer),
fits AS (SELECT request_id, tier, objective, id, size, position FROM requests JOIN catalog ON CASE WHEN tier = 'cpu' THEN cpu_ok ELSE need <= capacity END),
numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY size, position) AS up,
   row_number() OVER (PARTITION BY request_id ORDER BY size DESC, position) AS down, count(*) OVER (PARTITION BY request_id) AS n FROM fits),
picked AS (SELECT request_id, id FROM numbered WHERE CASE WHEN objective = 'performance' AND tier IN ('mid_gpu', 'high_gpu') THEN down = 1
   WHEN objective = 'memory' THEN up = 1 ELSE up = n // 2 + 1 END)
SELECT request_id, coalesce(id, (SELECT id FROM catalog ORDER BY position LIMIT 1)) AS choice FROM requests LEFT JOIN picked USING (request_id)""",
)
def _match_every_part(spark, sf):
    """Every part is an item with a level of its own."""
    key = F.col("p_partkey")
    need = F.col("p_size") + key / F.lit(1e6)
    catalog = table(spark, sf, "part").select(
        key.cast("string").alias("id"), need.alias("need"), F.col("p_retailprice").alias("size"), key.alias("position"),
        (F.col("p_size") <= 2).alias("cpu_ok"),
    )
    customer, segment = F.col("c_custkey"), F.col("c_mktsegment")
    tiers = F.array(*[F.lit(t) for t in ("cpu", "low_gpu", "mid_gpu", "high_gpu")])
    requests = table(spark, sf, "customer").select(
        customer.alias("request_id"),
        F.get(tiers, (customer % 4).cast("int")).alias("tier"),
        (F.col("c_acctbal") / 200).alias("capacity"),
        F.when(segment == "MACHINERY", "performance").when(segment == "FURNITURE", "memory").otherwise("balanced").alias("objective"),
        F.lit(None).cast("string").alias("override"),
    )
    return R.best_fit_match(requests, catalog, small_rows=0).select("request_id", "choice")


GOALS = """CASE doc_id % 6 WHEN 0 THEN 'Translate ' WHEN 1 THEN 'Résumé of ' WHEN 2 THEN 'Sentiment in ' WHEN 3 THEN 'Label the abstract ' ELSE 'Answer about ' END || source || ' ' || lang"""


@query(
    "tag_task_subtype",
    f"""SELECT doc_id, CASE WHEN regexp_matches(lower({GOALS}), 'translat|tradui|traduire') THEN 'translation'
WHEN regexp_matches(lower({GOALS}), 'summar|résumé|abstract|condensed') THEN 'summarization'
WHEN regexp_matches(lower({GOALS}), 'classif|sentiment|categor|label|intent') THEN 'classification' ELSE 'generative_qa' END AS subtype FROM documents""",
)
def _subtype(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(GOALS).alias("goal"))
    return docs.select("doc_id", detect.tag_task_subtype(F.col("goal")).alias("subtype"))
