"""Source, sink and streaming queries.

The given tables are Parquet, so each reader query first writes a table in the reader's format to a
fresh folder and reads it back; the SQL is the table itself.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.corpus import image_data_warnings
from quillmill.operators.detect import detect_task
from quillmill.plans.images import prepare_image_dataset
from quillmill.plans.prepare import prepare_text_dataset
from quillmill.queries.corpus import AUGMENTED, CLEAN, PAIRS, documents
from quillmill.queries.registry import query, rounded, table
from quillmill.queries.runs import SIGNALS, TRENDS, log_lines
from quillmill.session import scratch_path
from quillmill.sources import archives, images, readers, sinks
from quillmill.sources.storage import list_files, qualified
from quillmill.streaming.jobs import (
    arriving_pairs,
    incremental_prepare,
    keep_first_arrivals,
    log_health_stream,
    run_available,
)
from quillmill.streaming.monitor import monitor_runs, run_monitor

TURNS = "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in ("conv_id", "turn", "role", "text")])


@query("read_delimited", TURNS)
def _csv(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv_report(turns(spark, sf), path)
    return readers.read_delimited(spark, path, "csv")


@query("read_tab_separated", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    events = table(spark, sf, "events")
    # As text, since the writer would cut times to milliseconds.
    told = events.select(*[F.col(c).cast("string").alias(c) for c in events.columns])
    tabs = told.write.option("header", "true").option("sep", "\t").option("escape", '"')
    tabs.option("extension", "tab").csv(path)
    back = readers.read_delimited(spark, path, "tab")
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in events.schema])


@query("read_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def _jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    turns(spark, sf).write.json(path)
    return readers.read_jsonl(spark, path)


@query("read_json_documents", "SELECT conv_id, turn, role, text FROM conversations")
def _json(spark, sf):
    """One wrapped document per small part of the table: ``{"data": [row, ...]}``."""
    path = scratch_path(spark, "json")
    row = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    wrapped = (
        turns(spark, sf)
        .groupBy(F.expr("concat(conv_id div 16, '-', turn div 64)").alias("part"))
        .agg(F.concat(F.lit('{"data": ['), F.array_join(F.collect_list(row), ", "), F.lit("]}")).alias("value"))
    )
    wrapped.repartition("part").write.partitionBy("part").text(path)
    return readers.read_json_documents(spark, path).select("conv_id", "turn", "role", "text")


@query("read_delimited_blocks", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def _csv_blocks(spark, sf):
    """Texts with line breaks in their cells, read in blocks far smaller than the files."""
    path = scratch_path(spark, "csv")
    sinks.write_csv_report(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return readers.read_delimited(spark, path, "csv", block_bytes=1 << 18)


def json_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a partition as one document, ``{"data": [row, ...]}``, a line per row."""
    lead = '{"made": {"by": ["a", {"data": []}]}, "data": ['
    for batch in batches:
        rows = batch["row"].tolist()
        yield pd.DataFrame({"value": [lead + rows[0], *["," + row for row in rows[1:]]]})
        lead = ","
    yield pd.DataFrame({"value": ["]}" if lead == "," else lead + "]}"]})


@query("read_json_blocks", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _json_blocks(spark, sf):
    """One list per part file of the table, cut into its items by many tasks."""
    path = scratch_path(spark, "json")
    rows = table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("row"))
    rows.mapInPandas(json_document, "value string").write.text(path)
    return readers.read_json_documents(spark, path, block_bytes=1 << 18).select("doc_id", "text", "lang", "source", "n_chars")


BENCH_TEXT = CLEAN.format("text")


def text_folder(spark, sf) -> str:
    path = scratch_path(spark, "texts")
    table(spark, sf, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(path)
    return path


@query("read_text_documents", f"SELECT item_id, {BENCH_TEXT} AS text FROM benchmark")
def _texts(spark, sf):
    found = readers.read_text_documents(spark, text_folder(spark, sf))
    return found.select(F.regexp_extract("source", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "text")


@query("read_dataset_dir", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations UNION ALL SELECT NULL, NULL, 'page', url FROM pages")
def _dir(spark, sf):
    """A folder with comma and tab separated tables and text files, which are passed over."""
    path = scratch_path(spark, "mixed")
    sinks.write_csv_report(turns(spark, sf), f"{path}/turns")
    pages = table(spark, sf, "pages").select(F.lit("page").alias("role"), F.col("url").alias("text"))
    pages.write.option("header", "true").option("sep", "\t").option("extension", "tsv").csv(f"{path}/pages")
    table(spark, sf, "benchmark").select("text").write.text(f"{path}/notes")
    return as_text(readers.read_dataset_dir(spark, path))


@query("read_any", f"SELECT CAST(item_id AS BIGINT) AS item_id, {BENCH_TEXT} AS text FROM benchmark")
def _any(spark, sf):
    found = readers.read_any(spark, text_folder(spark, sf))
    return found.select(F.regexp_extract("source", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "text")


def zipped_pages(spark, sf, name: str = "pages/{0}.md") -> str:
    """One archive per 64 pages, written to the shared folder by the tasks that hold them.

    A member is named after its page's id and the id's remainder by 7."""
    path = scratch_path(spark, "zips")
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = FileSystem.from_uri(path)
        files.create_dir(folder)
        for batch in batches:
            for part, members in zip(batch["part"], batch["members"]):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                    for member in members:
                        page = member["page_id"]
                        archive.writestr(name.format(page, page % 7), member["html"])
                with files.open_output_stream(f"{folder}/part-{part}.zip") as out:
                    out.write(held.getvalue())
                yield pd.DataFrame({"part": [part]})

    parts = (
        table(spark, sf, "pages")
        .groupBy(F.expr("page_id div 64").alias("part"))
        .agg(F.collect_list(F.struct("page_id", "html")).alias("members"))
    )
    parts.mapInPandas(pack, "part long").count()
    return path


@query("read_zip_members", "SELECT page_id, page_id // 64 AS part, strlen(html) AS bytes FROM pages")
def _zip(spark, sf):
    members = readers.read_zip_members(spark, zipped_pages(spark, sf))
    return members.select(
        F.regexp_extract("member", r"(\d+)\.md$", 1).cast("long").alias("page_id"),
        F.regexp_extract("archive", r"part-(\d+)\.zip$", 1).cast("long").alias("part"),
        F.octet_length("content").cast("long").alias("bytes"),
    )


def page_of(path: str) -> tuple:
    return (
        F.regexp_extract(path, r"(\d+)\.md$", 1).cast("long").alias("page_id"),
        F.regexp_extract(path, r"part-(\d+)", 1).cast("long").alias("part"),
    )


@query(
    "read_zip_pieces",
    "SELECT page_id, page_id // 64 AS part, greatest(1, CAST(ceil(strlen(html) / 1000) AS BIGINT)) AS pieces, strlen(html) AS bytes FROM pages",
)
def _zip_pieces(spark, sf):
    pieces = archives.read_zip_pieces(archives.zip_index(spark, zipped_pages(spark, sf)), 1_000)
    sized = pieces.groupBy("archive", "member", "offset").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum(F.octet_length("content")).alias("bytes")
    )
    return sized.select(page_of("member")[0], page_of("archive")[1], "pieces", "bytes")


@query("extract_zip", "SELECT page_id, page_id // 64 AS part, strlen(html) AS bytes FROM pages")
def _extract(spark, sf):
    folder = qualified(spark, scratch_path(spark, "unzipped"))
    done = archives.extract_zip(archives.zip_index(spark, zipped_pages(spark, sf)), folder)
    return done.select(*page_of("path"), F.col("length").alias("bytes"))


@query("list_files", "SELECT page_id, page_id // 64 AS part, page_id % 7 AS kind, strlen(html) AS length FROM pages")
def _listing(spark, sf):
    """A tree of folders, as many as there are archives and kinds of pages in them."""
    folder = qualified(spark, scratch_path(spark, "unzipped"))
    archives.extract_zip(archives.zip_index(spark, zipped_pages(spark, sf, "kind_{1}/{0}.md")), folder)
    kind = F.regexp_extract("path", r"kind_(\d+)/", 1).cast("long").alias("kind")
    return list_files(spark, folder, folders_per_task=8).select(*page_of("path"), kind, "length")


@query("zip_texts", f"SELECT page_id, {CLEAN.format('html')} AS text FROM pages")
def _zip_texts(spark, sf):
    found = readers.zip_texts(readers.read_zip_members(spark, zipped_pages(spark, sf)))
    return found.select(F.regexp_extract("source", r"(\d+)\.md$", 1).cast("long").alias("page_id"), "text")


@query(
    "prepare_image_dataset",
    """SELECT page_id, page_id // 64 AS part, 'kind_' || (page_id % 7) AS label, count(*) OVER w AS num_images,
  (SELECT count(DISTINCT p.page_id % 7) FROM pages p WHERE p.page_id // 64 = pages.page_id // 64) AS num_classes
FROM pages WINDOW w AS (PARTITION BY page_id // 64)""",
)
def _image_dataset(spark, sf):
    bundle = prepare_image_dataset(spark, zipped_pages(spark, sf, "set/images/kind_{1}/p{0}.png"), "zip")
    report = bundle.report.withColumnRenamed("dataset", "r_dataset")
    return bundle.images.join(report, F.col("dataset") == F.col("r_dataset")).select(
        F.regexp_extract("path", r"p(\d+)\.png$", 1).cast("long").alias("page_id"),
        F.regexp_extract("dataset", r"part-(\d+)\.zip$", 1).cast("long").alias("part"),
        "label", "num_images", "num_classes",
    )


@query(
    "union_sources",
    f"""SELECT 0 AS source_id, conv_id, turn, role, text, CAST(NULL AS VARCHAR) AS item FROM ({TURNS})
UNION ALL SELECT 1, NULL, NULL, NULL, {BENCH_TEXT}, CAST(item_id AS VARCHAR) FROM benchmark""",
)
def _union(spark, sf):
    """A table of turns and a folder of texts; ``member`` tells the item that a text is of."""
    csv = scratch_path(spark, "csv")
    sinks.write_csv_report(turns(spark, sf), csv)
    both = readers.union_sources(spark, [csv, text_folder(spark, sf)])
    item = F.regexp_extract("member", "item_id=([^/]*)/", 1).alias("item")
    return both.select("source_id", *[F.col(c).cast("string") for c in ("conv_id", "turn", "role")], "text", item)


# ---- sinks --------------------------------------------------------------------------------


@query("write_instruction_jsonl", "SELECT role AS instruction, text AS output FROM conversations")
def _write_jsonl(spark, sf):
    path = scratch_path(spark, "pairs")
    sinks.write_instruction_jsonl(
        turns(spark, sf).select(F.col("role").alias("instruction"), F.col("text").alias("output")), path
    )
    return spark.read.schema("instruction string, output string").json(path)


@query(
    "bundle_roundtrip",
    f"""WITH {AUGMENTED}, parts AS (SELECT split AS part, instruction, output FROM bundle
UNION ALL SELECT 'all_rows', instruction, output FROM corpus)
SELECT part, count(*) AS n, CAST(sum(length(instruction) + length(output)) AS BIGINT) AS chars FROM parts GROUP BY part""",
)
def _bundle(spark, sf):
    made = prepare_text_dataset(documents(spark, sf), "doc_id")
    path = scratch_path(spark, "bundle")
    sinks.write_bundle(made.split, made.all_rows, path, made.mapping, made.generated_qa)
    back = sinks.read_bundle(spark, path)
    parts = [
        back[name].select(F.lit(name).alias("part"), "instruction", "output") for name in ("train", "eval", "all_rows")
    ]
    chars = F.sum(F.length("instruction") + F.length("output"))
    return readers.union_all(parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"), chars.alias("chars"))


@query("write_csv_report", "SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def _csv_report(spark, sf):
    path = scratch_path(spark, "report")
    per_source = table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars")
    )
    sinks.write_csv_report(per_source, path)
    return spark.read.option("header", "true").schema("source string, documents long, chars long").csv(path)


@query(
    "write_metrics_json",
    "SELECT event_id, CASE WHEN event_type <> 'error' AND value <> 0 THEN round(100 / value, 9) END AS metric FROM events",
)
def _metrics_json(spark, sf):
    path = scratch_path(spark, "metrics")
    value = F.when(F.col("event_type") == "error", float("nan")).when(F.col("value") == 0, float("inf")).otherwise(100 / F.col("value"))
    sinks.write_metrics_json(table(spark, sf, "events").select("event_id", value.alias("metric")), path)
    return rounded(spark.read.schema("event_id long, metric double").json(path), "metric")


# ---- image and file inventories made from page addresses ----------------------------------

SUFFIX = "CASE page_id % 7 WHEN 0 THEN 'txt' WHEN 1 THEN 'PNG' WHEN 2 THEN 'md' WHEN 3 THEN 'webp' WHEN 4 THEN 'csv' ELSE 'jpg' END"
FILES = f"""
files AS (SELECT page_id, page_id % 6 AS dataset, octet_length(encode(html)) AS length,
  CASE page_id % 6 WHEN 0 THEN 'wrap/' WHEN 1 THEN 'a/b/' ELSE '' END || regexp_extract(url, 'example\\.([a-z]+)', 1)
    || CASE page_id % 5 WHEN 0 THEN '/more' ELSE '' END || '/p' || page_id || '.' || {SUFFIX} AS path,
  contains(url, '#') OR contains(url, '/en/') AS moved FROM pages),
images AS (SELECT * FROM files WHERE lower(regexp_extract(path, '\\.([^.]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp', 'gif', 'webp'))
""".replace("\\\\", "\\")


def files(spark, sf) -> DataFrame:
    page = F.col("page_id")
    lead = F.when(page % 6 == 0, "wrap/").when(page % 6 == 1, "a/b/").otherwise("")
    deep = F.when(page % 5 == 0, "/more").otherwise("")
    host = F.regexp_extract("url", r"example\.([a-z]+)", 1)
    path = F.concat(lead, host, deep, F.lit("/p"), page.cast("string"), F.lit("."), F.expr(SUFFIX))
    return table(spark, sf, "pages").select(
        "page_id", (page % 6).alias("dataset"), F.octet_length("html").cast("long").alias("length"), path.alias("path"),
        (F.col("url").contains("#") | F.col("url").contains("/en/")).alias("moved"),
    )


@query(
    "detect_task",
    f"""WITH {FILES}, n AS (SELECT dataset, count(*) FILTER (WHERE lower(regexp_extract(path, '\\.([^.]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp', 'gif', 'webp')) AS images,
  count(*) FILTER (WHERE lower(regexp_extract(path, '\\.([^.]+)$', 1)) IN ('txt', 'md', 'rst')) AS texts FROM files GROUP BY dataset)
SELECT dataset, images, texts, CASE WHEN dataset = 5 THEN 'text_qa' WHEN dataset = 4 THEN 'image_classification'
  WHEN dataset = 3 THEN 'text_qa' WHEN images > greatest(3, texts) THEN 'image_classification' ELSE 'text_qa' END AS task FROM n""".replace("\\\\", "\\"),
)
def _detect(spark, sf):
    data = F.col("dataset")
    listing = files(spark, sf).withColumns(
        {
            "container": F.when(data == 3, "json").when(data == 4, "csv").when(data == 2, "zip").otherwise("dir"),
            "user_task": F.when(data == 5, "text_qa").otherwise("auto"),
            "goal": F.when(data == 4, "Classify the tickets").otherwise("answer questions"),
        }
    )
    return detect_task(listing)


INVENTORY = f"""
{FILES},
inventory AS (SELECT path, length, regexp_extract(path, '^wrap/([^/]+)/.+', 1) AS label FROM images WHERE regexp_matches(path, '^wrap/[^/]+/.+'))
"""


@query("image_inventory", f"WITH {INVENTORY} SELECT * FROM inventory")
def _inventory(spark, sf):
    return images.image_inventory(files(spark, sf).select("path", "length"), "wrap")


@query(
    "image_root",
    f"""WITH {FILES},
dirs AS (SELECT dataset, list_slice(string_split(path, '/'), 1, -2) AS d FROM images WHERE contains(path, '/')),
nested AS (SELECT dataset, d, unnest(range(len(d))) AS depth FROM dirs),
kids AS (SELECT dataset, array_to_string(d[1:depth], '/') AS root, depth, d[depth + 1] AS child FROM nested),
roots AS (SELECT dataset, root, depth, count(*) AS images, count(DISTINCT child) AS classes FROM kids GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY images DESC, classes < 2, depth, root) AS r FROM roots)
SELECT dataset, root, images, classes FROM best WHERE r = 1""",
)
def _root(spark, sf):
    return images.image_root(files(spark, sf))


@query(
    "image_manifest",
    f"""WITH {FILES}, listed AS (SELECT CASE WHEN moved THEN '/old/' ELSE '/data/' END || path AS path,
  CASE WHEN page_id % 11 = 0 THEN '' ELSE 'Class ' || (page_id % 3) || '!' END AS label FROM files)
SELECT path, coalesce(nullif(regexp_replace(trim(label), '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'unknown') AS label FROM listed
WHERE path IN (SELECT '/data/' || path FROM images)""",
)
def _manifest(spark, sf):
    """Every page is listed, some at an address that no file has."""
    listing = files(spark, sf)
    page = F.col("page_id")
    label = F.when(page % 11 == 0, "").otherwise(F.concat(F.lit("Class "), (page % 3).cast("string"), F.lit("!")))
    listed = F.when(F.col("moved"), F.concat(F.lit("/old/"), "path")).otherwise(F.col("path"))
    sheet = listing.select(listed.alias("Image_Path"), label.alias("class"))
    there = listing.select(F.concat(F.lit("/data/"), "path").alias("path"))
    return images.image_manifest(sheet, there, "/data")


@query(
    "image_data_warnings",
    f"""WITH {FILES}, n AS (SELECT dataset, count(*) AS num_images, count(DISTINCT regexp_extract(path, '^([^/]+)/.+', 1)) AS num_classes FROM images GROUP BY dataset)
SELECT dataset, num_images, num_classes, CASE WHEN num_images >= 1000 THEN 90.0::DOUBLE WHEN num_images >= 500 THEN 75.0 WHEN num_images >= 200 THEN 55.0
  WHEN num_images >= 50 THEN 35.0 ELSE 15.0 END AS quality_score,
  CASE WHEN num_images >= 500 THEN CASE WHEN num_images >= 1000 THEN 'excellent' ELSE 'good' END WHEN num_images >= 200 THEN 'fair' ELSE 'poor' END AS quality_label,
  array_to_string(list_filter([CASE WHEN num_images < 100 THEN 'few_images' END, CASE WHEN num_classes > 20 THEN 'many_classes' END], lambda x: x IS NOT NULL), ',') AS warnings,
  CASE WHEN num_images < 100 THEN 'collect_100_per_class' WHEN num_images < 500 THEN 'collect_more_images' ELSE '' END AS advice FROM n""",
)
def _image_warnings(spark, sf):
    labelled = images.image_inventory(
        files(spark, sf).withColumn("path", F.concat(F.lit("all/"), "path")), "all"
    )
    report = image_data_warnings(images.image_report(labelled, ["dataset"]))
    return report.withColumns({c: F.array_join(c, ",") for c in ("warnings", "advice")})


# ---- streaming ----------------------------------------------------------------------------


@query(
    "log_health_stream",
    f"""WITH {SIGNALS}, w AS (SELECT *, time_bucket(INTERVAL '1 day', ts) AS window_start FROM signals)
SELECT run_id, window_start, window_start + INTERVAL '1 day' AS window_end, bool_or(oom) AS oom_detected, bool_or(nan) AS nan_loss_detected,
  count(loss) AS losses, round(avg(loss), 6) AS mean_loss, count(*) AS lines FROM w
GROUP BY run_id, window_start HAVING window_start + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""",
)
def _log_stream(spark, sf):
    """The event table as a file stream; a window is final once the watermark has passed it."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")
    lines = log_lines(events).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = log_health_stream(lines, window="1 day", delay="10 minutes")
    out, marks = scratch_path(spark, "health"), scratch_path(spark, "marks")
    run_available(stream, out, marks)
    closed = spark.read.schema(stream.schema).parquet(out)
    bounds = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return rounded(closed.withColumns(bounds), "mean_loss", places=6)


@query(
    "monitor_runs",
    f"""WITH {TRENDS}, ended AS (SELECT run_id FROM signals GROUP BY run_id HAVING max(ts) + INTERVAL '1 day' < (SELECT max(ts) - INTERVAL '10 minutes' FROM events))
SELECT run_id, oom_detected, nan_loss_detected, oom_event, nan_event, f.losses, round(first_half, 6) AS first_half, round(second_half, 6) AS second_half, trend
FROM found f JOIN ended USING (run_id) LEFT JOIN trends USING (run_id)""",
)
def _monitor(spark, sf):
    """The event table as a file stream; a run is reported when a day has passed since its last line."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")
    lines = log_lines(events).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = monitor_runs(lines, quiet="1 day", delay="10 minutes")
    out, marks = scratch_path(spark, "ended"), scratch_path(spark, "marks")
    run_monitor(stream, out, marks)
    return rounded(spark.read.schema(stream.schema).parquet(out), "first_half", "second_half", places=6)


@query(
    "incremental_prepare",
    f"""WITH {PAIRS} SELECT DISTINCT instruction, output,
  CASE WHEN ('0x' || left(sha256(instruction || chr(1) || output), 8))::BIGINT / 4294967296.0::DOUBLE < 0.1 THEN 'eval' ELSE 'train' END AS split FROM pairs""",
)
def _incremental(spark, sf):
    """The document table as a file stream; its arrival time is the file's."""
    arriving = (
        spark.readStream.schema(table(spark, sf, "documents").schema)
        .parquet(f"{sf}/document[s].parquet")
        .withColumn("arrived", F.col("_metadata.file_modification_time"))
        .select("doc_id", "text", "source", "arrived")
    )
    stream = incremental_prepare(arriving, "doc_id", "arrived")
    out, marks = scratch_path(spark, "arrived"), scratch_path(spark, "marks")
    run_available(stream, out, marks)
    return spark.read.schema(stream.schema).parquet(out).select("instruction", "output", "split")


@query("first_arrivals", f"WITH {PAIRS} SELECT DISTINCT instruction, output FROM pairs")
def _arrivals(spark, sf):
    """The document table in several batches, and all of it once more behind them.

    A batch has as many files as the table has splits, so that no file grows with the table."""
    docs, folder = table(spark, sf, "documents"), scratch_path(spark, "arriving")
    files = max(1, docs.rdd.getNumPartitions())
    docs.repartition(3 * files).write.parquet(folder)
    docs.repartition(files).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", str(files)).parquet(folder)
    out, ledger, marks = (scratch_path(spark, name) for name in ("arrived", "ledger", "marks"))
    pairs = arriving_pairs(stream.select("doc_id", "text", "source"), "doc_id")
    keep_first_arrivals(pairs, out, ledger, marks, ["instruction", "output"], ["doc_id", "chunk"])
    return spark.read.parquet(out).select("instruction", "output")
