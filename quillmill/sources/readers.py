"""Readers for tables, JSON, text files, archives, and folders that mix them."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.text import NOT_BLANK, clean_text
from quillmill.operators.detect import TEXT_SUFFIXES, suffix_of
from quillmill.session import materialize, scratch_path
from quillmill.sources import csv_blocks, json_blocks
from quillmill.sources.archives import extract_zip, read_zip_members, zip_index
from quillmill.sources.storage import BLOCK_BYTES, files_of, list_files, qualified

# Cells that mean "missing", and which suffix is read in which way.
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
DELIMITERS = {"csv": ",", "tsv": "\t", "tab": "\t"}
TABLE_SUFFIXES = [*DELIMITERS, "json", "jsonl"]


def _glob(suffix: str) -> str:
    """A file-name glob for a suffix in any case."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing in one frame is null there.

    A column whose type differs between frames becomes text.
    """
    types: dict[str, set[str]] = {}
    for frame in frames:
        for field in frame.schema:
            types.setdefault(field.name, set()).add(field.dataType.simpleString())
    clashing = [name for name, seen in types.items() if len(seen) > 1]

    def aligned(frame: DataFrame) -> DataFrame:
        here = [c for c in clashing if c in frame.columns]
        return frame.withColumns({c: F.col(f"`{c}`").cast("string") for c in here}) if here else frame

    return functools.reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), map(aligned, frames)
    )


# ---- tables -------------------------------------------------------------------------------


def _profile_lines(spark: SparkSession, path: str, suffix: str | None) -> DataFrame:
    """A row per file: ``path``, ``length``, its first line as ``header``, whether it is valid UTF-8, and
    whether a cell may span lines, of which a line with an odd number of quotes is the sign."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", _glob(suffix))
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    odd = (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    opens_file = F.col("at") == 0
    files = lines.groupBy("file").agg(
        F.first("size").alias("length"),
        F.min_by(F.when(opens_file, F.col("value")), F.when(opens_file, F.col("line"))).alias("header"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(odd).alias("spans"),
    )
    plain = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    return files.select(plain.alias("path"), "length", "header", "utf8", "spans")


def read_delimited(
    spark: SparkSession,
    path: str,
    suffix: str | None = None,
    encoding: str = "auto",
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """CSV (or, by suffix, tab-separated) files with a header; every column is read as text.

    ``auto`` looks at the lines once: CSV files that are not valid UTF-8 are read as Latin-1, and
    files with different headers are matched by column name. Files with one header and no cell that
    spans lines go to Spark's reader. All others are read in blocks of ``block_bytes``, by as many
    tasks as there are blocks; only distinct headers come to the driver, never the names of files.
    Give ``encoding`` and ``schema`` (and ``multi_line=False`` where no cell spans lines) to skip that
    pass. Missing-value marks become null.
    """
    kind = suffix or path.rsplit(".", 1)[-1].lower()
    sep = DELIMITERS.get(kind, ",")
    reader = spark.read.option("header", "true").option("escape", '"').option("recursiveFileLookup", "true")
    reader = reader.option("sep", sep)
    if suffix:
        reader = reader.option("pathGlobFilter", _glob(suffix))
    if schema is not None:
        reader = reader.schema(schema)
    if schema is not None and encoding != "auto":
        table = reader.option("multiLine", str(multi_line).lower()).option("encoding", encoding).csv(path)
    else:
        files = materialize(_profile_lines(spark, path, suffix), "csv-files")
        # In text files other than CSV, and where an encoding is given, it is not guessed.
        latin = F.lit(kind == "csv" and encoding == "auto") & ~F.col("utf8")
        groups = files.groupBy("header", latin.alias("latin")).agg(F.bool_or("spans").alias("spans")).collect()
        if not groups:
            raise ValueError(f"no rows in {path}")
        named = "ISO-8859-1" if groups[0]["latin"] else "UTF-8"
        if len(groups) == 1 and not groups[0]["spans"]:
            table = reader.option("encoding", named if encoding == "auto" else encoding).csv(path)
        else:
            if encoding not in ("auto", "UTF-8"):
                raise ValueError("an encoding can only be given for files with one header and no line breaks in cells")
            table = _read_blocks(files.withColumn("utf8", ~latin), sep, schema, block_bytes)
    return table.select(
        *[
            F.when(~F.col(f"`{f.name}`").isin(MISSING_CELLS), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in table.schema
        ]
    )


def _read_blocks(files: DataFrame, sep: str, schema: T.StructType | str | None, block_bytes: int) -> DataFrame:
    """Files of any headers, with cells that may span lines, as one table."""
    spanning = files.where("spans")
    states = None
    if not spanning.isEmpty():
        states = materialize(csv_blocks.block_states(spanning, sep, block_bytes), "csv-states")
        firsts = csv_blocks.first_records(spanning, sep)
        files = files.join(firsts, F.col("path") == F.col("h_path"), "left").withColumn("header", F.coalesce("first", "header"))
        files = materialize(files.drop("h_path", "first"), "csv-headers")
    frames = []
    for header, spans in files.select("header", "spans").distinct().collect():
        own = files.where(F.col("header").eqNullSafe(F.lit(header)) & (F.col("spans") == spans))
        records = csv_blocks.read_records(own, states if spans else None, sep, block_bytes)
        if isinstance(schema, T.StructType):
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        else:
            names = csv_blocks.column_names((header or "").removeprefix("\ufeff"), sep)
            ddl = schema or ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        frames.append(csv_blocks.parsed(records, ddl, sep))
    return union_all(frames)


def read_json_documents(
    spark: SparkSession, path: str, suffix: str | None = None, block_bytes: int = json_blocks.BLOCK_BYTES
) -> DataFrame:
    """JSON files holding a list, an object with a ``data`` or ``records`` list, or one object.

    The documents become JSON lines in the shared folder once, a list of any length by as many tasks
    as its file has blocks; what follows is Spark's reader. Types are those of all rows."""
    lines = scratch_path(spark, "json-lines")
    json_blocks.json_lines(files_of(spark, path, suffix), block_bytes).write.text(lines)
    rows = spark.read.option("mode", "FAILFAST").json(lines)
    if not rows.columns:
        raise ValueError(f"unsupported JSON payload in {path}")
    return rows


def read_jsonl(spark: SparkSession, path: str, suffix: str | None = None, strict: bool = True) -> DataFrame:
    """One JSON object per line; blank lines are skipped.

    A bad line fails the read, or with ``strict=False`` lands in ``_corrupt_record``.
    """
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", _glob(suffix))
    return reader.json(path)


# ---- texts and archives -------------------------------------------------------------------


def decode_bytes(content: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are not valid UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def _texts(files: DataFrame, source: Column) -> DataFrame:
    texts = files.where(suffix_of(source).isin(TEXT_SUFFIXES)).select(
        source.alias("source"), decode_bytes(F.col("content")).alias("text")
    )
    return texts.where(F.col("text").rlike(NOT_BLANK)).select("source", clean_text(F.col("text")).alias("text"))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(source, text)``, one row per file, cleaned; blank files are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _texts(files, F.col("path"))


def zip_texts(members: DataFrame) -> DataFrame:
    """The text files among archive members, as ``(source, text)``."""
    return _texts(members, F.concat_ws("!/", "archive", "member"))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Zip archives as a dataset: the tables in them, unpacked to the shared folder and read from there;
    their text files if there is no table."""
    index = zip_index(spark, path)
    kinds = _suffix_counts(index.select(F.col("member").alias("path")))
    if not any(kinds.get(k) for k in TABLE_SUFFIXES):
        return zip_texts(read_zip_members(spark, path, TEXT_SUFFIXES))
    folder = scratch_path(spark, "unzipped")
    extract_zip(index.where(suffix_of(F.col("member")).isin(TABLE_SUFFIXES)), qualified(spark, folder))
    return read_dataset_dir(spark, folder)


# ---- folders and mixed inputs -------------------------------------------------------------


def _suffix_counts(files: DataFrame) -> dict[str, int]:
    """Number of files per known suffix; at most a handful of rows."""
    known = [*TABLE_SUFFIXES, *TEXT_SUFFIXES]
    kinds = files.select(suffix_of(F.col("path")).alias("kind")).where(F.col("kind").isin(known))
    return {r["kind"]: r["n"] for r in kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}


def read_dataset_dir(spark: SparkSession, path: str) -> DataFrame:
    """Every table below a folder, matched by column name; the text files if there is no table."""
    kinds = _suffix_counts(list_files(spark, path))
    frames = []
    for kind in TABLE_SUFFIXES:
        if not kinds.get(kind):
            continue
        if kind in DELIMITERS:
            frames.append(read_delimited(spark, path, kind))
        elif kind == "json":
            frames.append(read_json_documents(spark, path, kind))
        else:
            frames.append(read_jsonl(spark, path, kind))
    return union_all(frames) if frames else read_text_documents(spark, path)


def _is_dir(spark: SparkSession, path: str) -> bool | None:
    """True for a folder, False for a file, None if nothing is there."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(hadoop_path).isDirectory() if fs.exists(hadoop_path) else None


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A folder, archive, table or text file, by its kind."""
    folder = _is_dir(spark, path)
    if folder is None:
        raise FileNotFoundError(f"dataset not found: {path}")
    if folder:
        return read_dataset_dir(spark, path)
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "zip":
        return read_zip(spark, path)
    if kind in DELIMITERS:
        return read_delimited(spark, path)
    if kind == "json":
        return read_json_documents(spark, path)
    if kind == "jsonl":
        return read_jsonl(spark, path)
    if kind in TEXT_SUFFIXES:
        return read_text_documents(spark, path)
    raise ValueError(f"unsupported text dataset: {path}")


def union_sources(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several inputs as one table, with ``source_id``, the position of the input, ``class``, the stem of
    an archive (with a number behind it where stems repeat; null for other inputs), and ``member``, the
    path of a text file inside its input (null for rows of tables).

    Nothing is copied, so equal file names need no renaming.
    """
    frames, stems = [], []
    for i, path in enumerate(paths):
        frame, stem = read_any(spark, path), None
        member = F.lit(None).cast("string")
        if path.lower().endswith(".zip"):
            stem = path.rsplit("/", 1)[-1][: -len(".zip")]
            stems.append(stem)
            stem += f"_{stems.count(stem) - 1}" if stems.count(stem) > 1 else ""
            if frame.columns == ["source", "text"]:
                member = F.element_at(F.split("source", "!/", 2), 2)
        elif frame.columns == ["source", "text"]:
            base = qualified(spark, path)
            inside = F.substring("source", len(base) + 2, 2**31 - 1)
            member = F.when(F.col("source") == base, F.lit(base.rsplit("/", 1)[-1])).otherwise(inside)
        frames.append(frame.withColumns({"source_id": F.lit(i), "class": F.lit(stem).cast("string"), "member": member}))
    return union_all(frames)
