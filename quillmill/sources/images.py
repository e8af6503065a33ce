"""Image collections as tables of paths; image bytes stay in storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.detect import CLASS_NAMES, IMAGE_NAMES, IMAGE_SUFFIXES, find_column, suffix_of


def bare_path(path: Column, spark: SparkSession) -> Column:
    """A path without the scheme of local files or of the session's own store, in which a listing
    spells it out and a caller usually does not."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.FileSystem.get(spark._jsc.hadoopConfiguration()).getUri().toString().rstrip("/")
    local = F.regexp_replace(path, "^file:/+", "/")
    own = store + "/"
    return F.when(local.startswith(own), F.substring(local, F.lit(len(store) + 1), F.length(local))).otherwise(local)


def image_inventory(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """The images below ``root`` with ``label``, the folder directly under it; images outside any
    class folder are left out. ``files`` is a listing such as ``list_files`` gives."""
    full = bare_path(F.col(path), files.sparkSession)
    base = bare_path(F.lit(root.rstrip("/") + "/"), files.sparkSession)
    below = F.when(full.startswith(base), F.substring(full, F.length(base) + 1, F.length(full)))
    label = F.regexp_extract(below, r"^([^/]+)/.+", 1)
    return files.withColumn("label", label).where(
        suffix_of(F.col(path)).isin(IMAGE_SUFFIXES) & (F.col("label") != "")
    )


def image_report(inventory: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``num_images`` and ``num_classes``, overall or per dataset."""
    keys = by or []
    per_label = inventory.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return per_label.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_images"), F.count(F.lit(1)).alias("num_classes")
    )


def require_classes(inventory: DataFrame) -> DataFrame:
    """Fail unless there are images in at least two class folders."""
    if inventory.select("label").distinct().limit(2).count() < 2:
        raise ValueError("image classification needs at least two class folders with images")
    return inventory


def image_root(files: DataFrame, dataset: str = "dataset", path: str = "path") -> DataFrame:
    """Per dataset, the folder whose direct subfolders are the classes.

    That is the folder with the most images in its subfolders; among equals one with at least
    two class folders, then the shallowest. ``path`` is relative to the dataset. Images are
    counted per (folder, child) first, so a folder that holds everything is no hot key.
    """
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    images = files.where(suffix_of(F.col(path)).isin(IMAGE_SUFFIXES) & F.col(path).contains("/"))
    nested = images.select(dataset, folders.alias("dirs")).select(
        dataset, "dirs", F.posexplode("dirs").alias("depth", "child")
    )
    per_child = nested.groupBy(
        dataset,
        F.array_join(F.slice("dirs", F.lit(1), F.col("depth")), "/").alias("root"),
        "depth",
        "child",
    ).agg(F.count(F.lit(1)).alias("n"))
    per_root = per_child.groupBy(dataset, "root", "depth").agg(
        F.sum("n").alias("images"), F.count(F.lit(1)).alias("classes")
    )
    best = F.min_by(
        F.struct("root", "images", "classes"),
        F.struct(-F.col("images"), F.col("classes") < 2, "depth", "root"),
    )
    return per_root.groupBy(dataset).agg(best.alias("b")).select(dataset, "b.root", "b.images", "b.classes")


def image_manifest(table: DataFrame, files: DataFrame, base: str) -> DataFrame:
    """``(path, label)`` of the images a table lists and a file listing contains.

    Paths are relative to ``base`` unless absolute; labels are reduced to plain characters.
    """
    image, label = find_column(table.columns, IMAGE_NAMES), find_column(table.columns, CLASS_NAMES)
    if image is None or label is None:
        raise ValueError("an image table needs an image column and a label column")
    raw = F.col(f"`{image}`")
    absolute = raw.startswith("/") | raw.rlike("^[a-z][a-z0-9]*:/")
    full = F.when(absolute, raw).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), raw))
    tidy = F.regexp_replace(F.trim(F.col(f"`{label}`").cast("string")), "[^A-Za-z0-9_.-]+", "_")
    listed = table.select(
        full.alias("path"), F.coalesce(F.nullif(tidy, F.lit("")), F.lit("unknown")).alias("label")
    ).where(suffix_of(F.col("path")).isin(IMAGE_SUFFIXES))
    spark = table.sparkSession
    there = files.select("path", bare_path(F.col("path"), spark).alias("_bare")).dropDuplicates(["_bare"])
    wanted = listed.select(bare_path(F.col("path"), spark).alias("_bare"), "label")
    return wanted.join(there, "_bare").select("path", "label")
