"""From a folder, archives or a table of image paths to a labelled image dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.detect import IMAGE_SUFFIXES, suffix_of
from quillmill.session import materialize
from quillmill.sources import images
from quillmill.sources.archives import zip_index
from quillmill.sources.readers import read_delimited
from quillmill.sources.storage import list_files


@dataclass(frozen=True)
class ImageBundle:
    """``images(dataset, path, label)``; ``labels`` in their order; ``report`` with a row per dataset."""

    images: DataFrame
    labels: DataFrame
    report: DataFrame


def prepare_image_dataset(
    spark: SparkSession, path: str, kind: str | None = None, class_from_archive: bool = False
) -> ImageBundle:
    """The images at ``path`` with their labels, of at least two classes.

    ``kind`` is ``dir``, ``zip`` (an archive, or a folder of archives, each a dataset of its own) or
    ``csv`` (a table of image paths and labels, paths relative to its folder), and is read from the
    suffix if it is not given. A dataset's classes are the folders below its image root. With
    ``class_from_archive`` every archive is one class, named by its stem, and they make up one
    dataset. Writes the list of image paths once; the bytes of images are not read.
    """
    kind = kind or {"zip": "zip", "csv": "csv"}.get(path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower(), "dir")
    if kind == "csv":
        base = path.rstrip("/").rsplit("/", 1)[0]
        listed = images.image_manifest(read_delimited(spark, path), list_files(spark, base), base)
        found = listed.select(F.lit("csv").alias("dataset"), "path", "label")
    elif kind == "zip":
        members = zip_index(spark, path).select("archive", "member")
        members = materialize(members.where(suffix_of(F.col("member")).isin(IMAGE_SUFFIXES)), "image-members")
        place = F.concat_ws("!/", "archive", "member").alias("path")
        if class_from_archive:
            stem = F.regexp_extract("archive", r"([^/]+?)(?:\.[^./]*)?$", 1)
            found = members.select(F.lit("zip").alias("dataset"), place, stem.alias("label"))
        else:
            found = _below_roots(members.select(F.col("archive").alias("dataset"), place, F.col("member").alias("inside")))
    else:
        base = images.bare_path(F.lit(path.rstrip("/") + "/"), spark)
        whole = images.bare_path(F.col("path"), spark)
        listing = list_files(spark, path).where(suffix_of(F.col("path")).isin(IMAGE_SUFFIXES)).select(
            F.lit("dir").alias("dataset"), "path", F.substring(whole, F.length(base) + 1, F.length(whole)).alias("inside")
        )
        found = _below_roots(materialize(listing, "image-paths"))
    found = images.require_classes(materialize(found, "images"))
    labels = found.select("label").distinct().orderBy("label")
    return ImageBundle(found, labels, images.image_report(found, ["dataset"]))


def _below_roots(files: DataFrame) -> DataFrame:
    """Images in the class folders of each dataset's root, by ``inside``, the path in the dataset."""
    roots = images.image_root(files, "dataset", "inside").select(F.col("dataset").alias("r_dataset"), "root")
    lead = F.when(F.col("root") == "", "").otherwise(F.concat("root", F.lit("/")))
    below = F.when(F.col("inside").startswith(lead), F.substring(F.col("inside"), F.length(lead) + 1, F.length("inside")))
    label = F.regexp_extract(below, r"^([^/]+)/.+", 1)
    return (
        files.join(roots, F.col("dataset") == F.col("r_dataset"))
        .select("dataset", "path", label.alias("label"))
        .where(F.col("label") != "")
    )
