"""Writers for corpora, bundles, reports and metric records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.arrays import finite


def write_instruction_jsonl(df: DataFrame, path: str) -> None:
    """Instruction and output as JSON lines in UTF-8; null becomes an explicit ``null``."""
    df.select("instruction", "output").write.option("ignoreNullFields", "false").json(path)


def write_bundle(
    split: DataFrame, all_rows: DataFrame, path: str, mapping: dict[str, str], generated_qa: bool
) -> None:
    """The splits, the corpus before augmentation, and one row of facts, all as Parquet."""
    split.write.partitionBy("split").parquet(f"{path}/splits")
    all_rows.write.parquet(f"{path}/all_rows")
    spark = split.sparkSession
    facts = spark.createDataFrame(
        [(mapping, generated_qa)], "mapping map<string,string>, generated_qa boolean"
    )
    facts.coalesce(1).write.parquet(f"{path}/facts")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``train``, ``eval``, ``all_rows`` and ``facts``; a split reads only its own folder."""
    splits = spark.read.parquet(f"{path}/splits")
    return {
        "train": splits.where(F.col("split") == "train").drop("split"),
        "eval": splits.where(F.col("split") == "eval").drop("split"),
        "all_rows": spark.read.parquet(f"{path}/all_rows"),
        "facts": spark.read.parquet(f"{path}/facts"),
    }


def write_csv_report(df: DataFrame, path: str) -> None:
    """CSV with a header, standard quoting."""
    df.write.option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def json_ready(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by null at every depth."""

    def safe(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite(column)
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda v: safe(v, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(column, lambda k, v: safe(v, kind.valueType))
        if isinstance(kind, T.StructType):
            fields = [safe(column.getField(f.name), f.dataType).alias(f.name) for f in kind]
            return F.when(column.isNotNull(), F.struct(*fields))
        return column

    return df.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def write_metrics_json(df: DataFrame, path: str) -> None:
    """Metric records as JSON lines without NaN or infinities."""
    json_ready(df).write.option("ignoreNullFields", "false").json(path)
