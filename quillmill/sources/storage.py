"""Files as tables: listings made on executors, and ranged reads inside tasks.

Spark's own readers list files on the driver and hand a binary file over as one cell. What follows
opens files in the tasks, through Arrow's file systems (local, HDFS, S3, GCS), so a listing never
passes through the driver, and a file of any size is read in blocks.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.detect import suffix_of
from quillmill.session import materialize

#: Folders that a task lists in one round, at least those it was given, before it hands the rest on.
FOLDERS_PER_TASK = 256
#: Bytes of a block of a file that one task reads at a time.
BLOCK_BYTES = 32 << 20
_LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("is_folder", pa.bool_())])


def opened(uri: str) -> tuple[FileSystem, str]:
    """The file system of a path as Spark spells it, and the path in it."""
    local = re.sub("^file:/+", "/", uri)
    return FileSystem.from_uri(re.sub("^s3[an]:", "s3:", local))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's readers spell it."""
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop_path.getFileSystem(context._jsc.hadoopConfiguration())
    return hadoop_path.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()


def _hidden(name: str) -> bool:
    """What Spark's readers pass over: names that start with a dot or, but for partitions, a low line."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _list(folders_per_task: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = deque(path for batch in batches for path in batch.column(0).to_pylist())
        # All that it was given, so that the number of rounds follows the depth of the tree alone.
        budget, listed = max(folders_per_task, len(waiting)), 0
        while waiting and listed < budget:
            folder = waiting.popleft()
            listed += 1
            files, place = opened(folder)
            rows = []
            for found in files.get_file_info(FileSelector(place)):
                if _hidden(found.base_name):
                    continue
                path = f"{folder.rstrip('/')}/{found.base_name}"
                if found.type == FileType.Directory:
                    waiting.append(path)
                elif found.type == FileType.File:
                    rows.append({"path": path, "length": found.size, "is_folder": False})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_LISTED)
        rest = [{"path": path, "length": 0, "is_folder": True} for path in waiting]
        if rest:
            yield pa.RecordBatch.from_pylist(rest, schema=_LISTED)

    return run


def list_files(spark: SparkSession, root: str, folders_per_task: int = FOLDERS_PER_TASK) -> DataFrame:
    """``(path, length)`` of every file below ``root``; contents are not read.

    Folders are listed in rounds, not more than the tree has levels: each task lists those it is given,
    also some below them if they are few, and hands the rest on. Only their number comes to the driver. A store that Arrow cannot open, or a pattern, is
    listed by Spark.
    """
    base = qualified(spark, root)
    try:
        files, place = opened(base)
        kind = files.get_file_info(place).type
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        kind = FileType.NotFound
    if kind != FileType.Directory:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        return found.select("path", "length")
    folders, rounds = spark.createDataFrame([(base,)], "path string"), []
    while True:
        listed = materialize(
            folders.mapInArrow(_list(folders_per_task), "path string, length long, is_folder boolean"), "listing"
        )
        rounds.append(listed.where("NOT is_folder").select("path", "length"))
        folders = listed.where("is_folder").select("path")
        waiting = folders.count()
        if not waiting:
            break
        folders = folders.repartition(min(waiting, 4 * spark.sparkContext.defaultParallelism))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def files_of(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """``(path, length)`` of a file, or of the files below a folder that have ``suffix``, if given."""
    found = list_files(spark, path)
    return found if suffix is None else found.where(suffix_of(F.col("path")) == suffix)


def blocks_of(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per block of each file, with its ``start``, in addition to the columns of ``files``.

    Blocks are dealt to as many tasks as there are, up to sixteen per core.
    """
    last = F.greatest(F.col("length") - 1, F.lit(0).cast("long"))
    blocks = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(block_bytes).cast("long"))))
    return dealt(blocks)


def dealt(blocks: DataFrame, *keys: str) -> DataFrame:
    """A small table of work to do, over tasks of its own; Spark would put it into one."""
    most = 16 * blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.repartition(max(1, min(most, blocks.count())), *keys)


def entry_states(maps: DataFrame, start: Callable[[], tuple], step: Callable[[tuple, list[int]], tuple], fields: str) -> DataFrame:
    """The state in which each block of each file is entered: a prefix scan over the blocks' maps.

    ``maps`` has a row ``path, start, map`` per block, where ``map`` says what becomes of each state a
    block can be entered in. A file's blocks are composed in order, one small row per block.
    """
    names = [field.split()[0] for field in fields.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        states, state = [], start()
        for one in table.column("map").to_pylist():
            states.append(state)
            state = step(state, one)
        out = table.select(["path", "start"])
        for name, values in zip(names, zip(*states)):
            out = out.append_column(name, pa.array(list(values), pa.int64()))
        return out

    return maps.groupBy("path").applyInArrow(run, f"path string, start long, {fields}")
