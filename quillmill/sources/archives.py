"""Zip archives by random access: an index of their members, members in pieces, and unpacking.

The directory at the end of an archive says where each member lies, so members are tasks of their
own, however large their archive: a task opens the archive, goes to the member and unpacks it block
by block. Neither an archive nor, in pieces, a member is ever held as a whole.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.operators.detect import suffix_of
from quillmill.session import materialize
from quillmill.sources.storage import dealt, files_of, opened

#: Unpacked bytes of a piece, and packed bytes of one archive that a task takes in one go.
PIECE_BYTES = 64 << 20
SLICE_BYTES = 64 << 20
#: A member above this size is read in pieces only.
CELL_BYTES = (1 << 31) - 1024
_READ_BYTES = 1 << 20
INDEX = "archive string, member string, offset long, packed long, length long, method int, crc long"
_INDEX_SCHEMA = pa.schema(
    [("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("packed", pa.int64()),
     ("length", pa.int64()), ("method", pa.int32()), ("crc", pa.int64())]
)


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column("path").to_pylist():
            files, place = opened(archive)
            with files.open_input_file(place) as packed, zipfile.ZipFile(packed) as directory:
                rows = []
                for member in directory.infolist():
                    parts = re.split(r"[/\\]", member.filename)
                    if ".." in parts or parts[0] == "" or ":" in parts[0]:
                        raise ValueError(f"unsafe path in zip: {member.filename}")
                    if member.is_dir():
                        continue
                    if member.flag_bits & 1:
                        raise ValueError(f"encrypted member in zip: {member.filename}")
                    rows.append(
                        (archive, member.filename, member.header_offset, member.compress_size, member.file_size,
                         member.compress_type, member.CRC)
                    )
                for at in range(0, len(rows), 10_000):
                    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows[at : at + 10_000]), _INDEX_SCHEMA)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_INDEX_SCHEMA)


def zip_index(spark: SparkSession, path: str) -> DataFrame:
    """The staged table ``archive, member, offset, packed, length, method, crc`` of the files in the zip
    archives at ``path``, from their directories alone.

    A member name that leads out of its archive, or an encrypted member, fails the read.
    """
    archives = dealt(files_of(spark, path, "zip").select("path"))
    return materialize(archives.mapInArrow(_directory, INDEX), "zip-index")


def unpacked(packed: pa.NativeFile, row: dict) -> Iterator[bytes]:
    """A member's bytes, block by block, checked against its length and checksum at the end."""
    if row["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        # Rare methods: through the library, which reads the directory again and checks as well.
        with zipfile.ZipFile(packed) as directory, directory.open(row["member"]) as member:
            while block := member.read(_READ_BYTES):
                yield block
        return
    packed.seek(row["offset"])
    name, extra = struct.unpack("<HH", packed.read(30)[26:])
    packed.seek(row["offset"] + 30 + name + extra)
    inflate = zlib.decompressobj(-15) if row["method"] == zipfile.ZIP_DEFLATED else None
    left, length, crc = row["packed"], 0, 0
    while left:
        block = packed.read(min(left, _READ_BYTES))
        if not block:
            break
        left -= len(block)
        while block:
            out = inflate.decompress(block, _READ_BYTES) if inflate else block
            block = inflate.unconsumed_tail if inflate else b""
            length, crc = length + len(out), zlib.crc32(out, crc)
            if out:
                yield out
    while inflate and (out := inflate.decompress(inflate.unconsumed_tail, _READ_BYTES)):
        length, crc = length + len(out), zlib.crc32(out, crc)
        yield out
    if left or (length, crc) != (row["length"], row["crc"]):
        raise ValueError(f"damaged member in zip: {row['archive']}!/{row['member']}")


def _each_member(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """Members of a partition and their bytes; an archive stays open while its members follow each other."""
    held, packed = None, None
    try:
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != held:
                    if packed:
                        packed.close()
                    files, place = opened(row["archive"])
                    held, packed = row["archive"], files.open_input_file(place)
                yield row, unpacked(packed, row)
    finally:
        if packed:
            packed.close()


def _dealt(index: DataFrame) -> DataFrame:
    """Members that lie side by side go to one task, in their order, up to SLICE_BYTES of an archive."""
    sliced = index.withColumn("_slice", F.expr(f"offset div {SLICE_BYTES}"))
    slices = max(1, sliced.select("archive", "_slice").distinct().count())
    most = 16 * index.sparkSession.sparkContext.defaultParallelism
    return sliced.repartition(min(slices, most), "archive", "_slice").sortWithinPartitions("archive", "offset").drop("_slice")


def _pieces(piece_bytes: int) -> Callable:
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("piece", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, waiting = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows.clear()
                waiting = 0

        for member, blocks in _each_member(batches):
            held, number = bytearray(), 0
            for block in blocks:
                held += block
                while len(held) > piece_bytes:
                    yield from flushed()
                    rows.append((member["archive"], member["member"], member["offset"], number, bytes(held[:piece_bytes])))
                    yield from flushed()
                    del held[:piece_bytes]
                    number += 1
            rows.append((member["archive"], member["member"], member["offset"], number, bytes(held)))
            waiting += len(held)
            if waiting >= piece_bytes:
                yield from flushed()
        yield from flushed()

    return run


def read_zip_pieces(index: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``(archive, member, offset, piece, content)``: each member of an index as pieces in order, the
    last one of what is left; a member's ``offset`` tells members of one name apart."""
    fields = "archive string, member string, offset long, piece long, content binary"
    return _dealt(index).mapInArrow(_pieces(piece_bytes), fields)


def read_zip_members(spark: SparkSession, path: str, suffixes: list[str] | None = None) -> DataFrame:
    """``(archive, member, content)`` of the files in the zip archives at ``path``, or of those that have
    one of the ``suffixes``. Raises for a member that no cell can hold; see :func:`read_zip_pieces`."""
    index = zip_index(spark, path)
    if suffixes is not None:
        index = index.where(suffix_of(F.col("member")).isin(suffixes))
    longest = index.agg(F.max_by(F.struct("member", "length"), "length").alias("m")).first()["m"]
    if longest and longest["length"] > CELL_BYTES:
        raise ValueError(f"{longest['member']} has {longest['length']} bytes: read it in pieces")
    return read_zip_pieces(index, CELL_BYTES).select("archive", "member", "content")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, rows, made = ["archive", "member", "path", "length"], [], None
    for member, blocks in _each_member(batches):
        files, place = opened(member["path"])
        folder = place.rsplit("/", 1)[0]
        if folder != made:
            files.create_dir(folder, recursive=True)
            made = folder
        # A task that runs again writes the same bytes again.
        with files.open_output_stream(place) as out:
            for block in blocks:
                out.write(block)
        rows.append({n: member[n] for n in names})
        if len(rows) == 1_000:
            yield pa.RecordBatch.from_pylist(rows)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows)


def extract_zip(index: DataFrame, folder: str) -> DataFrame:
    """Unpack the members of an index below ``folder``, one folder per archive named by its stem, with a
    number behind it where stems are equal. Returns ``archive, member, path, length``.

    ``folder`` has to be a path that all executors reach."""
    stem = F.regexp_extract("archive", r"([^/]+?)(?:\.[^./]*)?$", 1)
    archives = index.select("archive").distinct().withColumn("stem", stem)
    number = F.row_number().over(Window.partitionBy("stem").orderBy("archive")) - 1
    named = F.when(number > 0, F.concat_ws("_", "stem", number.cast("string"))).otherwise(F.col("stem"))
    folders = archives.select(F.col("archive").alias("n_archive"), named.alias("folder"))
    inside = F.regexp_replace("member", r"\\", "/")
    placed = index.join(folders, F.col("archive") == F.col("n_archive")).withColumn(
        "path", F.concat_ws("/", F.lit(folder.rstrip("/")), "folder", inside)
    )
    work = _dealt(placed.drop("n_archive", "folder"))
    return materialize(work.mapInArrow(_written, "archive string, member string, path string, length long"), "unzipped")
