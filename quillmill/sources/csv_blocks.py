"""Delimited files with cells that span lines, read in blocks.

Whether a line break ends a row depends on every quote before it. So each block first says what it
does to the two states it can be entered in, between rows or inside a quoted cell; the maps of a
file's blocks are composed in order; and then every block is read on its own, from its first true
start of a row to the end of the last row that starts in it.

Rows end in ``\\n`` or ``\\r\\n``. A quote opens a cell only as its first character, a doubled quote
inside a quoted cell is one quote, and what follows a closed quote belongs to the cell.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import materialize
from quillmill.sources.storage import BLOCK_BYTES, blocks_of, dealt, entry_states, opened

_READ_BYTES = 1 << 20
#: Bytes of rows that are handed on at a time.
_BATCH_BYTES = 4 << 20
BETWEEN, INSIDE = 0, 1


class Quotes:
    """Tells whether a line ends between rows or inside a quoted cell."""

    def __init__(self, sep: str) -> None:
        s = re.escape(sep).encode()
        quoted_rest = rb'(?:[^"]++|"")*+"[^' + s + rb"]*+"
        field = rb'(?:"' + quoted_rest + rb'|[^"' + s + rb"][^" + s + rb"]*+|)"
        more = rb"(?:" + s + field + rb")*+"
        self.patterns = {BETWEEN: re.compile(field + more), INSIDE: re.compile(quoted_rest + more)}

    def after(self, line: bytes, state: int) -> int:
        if b'"' not in line:
            return state
        return BETWEEN if self.patterns[state].fullmatch(line) else INSIDE


def lines_from(file: pa.NativeFile, start: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, line)`` of the lines that begin at ``start`` or later, without their line feed."""
    # The byte before tells whether a line begins at the start itself.
    file.seek(max(0, start - 1))
    at = max(0, start - 1)
    pieces: list[bytes] = []
    skips = start > 0
    while block := file.read(_READ_BYTES):
        first, *others = block.split(b"\n")
        pieces.append(first)
        for other in others:
            line = b"".join(pieces)
            if not skips:
                yield at, line
            skips = False
            at += len(line) + 1
            pieces = [other]
    line = b"".join(pieces)
    if line and not skips:
        yield at, line


def _maps(sep: str, block_bytes: int) -> Callable:
    quotes = Quotes(sep)
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("map", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                files, place = opened(path)
                ends = [BETWEEN, INSIDE]
                with files.open_input_file(place) as file:
                    for offset, line in lines_from(file, start):
                        if offset >= start + block_bytes:
                            break
                        if b'"' in line:
                            ends = [quotes.after(line, state) for state in ends]
                yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "map": ends}], schema=schema)

    return run


def block_states(files: DataFrame, sep: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, start, state`` for every block of ``files(path, length)``."""
    blocks = blocks_of(files.select("path", "length"), block_bytes)
    maps = blocks.mapInArrow(_maps(sep, block_bytes), "path string, start long, map array<long>")
    return entry_states(maps, lambda: (BETWEEN,), lambda state, one: (one[state[0]],), "state long")


def rows_from(file: pa.NativeFile, start: int, end: int, state: int, quotes: Quotes) -> Iterator[bytes]:
    """The rows that start in a block, which may end behind it; lines inside them keep their ends."""
    held: list[bytes] = []
    for offset, line in lines_from(file, start):
        if offset == 0:
            line = line.removeprefix(b"\xef\xbb\xbf")
        if state == INSIDE and not held:
            # The rest of a row that started before.
            state = quotes.after(line, state)
            if offset >= end:
                return
            continue
        if not held and offset >= end:
            return
        held.append(line)
        state = quotes.after(line, state)
        if state == BETWEEN:
            row = b"\n".join(held).removesuffix(b"\r")
            held = []
            if row.strip(b" \r"):
                yield row
    if held:
        yield b"\n".join(held).removesuffix(b"\r")


def _rows(sep: str, block_bytes: int) -> Callable:
    quotes = Quotes(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                files, place = opened(block["path"])
                start, rows, size = block["start"], [], 0
                with files.open_input_file(place) as file:
                    found = rows_from(file, start, start + block_bytes, block["state"], quotes)
                    if start == 0:
                        next(found, None)  # the header
                    for row in found:
                        rows.append(row.decode("utf-8" if block["utf8"] else "latin-1", "replace"))
                        size += len(row)
                        if size >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["record"])
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["record"])

    return run


def read_records(files: DataFrame, states: DataFrame | None, sep: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``files(path, length, utf8)`` as text, headers left out. ``states`` has the state of
    each block; without it no cell spans lines."""
    blocks = blocks_of(files.select("path", "length", "utf8"), block_bytes)
    if states is None:
        blocks = blocks.withColumn("state", F.lit(BETWEEN).cast("long"))
    else:
        known = states.select(F.col("path").alias("s_path"), F.col("start").alias("s_start"), "state")
        blocks = blocks.join(known, (F.col("path") == F.col("s_path")) & (F.col("start") == F.col("s_start")))
        blocks = dealt(materialize(blocks.select("path", "length", "utf8", "start", "state"), "csv-blocks"))
    return blocks.mapInArrow(_rows(sep, block_bytes), "record string")


def _firsts(sep: str) -> Callable:
    quotes = Quotes(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                files, place = opened(one["path"])
                with files.open_input_file(place) as file:
                    row = next(rows_from(file, 0, 1, BETWEEN, quotes), b"")
                header = row.decode("utf-8" if one["utf8"] else "latin-1", "replace")
                yield pa.RecordBatch.from_pylist([{"h_path": one["path"], "first": header}])

    return run


def first_records(files: DataFrame, sep: str) -> DataFrame:
    """``h_path, first``: the header of each of ``files(path, utf8)``, which may span lines."""
    return files.select("path", "utf8").mapInArrow(_firsts(sep), "h_path string, first string")


def column_names(header: str, sep: str) -> list[str]:
    """The columns a header names, as Spark's reader would call them: numbered where they are empty or
    repeat in any case."""
    names = next(csv.reader(io.StringIO(header, newline=""), delimiter=sep), [])
    lower = [name.lower() for name in names]
    return [
        f"_c{i}" if not name else f"{name}{i}" if lower.count(name.lower()) > 1 else name for i, name in enumerate(names)
    ]


def parsed(records: DataFrame, ddl: str, sep: str) -> DataFrame:
    """Rows of text as columns."""
    options = {"sep": sep, "escape": '"', "multiLine": "true"}
    return records.select(F.from_csv("record", F.lit(ddl), options).alias("row")).select("row.*")
