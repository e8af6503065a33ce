"""JSON documents of any size, cut into the items of their list by many tasks.

Where an item of a list ends depends on every quote and bracket before it. A block of a file can be
entered between strings, inside one, or right behind a backslash in one; it says for each of these
states how it is left, and by how much the nesting depth changes. The maps of a file's blocks are
composed in order. With its true state, each block then finds the keys at the top of the document,
which tell where the list is, and cuts the items that start in it at the commas of the list's depth.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import materialize
from quillmill.sources.storage import blocks_of, dealt, entry_states, opened

#: Bytes of a block, and of what is read behind it at a time.
BLOCK_BYTES = 16 << 20
_AHEAD = 1 << 20
#: Where a list may be in an object, the first one that holds a list wins.
LIST_KEYS = ["data", "records"]
OUT, STRING, ESCAPED = 0, 1, 2
_ESCAPES = re.compile(rb"\\[\s\S]")
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "[]{},:"]] = True
#: Past the end of any file.
_FAR = 1 << 62
_BLANK = b" \t\r\n"


class Scan:
    """The structure of some bytes, given the state they are entered in."""

    def __init__(self, data: bytes, state: int, depth: int = 0) -> None:
        if state == ESCAPED:
            data = b"." + data[1:]
        masked = _ESCAPES.sub(b"..", data) if b"\\" in data else data
        codes = np.frombuffer(masked, np.uint8)
        quotes = np.flatnonzero(codes == ord('"'))
        inside = int(state != OUT)
        marks = np.flatnonzero(_MARKS[codes])
        marks = marks[(np.searchsorted(quotes, marks) + inside) % 2 == 0]
        self.codes = codes[marks]
        self.places = marks
        self.depths = depth + np.cumsum(_STEP[self.codes])
        self.depth = int(self.depths[-1]) if len(marks) else depth
        ends_inside = (len(quotes) + inside) % 2
        self.state = (ESCAPED if masked.endswith(b"\\") else STRING) if ends_inside else OUT

    def at(self, code: str, depth: int) -> np.ndarray:
        """Places of a mark that leaves the given depth."""
        return self.places[(self.codes == ord(code)) & (self.depths == depth)]


def block_map(data: bytes) -> list[int]:
    """Per state of entry how the block is left, and the change of depth."""
    found = [Scan(data, state) for state in (OUT, STRING, ESCAPED)]
    return [n for one in found for n in (one.state, one.depth)]


def _step(state: tuple, one: list[int]) -> tuple:
    return one[2 * state[0]], state[1] + one[2 * state[0] + 1]


def _first_mark(file: pa.NativeFile, at: int, length: int) -> tuple[bytes, int]:
    """The first character at or after a place that is not blank, and where it is."""
    while at < length:
        file.seek(at)
        block = file.read(4096)
        rest = block.removeprefix(b"\xef\xbb\xbf" if at == 0 else b"").lstrip(_BLANK)
        if rest:
            return rest[:1], at + len(block) - len(rest)
        at += len(block)
    return b"", length


def _key_events(file: pa.NativeFile, data: bytes, start: int, length: int, scan: Scan) -> Iterator[tuple]:
    """``(key, where its value starts, whether that is a list, where the list ends or -1)`` of the keys of
    interest at the top of an object; and a row without a key for the first list that ends at the top."""
    closers = scan.at("]", 1)
    for place in scan.at(":", 1).tolist():
        before = data[max(0, place - 300) : place]
        if place < 300 and start:
            file.seek(max(0, start - 300))
            before = file.read(min(300, start)) + before
        before = before.rstrip(_BLANK)
        for key in LIST_KEYS:
            name = b'"' + key.encode() + b'"'
            if before.endswith(name) and before[: -len(name)][-1:] != b"\\":
                later = closers[closers > place]
                mark, value = _first_mark(file, start + place + 1, length)
                yield key, value, mark == b"[", start + int(later[0]) if len(later) else -1
    if len(closers):
        yield None, start + int(closers[0]), False, -1


def _layout(events: list[tuple]) -> tuple[int, int, int] | None:
    """``(depth of the items, where the list starts, where it ends)``; None if there is no list."""
    for key in LIST_KEYS:
        own = max((e for e in events if e[0] == key), key=lambda e: e[1], default=None)
        if own and own[2]:
            later = [e[1] for e in events if e[0] is None and e[1] > own[1]]
            return 2, own[1], own[3] if own[3] >= 0 else min(later, default=_FAR)
    return None


def _items(
    file: pa.NativeFile, start: int, size: int, length: int, state: int, depth: int, item_depth: int, first: int, end: int
) -> Iterator[bytes]:
    """The items of the list between ``first`` and ``end`` that start in a block."""
    file.seek(start)
    data = file.read(size)
    scan = Scan(data, state, depth)
    commas = scan.at(",", item_depth) + start
    begins = [first] if start <= first < start + size else []
    begins += commas[(commas > first) & (commas < end)].tolist()
    if not begins:
        return
    closers = scan.at("]", item_depth - 1) + start
    ends = begins[1:] + closers[closers > begins[-1]][:1].tolist()
    for begin, stop in zip(begins, ends):
        yield data[begin + 1 - start : stop - start]
    if len(ends) == len(begins):
        return
    # The last one goes on behind the block.
    pieces, at = [data[begins[-1] + 1 - start :]], start + len(data)
    while at < length:
        file.seek(at)
        block = file.read(_AHEAD)
        scan = Scan(block, scan.state, scan.depth)
        stops = np.concatenate([scan.at(",", item_depth), scan.at("]", item_depth - 1)])
        if len(stops):
            pieces.append(block[: int(stops.min())])
            break
        pieces.append(block)
        at += len(block)
    yield b"".join(pieces)


def _as_line(item: bytes) -> str:
    try:
        text = item.decode("utf-8")
    except UnicodeDecodeError:
        text = item.decode("latin-1")
    # Line ends are blanks in JSON; inside strings they are escaped.
    return text.replace("\r", " ").replace("\n", " ").strip()


def _lines(items: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    lines, size = [], 0
    for item in items:
        line = _as_line(item)
        if line:
            lines.append(line)
            size += len(line)
        if size >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
            lines, size = [], 0
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])


def _whole(file: pa.NativeFile, at: int, length: int) -> Iterator[bytes]:
    file.seek(at)
    yield file.read(length - at)


def _root(file: pa.NativeFile, length: int, path: str) -> tuple[bytes, int]:
    """The first character of the document, and where it is."""
    kind, at = _first_mark(file, 0, length)
    if kind and kind not in b"[{":
        raise ValueError(f"unsupported JSON payload in {path}")
    return kind, at


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of one block: state and layout are known at once."""
    for batch in batches:
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
            files, place = opened(path)
            with files.open_input_file(place) as file:
                kind, at = _root(file, length, path)
                layout = None
                if kind == b"[":
                    layout = 1, at, length
                elif kind == b"{":
                    file.seek(0)
                    data = file.read(length)
                    layout = _layout(list(_key_events(file, data, 0, length, Scan(data, OUT))))
                if layout:
                    yield from _lines(_items(file, 0, length, length, OUT, 0, *layout))
                elif kind:
                    yield from _lines(_whole(file, at, length))


def _each_block(block_bytes: int, visit: Callable, fields: list[tuple]) -> Callable:
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                files, place = opened(block["path"])
                with files.open_input_file(place) as file:
                    file.seek(block["start"])
                    rows = list(visit(file, file.read(block_bytes), block))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _map_of(file: pa.NativeFile, data: bytes, block: dict) -> Iterator[dict]:
    yield {"path": block["path"], "start": block["start"], "map": block_map(data)}


def _facts_of(file: pa.NativeFile, data: bytes, block: dict) -> Iterator[dict]:
    at = {"path": block["path"], "start": block["start"]}
    if block["start"] == 0:
        kind, place = _root(file, block["length"], block["path"])
        yield at | {"key": "[" if kind == b"[" else "{" if kind else "", "place": place, "is_list": False, "closer": -1}
    scan = Scan(data, block["state"], block["depth"])
    for key, place, is_list, closer in _key_events(file, data, block["start"], block["length"], scan):
        yield at | {"key": key, "place": place, "is_list": is_list, "closer": closer}


def _layout_of(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    root = next(r for r in rows if r["key"] in ("[", "{", ""))
    layout = (1, root["place"], _FAR) if root["key"] == "[" else None
    if root["key"] == "{":
        layout = _layout([(r["key"], r["place"], r["is_list"], r["closer"]) for r in rows if r is not root])
    # Without a list the whole document is one row, which its first block reads.
    item_depth, first, end = layout or (0, root["place"], 0)
    return pa.table({"l_path": [root["path"]], "item_depth": [item_depth], "first": [first], "end": [end]})


def _cut(block_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                files, place = opened(b["path"])
                with files.open_input_file(place) as file:
                    if b["item_depth"]:
                        yield from _lines(
                            _items(file, b["start"], block_bytes, b["length"], b["state"], b["depth"], b["item_depth"], b["first"], b["end"])
                        )
                    elif b["start"] == 0 and b["first"] < b["length"]:
                        yield from _lines(_whole(file, b["first"], b["length"]))

    return run


def json_lines(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``value``: the rows of JSON documents ``files(path, length)``, one line of text each. A document is
    a list, an object whose ``data`` or ``records`` is a list, or one object, which is one row."""
    large = files.where(F.col("length") > block_bytes)
    small = files.where(F.col("length") <= block_bytes)
    lines = dealt(small).mapInArrow(_small, "value string")
    if large.isEmpty():
        return lines
    blocks = materialize(blocks_of(large.select("path", "length"), block_bytes), "json-blocks")
    place = [("path", pa.string()), ("start", pa.int64())]
    maps = blocks.mapInArrow(
        _each_block(block_bytes, _map_of, [*place, ("map", pa.list_(pa.int64()))]), "path string, start long, map array<long>"
    )
    states = entry_states(maps, lambda: (OUT, 0), _step, "state long, depth long")
    states = states.select(F.col("path").alias("s_path"), F.col("start").alias("s_start"), "state", "depth")
    known = blocks.join(states, (F.col("path") == F.col("s_path")) & (F.col("start") == F.col("s_start")))
    known = materialize(known.select("path", "length", "start", "state", "depth"), "json-states")
    facts = [*place, ("key", pa.string()), ("place", pa.int64()), ("is_list", pa.bool_()), ("closer", pa.int64())]
    found = dealt(known).mapInArrow(
        _each_block(block_bytes, _facts_of, facts),
        "path string, start long, key string, place long, is_list boolean, closer long",
    )
    layouts = materialize(
        found.groupBy("path").applyInArrow(_layout_of, "l_path string, item_depth long, first long, end long"),
        "json-layouts",
    )
    work = known.join(layouts, F.col("path") == F.col("l_path")).drop("l_path")
    return lines.unionByName(dealt(materialize(work, "json-work")).mapInArrow(_cut(block_bytes), "value string"))
