"""WARC archives of pages, and their index as one ordered list of captures.

Every page becomes a record; among equal payloads the smallest page is the response and the others
revisit it. Archives are written with captures in the order of their URL keys, so each is a locally
sorted run of the index. The runs are dealt into key ranges and every range is merged by a loser
tree over its runs: ranges and places in them give the global order of capture histories. Archives
of others are read as well, with a gzip member per record or one for all; times are in UTC.

Null payloads are empty; a null URL has an empty key and sorts first; a null page id is the lowest
id and comes back as null; line breaks inside a URL are escaped. Pages whose id repeats count as
one page: none of them revisits another. Equal keys and times are ordered by page id. Other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm import common
from quillmill.session import scratch_path

#: Equal payloads below this many bytes are stored again and again.
LEAST_BYTES = 100
#: Payloads of up to so many bytes share an archive with others, up to so many records; larger ones
#: have one of their own. An archive is read as one cell.
FILE_ROWS = {1 << 16: 4_000, 1 << 22: 60, 1 << 31: 1}
READ_BYTES = 1 << 16
#: Captures of a range, about, and sampled index keys per range that the ranges are cut by; the number
#: of ranges follows the number of captures.
RANGE_ROWS = 200_000
RANGE_SAMPLE = 8
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long,"
    " url_key string, captured string, archive string"
)


def url_key(url: Column) -> Column:
    """Host labels from the top down, then path and query: ``com,example)/path?query``."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""), "^[A-Za-z]+://", ""))
    host = F.regexp_extract(bare, r"^([^/:?]*)", 1)
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.when(bare == "", "").otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    )


def in_utc(when: Column) -> Column:
    """A time as WARC spells it, whatever the zone of the session."""
    seconds = F.unix_seconds(when.cast("timestamp"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")).cast("string")
    part = lambda size, of: F.lpad((F.floor(F.pmod(seconds, F.lit(86_400)) / size) % of).cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60), F.lit("Z"))


def decide(pages: DataFrame) -> DataFrame:
    """Add ``first``, the page a record revisits (null: it is a response), to ``k, html, ...``.

    The smallest page per digest is an aggregate of digests and ids; the join back has one row per
    digest on that side, so AQE can split a digest that many pages share.
    """
    sized = pages.withColumns({"digest": F.sha2(F.encode("html", "utf-8"), 256), "bytes": F.octet_length("html").cast("long")})
    firsts = (
        sized.where(F.col("bytes") >= LEAST_BYTES)
        .groupBy("digest")
        .agg(F.min("k").alias("low"), F.max("k").alias("high"))
        .where("low < high")
        .select(F.col("digest").alias("f_digest"), "low")
    )
    # As a table, this side brings no partitioning that would tie a hot payload to one task.
    firsts = common.staged(firsts, "first-payloads")
    joined = sized.join(firsts, F.col("digest") == F.col("f_digest"), "left")
    return joined.withColumn("first", F.when(F.col("low") < F.col("k"), F.col("low"))).drop("f_digest", "low")


def records(decided: DataFrame) -> DataFrame:
    """``value``, the text of each record without its closing blank lines, with ``url_key, captured, k``."""
    name = lambda k: F.concat(F.lit("<urn:x-page:"), F.nullif(k, F.lit(common.NULL_ID)).cast("string"), F.lit(">"))
    named = lambda k: F.coalesce(name(k), F.lit("<urn:x-page:>"))
    is_revisit = F.col("first").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
    )
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        named(F.col("k")),
        F.lit("\r\nWARC-Date: "),
        F.col("captured"),
        F.lit("\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(is_revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), named(F.col("first")))).otherwise(""),
        F.lit("\r\nX-URL-Key: "),
        F.regexp_replace(F.col("url_key"), r"[\r\n]", "%0A"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return decided.select("k", "url_key", "captured", F.concat(head, block).alias("value"))


def write_archives(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    captured_col: str | None = None,
) -> None:
    """Write a record per page to gzipped archives below ``path``, in any store Spark writes to.

    Without a column of capture times, a page is dated as many seconds after 2020 as its id says.
    """
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID))
    when = F.col(captured_col) if captured_col else F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(k, F.lit(2**31)))
    pages = df.select(
        k.alias("k"),
        F.col(url_col).cast("string").alias("url"),
        common.text_of(payload_col).alias("html"),
        F.coalesce(in_utc(when), F.lit("")).alias("captured"),
        url_key(F.col(url_col).cast("string")).alias("url_key"),
    )
    longest = pages.agg(F.coalesce(F.max(F.octet_length("html")), F.lit(0))).first()[0]
    least = -1
    for most, rows in FILE_ROWS.items():
        some = records(decide(pages).where(F.col("bytes").between(least + 1, most)))
        # A record is a line of the file, and its closing blank lines are the line's end.
        lines = some.sortWithinPartitions("url_key", "captured", "k").select("value")
        writer = lines.write.mode("append").option("lineSep", END).option("compression", "gzip")
        writer.option("maxRecordsPerFile", rows).text(path)
        if longest <= most:
            break
        least = most


class _Unpacked:
    """Reads an archive member by member and piece by piece; nothing is read or held twice."""

    def __init__(self, packed: bytes) -> None:
        self.view, self.at = memoryview(packed), 0
        self.inflate = zlib.decompressobj(31)
        self.begun = False
        self.held = bytearray()

    def _more(self) -> bool:
        if self.inflate.eof:
            # Archives usually have a gzip member per record; zeros may pad the end.
            rest = self.inflate.unused_data
            self.at -= len(rest)
            while self.at < len(self.view) and self.view[self.at] == 0:
                self.at += 1
            self.inflate, self.begun = zlib.decompressobj(31), False
        if self.at >= len(self.view):
            if self.begun:
                raise ValueError("archive ends inside a gzip member")
            return False
        block = self.view[self.at : self.at + READ_BYTES]
        self.begun = True
        self.at += len(block)
        self.held += self.inflate.decompress(block)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed over; None at the end."""
        searched = 0
        while (found := self.held.find(mark, searched)) < 0:
            searched = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("archive ends inside a record")
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """The next bytes, in pieces."""
        while size:
            if not self.held and not self._more():
                raise ValueError("archive ends inside a record")
            piece = bytes(self.held[:size])
            del self.held[: len(piece)]
            size -= len(piece)
            if piece:
                yield piece

    def skip_ends(self) -> None:
        """Pass over the line ends behind a record."""
        while True:
            while self.held and self.held[0] in b"\r\n":
                del self.held[:1]
            if self.held or not self._more():
                return


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by their names in lower case."""
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def key_of(url: str) -> str:
    """``url_key`` of one address."""
    bare = re.sub("^[A-Za-z]+://", "", re.sub("#.*$", "", url)).lower()
    if not bare:
        return ""
    host = re.match(r"[^/:?]*", bare)[0]
    rest = re.sub(r"^[^/?]*", "", bare)
    return ",".join(reversed(host.split("."))) + ")" + (rest or "/")


def parse_archive(packed: bytes) -> Iterator[dict]:
    """The responses, resources and revisits of an archive, its own or another's. Digest and size are
    those of the payload that was read, which has to match a SHA-256 digest the record gives; a revisit
    has what its record says. Ids are those of pages written here, else null."""
    data = _Unpacked(packed)

    def number(name: str) -> int | None:
        found = re.fullmatch("<urn:x-page:(-?[0-9]*)>", name)
        return found and int(found[1] or common.NULL_ID)

    while (head := data.until(END.encode())) is not None:
        fields = _fields(head.lstrip(b"\r\n"))
        kind, size = fields.get("warc-type"), int(fields["content-length"])
        http, digest, length = b"", hashlib.sha256(), 0
        # The payload starts behind the HTTP header, if there is one.
        in_head = fields.get("content-type", "").startswith("application/http")
        for piece in data.take(size):
            if in_head:
                http += piece
                cut = http.find(END.encode())
                if cut < 0:
                    continue
                http, piece, in_head = http[:cut], http[cut + len(END) :], False
            digest.update(piece)
            length += len(piece)
        data.skip_ends()
        if kind not in ("response", "resource", "revisit"):
            continue
        said = fields.get("warc-payload-digest", "")
        record = {
            "page_id": number(fields.get("warc-record-id", "")),
            "payload_bytes": length,
            "payload_digest": digest.hexdigest(),
            "record_type": kind,
            "refers_to": None,
            "url_key": fields.get("x-url-key", key_of(fields.get("warc-target-uri", "").strip("<>"))),
            "captured": fields.get("warc-date", ""),
        }
        if kind == "revisit":
            stored = _fields(http).get("content-length", "")
            record["payload_bytes"] = int(stored) if stored.isdigit() else None
            record["payload_digest"] = said.removeprefix("sha256:")
            record["refers_to"] = number(fields.get("warc-refers-to", ""))
        elif re.fullmatch("sha256:[0-9a-f]{64}", said) and said != f"sha256:{record['payload_digest']}":
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
        yield record


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in CAPTURES.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in CAPTURES.split(", ")])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = [record | {"archive": path} for record in parse_archive(content.as_buffer())]
            yield pa.RecordBatch.from_pylist(rows, schema=schema).select(names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives below ``path``; records of a file stay in its order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(_captures, CAPTURES)


class LoserTree:
    """Merges sorted runs: every inner node remembers the loser of its match, and a run that gives
    its head away replays the matches on its way to the top."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        self.losers = [0] * len(runs)
        self.winner = self._play(1) if runs else -1

    def _beats(self, a: int, b: int) -> bool:
        left, right = self.heads[a], self.heads[b]
        if left is None or right is None:
            return right is None and (left is not None or a < b)
        return left < right or (left == right and a < b)

    def _play(self, node: int) -> int:
        if node >= len(self.runs):
            return node - len(self.runs)
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[self.winner]) is not None:
            yield head
            won = self.winner
            self.heads[won] = next(self.runs[won], None)
            node = (won + len(self.runs)) // 2
            while node:
                if self._beats(self.losers[node], won):
                    won, self.losers[node] = self.losers[node], won
                node //= 2
            self.winner = won


def _ranged(cuts: list[tuple]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url_key", "captured", "page_id")]
            columns[2] = [common.NULL_ID if k is None else k for k in columns[2]]
            keys = zip(*columns)
            ranges = pa.array([bisect_right(cuts, key) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([ranges, *batch.columns], ["range_no", *batch.schema.names])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each range that was dealt to this partition."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    runs: dict[int, dict[str, list[tuple]]] = {}
    columns = [table.column(c).to_pylist() for c in ("range_no", "archive", "url_key", "captured", "page_id")]
    columns[4] = [common.NULL_ID if k is None else k for k in columns[4]]
    for row, (range_no, archive, *key) in enumerate(zip(*columns)):
        runs.setdefault(range_no, {}).setdefault(archive, []).append((*key, row))
    for range_no in sorted(runs):
        for run in runs[range_no].values():
            run.sort()  # linear: a run arrives in its order
        order = [head[-1] for head in LoserTree([iter(run) for run in runs[range_no].values()])]
        merged = table.take(order).append_column("range_place", pa.array(range(len(order)), pa.int64()))
        yield from merged.to_batches()


def _order_id(name: str) -> Column:
    """Records without an id come before all others of their address and time."""
    return F.coalesce(F.col(name), F.lit(common.NULL_ID)).alias(name)


def merge_index(captures: DataFrame) -> DataFrame:
    """The captures in global order of (URL key, time, page): by ``range_no``, then ``range_place``.

    ``captures`` is read three times and should be a table. The ranges are cut at quantiles of a
    sample of whole index keys, so a URL or host with many captures spreads over many ranges.
    """
    rows = captures.count()
    ranges = max(common.partitions(captures.sparkSession), rows // RANGE_ROWS)
    keys = captures.select("url_key", "captured", _order_id("page_id"))
    sample = sorted(tuple(r) for r in keys.sample(min(1.0, RANGE_SAMPLE * ranges / max(1, rows)), seed=7).collect())
    cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    fields = ", ".join(f"{c} {t}" for c, t in captures.dtypes)
    return (
        captures.mapInArrow(_ranged(cuts), f"range_no int, {fields}")
        .repartitionById(ranges, F.col("range_no"))
        .mapInArrow(_merged, f"range_no int, {fields}, range_place long")
    )


def global_places(merged: DataFrame) -> DataFrame:
    """Add ``index_place``, a capture's place (from 0) in the whole index, in place of its place in
    a range. Stages the index; the ranges before each one are summed in one row per range."""
    held = common.staged(merged, "capture-index")
    sizes = held.groupBy("range_no").count()
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        F.col("range_no").alias("s_range"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift")
    )
    # As a table, this side is broadcast if it is small.
    shifts = common.staged(shifts, "capture-shifts")
    placed = held.join(shifts, F.col("range_no") == F.col("s_range"))
    index_place = F.col("range_place") + F.col("shift")
    return placed.withColumn("index_place", index_place).drop("range_no", "s_range", "range_place", "shift")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = common.staged(read_archives(spark, path), "captures")
    index = global_places(merge_index(captures))
    null_id = F.lit(common.NULL_ID)
    return index.withColumns({c: F.nullif(F.col(c), null_id) for c in ("page_id", "refers_to")}).drop("archive")
