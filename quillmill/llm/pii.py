"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mails, addresses, cards and phones. They and a shape for long mixed tokens are
the seeds. Every identifier-like value of a text is an instance and its surroundings induce lexical
patterns: the lexemes before it, those behind it, and a leading word of its own. A pattern is trusted
for a kind as far as the distinct instances it holds are of that kind, and accepted from a threshold
on; an instance is as trusted as the accepted patterns it stands in make it. Both are scored in turn
on the graph of patterns and instances, with seeds held fixed, until the accepted patterns and their
trust stand still. Trust never falls, so that happens however many steps from a seed a pattern is.
Values in accepted patterns that no base pattern matches are added as spans.

Null and empty texts have no spans. Every row is scanned on its own, so repeated rows get equal
spans; they count once in the graph, which is made of distinct instances. Other columns are not
read, and an empty table gives an empty result. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import common

#: In the order in which spans with one start are listed; the last is found by the method only.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Shorter values are no identifiers.
LEAST_CHARS = 6
#: Characters before and behind a value that its patterns are taken from.
CONTEXT = 64
#: Rounds go on while more patterns are accepted, or some trust rises by more than this.
STILL = 0.001
#: Distinct seed instances that a pattern must hold, and the least trust to accept it.
SUPPORT = 3
TRUST = 0.8

# The base patterns.
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits would also start where the run does.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+/-]*[A-Za-z0-9]")
_LEXEME = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_DIGIT = re.compile("[0-9]")
_HEAD = re.compile("[A-Z]{4}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if i % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+`` and a host, from each ``@`` outwards: a search from the left
    would try every character of a long word."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        if start < at and (host := _EMAIL_HOST.match(text, at)):
            yield start, host.end()
            free = host.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base patterns, in order."""
    found = [(start, 0, end) for start, end in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _mixed(value: str) -> bool:
    """The seed shape of a secret: long, of letters and several digits."""
    digits = sum(c.isdigit() for c in value)
    return len(value) >= 16 and digits >= 2 and len(value) - digits >= 2


def _patterns(text: str, start: int, end: int, value: str) -> list[str]:
    """Two and three lexemes before the value, two and three behind it, and the capitals it begins with."""
    before = _LEXEME.findall(text[max(0, start - CONTEXT) : start].lower())
    after = _LEXEME.findall(text[end : end + CONTEXT].lower())
    found = ["before " + " ".join(before[-n:]) for n in (2, 3) if len(before) >= n]
    found += ["after " + " ".join(after[:n]) for n in (2, 3) if len(after) >= n]
    if _HEAD.match(value):
        found.append("head " + value[:4])
    return found


def scan(text: str) -> dict:
    """Base spans, and each instance with its seed kind (-1: none), hash, place and patterns."""
    base = base_spans(text)
    instances = [(kind, start, end, text[start:end], True) for start, kind, end in base]
    free = 0  # everything before this offset is left behind or covered by base spans
    ahead = iter([*base, (len(text) + 1, 0, len(text) + 1)])
    start_next, _, end_next = next(ahead)
    for m in _VALUE.finditer(text) if _DIGIT.search(text) else ():
        start, end = m.span()
        while start_next < end:
            free = max(free, end_next)
            start_next, _, end_next = next(ahead)
        value = m.group()
        if start >= free and len(value) >= LEAST_CHARS and _DIGIT.search(value):
            instances.append((4 if _mixed(value) else -1, start, end, value, False))
    return {
        "base": [{"start": s, "kind": k, "end": e} for s, k, e in base],
        "instances": [
            {
                "seed": kind,
                "start": start,
                "end": end,
                "value": xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - 2**63,
                "is_base": is_base,
                "patterns": _patterns(text, start, end, value),
            }
            for kind, start, end, value, is_base in instances
        ],
    }


SCAN = (
    "base array<struct<start:int,kind:int,end:int>>, instances array<struct<seed:int,start:int,end:int,"
    "value:long,is_base:boolean,patterns:array<string>>>"
)


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """``pattern, kind, trust`` of the accepted patterns, from distinct ``pattern, value, seed``.

    Trust of a pattern is the mean trust of its instances; an instance that no seed explains has
    1 less the product of its accepted patterns' doubts. Rounds run over the same staged edges; a hot
    pattern or instance is summed before the shuffle, and AQE can split the joins, whose other side is
    a table with one row per key. Two numbers per round come to the driver.
    """
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    held = edges.where("seed >= 0").select("pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("trust"))
    sizes = common.staged(sizes, "pii-sizes")
    accepted = (F.col("mass") >= SUPPORT) & (F.col("trust") >= TRUST)
    before, known = None, -1
    while True:
        sums = held.groupBy("pattern", "kind").agg(F.sum("trust").alias("mass"))
        scored = sums.join(sizes, "pattern").select("pattern", "kind", "mass", (F.col("mass") / F.col("n")).alias("trust"))
        if before is not None:
            last = before.select(F.col("pattern").alias("l_pattern"), F.col("kind").alias("l_kind"), F.col("trust").alias("last"))
            same = (F.col("pattern") == F.col("l_pattern")) & (F.col("kind") == F.col("l_kind"))
            scored = scored.join(last, same, "left").drop("l_pattern", "l_kind")
        else:
            scored = scored.withColumn("last", F.lit(None).cast("double"))
        scored = common.staged(scored, "pii-patterns")
        rise = F.max(F.col("trust") - F.coalesce("last", F.lit(0.0)))
        now, risen = scored.agg(F.count_if(accepted), F.coalesce(rise, F.lit(0.0))).first()
        if now == known and risen <= STILL:
            return scored.where(accepted).select("pattern", "kind", "trust")
        before, known = scored, now
        spread = edges.where("seed < 0").select("pattern", "value").join(
            scored.where(accepted).select("pattern", "kind", "trust"), "pattern"
        )
        doubts = spread.groupBy("value", "kind").agg(
            F.sum(F.log(F.greatest(1.0 - F.col("trust"), F.lit(1e-9)))).alias("doubt")
        )
        learned = doubts.select("value", "kind", (1.0 - F.exp("doubt")).alias("trust"))
        again = edges.where("seed < 0").select("pattern", F.col("value").alias("e_value")).join(
            learned, F.col("e_value") == F.col("value")
        )
        held = edges.where("seed >= 0").select(
            "pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("trust")
        ).unionByName(again.select("pattern", "value", "kind", "trust"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``base`` and ``added`` spans per document, arrays of ``(start, kind, end)``.

    The texts are read once; what is staged holds identifiers and their contexts only.
    """
    read = common.per_value(scan, SCAN)
    scanned = common.staged(
        df.select(F.col(id_col).alias("id"), read(common.text_of(text_col)).alias("s")).select("id", "s.*"),
        "pii-scan",
        row="row",
    )
    places = scanned.select("row", F.explode("instances").alias("i")).select("row", "i.*")
    places = places.withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = common.staged(
        places.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges"
    )
    trusted = trusted_patterns(edges).select(F.col("pattern").alias("t_pattern"), "kind", "trust")
    added = (
        places.where("not is_base")
        .join(trusted, F.col("pattern") == F.col("t_pattern"))
        .groupBy("row", "start", "end")
        .agg(F.max(F.struct("trust", "kind"))["kind"].alias("kind"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    )
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return scanned.join(added, "row", "left").select("id", "base", F.coalesce("added", nothing).alias("added"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.documents(spark, sf_dir))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[number(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
