"""Token counts from a tokenizer compiled to a finite-state transducer.

Byte-level BPE is rational: after any bytes of a piece, the last token of their encoding is the one
token that ends there and may follow the last token of what precedes it (two tokens may be
neighbours exactly if they are the encoding of their joined bytes). What can still matter later is
bounded: the longest suffix that some token begins with, and at each place inside it the last token
and the count up to there. That is a state; a transition reads a byte and is annotated with the
change of the token count. States are compiled when first reached and shared by all texts.

A text is counted in chunks. A chunk maps the state in which it is entered to the one in which it
is left; since a space after another character always ends a piece, whatever state it is entered
in, the map needs no table of states: it is the places of the first and last such space, and the
count between them. What lies outside is counted, from the state in which a piece begins, once the
neighbours close it. Maps compose associatively and hold places only, never text; they are composed
from the left, and only the last prefix, which is the count of the whole text, is kept.

Nulls count as the empty text (no bytes, no tokens). Whole texts are counted whatever their
length. Special strings inside a text count as one token each, as the library counts them. Other
columns are kept by ``count_tokens``; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache, reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import common
from quillmill.llm.merges import LONGEST_REMEMBERED, Merges
from quillmill.llm.pieces import spans, splitter

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK_CHARS = 65_536
#: States, and pieces, that a worker remembers.
MOST_STATES = 600_000
MOST_PIECES = 300_000

_SURE_CUT = re.compile(r"(?<=\S)[ \n]")

#: A chunk's map: where it starts, its first sure cut, tokens from there to its last one, where that
#: is, and where the chunk ends. Cuts are None where it has none.
ChunkMap = tuple[int, int | None, int, int | None, int]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves,
    the others in their order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Transducer(Merges):
    """Counts tokens of pieces; its transitions are compiled on demand."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        in_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        tokens = [bytes([b]) for b in range(256)]
        number = {token: i for i, token in enumerate(tokens)}
        merged = {}
        for merge in spec["model"]["merges"]:
            left, right = map(in_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            merged[number[left] << 20 | number[right]] = len(tokens)
            number.setdefault(left + right, len(tokens))
            tokens.append(left + right)
        super().__init__(dict(enumerate(tokens)), merged)
        # A token that its own bytes are not merged into never comes up.
        self.beginnings = {t[:n] for t in number for n in range(1, len(t) + 1)}
        self.split, self.spans = splitter(), spans()
        self.alone: dict[int, bool] = {}
        self.pieces: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        # A state: the live suffix, and for each place back from its end the last token (-1: the
        # piece begins here) and the tokens since.
        self.states: list[tuple[bytes, tuple, tuple]] = [(b"", (-1,), (0,))]
        self.numbers: dict[tuple[bytes, tuple, tuple], int] = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def _may_begin(self, token: int) -> bool:
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self.merge(self.bytes_of[token]) == [token]
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, lasts, counts = self.states[state]
        suffix += bytes([byte])
        while suffix not in self.beginnings:
            suffix = suffix[1:]
        size = len(suffix)
        for start in range(size):
            token = self.token_of.get(suffix[start:])
            if token is not None:
                before = lasts[size - start - 1]
                if self._may_begin(token) if before < 0 else self.fits(before, token):
                    break
        change = 1 - counts[size - start - 1]
        reached = suffix, (token, *lasts[:size]), (0, *[n + change for n in counts[:size]])
        steps = self.steps[state]
        if reached not in self.numbers and len(self.states) >= MOST_STATES:
            self._restart()
        number = self.numbers.setdefault(reached, len(self.states))
        if number == len(self.states):
            self.states.append(reached)
            self.steps.append({})
        step = number, change
        steps[byte] = step
        return step

    def count_piece(self, piece: str) -> int:
        """Run the transducer over a piece and sum what its transitions are annotated with."""
        count = self._run(piece, 0, len(piece))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self.pieces) >= MOST_PIECES:
                self.pieces.clear()
            self.pieces[piece] = count
        return count

    def _run(self, text: str, start: int, end: int) -> int:
        state = count = 0
        for at in range(start, end, CHUNK_CHARS):
            for byte in text[at : min(end, at + CHUNK_CHARS)].encode("utf-8", "surrogatepass"):
                step = self.steps[state].get(byte) or self._compile(state, byte)
                state = step[0]
                count += step[1]
        return count

    def count_plain(self, text: str) -> int:
        known, run = self.pieces, self.count_piece
        return sum([known.get(piece) or run(piece) for piece in self.split(text)])

    def count_between(self, text: str, start: int, end: int) -> int:
        """The same of a part of a text; of a long part, no more than a piece or a chunk is copied."""
        if end - start <= CHUNK_CHARS:
            return self.count_plain(text[start:end])
        total, known = 0, self.pieces
        for a, b in self.spans(text, start, end):
            if b - a > LONGEST_REMEMBERED:
                total += self._run(text, a, b)
            else:
                piece = text[a:b]
                total += known.get(piece) or self.count_piece(piece)
        return total

    # Chunks.

    def chunk_map(self, text: str, start: int, end: int) -> ChunkMap:
        found = _SURE_CUT.search(text, start, end)
        if found is None:
            return start, None, 0, None, end
        first, last = found.start(), end
        while True:
            last = max(text.rfind(" ", first, last), text.rfind("\n", first, last))
            if _SURE_CUT.match(text, last):
                break
        return start, first, self.count_between(text, first, last), last, end

    def compose(self, text: str, left: ChunkMap, right: ChunkMap) -> ChunkMap:
        """The map of two neighbours in ``text``."""
        if right[1] is None:
            return *left[:4], right[4]
        if left[1] is None:
            return left[0], *right[1:]
        between = self.count_between(text, left[3], right[1])
        return left[0], left[1], left[2] + between + right[2], right[3], right[4]

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        for special in self.special:
            parts = [piece for part in parts for piece in part.split(special)]
        total += len(parts) - 1
        for part in parts:
            if len(part) <= CHUNK_CHARS:
                total += self.count_plain(part)
            else:
                size = len(part)
                maps = (self.chunk_map(part, i, min(size, i + CHUNK_CHARS)) for i in range(0, size, CHUNK_CHARS))
                _, first, middle, last, _ = reduce(lambda left, right: self.compose(part, left, right), maps)
                if first is None:
                    total += self.count_between(part, 0, size)
                else:
                    total += self.count_between(part, 0, first) + middle + self.count_between(part, last, size)
        return total


@lru_cache(maxsize=4)
def transducer(name: str) -> Transducer:
    return Transducer(public_tokenizers.path(name))


def counter(vocabulary: str = VOCABULARY) -> Callable:
    """A column function: the number of tokens of a text."""
    return common.per_value(lambda text: transducer(vocabulary).count(text), "long")


def count_tokens(
    df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit``; row-local, no shuffle."""
    text = common.text_of(text_col)
    return (
        df.withColumn("n_bytes", F.octet_length(text).cast("long"))
        .withColumn("n_tokens", counter(vocabulary)(text))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
