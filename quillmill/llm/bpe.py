"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is encoded as a tree: halves are encoded on their own and joined. Joining keeps every token
that no cut can change and encodes a window around the cut again, which grows until it fits:

- Between pieces (matches of the split pattern): a match is settled by the characters up to the
  second one after its end, so all pieces of the left half but its last two are final; from there
  on, matching runs again until it starts a settled piece where the right half starts one too.
- Inside a piece: a token row is the BPE encoding of its bytes exactly if every two neighbours are
  the encoding of their joined bytes. The window grows on the side whose pair does not hold, by one
  token, then two, then four, until the pairs at both of its ends hold.

Decoding concatenates bytes up the same tree. Nulls count as the empty text, which has no tokens.
Whole texts are encoded whatever their length; other columns are kept by ``encode_documents``,
and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import common
from quillmill.llm.merges import LONGEST_REMEMBERED, REMEMBERED, Merges
from quillmill.llm.pieces import splitter

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of a text, and bytes of a piece, that are encoded without halving.
LEAF_CHARS = 32_768
LEAF_BYTES = 6


class Codec(Merges):
    """The vocabulary on one worker, and the encodings it remembers. Tokens are their ranks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        merged = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    merged[left << 20 | right] = rank
        super().__init__({rank: token for token, rank in ranks.items()}, merged)
        self.split = splitter()
        self.leaves: dict[bytes, list[int]] = {}
        self.known: dict[str, list[int]] = {}
        self.spelled: dict[str, tuple[str, bytes]] = {}

    # Inside a piece.

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left or right
        take, give, grow = len(left) - 1, 1, 1
        window = self.window(left[take], right[0])
        while True:
            starts = take == 0 or self.fits(left[take - 1], window[0])
            ends = give == len(right) or self.fits(window[-1], right[give])
            if starts and ends:
                return [*left[:take], *window, *right[give:]]
            # A side that does not fit grows by twice as many tokens each time.
            take = take if starts else max(0, take - grow)
            give = give if ends else min(len(right), give + grow)
            grow *= 2
            window = self.merge(self.decode([*left[take:], *right[:give]]))

    def tokens(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            found = self.leaves.get(data)
            if found is None:
                if len(self.leaves) >= REMEMBERED:
                    self.leaves.clear()
                found = self.leaves[data] = self.merge(data)
            return found
        half = len(data) // 2
        return self.join_tokens(self.tokens(data[:half]), self.tokens(data[half:]))

    def piece(self, piece: str) -> list[int]:
        ids = self.tokens(piece.encode("utf-8", "surrogatepass"))
        if len(piece) > LONGEST_REMEMBERED:
            return ids
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[piece] = ids
        return ids

    # Between pieces.

    def _rejoined(self, left: list[str], right: list[str]) -> list[str]:
        """The pieces of the joined texts of two rows of pieces."""
        if not left or not right:
            return left or right
        starts, at = {}, 0
        for i, piece in enumerate(right):
            starts[at] = i
            at += len(piece)
        window, taken = "".join(left[-2:]), 0
        cut = len(window)
        grow = 2
        while True:
            more = right[taken : taken + grow]
            window += "".join(more)
            taken += len(more)
            grow *= 2
            whole = taken == len(right)
            seen, place = [], 0
            for piece in self.split(window):
                settled = whole or place + 2 <= len(window)
                if settled and place >= cut and place - cut in starts:
                    return [*left[:-2], *seen, *right[starts[place - cut] :]]
                seen.append(piece)
                place += len(piece)
            if whole:
                return [*left[:-2], *seen]

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.split(text)
        half = len(text) // 2
        return self._rejoined(self.pieces(text[:half]), self.pieces(text[half:]))

    # Whole texts.

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for piece in self.pieces(text):
            ids += known.get(piece) or self.piece(piece)
        return ids

    def spell(self, piece: str) -> tuple[str, bytes]:
        """Decimal ids of a piece, and what they decode to."""
        ids = self.known.get(piece) or self.piece(piece)
        found = ",".join(map(str, ids)), self.decode(ids)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self.spelled) >= REMEMBERED:
                self.spelled.clear()
            self.spelled[piece] = found
        return found

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the decimal ids, digest of the bytes they decode to."""
        spelled, spell = self.spelled, self.spell
        rows = [spelled.get(piece) or spell(piece) for piece in self.pieces(text)]
        ids = ",".join([row[0] for row in rows])
        decoded = b"".join([row[1] for row in rows])
        count = ids.count(",") + 1 if rows else 0
        return count, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=4)
def codec(name: str) -> Codec:
    return Codec(public_tokenizers.path(name))


def encode_documents(
    df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, ids: str = "ids"
) -> DataFrame:
    """Add the token ids of a text; row-local, no shuffle."""
    encode = common.per_value(lambda text: codec(vocabulary).encode(text), "array<int>")
    return df.withColumn(ids, encode(common.text_of(text_col)))


def decode_documents(
    df: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY, decoded: str = "decoded"
) -> DataFrame:
    """Add the bytes of an array of token ids; a null array counts as an empty one."""
    decode = common.per_value(lambda ids: codec(vocabulary).decode(ids), "binary")
    return df.withColumn(decoded, decode(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes per document.

    Encoding and decoding share one pass; the ids themselves do not leave the worker. Both
    concatenate what a worker remembers of each piece: its ids, and the bytes these ids decode to.
    """

    names = ("n_tokens", "ids_sha256", "decoded_sha256")

    def digest(text: str) -> dict:
        return dict(zip(names, codec(vocabulary).round_trip(text)))

    run = common.per_value(digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return df.select(F.col(id_col), run(common.text_of(text_col)).alias("_d")).select(id_col, "_d.*")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
