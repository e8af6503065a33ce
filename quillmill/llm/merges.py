"""The merge rules of a byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterable
from heapq import heapify, heappop, heappush

#: Pieces, halves and windows a worker remembers, each.
REMEMBERED = 300_000
#: Longer pieces (characters) are not remembered, which bounds what is in bytes.
LONGEST_REMEMBERED = 256
#: More bytes than this are merged by way of a heap.
SCANNED_BYTES = 96
#: Above every token.
NEVER = 2**62


class Merges:
    """Merge rules on one worker. Tokens are numbers in the order in which they are merged."""

    def __init__(self, bytes_of: dict[int, bytes], merged: dict[int, int]) -> None:
        """``merged`` maps ``left << 20 | right`` to the token that the two merge into."""
        self.bytes_of = bytes_of
        self.merged = merged
        self.token_of: dict[bytes, int] = {}
        for token, data in bytes_of.items():
            self.token_of.setdefault(data, token)
        self.byte = [self.token_of[bytes([i])] for i in range(256)]
        self.windows: dict[int, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: join the neighbours of lowest rank, leftmost first, until none is left."""
        if len(data) > SCANNED_BYTES:
            return self._merge_long(data)
        rank_of = self.merged.get
        ids = [self.byte[b] for b in data]
        ranked = [rank_of(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranked and (best := min(ranked)) != NEVER:
            i = ranked.index(best)
            ids[i : i + 2] = [best]
            del ranked[i]
            if i:
                ranked[i - 1] = rank_of(ids[i - 1] << 20 | best, NEVER)
            if i < len(ranked):
                ranked[i] = rank_of(best << 20 | ids[i + 1], NEVER)
        return ids

    def _merge_long(self, data: bytes) -> list[int]:
        """The same in n log n: neighbours wait in a heap, and those that have changed are skipped."""
        rank_of, size = self.merged.get, len(data)
        ids = [self.byte[b] for b in data]
        before, after = [*range(-1, size - 1)], [*range(1, size + 1)]
        ranks = [*(rank_of(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])), NEVER]
        waiting = [(rank, i) for i, rank in enumerate(ranks) if rank != NEVER]
        heapify(waiting)
        while waiting:
            rank, i = heappop(waiting)
            if ranks[i] != rank:
                continue
            gone = after[i]
            ids[i], after[i] = rank, after[gone]
            ids[gone], ranks[gone] = -1, NEVER
            if after[i] < size:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else size
                if left >= 0:
                    ranks[left] = rank_of(ids[left] << 20 | ids[right], NEVER) if right < size else NEVER
                    if ranks[left] != NEVER:
                        heappush(waiting, (ranks[left], left))
        return [token for token in ids if token >= 0]

    def window(self, left: int, right: int) -> list[int]:
        """The encoding of the bytes of two tokens; the two themselves if they may be neighbours."""
        key = left << 20 | right
        found = self.windows.get(key)
        if found is None:
            if len(self.windows) >= REMEMBERED:
                self.windows.clear()
            found = self.windows[key] = self.merge(self.bytes_of[left] + self.bytes_of[right])
        return found

    def fits(self, left: int, right: int) -> bool:
        return self.window(left, right) == [left, right]

    def decode(self, ids: Iterable[int]) -> bytes:
        """Concatenation of the tokens' bytes; ``bytes.join`` is the flat form of the tree."""
        return b"".join(map(self.bytes_of.__getitem__, ids))
