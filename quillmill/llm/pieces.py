"""Splitting a text into the pieces that byte-level BPE encodes one by one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import public_tokenizers
import regex

# The letters and spaces below U+0250, where the split pattern's classes are plain
# ranges. The superscripts and fractions of that range are left out: they are numbers, not digits.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_SPACES = r"\t-\r \x85\xa0"
_PLAIN = (
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACES}{_LETTERS}0-9]+"
    rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_NOT_PLAIN = "[^\t-\r -~\x85\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]"


def splitter(pattern: str = public_tokenizers.PATTERN) -> Callable[[str], list[str]]:
    """The matches of the split pattern in a text.

    Where a text holds only characters whose classes are plain ranges, the same matches come from
    the standard library's faster engine.
    """
    full = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return full
    plain, odd = re.compile(_PLAIN).findall, re.compile(_NOT_PLAIN).search
    return lambda text: full(text) if odd(text) else plain(text)


def spans(pattern: str = public_tokenizers.PATTERN) -> Callable[[str, int, int], Iterator[tuple[int, int]]]:
    """The same matches as their places in a part of a text, one by one."""
    full, plain, odd = regex.compile(pattern), re.compile(_PLAIN), re.compile(_NOT_PLAIN)

    def run(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
        own = full if pattern != public_tokenizers.PATTERN or odd.search(text, start, end) else plain
        return (m.span() for m in own.finditer(text, start, end))

    return run
