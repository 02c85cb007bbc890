"""Texts of UTF-8 bytes as ragged arrays of word numbers, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are cut into words in slices of about so many bytes.
SLICE = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Numbers(dict):
    """Words numbered from ``first`` in order of appearance."""

    def __init__(self, first: int = 0):
        super().__init__()
        self.first = first

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + self.first
        return number


def slices(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about SLICE bytes, cut at blanks only."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and not BLANK[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def numbered(words: list[bytes], numbers: dict) -> np.ndarray:
    """The numbers of words."""
    return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
