"""Cuts text as the pattern of byte-level BPE vocabularies does, over whole batches of bytes.

The pattern has seven branches: contractions, letters, numbers and other signs, each of the last three
with one blank before it, and white space that leaves its last character to what follows.  Where a
token starts depends only on the classes of neighbouring characters, so all starts of a batch are
found by comparisons of arrays.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

from quire.llm.words import padded

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Unicode's White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a contraction.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
    kinds = np.frombuffer(kinds.encode("ascii"), np.uint8)
    table[kinds == ord("L")] = LETTER
    table[kinds == ord("N")] = NUMBER
    table[WHITE] = SPACE
    return table


def code_points(data: np.ndarray, eight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of each character of UTF-8 text."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    wide = np.flatnonzero(points >= 0x80)
    if len(wide):
        lead, word = points[wide], eight[at[wide]].astype(np.int64)
        b1, b2, b3 = (word >> 8) & 0x3F, (word >> 16) & 0x3F, (word >> 24) & 0x3F
        two = (lead & 0x1F) << 6 | b1
        three = (lead & 0x0F) << 12 | b1 << 6 | b2
        four = (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
        points[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    return at, points


def pretokens(data: np.ndarray, ends: np.ndarray):
    """Starts and lengths in bytes of all tokens, where each row's tokens end, and the padded bytes."""
    room, eight = padded(data)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(ends), np.int64), room, eight
    at, points = code_points(data, eight)
    kind = char_classes()[points]
    row_start = np.zeros(len(at) + 3, bool)
    begins = np.concatenate([[0], ends[:-1]])
    row_start[np.searchsorted(at, begins)] = True
    row_start[len(at) :] = True

    start = row_start[: len(at)].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last of a run of white space before something else: a blank joins it, another stands alone.
    after = np.flatnonzero(start[1:] & ~row_start[1 : len(at)] & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False

    quote = np.flatnonzero(start & (points == ord("'")))
    if len(quote):
        far = np.concatenate([points, [0, 0, 0]])
        one, two = far[quote + 1], far[quote + 2]
        near = ~row_start[quote + 1]
        both = near & ~row_start[quote + 2]
        size = np.zeros(len(quote), np.int64)
        for ending in ENDINGS:
            if len(ending) == 1:
                size[near & (one == ord(ending))] = 2
            else:
                size[both & (one == ord(ending[0])) & (two == ord(ending[1]))] = 3
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        then = quote + size
        start[then[then < len(at)]] = True
    starts = at[start]
    lengths = np.diff(starts, append=len(data))
    return starts, lengths, np.searchsorted(starts, ends, side="left"), room, eight


def cut_points(text: bytes, step: int) -> list[int]:
    """Places at least ``step`` bytes apart where cutting changes no token: before a blank that follows
    neither white space nor part of a character."""
    cuts, at = [], step
    while at < len(text):
        at = text.find(b" ", at)
        if at < 0:
            break
        before = text[at - 1]
        if before < 0x80 and chr(before).isalnum():
            cuts.append(at)
            at += step
        else:
            at += 1
    return cuts
