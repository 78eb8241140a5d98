"""Words of UTF-8 texts as hashes, many at a time, and hashes of runs of words.

A word is a run of letters, digits, underscores and characters beyond ASCII; A-Z count as a-z.
Typographic punctuation and blanks (Latin-1, general, CJK and full-width) part words as those of
ASCII do, and each Chinese character, kana or full-width sign of U+3400 to U+9FFF and U+3040 to
U+30FF is a word of its own, as such texts have no blanks. The hash of a word is a polynomial
over its bytes modulo 2**64, mixed; that of a run of words is a Karp-Rabin polynomial over the
words. Where equal hashes decide and don't only propose, the operator says so.
"""

from __future__ import annotations

import numpy as np

BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at a time; texts are cut between words.
PIECE = 1 << 21

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = (
    ((LOWER >= 97) & (LOWER <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES == 95) | (_BYTES >= 128)
)
with np.errstate(over="ignore"):
    #: Powers for the bytes of a word; those of longer words repeat.
    POWERS = np.cumprod(np.full(256, BASE, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _beyond_ascii(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Takes punctuation beyond ASCII out of ``inside``; tells where one-character words begin."""
    own = np.zeros(len(data) + 1, bool)
    if not (data >= 0xC2).any():
        return own
    one, two = np.append(data[1:], 0), np.append(data[2:], [0, 0])[: len(data)]
    # Latin-1 signs but for the ordinals and micro, and the signs of multiplication and division.
    short = (data == 0xC2) & (one != 0xAA) & (one != 0xB5) & (one != 0xBA)
    short |= (data == 0xC3) & ((one == 0x97) | (one == 0xB7))
    # General punctuation, CJK punctuation, full-width punctuation.
    long = (data == 0xE2) & ((one == 0x80) | (one == 0x81)) | (data == 0xE3) & (one == 0x80)
    long |= (data == 0xEF) & (one == 0xBC) & ((two <= 0x8F) | (two >= 0x9A) & (two <= 0xA0))
    for at, size in ((np.flatnonzero(short), 2), (np.flatnonzero(long), 3)):
        for k in range(size):
            inside[np.minimum(at + k, len(data) - 1)] = False
    single = (data >= 0xE4) & (data <= 0xE9) | (data == 0xE3) & ((one >= 0x81) & (one <= 0x83) | (one >= 0x90))
    at = np.flatnonzero(single)
    own[at] = True
    own[np.minimum(at + 3, len(data))] = True
    return own


def _piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = IS_WORD[data]
    begin = _beyond_ascii(data, inside)
    here, before = np.append(inside, False), np.concatenate([[False], inside])
    starts = np.flatnonzero(here & (~before | begin))
    ends = np.flatnonzero(before & (~here | begin))
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        terms = (LOWER[data[inside]].astype(np.uint64) + np.uint64(1)) * POWERS[place & 255]
        return starts, ends, mixed(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * STEP)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of the bytes ``data``."""
    found, at = [], 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        if stop < len(data):
            # Cut behind the last byte that is in no word; a longer word stays whole.
            gaps = np.flatnonzero(~IS_WORD[data[at:stop]])
            if len(gaps):
                stop = at + gaps[-1] + 1
            else:
                gaps = np.flatnonzero(~IS_WORD[data[stop:]])
                stop = stop + gaps[0] if len(gaps) else len(data)
        starts, ends, hashes = _piece(data[at:stop])
        found.append((starts + at, ends + at, hashes))
        at = stop
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(part) for part in zip(*found))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(count, np.uint64(size))
        for k in range(size):
            total = total * BASE + hashes[k : k + count]
    return mixed(total)
