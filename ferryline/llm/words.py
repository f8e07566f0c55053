"""64-bit hashes of words, word n-grams and fixed windows of whole groups of texts, in numpy (used inside Spark tasks).

Texts lie one after the other: ``hashes`` holds all their words, ``edges`` the place of each text's first word and the end.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Fixed value: an odd number that is 3 modulo 4.
_BYTE_BASE = 0xD1342543DE82EF97 | 3
#: Bytes hashed at once, and the longest word hashed with others.
_SEGMENT, _LONG_WORD = 1 << 20, 256
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values(lower: bool) -> np.ndarray:
    """A wide number for every byte; with ``lower``, A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
    if lower:
        values[65:91] = values[97:123]
    return values


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, count: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    bits = max(20, max(count - 1, 0).bit_length())
    return (_powers if bits <= 21 else _powers.__wrapped__)(base, bits)[:count]


def split_words(text: str, lower: bool = False) -> list[bytes]:
    """Maximal runs of bytes other than space and U+0009 to U+000D; ``lower`` maps A-Z only."""
    data = text.encode()
    return (data.lower() if lower else data).split()


def _segments(spaces: np.ndarray) -> list[int]:
    """Where the bytes are cut for hashing: at white space, about _SEGMENT apart."""
    cuts = [0]
    while len(spaces) - cuts[-1] > _SEGMENT:
        at = cuts[-1] + _SEGMENT
        while at < len(spaces):
            found = np.flatnonzero(spaces[at : at + _SEGMENT])
            if len(found):
                at += int(found[0])
                break
            at += _SEGMENT
        cuts.append(min(at, len(spaces)))
    return [*cuts, len(spaces)] if cuts[-1] < len(spaces) else cuts


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges) of all words (maximal runs of bytes other than space and U+0009 to U+000D; ``lower`` maps A-Z only).

    A word's hash is a polynomial in its bytes, as the difference of two prefix sums; very long words are hashed
    one by one.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    spaces = _IS_SPACE[data]
    # A word begins behind white space or at the start of a text, and ends before white space or at the end of one.
    first, last = ~spaces, ~spaces
    first[1:] &= spaces[:-1]
    last[:-1] &= spaces[1:]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cut] |= ~spaces[cut]
    last[cut[1:] - 1] |= ~spaces[cut[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    values, inverse = _byte_values(lower), pow(_BYTE_BASE, -1, 1 << 64)
    out = np.empty(len(starts), np.uint64)
    cuts = _segments(spaces)
    for lo, hi in zip(cuts, cuts[1:]):
        i, j = np.searchsorted(starts, [lo, hi])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * powers(inverse, hi - lo), out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * powers(_BYTE_BASE, hi - lo)[s])
    for k in np.flatnonzero(ends - starts > _LONG_WORD).tolist():
        word = data[starts[k] : ends[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return out, np.searchsorted(starts, offsets)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words: a polynomial in the word hashes, mixed."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, n, np.uint64)
    for j in range(n):
        total = total * _MULTIPLIER + hashes[j : j + count]
    return mix(total)


def inside(edges: np.ndarray, width: int, count: int) -> np.ndarray:
    """For ``count`` runs of ``width`` consecutive words: whether the run stays in one text."""
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    return text[:count] == text[width - 1 : width - 1 + count]


def shingle_sets(hashes: np.ndarray, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, edges): each text's distinct n-word shingles, ascending; with fewer than n words, the whole sequence as one."""
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    grams, owners = gram_hashes(hashes, n), text[: max(len(hashes) - n + 1, 0)]
    keep = inside(edges, n, len(grams))
    found, owner = [grams[keep]], [owners[keep]]
    for m in range(1, n):
        short = np.flatnonzero(np.diff(edges) == m)
        if len(short):
            found.append(gram_hashes(hashes, m)[edges[short]])
            owner.append(short)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.searchsorted(owner[new], np.arange(len(edges)))


def window_hashes(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash modulo 2**64 of every ``width`` consecutive words.

    One prefix sum of ``hash * base**-i`` serves all windows; a window is the difference of two prefix
    sums, brought to the same power by ``base**i``. ``base`` must be odd.
    """
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(pow(base, -1, 1 << 64), len(hashes)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(base, count))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
