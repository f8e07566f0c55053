"""Which names of two lists can reach a similarity at all, by what their letters and letter pairs have in common.

The similarity of two texts of s characters together is 2 * M / s, where M characters match. With a threshold t, M is at least
``needed(s)`` = ceil(t * s / 2). Then
* the counts of their letters differ by at most s - 2 * M in sum, since M letters are in both;
* the M matching characters stand in runs, of which there are at most s - 2 * M + 1, as an unmatched character lies between two
  runs; a run of r characters holds r - 1 letter pairs, so the texts have at least M - (s - 2 * M + 1) letter pairs in common.
Both are necessary, so no pair is lost; the ratio itself decides on what is left.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np

#: Columns of the letter and letter-pair counts. What shares a column makes names look more alike, never less.
LETTERS, LETTER_PAIRS = 64, 128
#: Pairs whose counts are compared at once.
TILE = 1 << 13
#: The length from which ``difflib`` leaves out frequent characters of the second text.
POPULAR_FROM = 200


def needed(total: np.ndarray, threshold: float) -> np.ndarray:
    """The least number of matching characters of two texts with ``total`` characters."""
    return np.ceil(threshold * total / 2 - 1e-9).astype(np.int64)


class Names:
    """Counts of letters and letter pairs of a list of names."""

    def __init__(self, names: list[str]):
        self.names = names
        self.length = np.array([len(x) for x in names], np.int64)
        codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(names)), self.length)
        self.letters = self._counts(owner, codes % LETTERS, LETTERS)
        inside = owner[:-1] == owner[1:] if len(codes) else np.empty(0, bool)
        self.pairs = self._counts(owner[:-1][inside], (codes[:-1] * 31 + codes[1:])[inside] % LETTER_PAIRS, LETTER_PAIRS)

    def _counts(self, owner: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(owner * width + column, minlength=len(self.names) * width).reshape(-1, width).astype(np.int32)


def near(one: Names, rows: np.ndarray, other: Names, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of ``rows``, j of ``columns``), by i and j, of names of ``one`` and ``other`` that can reach the threshold."""
    total = one.length[rows][:, None] + other.length[columns]
    apart = total - 2 * needed(total, threshold)
    at = np.nonzero((apart >= 0) & (np.abs(one.length[rows][:, None] - other.length[columns]) <= apart))
    i, j, apart, total = rows[at[0]], columns[at[1]], apart[at], total[at]
    kept = np.abs(one.letters[i] - other.letters[j]).sum(axis=1) <= apart
    i, j, apart, total = i[kept], j[kept], apart[kept], total[kept]
    kept = np.minimum(one.pairs[i], other.pairs[j]).sum(axis=1) >= needed(total, threshold) - apart - 1
    return i[kept], j[kept]


def _tiles(rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """``rows`` in pieces that make at most ``TILE`` pairs with ``width`` columns each, one row at least."""
    step = max(1, TILE // max(1, width))
    for start in range(0, len(rows), step):
        yield rows[start : start + step]


def candidates(one: Names, other: Names, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of ``one``, j of ``other``) that can reach the threshold; in the ``same`` list each pair once, a name also with itself."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    columns = np.arange(len(other.names))
    for rows in _tiles(np.arange(len(one.names)), len(columns)):
        i, j = near(one, rows, other, columns, threshold)
        left.append(i[j >= i] if same else i)
        right.append(j[j >= i] if same else j)
    return np.concatenate(left), np.concatenate(right)


def ratio(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``; for texts that are short enough to have no popular characters there, by searches of Python's own.

    Between two matches, the longest common run that starts earliest in ``a``, and there earliest in ``b``, is the next match.
    """
    if len(b) >= POPULAR_FROM:
        return difflib.SequenceMatcher(None, a, b).ratio()
    matched, left = 0, [(a, b)]
    while left:
        x, y = left.pop()
        at = size = start = 0
        end = len(x)
        while start + size < end:
            if x[start : start + size + 1] in y:
                at, size = start, size + 1
            else:
                start += 1
        if size:
            matched += size
            j = y.index(x[at : at + size])
            if at and j:
                left.append((x[:at], y[:j]))
            if at + size < len(x) and j + size < len(y):
                left.append((x[at + size :], y[j + size :]))
    return 2.0 * matched / (len(a) + len(b)) if a or b else 1.0


def earliest(current: list[str], previous: list[str], until: list[int], threshold: float) -> list[tuple[int, int, float]]:
    """(i, j, ratio): for ``current[i]`` the first of ``previous[:until[i]]`` that reaches the threshold; names behind it are not looked at.

    All names meet the few earliest ones at once, and those that are left meet more and more of the others.
    """
    out, one, other = [], Names(current), Names(previous)
    limit, left = np.array(until, np.int64), np.arange(len(current))
    start, width = 0, 1
    while start < len(previous):
        left = left[limit[left] > start]
        if not len(left):
            break
        found: dict[int, tuple[int, int, float]] = {}
        columns = np.arange(start, min(start + width, len(previous)))
        for rows in _tiles(left, len(columns)):
            i, j = near(one, rows, other, columns, threshold)
            inside = j < limit[i]
            for x, y in zip(i[inside].tolist(), j[inside].tolist(), strict=True):
                # The earlier name is the second one of the ratio, which is not symmetric.
                if x not in found and (similarity := ratio(current[x], previous[y])) >= threshold:
                    found[x] = (x, y, similarity)
        out.extend(found.values())
        left = left[~np.isin(left, np.fromiter(found, np.int64, len(found)))]
        start, width = start + width, min(2 * width, 1024)
    return sorted(out)
