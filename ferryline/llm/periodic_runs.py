"""Periodic runs of words, from the maximal pairs of each text.

A run is a stretch with smallest period q that holds at least ``copies`` periods and ``least`` words and that no neighbour
extends. A maximal pair is two equal stretches of a text, at distance p, that differ in the word before and in
the word behind. A run of length L is the maximal pair of its first and its last L - q words at distance q; the other way
round, a maximal pair of length m at distance p with m >= (copies - 1) * p and m + p >= least is a stretch of length
m + p with period p that nothing extends. So the pairs that meet these lengths are the runs, with nothing left to extend;
pairs at a multiple of the period give the same stretch and go.

Plan, for a group of texts at once and without a shuffle
1. Words are numbered exactly; suffixes are sorted by doubled prefixes, each round only those that are not alone yet.
2. Longest common prefixes of neighbours are read off the rounds' ranks, from the longest prefix down.
3. Where they are long enough for a run, the LCP intervals are walked bottom up. An interval holds its suffixes
   in the order of their places, each with the word at its left. When two are joined, the smaller one is looked up in the
   larger one, and pairs within the distance that the length allows come out if their left words differ.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents, groups, read_documents, tidy

#: Bytes of text whose suffixes are sorted together; a longer text is sorted alone.
TOGETHER = 3_000_000


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, edges): equal numbers for equal words, text after text, and the place of each text's first word and the end."""
    parts = pc.ascii_split_whitespace(texts)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, empty = flat.indices.to_numpy(zero_copy_only=False), pc.index(flat.dictionary, "").as_py()
    kept = codes != empty
    edges = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
    return codes[kept].astype(np.int64), edges


def sorted_suffixes(codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(order, rounds): the suffixes of all texts, text by text, and for 1, 2, 4, ... words the places whose
    prefix of so many words is not the only one in its text, ascending, with their ranks.

    A rank is the first place of its group in ``order``; it is final as soon as the group has one suffix.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    key = text * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    sorted_key = key[order]
    first = np.ones(n, bool)
    first[1:] = sorted_key[1:] != sorted_key[:-1]
    starts = np.flatnonzero(first)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    many = np.repeat(np.diff(np.r_[starts, n]) > 1, np.diff(np.r_[starts, n]))
    open_places = np.sort(order[many])
    rounds, width = [], 1
    while len(open_places):
        rounds.append((open_places, rank[open_places]))
        behind = np.minimum(open_places + width, n)
        # Behind the last word of a text comes nothing.
        behind = np.where(behind < edges[1:][text[open_places]], rank[behind], -1)
        own = rank[open_places]
        by = np.lexsort((behind, own))
        places, own, behind = open_places[by], own[by], behind[by]
        new_group = np.r_[True, own[1:] != own[:-1]]
        new_sub = new_group | np.r_[True, behind[1:] != behind[:-1]]
        at = np.arange(len(places))
        group_start, sub_start = at[new_group][np.cumsum(new_group) - 1], at[new_sub][np.cumsum(new_sub) - 1]
        order[own + at - group_start] = places
        rank[places] = own + sub_start - group_start
        sizes = np.diff(np.r_[np.flatnonzero(new_sub), len(places)])
        open_places = np.sort(places[np.repeat(sizes > 1, sizes)])
        width *= 2
    return order, rounds


def common_prefixes(left: np.ndarray, right: np.ndarray, rounds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The number of words that the suffixes ``left`` and ``right`` of one text have in common at their start."""
    out = np.zeros(len(left), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        places, ranks = rounds[k]
        i, j = (np.minimum(np.searchsorted(places, x + out), len(places) - 1) for x in (left, right))
        same = (places[i] == left + out) & (places[j] == right + out) & (ranks[i] == ranks[j])
        out[same] += 1 << k
    return out


def _joined(one: list[int], other: list[int], length: int, reach: int, before: list[int], out: list[tuple[int, int, int]]) -> list[int]:
    """Two children of an LCP interval of ``length`` in one list; their pairs within ``reach`` go to ``out`` as (place, distance, length)."""
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    for place in small:
        low = bisect_left(large, place - reach)
        high = bisect_right(large, place + reach, low)
        if high - low > 2 and before[place] == before[large[high - 1]]:
            # So near each other they follow in equal steps, and all but the first have the same word at their left.
            high = low + 1
        for x in large[low:high]:
            if before[x] != before[place]:
                out.append((min(x, place), abs(x - place), length))
    if len(small) * 8 < len(large):
        for place in small:
            insort(large, place)
    else:
        large.extend(small)
        large.sort()
    return large


def maximal_pairs(suffixes: list[int], prefixes: list[int], before: list[int], copies: int) -> list[tuple[int, int, int]]:
    """(place, distance, length) of the maximal pairs that are long enough for their distance.

    ``suffixes`` are neighbours in sorted order, ``prefixes[k]`` what the k-th and the next one have in common.
    """
    out: list[tuple[int, int, int]] = []
    waiting: list[tuple[int, list[int]]] = []
    for place, length in zip(suffixes, [*prefixes, -1], strict=True):
        node = [place]
        while waiting and waiting[-1][0] >= length:
            inner, known = waiting.pop()
            node = _joined(known, node, inner, inner // (copies - 1), before, out)
            if inner == length:
                break
        waiting.append((length, node))
    return out


def find_runs(codes: np.ndarray, edges: np.ndarray, least: int = 6, copies: int = 4) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period; ``start`` counts the words of the text."""
    if copies < 2:
        raise ValueError("a run has two periods or more")
    if not len(codes):
        return np.empty((0, 4), np.int64)
    order, rounds = sorted_suffixes(codes, edges)
    #: The shortest pair of any run: that of period 1, or of the longest period for which ``least`` decides.
    shortest = min(max((copies - 1) * p, least - p) for p in range(1, max(2, least)))
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    before = np.r_[-1, codes[:-1]]
    before[edges[:-1][edges[:-1] < len(codes)]] = -1
    # Neighbours with fewer words in common than the round below ``shortest`` has are left out early.
    level = max(0, shortest.bit_length() - 1)
    if level >= len(rounds):
        return np.empty((0, 4), np.int64)
    held = np.full(len(codes), -1, np.int64)
    held[rounds[level][0]] = rounds[level][1]
    held = held[order]
    at = np.flatnonzero((held[1:] >= 0) & (held[1:] == held[:-1]))
    common = common_prefixes(order[at], order[at + 1], rounds)
    at, common = at[common >= shortest], common[common >= shortest]
    if not len(at):
        return np.empty((0, 4), np.int64)
    # Blocks of neighbours; only those with two places near enough for their longest prefix can hold a run.
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    last = np.r_[first[1:], len(at)]
    blocks = [(int(at[i]), int(at[j - 1]) + 2, i, j) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
    found: list[tuple[int, int, int]] = []
    before = before.tolist()
    for lo, hi, i, j in blocks:
        places = order[lo:hi]
        if np.diff(np.sort(places)).min() <= common[i:j].max() // (copies - 1):
            found += maximal_pairs(places.tolist(), common[i:j].tolist(), before, copies)
    pairs = np.array(found, np.int64).reshape(-1, 3)
    place, period, length = pairs[:, 0], pairs[:, 1], pairs[:, 2] + pairs[:, 1]
    kept = (length >= least) & (length >= copies * period)
    place, period, length = place[kept], period[kept], length[kept]
    by = np.lexsort((period, length, place))
    place, period, length = place[by], period[by], length[by]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (length[1:] != length[:-1])
    place, period, length = place[new], period[new], length[new]
    by = np.lexsort((period, place))
    place, period, length = place[by], period[by], length[by]
    return np.stack([text[place], place - edges[:-1][text[place]], length, period], axis=1)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word that each word of a text becomes where a period is planted, by its doc_id; None where none is."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    source = np.arange(n)
    source[a:] = a + (source[a:] - a) % p
    return source


def _runs_of(doc_ids: list[int | None], texts: pa.Array, plant: bool, least: int, copies: int):
    """(index, n words, source of each word or None, runs) of each text, in order."""
    at = 0
    for group in groups(texts, TOGETHER):
        codes, edges = word_codes(group)
        sources: dict[int, np.ndarray] = {}
        if plant:
            for k in range(len(group)):
                source = planted(doc_ids[at + k], int(edges[k + 1] - edges[k]))
                if source is not None:
                    sources[k] = source
                    codes[edges[k] : edges[k + 1]] = codes[edges[k] : edges[k + 1]][source]
        runs = find_runs(codes, edges, least, copies)
        cuts = np.searchsorted(runs[:, 0], np.arange(len(group) + 1)).tolist()
        for k in range(len(group)):
            yield at + k, int(edges[k + 1] - edges[k]), sources.get(k), runs[cuts[k] : cuts[k + 1], 1:]
        at += len(group)


def _collapsed(text: str, n: int, source: np.ndarray | None, runs: np.ndarray) -> bytes:
    """The words outside runs and those of each run's first period, joined by one space."""
    words = text.encode().split()
    if source is None and not len(runs):
        return b" ".join(words)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(depth)[:n] == 0)
    return b" ".join([words[i] for i in (kept if source is None else source[kept]).tolist()])


_DIGESTS = {"doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def _digests(plant: bool, least: int, copies: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column("text"), []
            doc_ids = batch.column("doc_id").to_pylist()
            for i, n, source, runs in _runs_of(doc_ids, texts, plant, least, copies):
                listed = runs.tolist()
                best = max(listed, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                lines = "".join(f"{s},{m},{p}\n" for s, m, p in listed)
                rows.append((doc_ids[i], len(listed), *most, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_collapsed(texts[i].as_py(), n, source, runs)).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_DIGESTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _DIGESTS.values(), strict=True)], names=list(_DIGESTS))
        tidy()

    return run


def _collapse(least: int, copies: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, spans = batch.column("text"), [], []
            doc_ids = batch.column("doc_id").to_pylist()
            for i, n, _, runs in _runs_of(doc_ids, texts, False, least, copies):
                text = texts[i].as_py()
                out.append(_collapsed(text, n, None, runs).decode() if len(runs) else text)
                spans.append([{"start": s, "length": m, "period": p} for s, m, p in runs.tolist()])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind), pa.array(out, pa.string())], names=["doc_id", "runs", "text"])
        tidy()

    return run


def collapse_runs(docs: DataFrame, least: int = 6, copies: int = 4) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, text): the runs of each text, and the text with each run cut to its first period.

    A run has ``copies`` (2 or more) periods and ``least`` words at least. Words are runs of characters other than space and U+0009 to
    U+000D. A text without a run stays as it is, of others the kept words are joined by one space; a null text becomes empty.
    """
    return documents(docs).mapInArrow(_collapse(least, copies), "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string")


def run_digests(docs: DataFrame, plant: bool = True, least: int = 6, copies: int = 4) -> DataFrame:
    """One row per input row: number of runs, the run with the greatest length / period, digests of all runs and of the collapsed text.

    Returns (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256). With ``plant``, a tenth
    of the documents, chosen by doc_id, get a period first (see ``planted``).

    * null, empty and wordless texts: no runs, four nulls, and digests of the empty string;
    * of runs with equal length / period, the one with the smallest start, then period, is shown;
    * runs that overlap or lie in each other are all counted; a word in any of them behind its first period goes;
    * a null doc_id stays null and gets no period; repeated rows give equal rows; an empty table gives an empty result;
    * a very long text is held by one task; further columns are ignored.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return documents(docs).mapInArrow(_digests(plant, least, copies), schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read_documents(spark, sf_dir))
