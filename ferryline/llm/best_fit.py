"""Best-fit packing by minimum bin slack.

Plan
1. Texts are encoded in one pass; documents longer than ``size`` are cut, every other is one piece.
2. Only the histogram of piece lengths (at most ``size`` numbers) decides which lengths share a sequence. Minimum
   bin slack: the longest length left takes a bin, and a subset-sum over the lengths left (bitsets of
   reachable sums, lengths with their counts) finds the fullest combination with it. A combination is used as often as
   the counts allow, so the number of combinations does not grow with the corpus. Filling every bin to the brim can use up
   the short pieces too early; so the search is repeated with a slack that a bin may keep, until the sum of all lengths
   shows that no plan has fewer sequences, or all slacks have been tried. The plan with the fewest sequences is taken, and
   its emptiest sequences are packed anew as long as that saves any.
3. Pieces are numbered within their length, in shards, and a piece's number says which sequence and
   which place of that combination it takes. No piece passes through the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import documents, materialize, read_documents
from .tokens import WORD_BPE, encoder, tokenizer_path

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fill(counts: dict[int, int], room: int, slack: int) -> Counter:
    """A combination of lengths that leaves the least of ``room`` unused.

    ``counts`` are the lengths left. Bit s of ``reach[i]`` says that s is a sum of the first i lengths,
    longest first; the sums are walked back from the largest one. Of equally full combinations, the walk takes the one
    with the longest pieces, so that short pieces are left for the bins that need them. Shorter lengths are looked at only
    while more than ``slack`` stays unused.
    """
    full, enough = (1 << (room + 1)) - 1, max(0, room - slack)
    reach, used = [1], []
    for n in sorted((n for n, c in counts.items() if c > 0 and n <= room), reverse=True):
        if reach[-1] >> enough:
            break
        bits, step, many = reach[-1], 1, min(counts[n], room // n)
        while many > 0:
            step = min(step, many)
            bits |= bits << (n * step) & full
            many -= step
            step *= 2
        reach.append(bits)
        used.append(n)
    total = reach[-1].bit_length() - 1
    out: Counter = Counter()
    for i in range(len(used) - 1, -1, -1):
        while not reach[i] >> total & 1:
            total -= used[i]
            out[used[i]] += 1
    return out


def fullest(seed: int, counts: dict[int, int], size: int, slack: int = 0) -> Counter:
    """A combination that holds ``seed``: with the fullest one of long lengths that leaves at most ``slack`` of ``size``, and
    the fullest one of what is left then in the rest."""
    out, left = Counter({seed: 1}), Counter(counts)
    left[seed] -= 1
    for allowed in (slack, 0) if slack else (0,):
        more = fill(left, size - sum(n * k for n, k in out.items()), allowed)
        out += more
        left -= more
    return out


def plan_with(histogram: dict[int, int], size: int, slack: int) -> list[tuple[Counter, int]]:
    """(combination, times) until every piece of ``histogram`` (length: count) has a place."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        found = fullest(max(left), left, size, slack)
        times = min(left[n] // k for n, k in found.items())
        out.append((found, times))
        for n, k in found.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def sequences(combinations: list[tuple[Counter, int]]) -> int:
    return sum(times for _, times in combinations)


def lengths_of(combinations: list[tuple[Counter, int]]) -> Counter:
    out: Counter = Counter()
    for found, times in combinations:
        for n, k in found.items():
            out[n] += k * times
    return out


def fewest(histogram: dict[int, int], size: int, slacks: Iterable[int], best: list[tuple[Counter, int]] | None = None) -> tuple[list[tuple[Counter, int]], int]:
    """(plan with the fewest sequences, its slack) of ``best`` and those for ``slacks``; ends where the sum of all lengths allows no fewer."""
    least, best_slack = -(-sum(n * c for n, c in histogram.items()) // size), 0
    for slack in slacks:
        if best is not None and sequences(best) <= least:
            break
        found = plan_with(histogram, size, slack)
        if best is None or sequences(found) < sequences(best):
            best, best_slack = found, slack
    return best or [], best_slack


def emptiest(combinations: list[tuple[Counter, int]], size: int, count: int) -> tuple[list[tuple[Counter, int]], list[tuple[Counter, int]]]:
    """(the ``count`` emptiest sequences, the others)."""
    taken, others = [], []
    for found, times in sorted(combinations, key=lambda x: sum(n * k for n, k in x[0].items())):
        now = min(times, count)
        count -= now
        taken += [(found, now)] if now else []
        others += [(found, times - now)] if times > now else []
    return taken, others


def plan(histogram: dict[int, int], size: int) -> list[tuple[Counter, int]]:
    """The plan with the fewest sequences over slacks up to half of ``size`` and those beside the best one; then its
    emptiest sequences, with more and more fuller ones, are packed anew in the same way as long as that saves any."""
    step = max(1, size // 64)
    coarse = [0, *(k for k in (1, 2, 4, 8, 16) if k < step), *range(step, size // 2 + 1, step)]

    def search(lengths: dict[int, int], known: list[tuple[Counter, int]] | None) -> list[tuple[Counter, int]]:
        found, slack = fewest(lengths, size, coarse, known)
        return fewest(lengths, size, range(max(0, slack - step), slack + step, max(1, step // 8)), found)[0]

    best = search(histogram, None)
    share = 1
    while share < 8 and sequences(best) > -(-sum(n * c for n, c in histogram.items()) // size):
        taken, others = emptiest(best, size, -(-sequences(best) * share // 8))
        again = search(lengths_of(taken), taken)
        share = 1 if sequences(again) < sequences(taken) else share * 2
        best = others + again
    return best


def places(combinations: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """For each length and range of its pieces' numbers: the first sequence, pieces per sequence, first offset.

    Sorted by (length, first): a lookup table of a few rows per combination.
    """
    rows, seen, sequence = [], Counter(), 0
    for found, times in combinations:
        offset = 0
        for n in sorted(found, reverse=True):
            rows.append((n, seen[n], sequence, found[n], offset))
            seen[n] += found[n] * times
            offset += n * found[n]
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T, strict=True))


def _pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(path, True)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), found.encode(batch.column("text")), strict=True):
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    out.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _seat(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table["length"] << 40 | table["first"]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, length << 40 | number, "right") - 1
            within = number - table["first"][at]
            sequence = table["sequence"][at] + within // table["each"][at]
            offset = table["offset"][at] + within % table["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, shard_rows: int = 50_000) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens, as few as the search finds.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece. A document's
    ids end with ``end_id``; only documents above ``size`` are cut. Offsets in a sequence are gapless from 0.

    * null and empty texts are pieces of the end id alone;
    * a null doc_id is packed like any other; rows that repeat a doc_id are packed each;
    * an empty table gives an empty result; further columns are ignored.

    Pieces of one length may be a third of all: they are numbered per shard of about ``shard_rows`` rows, and the shards'
    counts are added up per length, so no task holds one length's rows.
    """
    spark = docs.sparkSession
    pieces, _ = materialize(documents(docs).mapInArrow(_pieces(path, size, end_id), _PIECES), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    counts = sharded.groupBy("shard", "length").agg(F.count("*").alias("n"))
    counts, _ = materialize(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(histogram, size)))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(F.col("shard").alias("b_shard"), F.col("length").alias("b_length"), before.alias("base"))
    order = W.partitionBy("shard", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sharded.withColumn("rank", F.row_number().over(order) - 1)
    numbered = ranked.join(bases, (F.col("shard") == F.col("b_shard")) & (F.col("length") == F.col("b_length")))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).cast("long").alias("number"))
    return numbered.mapInArrow(_seat(table), f"{_PIECES}, sequence_id long, offset long")


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir), tokenizer_path(WORD_BPE), size=2048, end_id=0)
