"""Counting 64-bit keys (shingles, windows) over all sources, where a source is a group of texts.

Every source sends each of its distinct keys once, as sorted arrays cut at equal parts of the key range, so a
key in very many texts is combined before the shuffle and every bucket has about the same size. A bucket adds
up what its sources sent and answers with one byte for every key, in the order in which it came.

A text's source is a hash of the text, so it is the same whenever it is read: keys are computed again for the answers, not written.
For counting, a key is cut to its bucket and 32 bits more; keys that then look alike count together, which can only
make a key look more frequent than it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes and rows of a source, and keys of a bucket: bound what a task holds.
SOURCE_BYTES, SOURCE_ROWS, BUCKET_KEYS = 600_000, 5_000, 1_000_000
_SENT = pa.schema([("source", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])
_ANSWER = pa.schema([("source", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary())])


def with_sources(docs: DataFrame) -> tuple[DataFrame, int]:
    """(``docs(doc_id, text, ...)`` with ``source``, number of leading key bits that name a bucket)."""
    size, rows = docs.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    sources = max(1, -(-(size or 0) // SOURCE_BYTES), -(-rows // SOURCE_ROWS))
    # A text has at most one key for each of its words, and these take about six bytes.
    bits = min(32, max(0, ((size or 0) // 6 // BUCKET_KEYS).bit_length()))
    return docs.withColumn("source", F.pmod(F.xxhash64("doc_id", "text"), F.lit(sources))), bits


def counted(keys: np.ndarray, bits: int) -> np.ndarray:
    """The part of each key by which it is counted."""
    return keys >> np.uint64(32 - bits)


def column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return pa.concat_arrays(chunks) if chunks else pa.array([], table.schema.field(name).type)


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """0 for keys of one text, 1 for two, 2 for three or four, 3 for five to eight and so on."""
    return np.ceil(np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _answer(table: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")]
    times = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("times")]).astype(np.int64)
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    total = frequency_class(np.add.reduceat(times[order], start))
    out = np.empty(len(flat), np.uint8)
    out[order] = np.repeat(total, np.diff(np.r_[start, len(flat)]))
    ends = np.cumsum([len(k) for k in keys])
    return pa.table([table.column("source"), table.column("bucket"), pa.array([x.tobytes() for x in np.split(out, ends[:-1])], pa.binary())], schema=_ANSWER)


def frequency_classes(docs: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(source, bucket, answer): the classes of the keys of each source of ``docs(source, ...)``, as ``classes_of`` reads them.

    ``keys_of`` gives the distinct ``counted`` keys of a source's rows, ascending, and in how many of its texts each occurs.
    """

    def send(table: pa.Table) -> pa.Table:
        keys, times = keys_of(table)
        buckets, first = np.unique(keys >> np.uint64(32), return_index=True)
        edges, times = [*first.tolist(), len(keys)], np.minimum(times, 255).astype(np.uint8)
        rest = keys.astype(np.uint32)
        runs = list(zip(edges, edges[1:]))
        columns = [[table.column("source")[0].as_py()] * len(runs), buckets.tolist(), [rest[lo:hi].tobytes() for lo, hi in runs], [times[lo:hi].tobytes() for lo, hi in runs]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SENT, strict=True)], schema=_SENT)

    sent = docs.groupBy("source").applyInArrow(send, "source long, bucket long, keys binary, times binary")
    return sent.groupBy("bucket").applyInArrow(_answer, "source long, bucket long, answer binary")


def classes_of(answers: pa.Table) -> np.ndarray:
    """The class of each distinct ``counted`` key of a source, in ascending order of the keys."""
    found = sorted(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True))
    return np.frombuffer(b"".join(x for _, x in found), np.uint8)


def with_classes(docs: DataFrame, classes: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f`` of each source's rows of ``docs`` and its rows of ``classes``."""
    return docs.groupBy("source").cogroup(classes.groupBy("source")).applyInArrow(f, schema)
