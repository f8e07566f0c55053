"""Substring dedup: passages of at least ``width`` words that already start in an earlier document.

Plan
1. The Rabin-Karp hash of every window of ``width`` words is counted in Spark, by the number of texts with it; a
   group of texts sends each of its hashes once.
2. Windows that occur in more than one text are hashed once more, and the least doc_id of each pair of hashes is found.
   Windows of one group of texts with equal hashes are resolved in the group and leave it once, so a very frequent
   passage is combined before the shuffle.
3. Positions of windows with a smaller first doc_id are gathered per document and merged into maximal
   removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, drop_path, materialize, read_documents
from .key_counts import classes_of, column, counted, frequency_classes, with_classes, with_sources
from .words import inside, signed, split_words, window_hashes, word_hashes

#: Odd multipliers of the two window hashes.
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_WINDOWS = "hash_a long, hash_b long, doc_id long, key long, at long, until long, resolved boolean"
_NAMES = ["hash_a", "hash_b", "doc_id", "key", "at", "until", "resolved"]


class _Source:
    """The windows of a source's texts, in the order of the counted part of their hashes."""

    def __init__(self, table: pa.Table, width: int, bits: int):
        self.width = width
        self.words, self.edges = word_hashes(column(table, "text"))
        hashes = window_hashes(self.words, width, BASES[0])
        place = np.flatnonzero(inside(self.edges, width, len(hashes)))
        order = np.argsort(counted(hashes[place], bits), kind="stable")
        #: Place of each window among the words, and the text it is in.
        self.place = place[order]
        self.hashes = hashes[self.place]
        self.counted = counted(self.hashes, bits)
        self.text = np.searchsorted(self.edges, self.place, "right") - 1
        self.docs = column(table, "doc_id").to_numpy(zero_copy_only=False)
        self.start = np.flatnonzero(np.r_[True, self.counted[1:] != self.counted[:-1]][: len(self.counted)])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct counted hashes and whether one or more documents of this source have each."""
        if not len(self.start):
            return self.counted, np.empty(0, np.int64)
        doc = self.docs[self.text]
        return self.counted[self.start], 1 + (np.minimum.reduceat(doc, self.start) < np.maximum.reduceat(doc, self.start))

    def shared(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, second hash, text, place in the text) of the windows that more than one text has."""
        some = np.repeat(classes > 0, np.diff(np.r_[self.start, len(self.hashes)]))
        place, text = self.place[some], self.text[some]
        return self.hashes[some], window_hashes(self.words, self.width, BASES[1])[place], text, place - self.edges[text]


def _window_rows(width: int, bits: int):
    """Repeated windows: one row for the least doc_id of each hash in a source; (start, until) runs of the
    others, which the source itself shows to repeat."""

    def part(*columns) -> pa.Table:
        return pa.table([pa.array(c) for c in columns], names=_NAMES)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        source = _Source(table, width, bits)
        a, b, text, at = source.shared(classes_of(answers))
        doc, key = source.docs[text], column(table, "key").to_numpy()[text]
        order = np.lexsort((doc, b, a))
        first = np.ones(len(order), bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        least = doc[order][np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else doc
        # Of windows of the least document itself, all are sent: each has its own place.
        resolved = np.zeros(len(order), bool)
        resolved[order] = doc[order] > least
        sent = np.flatnonzero(~resolved)
        out = [part(signed(a)[sent], signed(b)[sent], doc[sent], key[sent], at[sent], at[sent] + 1, np.zeros(len(sent), bool))]
        known = np.flatnonzero(resolved)
        known = known[np.lexsort((at[known], text[known]))]
        if len(known):
            new = np.ones(len(known), bool)
            new[1:] = (text[known][1:] != text[known][:-1]) | (at[known][1:] != at[known][:-1] + 1)
            start = known[new]
            end = known[np.r_[np.flatnonzero(new)[1:] - 1, len(known) - 1]]
            none = pa.nulls(len(start), pa.int64())
            out.append(part(none, none, doc[start], key[start], at[start], at[end] + 1, np.ones(len(start), bool)))
        return pa.concat_tables(out)

    return run


def merged(starts: np.ndarray, untils: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal word intervals covered by windows that start at [start, until)."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(starts, kind="stable"):
        lo, hi = int(starts[k]), int(untils[k]) + width - 1
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def repeated_windows(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, key, runs): for each document the [at, until) runs of windows that start earlier.

    ``docs`` has doc_id, text and ``key``, which tells texts under one doc_id apart.
    """
    spark = docs.sparkSession
    sourced, bits = with_sources(docs.where("doc_id is not null").select("doc_id", "key", "text"))
    classes, classes_path = materialize(frequency_classes(sourced, lambda table: _Source(table, width, bits).keys()), "classes")
    windows, windows_path = materialize(with_classes(sourced, classes, _window_rows(width, bits), _WINDOWS), "windows")
    drop_path(spark, classes_path)
    sent = windows.where("not resolved")
    first = sent.groupBy("hash_a", "hash_b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash_a", "hash_b", "first")
    # Written first: the shuffle behind the minima goes before the one for the join, whose hot keys Spark can then split.
    first, first_path = materialize(first, "first")
    late = sent.join(first, ["hash_a", "hash_b"]).where("first < doc_id").select("doc_id", "key", "at", "until")
    late = late.unionByName(windows.where("resolved").select("doc_id", "key", "at", "until"))
    runs, _ = materialize(late.groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "until")).alias("runs")), "runs")
    for path in (windows_path, first_path):
        drop_path(spark, path)
    return runs


def _cut(width: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                text = text.as_py()
                words = split_words(text or "")
                n_words, kept = len(words), words
                if runs.is_valid:
                    at, until = (runs.values.field(k).to_numpy() for k in (0, 1))
                    kept, last = [], 0
                    for lo, hi in merged(at, until, width):
                        kept += words[last:lo]
                        last = hi
                    kept += words[last:]
                joined = b" ".join(kept)
                out["n_words"].append(n_words)
                out["n_removed"].append(n_words - len(kept))
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                out["kept_text"].append((joined.decode() if len(kept) < n_words else text) if keep_text else None)
            rest = [c for c in batch.schema.names if c not in ("text", "runs")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept_text"], pa.string())], names=[*rest, *out])

    return run


def _with_runs(docs: DataFrame, width: int) -> DataFrame:
    base = documents(docs).withColumn("key", F.xxhash64("text"))
    runs = repeated_windows(base, width)
    return base.join(runs, ["doc_id", "key"], "left").select("doc_id", "key", "text", "runs")


def substring_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts in a smaller doc_id.

    Returns (doc_id, n_words, n_removed, kept_sha256), one row per input row; words are runs of
    characters other than space and U+0009 to U+000D, unchanged; kept words are joined by one space.

    * null or wordless text, and texts shorter than a window: nothing is removed;
    * a very long text is held by one task;
    * a null doc_id is not smaller than any: the row loses nothing and removes nothing;
    * rows that repeat a doc_id do not remove from each other; each is judged by its own text;
    * windows are judged on the input, so a passage removed here still removes from larger doc_ids;
    * an empty table gives an empty result; further columns are ignored.
    """
    cut = _with_runs(docs, width).mapInArrow(_cut(width, False), "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``.

    A text that loses words becomes its kept words joined by one space; all others stay as they are,
    nulls too. ``n_chars``, where there is one, follows the new text. A text that is wholly repeated
    becomes empty; the row stays.
    """
    runs = repeated_windows(documents(docs).withColumn("key", F.xxhash64("text")), width)
    others = [c for c in docs.columns if c != "text"]
    named = docs.select(F.struct(*(docs[c] for c in others)).alias("row"), docs["text"].alias("text"))
    named = named.withColumns({"doc_id": F.col("row.doc_id").cast("long"), "key": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    joined = named.join(runs, ["doc_id", "key"], "left").select("row", "text", "runs")
    schema = named.select("row").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_sha256": F.lit(""), "kept_text": F.lit(None).cast("string")}).schema
    cut = joined.mapInArrow(_cut(width, True), schema)
    new = {c: F.col("row").getField(c) for c in others} | {"text": F.col("kept_text")}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return cut.select(*(new[c].alias(c) for c in docs.columns))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_documents(spark, sf_dir), width=50)


OP5_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
starts AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM t WHERE len(w) >= 50),
win AS (SELECT r, doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM starts),
late AS (SELECT r, k FROM (SELECT r, doc_id, k, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
gone AS (SELECT DISTINCT r, k + j AS p FROM late, range(0, 50) AS g(j)),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS text, count(*) AS n FROM words ANTI JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY words.r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.r = kept.r
"""
