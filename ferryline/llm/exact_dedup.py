"""Exact dedup by composable polynomial fingerprints, confirmed by comparison.

Plan
1. Each text is cut into chunks; a chunk's polynomial hash is computed on its own and shifted by the
   length of what follows it (``hash * base ** suffix``), so a text's fingerprint is the plain sum of
   its chunks' parts modulo a prime: chunks of huge texts can be hashed anywhere, in any order, and
   are combined by a map-side sum.
2. Rows with equal fingerprints and lengths are dealt by (fingerprint, salt) and sorted; a streaming
   pass compares each text, chunk by chunk, with the first of its run. The first rows of each salt are
   compared once more across the salts. A hot group is thus spread over all salts, and a task holds
   two texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ascii_lower, documents, drop_path, materialize, read_documents

#: Two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525077)
CHUNK = 1 << 16


def power(base: int, exponent: int, prime: int) -> int:
    return pow(base, exponent, prime)


def chunk_hash(data: np.ndarray, base: int, prime: int) -> int:
    """Sum of ``(byte + 1) * base ** (bytes after it)`` modulo ``prime``, at most CHUNK bytes at once.

    A product is below 2**40 and a chunk has at most 2**18 bytes, so the sum fits 64 bits.
    """
    table = _powers(base, prime)
    return int((data.astype(np.int64) + 1) @ table[len(table) - len(data) :] % prime)


_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int) -> np.ndarray:
    """base ** (4 * CHUNK - 1), ..., base, 1 modulo prime, by doubling."""
    if (base, prime) not in _tables:
        out = np.ones(1, np.int64)
        while len(out) < 4 * CHUNK:
            out = np.concatenate([out * pow(base, len(out), prime) % prime, out])
        _tables[base, prime] = out
    return _tables[base, prime]


def combine(left: int, right: int, right_length: int, base: int, prime: int) -> int:
    """Fingerprint of a concatenation from the fingerprints of its two halves."""
    return (left * power(base, right_length, prime) + right) % prime


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = {"part_a": [], "part_b": []}
        for chunk, rest in zip(batch.column("chunk"), batch.column("rest"), strict=True):
            data, after = np.frombuffer(chunk.as_py(), np.uint8), rest.as_py()
            for name, base, prime in zip(sums, BASES, PRIMES, strict=True):
                sums[name].append(chunk_hash(data, base, prime) * power(base, after, prime) % prime)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "sha", "bytes")), *(pa.array(x, pa.int64()) for x in sums.values())], names=["doc_id", "key", "sha", "bytes", *sums])


def fingerprints(texts: DataFrame) -> DataFrame:
    """(doc_id, key, sha, bytes, print_a, print_b, copies) for ``texts(doc_id, key, text)``.

    ``key`` tells rows with one doc_id and different texts apart; ``sha`` is the digest of the text;
    ``copies`` is the number of rows with that doc_id and text, whose parts are summed together and
    divided again.
    """
    sized = texts.select("doc_id", "key", F.sha2("text", 256).alias("sha"), F.encode("text", "UTF-8").alias("data")).withColumn("bytes", F.octet_length("data").cast("long"))
    n_chunks = f"greatest((bytes + {CHUNK - 1}) div {CHUNK}, 1L)"
    chunks = sized.withColumn("k", F.explode(F.expr(f"sequence(0L, {n_chunks} - 1L)"))).select(
        "doc_id", "key", "sha", "bytes", F.expr(f"substring(data, cast(k * {CHUNK} + 1 as int), {CHUNK})").alias("chunk"), F.expr(f"greatest(bytes - (k + 1) * {CHUNK}, 0L)").alias("rest")
    )
    parts = chunks.mapInArrow(_parts, "doc_id long, key long, sha string, bytes long, part_a long, part_b long")
    summed = parts.groupBy("doc_id", "key", "sha", "bytes").agg(F.sum("part_a").alias("a"), F.sum("part_b").alias("b"), F.count("*").alias("chunks"))
    summed = summed.withColumn("copies", F.expr(f"chunks div {n_chunks}"))
    return summed.select("doc_id", "key", "sha", "bytes", F.expr(f"(a div copies) % {PRIMES[0]}").alias("print_a"), F.expr(f"(b div copies) % {PRIMES[1]}").alias("print_b"), "copies")


def same_text(a: str, b: str) -> bool:
    """Chunkwise comparison that ends at the first difference."""
    return len(a) == len(b) and all(a[i : i + CHUNK] == b[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in runs of one fingerprint (and salt), largest doc_id first: each row's first equal row.

    Only the texts of the run's distinct leaders are held, one unless fingerprints collide.
    """
    run, leaders = None, []
    for batch in batches:
        out = {"lead_id": [], "lead_key": [], "lead_text": []}
        for *now, doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("print_a", "print_b", "bytes", "salt", "doc_id", "key")), batch.column("text"), strict=True):
            text = text.as_py()
            if now != run:
                run, leaders = now, []
            found = next((x for x in leaders if same_text(x[2], text)), None)
            if found is None:
                found = (doc_id, key, text)
                leaders.append(found)
            first = found[2] is text
            for name, value in zip(out, (found[0], found[1], text if first else None), strict=True):
                out[name].append(value)
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out["lead_id"], pa.int64()), pa.array(out["lead_key"], pa.int64()), pa.array(out["lead_text"], pa.string())], names=[*rest, *out])


_RUN = ["print_a", "print_b", "bytes", "salt"]


def _compared(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, key, _RUN, salts, text) with lead_id, lead_key and the leaders' lead_text."""
    dealt = rows.repartition(*_RUN).sortWithinPartitions(*_RUN, F.desc_nulls_last("doc_id"))
    schema = "doc_id long, key long, print_a long, print_b long, bytes long, salt int, salts int, lead_id long, lead_key long, lead_text string"
    return dealt.select("doc_id", "key", *_RUN, "salts", "text").mapInArrow(_compare, schema)


def exact_groups(docs: DataFrame, rows_per_salt: int = 1024, bytes_per_salt: int = 64 << 20) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z only.

    Returns (doc_id, keep_id, group_size, kept, text_sha256), one row per input row: of equal texts the
    row with the largest doc_id stays.

    * null text counts as empty; empty texts are equal to each other;
    * a row without doc_id sorts below every doc_id; a group of only such rows has a null keep_id;
    * rows that repeat both doc_id and text all count in group_size and share one decision;
    * rows that repeat a doc_id with different texts are judged each by its own text;
    * copies are compared in parts of ``rows_per_salt`` rows and ``bytes_per_salt`` bytes at most, or of one very long text;
    * an empty table gives an empty result; further columns are ignored.
    """
    texts = documents(docs).select("doc_id", ascii_lower(F.col("text")).alias("text")).withColumn("key", F.xxhash64("text"))
    prints, _ = materialize(fingerprints(texts), "prints")
    suspects = prints.groupBy("print_a", "print_b", "bytes").agg(F.count("*").alias("members")).where("members > 1")
    suspects, _ = materialize(suspects.select("print_a", "print_b", "bytes", F.expr(f"cast(ceil(greatest(members / {rows_per_salt}, least(members, members * bytes / {bytes_per_salt}))) as int)").alias("salts")), "suspects")
    rows = prints.select("doc_id", "key", "print_a", "print_b", "bytes").join(suspects, ["print_a", "print_b", "bytes"]).withColumn("salt", F.expr("cast(pmod(xxhash64(doc_id, key), salts) as int)"))
    rows = rows.select(F.col("doc_id").alias("row_id"), F.col("key").alias("row_key"), *_RUN, "salts")
    texts_of = texts.join(rows, texts["doc_id"].eqNullSafe(rows["row_id"]) & (texts["key"] == rows["row_key"])).dropDuplicates(["doc_id", "key"])
    first, first_path = materialize(_compared(texts_of.select("doc_id", "key", *_RUN, "salts", "text")), "first")

    # Leaders of groups with several salts meet once more.
    leaders = first.where("salts > 1 and lead_text is not null").select("doc_id", "key", "print_a", "print_b", "bytes", F.lit(0).alias("salt"), "salts", F.col("lead_text").alias("text"))
    again = _compared(leaders).select(F.col("doc_id").alias("sub_id"), F.col("key").alias("sub_key"), F.col("lead_id").alias("top_id"), F.col("lead_key").alias("top_key"), F.lit(True).alias("moved"))
    joined = first.join(again, first["lead_id"].eqNullSafe(again["sub_id"]) & (first["lead_key"] == again["sub_key"]), "left")
    classes = joined.select("doc_id", "key", F.when(F.col("moved"), F.col("top_id")).otherwise(F.col("lead_id")).alias("keep_id"), F.when(F.col("moved"), F.col("top_key")).otherwise(F.col("lead_key")).alias("class_key"))
    classes, _ = materialize(classes, "classes")
    drop_path(docs.sparkSession, first_path)

    member = classes.select(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key"), "keep_id", "class_key")
    rows = prints.select("doc_id", "key", "sha", "copies").join(member, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left")
    alone = F.col("m_key").isNull()
    rows = rows.select("doc_id", "key", "sha", "copies", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(alone, F.col("key")).otherwise(F.col("class_key")).alias("class_key"))
    sizes = rows.groupBy("keep_id", "class_key").agg(F.sum("copies").alias("group_size")).where("group_size > 1").select(F.col("keep_id").alias("g_id"), F.col("class_key").alias("g_key"), "group_size")
    out = rows.join(sizes, F.col("keep_id").eqNullSafe(F.col("g_id")) & (F.col("class_key") == F.col("g_key")), "left").withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
    return out.select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged.

    The row with the largest doc_id stays; of rows that repeat doc_id and text, any one stays. Null and empty texts are
    equal, so one row of them stays, with the text it has; a null doc_id sorts below every other.
    """
    groups, _ = materialize(exact_groups(docs), "groups")
    gone = groups.where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha")).distinct()
    sha = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)
    left = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (sha == gone["_gone_sha"]), "left_anti")
    if groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        return left
    name = "_sha"
    while name in docs.columns:
        name += "_"
    return left.withColumn(name, F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)).dropDuplicates(["doc_id", name]).drop(name)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_documents(spark, sf_dir))


OP4_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
