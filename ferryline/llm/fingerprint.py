"""Document fingerprints: a homomorphic multiset hash of paragraphs, with DataFrame functions only.

Every paragraph (a line, cut further at sentence ends and, where long, at word boundaries) is hashed to a wide vector; a
document's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo powers of two. So the order of paragraphs
does not matter, equal multisets have equal fingerprints, and a paragraph is inserted or deleted by adding or
subtracting its vector (``add``, ``subtract``).

Lanes: 1 count and 8 sums of 32 hash bits (modulo 2**32) tell multisets apart; 128 sums of +1 or -1 by hash bits
(modulo 2**16) keep distances. These take the first, second, ... copy of a paragraph as different elements, so that each
is there once or not at all and the squared difference of the lanes estimates the size of the multisets' difference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import documents, read_documents

_HASHES = 4
_STRONG = 1 + 2 * _HASHES
_NEAR = 128
_M32, _M16 = (1 << 32) - 1, (1 << 16) - 1


#: After this many characters, a paragraph is cut behind the next word of 3, 6 or 9 characters. So cuts depend on the text
#: before them only, and are met again after a change. \G: one pass, also where no such word comes.
_LONG = 64
_CUT = rf"\G([^\r\n]{{{_LONG}}}[^\r\n]*?(?<= )(?:\S{{3}}|\S{{6}}|\S{{9}})) +(?=\S)"


def paragraphs(text: Column) -> Column:
    """Non-empty lines, cut after . ! ? before a blank, and long ones further at word boundaries."""
    parts = F.filter(F.split(text, r"[\r\n]+|(?<=[.!?]) +"), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > _LONG, F.split(F.regexp_replace(p, _CUT, "$1\n"), "\n")).otherwise(F.array(p))))


def paragraph_hashes(text: Column, name: str) -> list[Column]:
    """Independent 64-bit hashes of every paragraph: columns name0, name1, ... of array<long>.

    ``fingerprint`` reads each once per lane, so they must be selected as columns before it.
    """
    return _hashes(paragraphs(text), name)


def _hashes(parts: Column, name: str) -> list[Column]:
    return [F.transform(parts, _hash(k)).alias(f"{name}{k}") for k in range(_HASHES)]


def _hash(k: int):
    return lambda p: F.xxhash64(F.lit(k), p)


def _let(value: Column, f) -> Column:
    """``f(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _numbered(hashes: Column, earlier: Column | None) -> Column:
    """Hashes of (paragraph, number of its copy), from 0 or after the copies in ``earlier``: runs of the sorted hashes."""

    def run(s: Column, a: Column, end: Column) -> Column:
        before = F.lit(0) if earlier is None else F.size(F.filter(earlier, lambda x: x == F.get(s, a)))
        return _let(before, lambda n: F.transform(F.sequence(a, end - 1), lambda i: F.xxhash64(F.get(s, a), i - a + n)))

    def starts(s: Column) -> Column:
        return F.filter(F.transform(s, lambda h, i: F.when((i == 0) | (h != F.get(s, i - 1)), i)), lambda i: i.isNotNull())

    return _let(F.sort_array(hashes), lambda s: _let(starts(s), lambda at: F.flatten(F.transform(at, lambda a, r: run(s, a, F.coalesce(F.get(at, r + 1), F.size(s)))))))


def fingerprint(hashes: list[Column], earlier: list[Column] | None = None) -> Column:
    """The vector of ``paragraph_hashes``: array<long> of _STRONG lanes modulo 2**32 and _NEAR lanes modulo 2**16.

    Copies are numbered from the first one; with ``earlier`` (``paragraph_hashes`` too) after those in it.
    """

    def total(k: int, term) -> Column:
        return F.aggregate(hashes[k], F.lit(0).cast("long"), lambda acc, h: acc + term(h))

    def signs(elements: Column) -> Column:
        """For each bit of the elements' hashes: elements with the bit less elements without it."""
        count = lambda j: F.aggregate(elements, F.lit(0).cast("long"), lambda acc, h: acc + F.getbit(h, j))
        return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: (count(j) * 2 - F.size(elements)).bitwiseAND(F.lit(_M16)))

    strong = [F.size(hashes[0]).cast("long")]
    for k in range(_HASHES):
        strong += [total(k, lambda h: h.bitwiseAND(F.lit(_M32))), total(k, lambda h: F.shiftrightunsigned(h, 32))]
    near = F.array(*(_numbered(hashes[k], earlier and earlier[k]) for k in range(_NEAR // 64)))
    return F.concat(F.array(*(x.bitwiseAND(F.lit(_M32)) for x in strong)), F.flatten(F.transform(near, signs)))


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    def lane(i: Column, x: Column, y: Column) -> Column:
        return (x + y * sign).bitwiseAND(F.when(i < _STRONG, F.lit(_M32)).otherwise(F.lit(_M16)))

    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p, i: lane(i, p["x"], p["y"]))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of two multisets together, ``b`` made with the paragraphs of ``a`` as ``earlier``; with one paragraph's vector: insertion."""
    return _lanewise(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``, which must be in it: deletion. ``b`` is made with the paragraphs that stay as ``earlier``."""
    return _lanewise(a, b, -1)


def as_hex(vector: Column) -> Column:
    strong = F.array_join(F.transform(F.slice(vector, 1, _STRONG), lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return F.lower(F.concat(strong, F.array_join(F.transform(F.slice(vector, _STRONG + 1, _NEAR), lambda x: F.lpad(F.hex(x), 4, "0")), "")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two multisets of paragraphs, 0 to 1; 1 for equal fingerprints.

    From the sizes m and n and the estimated size d of the difference: i = (m + n - d) / 2 shared, i / (m + n - i).
    """
    def near(v: Column) -> Column:
        return F.slice(v, _STRONG + 1, _NEAR)

    def squared(p: Column) -> Column:
        gap = (p["x"] - p["y"]).bitwiseAND(F.lit(_M16))
        signed = F.when(gap > _M16 // 2, gap - _M16 - 1).otherwise(gap)
        return signed * signed

    apart = F.aggregate(F.transform(F.arrays_zip(near(a).alias("x"), near(b).alias("y")), squared), F.lit(0).cast("long"), lambda acc, x: acc + x) / F.lit(float(_NEAR))
    both = (a[0] + b[0]).cast("double")
    shared = F.greatest(F.lit(0.0), (both - apart) / 2)
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), shared / (both - shared)))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``range`` and ``rank`` columns such that the next document, in descending
    doc_id order, is the next row of the window (range, rank desc, text desc); ``ghost`` rows close each range.

    Ranges are cut at quantiles of doc_id, so no task sorts them all. The first row of each lower range (and,
    for the lowest one, of the highest) is repeated at the end of the range above as a ghost row: one document per range.
    """
    spark = docs.sparkSession
    wanted = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = docs.withColumn("rank", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = ranked.agg(F.percentile_approx("rank", [i / wanted for i in range(1, wanted)] or [0.5], 10 * wanted)).first()[0] or []
    cuts = sorted(set(cuts))
    ranged = ranked.withColumn("range", reduce(lambda acc, c: acc + F.when(F.col("rank") >= c, 1).otherwise(0), cuts, F.lit(0)) if len(cuts) < 64 else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("rank"))))
    # One row per range: its greatest doc_id.
    heads = [tuple(r) for r in ranged.groupBy("range").agg(F.max("rank")).orderBy("range").collect()]
    ghosts = [(head, heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)]
    table = spark.createDataFrame(ghosts, "head long, above int")
    repeated = ranged.join(F.broadcast(table), F.col("rank") == F.col("head")).select("doc_id", "text", "rank", F.col("above").alias("range"), F.lit(True).alias("ghost"))
    return ranged.select("doc_id", "text", "rank", "range", F.lit(False).alias("ghost")).unionByName(repeated)


def fingerprint_digests(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all) of the next document,
    in descending doc_id order, after the last the first. Returns (doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next), one row per input row.

    * null text counts as empty; two empty texts are equal (likeness 1), an empty and another one 0;
    * rows that repeat a doc_id follow one another by descending text; a null doc_id comes last;
    * a single row is its own next document; an empty table gives an empty result.
    """
    rows = with_next(documents(docs))
    order = W.partitionBy("range").orderBy("ghost", F.desc("rank"), F.desc("text"))
    half = (F.col("n_chars") / 2).cast("int")
    rows = rows.withColumns({"next_text": F.coalesce(F.lead("text").over(order), F.lit("")), "n_chars": F.length("text")})
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "rank", "range", "ghost", "text", "n_chars", edited.alias("edited"))
    rows = rows.select("doc_id", "rank", "range", "ghost", "text", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("changed"))
    rows = rows.select("doc_id", "rank", "range", "ghost", "text", "n_chars", "edited_sha256", *_hashes(F.col("own"), "own"), *_hashes(F.col("changed"), "changed"))
    own, changed = ([F.col(f"{name}{k}") for k in range(_HASHES)] for name in ("own", "changed"))
    rows = rows.select("doc_id", "rank", "range", "ghost", "text", "n_chars", "edited_sha256", fingerprint(own).alias("own"), fingerprint(changed).alias("changed"))
    rows = rows.withColumn("next", F.lead("own").over(order)).where("not ghost")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("own")).alias("fingerprint"),
        as_hex(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_digests(read_documents(spark, sf_dir))
