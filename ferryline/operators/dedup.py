"""Duplicates among valid rows: flagged, never merged or removed.

Rows are named by ``ord``, a plain bigint or any orderable column that follows the source's order; with
several files use struct(_src_file, _row).
"""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import remove_accents, strip
from ..working import written
from .name_index import earliest

#: Keys of exact matches in the order of priority, and the threshold for names.
EXACT_KEYS = ("document", "customer_document", "external_id", "email")
THRESHOLD = 0.80


def _key(c: str) -> Column:
    return F.lower(strip(F.col(c)))


def find_exact(valid: DataFrame, ord: str = "_row") -> DataFrame:
    """(ord, matched, key, value): a row with a key value seen before, once, by its first such key.

    It points to the first valid row with that value. The first row of a value is a minimum, combined
    before the shuffle, so a very common value fills no task; the rows then meet it in an equi-join.
    """
    keys = [k for k in EXACT_KEYS if k in valid.columns]
    long = valid.select(F.col(ord).alias("ord"), F.explode(F.array(*(F.struct(F.lit(i).alias("priority"), F.lit(k).alias("key"), _key(k).alias("value")) for i, k in enumerate(keys)))).alias("k"))
    long = long.select("ord", "k.priority", "k.key", "k.value").where("value is not null")
    first = long.groupBy("key", "value").agg(F.min("ord").alias("matched"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = long.join(first, ["key", "value"]).where("matched < ord")
    best = seen.groupBy("ord").agg(F.min_by(F.struct("matched", "key", "value"), "priority").alias("m"))
    return best.select("ord", "m.matched", "m.key", "m.value")


def name_similarity(a: str, b: str) -> float:
    """Ratcliff/Obershelp ratio of (current, previous)."""
    return difflib.SequenceMatcher(None, a, b).ratio()


#: Fixed value: letters whose counts place a name of a large block, each group in a row of steps; with the length, they say which parts can meet.
_PLACED_BY = ("a", "ei", "ou", "rlmn", "stdc")
_STEPS = (3, 2, 2, 3, 4, 4)


def _placed(name: Column) -> list[Column]:
    """The length of a name and its numbers of the letters above."""
    return [F.length(name), *(F.length(name) - F.length(F.translate(name, letters, "")) for letters in _PLACED_BY)]


def _parts(entries: DataFrame, part_entries: int) -> DataFrame:
    """``entries(key, value, name, ...)`` of blocks with two or more rows, with ``part``: one for a small block; a larger block is cut by length and
    letters, and evenly within these, into parts of about ``part_entries``."""
    blocks = entries.groupBy("key", "value").agg(F.count("*").alias("n"), F.max(F.col("first") < F.col("last")).alias("again"))
    blocks = blocks.where((F.col("n") > 1) | F.col("again")).select("key", "value", "n")
    inside = entries.join(blocks, ["key", "value"])
    cell = F.xxhash64(*(F.floor(x / F.lit(step)) for x, step in zip(_placed(F.col("name")), _STEPS, strict=True)))
    inside = inside.withColumn("cell", F.when(F.col("n") <= part_entries, F.lit(0).cast("long")).otherwise(cell)).drop("n")
    sizes = inside.groupBy("key", "value", "cell").agg(F.ceil(F.count("*") / F.lit(part_entries)).cast("int").alias("cuts"))
    return inside.join(sizes, ["key", "value", "cell"]).withColumn("part", F.struct("cell", F.pmod(F.xxhash64("name"), F.col("cuts")).alias("cut"))).drop("cell", "cuts")


def _part_pairs(parts: DataFrame, threshold: float) -> DataFrame:
    """(key, value, part_a, part_b) of parts of one block, each pair once, whose names' lengths and letters can come close enough.

    A part is summed up in the least and greatest of each number; two names are at least as far apart as the gaps between these, and at most
    (1 - threshold) * (their lengths) where they reach the threshold. The rows here are parts, about one for 500 names.
    """
    numbers = [f"p{i}" for i in range(len(_STEPS))]
    placed = parts.select("key", "value", "part", *(c.alias(n) for c, n in zip(_placed(F.col("name")), numbers, strict=True)))
    boxes = placed.groupBy("key", "value", "part").agg(*(f(n).alias(f"{n}_{x}") for n in numbers for f, x in ((F.min, "low"), (F.max, "high"))))
    one, other = (boxes.select("key", "value", *(F.col(c).alias(f"{c}_{side}") for c in boxes.columns if c not in ("key", "value"))) for side in "ab")

    def gap(n: str) -> Column:
        return F.greatest(F.lit(0), F.col(f"{n}_low_a") - F.col(f"{n}_high_b"), F.col(f"{n}_low_b") - F.col(f"{n}_high_a"))

    allowed = F.lit(1 - threshold) * (F.col("p0_high_a") + F.col("p0_high_b")) + F.lit(1e-6)
    letters = sum((gap(n) for n in numbers[1:]), F.lit(0))
    met = one.join(other, ["key", "value"]).where((F.col("part_a") <= F.col("part_b")) & (F.greatest(gap("p0"), letters) <= allowed))
    return met.select("key", "value", "part_a", "part_b")


def _scored(threshold: float):
    """For each name that looks, the earliest one it sees in its unit and is similar to, with the ratio in three decimals; a name that finds none comes out
    with nulls where it stays ``open``.

    Rows come sorted by (key, value, pair, side, first), and a unit is held at a time. Names of a unit with two sides see those of the other side.
    """
    names = ["key", "value", "name", "prev_name", "prev_first", "similarity"]

    def ordinal(x):
        return tuple(x.values()) if isinstance(x, dict) else x

    def compared(batch: pa.RecordBatch, units: list[tuple], start: int, until: int) -> tuple[list[int], list[int | None], list[float | None]]:
        rows, prev, similarity = [], [], []
        name, first, last, side, looks, seen, open_ = (batch.column(c).slice(start, until - start).to_pylist() for c in ("name", "first", "last", "side", "looks", "seen", "open"))
        met = bytearray(until - start)
        first, last = [ordinal(x) for x in first], [ordinal(x) for x in last]
        at = 0
        for _, unit in groupby(units[start:until]):
            n = len(list(unit))
            half = at + side[at : at + n].count(0)
            ends = [(at, half), (half, at + n)]
            for own, other in zip(ends, reversed(ends)) if at < half < at + n else [((at, at + n), (at, at + n))]:
                x, y = [k for k in range(*own) if looks[k]], [k for k in range(*other) if seen[k]]
                before = [first[k] for k in y]
                for i, j, ratio in earliest([name[k] for k in x], [name[k] for k in y], [bisect_left(before, last[k]) for k in x], threshold) if x and y else ():
                    rows.append(start + x[i])
                    prev.append(start + y[j])
                    similarity.append(round(ratio, 3))
                    met[x[i]] = 1
            at += n
        alone = [start + k for k in range(until - start) if open_[k] and looks[k] and not met[k]]
        rows += alone
        prev += [None] * len(alone)
        similarity += [None] * len(alone)
        return rows, prev, similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def done(batch: pa.RecordBatch, whole: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
            units = list(zip(*(batch.column(c).to_pylist() for c in ("key", "value", "pair")), strict=True))
            until = len(units)
            while not whole and until and units[until - 1] == units[-1]:
                until -= 1
            rows, prev, similarity = compared(batch, units, 0, until)
            now, then = batch.take(pa.array(rows, pa.int64())), batch.take(pa.array(prev, pa.int64()))
            return pa.RecordBatch.from_arrays([now.column("key"), now.column("value"), now.column("name"), then.column("name"), then.column("first"), pa.array(similarity, pa.float64())], names=names), batch.slice(until)

        for batch in batches:
            out, held = done(pa.concat_batches([held, batch]) if held is not None else batch, False)
            yield out
        if held is not None:
            yield done(held, True)[0]

    return run


def _units(rows: DataFrame, unit: list[str], threshold: float) -> DataFrame:
    """(key, value, name, prev_name, prev_first, similarity): ``rows(key, value, pair, side, name, first, last, looks, seen, open)`` compared by units."""
    # A stated number of partitions is not merged at run time: the rows are few, the work on them is not.
    sent = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *unit).sortWithinPartitions(*unit, "side", "first")
    kind = rows.schema["first"].dataType.simpleString()
    return sent.mapInArrow(_scored(threshold), f"key string, value string, name string, prev_name string, prev_first {kind}, similarity double")


def _with_first_names(entries: DataFrame, threshold: float, part_entries: int, firsts: int) -> tuple[DataFrame, DataFrame, int]:
    """(matches of names among the ``firsts`` earliest ones of their block; (key, value, name) of those whose block has more names than these and that have
    no match there; their number).

    What is found among the earliest names is the earliest there is. A block is cut evenly, and its earliest names are sent to all its cuts.
    """
    blocks = entries.groupBy("key", "value").agg(F.count("*").alias("n"), F.max(F.col("first") < F.col("last")).alias("again")).where((F.col("n") > 1) | F.col("again")).drop("again")
    # The limit on the row number is taken in every task before the shuffle.
    early = entries.select("key", "value", "first", F.row_number().over(W.partitionBy("key", "value").orderBy("first")).alias("at")).where(F.col("at") <= firsts)
    inside = entries.join(blocks.join(early.groupBy("key", "value").agg(F.max("first").alias("until")), ["key", "value"]), ["key", "value"])
    inside = inside.withColumn("cuts", F.ceil(F.col("n") / F.lit(4 * part_entries)).cast("int")).withColumn("cut", F.pmod(F.xxhash64("name"), F.col("cuts")).cast("int"))
    seen = F.col("first") <= F.col("until")
    rows = inside.select("*", seen.alias("seen"), F.explode(F.when(seen, F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array("cut"))).alias("pair"))
    rows = rows.select("key", "value", F.col("pair").cast("long").alias("pair"), F.lit(0).alias("side"), "name", "first", "last", (F.col("cut") == F.col("pair")).alias("looks"), "seen", ((F.col("n") > firsts) & (F.col("last") > F.col("until"))).alias("open"))
    counted, unmatched = Observation(), F.col("similarity").isNull()
    looked, _ = written(_units(rows, ["key", "value", "pair"], threshold), "first_names", counted, F.count_if(unmatched).alias("open"))
    return looked.where(~unmatched), looked.where(unmatched).select("key", "value", "name"), counted.get["open"]


def find_possible(valid: DataFrame, exact: DataFrame, ord: str = "_row", threshold: float = THRESHOLD, part_entries: int = 500, firsts: int = 64) -> DataFrame:
    """(ord, matched, key, value, similarity) for rows that are no exact match: the first earlier row
    with a similar name and the same phone, or else the same postal code.

    Blocks are the distinct (phone or postal code, name) pairs: a value shared by very many rows with one name is one entry.
    Only the earliest similar name of an entry counts, so every name is first compared with the earliest ones of its block, up to the first
    similar one. For names that have none there, a large block is cut into parts by the lengths and letters of its names, and only parts that can
    hold a pair of similar names meet, dealt to the tasks by the pair of parts. Where names meet, their letters and letter pairs exclude nearly all
    dissimilar pairs (see ``name_index``) before the ratio is computed. Runs when it is called, as its working tables are written once.
    """
    name = next(n for n in ("full_name", "name") if n in valid.columns)
    keys = [k for k in ("phone", "postal_code") if k in valid.columns]
    # The accents go in a select of their own, once per row, and are written: the entries and the rows that look for a match both read them,
    # and a filter on the name does not compute it twice.
    plain = valid.select(F.col(ord).alias("ord"), remove_accents(F.lower(strip(F.col(name)))).alias("name"), *(_key(k).alias(k) for k in keys))
    rows, _ = written(plain, "plain_names")
    long = rows.where("name <> ''").select("ord", "name", F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(k).alias("key"), F.col(k).alias("value")) for i, k in enumerate(keys)))).alias("k"))
    long = long.select("ord", "name", "k.rank", "k.key", "k.value").where("value is not null")
    entries, _ = written(long.groupBy("key", "value", "name").agg(F.min("ord").alias("first"), F.max("ord").alias("last")), "entries")
    early, left_over, n_open = _with_first_names(entries, threshold, part_entries, firsts)
    # Where every name has met one among the earliest, there is nothing more to compare.
    scored = early if not n_open else early.unionByName(_late_names(entries, left_over, threshold, part_entries))
    scored = scored.select("key", "value", "name", "prev_first", "similarity")
    left = long.join(exact.select(F.col("ord").alias("x")), F.col("ord") == F.col("x"), "left_anti")
    found = left.join(scored, ["key", "value", "name"]).where("prev_first < ord")
    best = found.groupBy("ord").agg(F.min_by(F.struct(F.col("prev_first").alias("matched"), "key", "value", "similarity"), F.struct("prev_first", "rank")).alias("m"))
    return best.select("ord", "m.matched", "m.key", "m.value", "m.similarity")


def _late_names(entries: DataFrame, left_over: DataFrame, threshold: float, part_entries: int) -> DataFrame:
    """(key, value, name, prev_name, prev_first, similarity): the earliest similar name of the names ``left_over``, wherever it stands in their block."""
    # Only blocks with names that are still open, all names of them: these are what the open ones may resemble.
    blocks = left_over.select("key", "value").distinct()
    looking = left_over.select("key", "value", "name", F.lit(True).alias("looks"))
    parts = _parts(entries.join(blocks, ["key", "value"]), part_entries).join(looking, ["key", "value", "name"], "left").withColumn("looks", F.coalesce("looks", F.lit(False)))
    active = parts.where("looks").select("key", "value", "part").distinct()
    met = _part_pairs(parts, threshold)
    met = met.join(active.select("key", "value", F.col("part").alias("part_a"), F.lit(True).alias("on_a")), ["key", "value", "part_a"], "left")
    met = met.join(active.select("key", "value", F.col("part").alias("part_b"), F.lit(True).alias("on_b")), ["key", "value", "part_b"], "left").where("on_a or on_b")
    ends = met.select("key", "value", F.explode(F.array(F.struct(F.col("part_a").alias("part"), F.lit(0).alias("side")), F.struct(F.col("part_b").alias("part"), F.lit(1).alias("side")))).alias("e"), F.xxhash64("part_a", "part_b").alias("pair"), (F.col("part_a") == F.col("part_b")).alias("alone"))
    # A part that meets itself is sent once.
    ends = ends.where(~(F.col("alone") & (F.col("e.side") == 1))).select("key", "value", "e.part", "e.side", "pair")
    unit = ["key", "value", "pair"]
    sent = parts.join(ends, ["key", "value", "part"]).select(*unit, "side", "name", "first", "last", "looks", F.lit(True).alias("seen"), F.lit(False).alias("open"))
    return _units(sent, unit, threshold).groupBy("key", "value", "name").agg(F.min_by(F.struct("prev_name", "prev_first", "similarity"), "prev_first").alias("m")).select("key", "value", "name", "m.*")


def duplicates(exact: DataFrame, possible: DataFrame) -> DataFrame:
    """(ord, matched, kind, key, value, similarity)"""
    one = exact.select("ord", "matched", F.lit("exact").alias("kind"), "key", "value", F.lit(None).cast("double").alias("similarity"))
    return one.unionByName(possible.select("ord", "matched", F.lit("possible").alias("kind"), "key", "value", "similarity"))


def annotate_duplicates(validated: DataFrame, found: DataFrame, ord: str = "_row") -> DataFrame:
    """``validated`` with warnings appended to the issues, exact first; no row is removed or rejected."""
    null = F.lit(None).cast("string")
    warning = F.struct(
        F.concat(F.lit("duplicate_"), F.col("kind")).alias("code"),
        F.lit("warning").alias("severity"),
        F.col("key").alias("field"),
        F.concat(F.lit("same "), F.col("key"), F.lit(" as row "), F.col("matched").cast("string")).alias("message"),
        F.col("value").alias("original_value"),
        null.alias("normalized_value"),
    )
    per_row = found.select(F.col("ord").alias("_dup"), F.struct(F.when(F.col("kind") == "exact", 0).otherwise(1).alias("at"), warning.alias("warning")).alias("w"))
    per_row = per_row.groupBy("_dup").agg(F.transform(F.array_sort(F.collect_list("w")), lambda x: x["warning"]).alias("_more"))
    joined = validated.join(per_row, F.col(ord) == F.col("_dup"), "left")
    return joined.withColumn("issues", F.when(F.col("_more").isNull(), F.col("issues")).otherwise(F.concat("issues", "_more"))).drop("_dup", "_more")
