"""N-gram Jaccard join: linked documents by a T-occurrence search with DivideSkip.

Plan
1. Every document becomes its set of distinct n-word shingles (64-bit hashes). Of equal sets, in a
   group of texts and then in the corpus, one represents the others.
2. Candidates. Spark counts in how many sets each shingle occurs. Two sets over the threshold share one of the
   few rarest shingles of each (as many as a partner may lack, and one more). Shingles of one set find nobody: a document with
   more of them than a partner may lack has no partner and goes no further. The other documents meet at
   their rarest shared shingles, so a passage that very many documents share brings no two of them together.
   In a group of texts, a shingle's documents are led by the first, so it leaves the group once.
3. Documents connected by candidates form a cluster. In it an inverted index over whole sets answers one T-occurrence query per
   document: the short lists are merged by a heap, the long ones are probed by binary search, and documents that reach
   the required overlap are compared exactly. Large clusters are cut into blocks, and
   every pair of blocks is searched, so that no task holds more than two blocks.
4. Links and set equalities give the connected components.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, drop_path, materialize, read_documents
from .components import connected_components
from .key_counts import classes_of, column, counted, frequency_classes, with_classes, with_sources
from .words import mix, shingle_sets, signed, word_hashes

_SALT = np.uint64(0xD6E8FEB86659FD93)
_FOUND = "doc_id long, n_shingles long, set_a long, set_b long, twin long, stored boolean, v long, key long, shingles binary"
_TYPES = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "set_a": pa.int64(), "set_b": pa.int64(), "twin": pa.int64(), "stored": pa.bool_(), "v": pa.int64(), "key": pa.int64(), "shingles": pa.binary()}


class _Sets:
    """The sets of a source's documents; of equal ones, that of the least doc_id is stored for all."""

    def __init__(self, table: pa.Table, n: int):
        self.ids = table.column("doc_id").to_pylist()
        shingles, edges = shingle_sets(*word_hashes(column(table, "text"), lower=True), n)
        sizes = np.diff(edges)
        self.n_shingles, self.signs = sizes.tolist(), []
        for x in (shingles, shingles ^ _SALT):
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(mix(x), out=sums[1:])
            self.signs.append(signed(sums[edges[1:]] - sums[edges[:-1]]).tolist())
        whole = list(zip(*self.signs, self.n_shingles, strict=True))
        first: dict[tuple, int] = {}
        for i, sign in enumerate(whole):
            if self.ids[i] is not None and sign[2] and (sign not in first or self.ids[i] < self.ids[first[sign]]):
                first[sign] = i
        self.stored = np.zeros(len(self.ids), bool)
        self.stored[list(first.values())] = True
        self.twins = [None if self.stored[i] or self.ids[i] is None or not sign[2] else self.ids[first[sign]] for i, sign in enumerate(whole)]
        #: Of the stored sets: shingles one set after the other, sizes, documents.
        self.flat, self.sizes = shingles[np.repeat(self.stored, sizes)], sizes[self.stored]
        self.docs = np.array([self.ids[i] for i in np.flatnonzero(self.stored).tolist()], np.int64)


def _keys(n: int, bits: int):
    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(counted(_Sets(table, n).flat, bits), return_counts=True)

    return keys_of


def rarest(flat: np.ndarray, classes: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sets that may have a partner, owners, keys): the rarest shingles of each of these sets that others share.

    A partner has at least ``num / den`` of a set's shingles, so it lacks fewer than ``reach`` of them and has one of any ``reach``
    of them: the first ones by (class, hash), an order that all sets share.
    """
    reach = sizes - -(-num * sizes // den) + 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    may = np.bincount(owner[classes == 0], minlength=len(sizes)) < reach
    keep = may[owner]
    flat, classes, owner = flat[keep], classes[keep], owner[keep]
    order = np.lexsort((flat, classes, owner))
    flat, classes, owner = flat[order], classes[order], owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    taken = (rank < reach[owner]) & (classes > 0)
    return may, owner[taken], flat[taken]


def _candidates(n: int, num: int, den: int, bits: int):
    """Rows of four kinds: every document with its set's size and signature; (doc_id, v): documents with a shared key;
    (doc_id, key): a key's first document; (doc_id, shingles): sets that may have a partner."""

    def part(**columns: pa.Array) -> pa.Table:
        count = len(columns["doc_id"])
        return pa.table({c: columns.get(c, pa.nulls(count, t)) for c, t in _TYPES.items()}, schema=pa.schema(_TYPES.items()))

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _Sets(table, n)
        rows = {"doc_id": sets.ids, "n_shingles": sets.n_shingles, "set_a": sets.signs[0], "set_b": sets.signs[1], "twin": sets.twins, "stored": sets.stored.tolist()}
        out = [part(**{c: pa.array(x, _TYPES[c]) for c, x in rows.items()})]
        if len(sets.flat):
            classes = classes_of(answers)[np.unique(counted(sets.flat, bits), return_inverse=True)[1]]
            may, owner, keys = rarest(sets.flat, classes, sets.sizes, num, den)
            docs = sets.docs[owner]
            order = np.lexsort((docs, keys))
            docs, keys = docs[order], keys[order]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            lead = docs[np.flatnonzero(first)[np.cumsum(first) - 1]]
            pairs = np.unique(np.stack([docs, lead])[:, docs != lead], axis=1)
            ends, chosen = np.cumsum(sets.sizes), np.flatnonzero(may)
            out += [
                part(doc_id=pa.array(pairs[0]), v=pa.array(pairs[1])),
                part(doc_id=pa.array(docs[first]), key=pa.array(signed(keys[first]))),
                part(doc_id=pa.array(sets.docs[chosen]), shingles=pa.array([sets.flat[ends[k] - sets.sizes[k] : ends[k]].tobytes() for k in chosen.tolist()], pa.binary())),
            ]
        return pa.concat_tables(out)

    return run


def required_overlap(a: int, b: int, num: int, den: int) -> int:
    """Least intersection with which sets of sizes a and b reach num / den of their union."""
    return -(-num * (a + b) // (num + den))


def t_occurrence(lists: list[np.ndarray], needed: int, skip: np.ndarray, mu: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least ``needed`` of the ascending lists, with their counts (DivideSkip).

    The longest lists are set aside; the others are merged by a heap of their heads, and members that can still reach ``needed``
    are looked up in the long lists by binary search, the shortest of them first: most members fail there. ``mu`` is the cost of a
    look-up, of many members at once, against that of a step of the heap. Members marked in ``skip`` are left out.
    """
    none = np.empty(0, np.int64)
    if len(lists) < needed:
        return none, none
    by_length = sorted(lists, key=len, reverse=True)
    n_long = min(needed - 1, int(needed / (mu * math.log2(max(2, len(by_length[0]))) + 1)))
    long, short = by_length[:n_long], by_length[n_long:]
    members, counts, last, count = [], [], -1, 0
    for member in heapq.merge(*(x.tolist() for x in (y[~skip[y]] for y in short) if len(x))):
        if member == last:
            count += 1
            continue
        if count + n_long >= needed:
            members.append(last)
            counts.append(count)
        last, count = member, 1
    if count and count + n_long >= needed:
        members.append(last)
        counts.append(count)
    members, counts = np.array(members, np.int64), np.array(counts, np.int64)
    for i, probed in enumerate(reversed(long)):
        if not len(members):
            break
        at = np.searchsorted(probed, members)
        at[at == len(probed)] = 0
        counts = counts + (probed[at] == members)
        keep = counts + (n_long - 1 - i) >= needed
        if not keep.all():
            members, counts = members[keep], counts[keep]
    return members, counts


def links_within(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets (positions), found by T-occurrence queries.

    Two sets in one tree need no further comparison: a query skips its own tree, and, while its set is indexed, the sets that have
    asked before, for these have met it. Once a tree has most of the indexed sets, they
    leave the index: each of them asks once, and every set outside that tree stays indexed, so no pair is lost.
    """
    sizes = np.array([len(s) for s in sets])
    tree, out, main = np.arange(len(sets)), [], None

    def index(members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate([sets[i] for i in members])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(members.astype(np.int32), sizes[members])[order]
        edge = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        return flat[edge], np.r_[edge, len(flat)], owner

    members = np.arange(len(sets))
    keys, edge, owner = index(members)
    indexed = np.ones(len(sets), bool)
    for x in range(len(sets)):
        at = np.searchsorted(keys, sets[x])
        at[at == len(keys)] = 0
        found = at[keys[at] == sets[x]]
        needed = required_overlap(int(sizes[x]), -(-num * int(sizes[x]) // den), num, den)
        if len(found) < needed:
            continue
        near, both = t_occurrence([owner[edge[k] : edge[k + 1]] for k in found.tolist()], needed, (tree == tree[x]) | (indexed[x] & (np.arange(len(sets)) < x)))
        linked = near[den * both >= num * (sizes[x] + sizes[near] - both)].tolist()
        for y in linked:
            if tree[x] != tree[y]:
                tree[tree == tree[y]] = tree[x]
                out.append((x, y))
        if linked and (main is None or tree[main] == tree[x]):
            inside = tree[members] == tree[x]
            if 2 * np.count_nonzero(inside) > len(members):
                main, members = x if main is None else main, members[~inside]
                indexed[:] = False
                indexed[members] = True
                if not len(members):
                    break
                keys, edge, owner = index(members)
    return out


def _search(num: int, den: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, sets, seen = [], [], set()
        for doc_id, content in zip(table.column("doc_id").to_pylist(), table.column("shingles").to_pylist(), strict=True):
            if (doc_id, content) not in seen:
                seen.add((doc_id, content))
                ids.append(doc_id)
                sets.append(np.frombuffer(content, np.uint64))
        pairs = links_within(sets, num, den) if len(sets) > 1 else []
        return pa.table({"u": pa.array([ids[a] for a, _ in pairs], pa.int64()), "v": pa.array([ids[b] for _, b in pairs], pa.int64())}, schema=schema)

    return run


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block_shingles: int = 4_000_000, block_sets: int = 20_000) -> DataFrame:
    """Link documents whose sets of n-word shingles (A-Z lower-cased) have Jaccard similarity >= num/den.

    Returns (doc_id, n_shingles, component_id), one row per input row: ``component_id`` is the smallest
    doc_id reachable by links. Links are exact for every pair; a tie with the threshold counts as a link.

    * null or wordless text: no shingles, no links, component_id = doc_id;
    * fewer than n words: the whole sequence is the single shingle;
    * a very long text is one set, held by one task;
    * rows that repeat a doc_id are one vertex, each keeps its own row and its own n_shingles;
    * null doc_id: the row keeps its n_shingles, has no links and a null component_id;
    * an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    sourced, bits = with_sources(documents(docs))
    classes, classes_path = materialize(frequency_classes(sourced, _keys(n, bits)), "classes")
    found, _ = materialize(with_classes(sourced, classes, _candidates(n, num, den, bits), _FOUND), "found")
    drop_path(spark, classes_path)
    sizes = found.where("stored is not null").select("doc_id", "n_shingles", "set_a", "set_b", "twin", "stored")
    keys = found.where("key is not null").select("key", F.col("doc_id").alias("u"))
    lead = keys.groupBy("key").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    candidates = keys.join(lead, "key").where("u <> v").select("u", "v").unionByName(found.where("v is not null").select(F.col("doc_id").alias("u"), "v"))
    clusters = connected_components(candidates)

    # Of equal sets, the least doc_id searches for all.
    sign = ["set_a", "set_b", "n_shingles"]
    firsts = sizes.where("stored").groupBy(*sign).agg(F.min("doc_id").alias("rep"))
    same = sizes.where("stored").join(firsts, sign).select("doc_id", "n_shingles", "rep")
    same, _ = materialize(same, "same")
    reps = same.where("doc_id = rep").groupBy("doc_id").agg(F.max("n_shingles").alias("size"))
    members = reps.join(clusters, F.col("doc_id") == F.col("vertex")).select("doc_id", "size", "component")
    weights = members.groupBy("component").agg(F.count("*").alias("docs"), F.sum("size").alias("weight")).where("docs > 1")
    blocks = F.ceil(F.greatest(F.col("weight") / F.lit(block_shingles), F.col("docs") / F.lit(block_sets))).cast("int")
    placed = members.join(weights, "component").select("doc_id", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"))
    dealt = placed.select("doc_id", "component", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("low"), F.greatest(j, F.col("block")).alias("high")))).alias("at"))
    dealt = dealt.select(F.col("doc_id").alias("member"), "component", "at.low", "at.high")
    contents = found.where("shingles is not null").select("doc_id", "shingles")
    parts = dealt.join(contents, F.col("member") == F.col("doc_id")).select("component", "low", "high", "doc_id", "shingles")
    links = parts.groupBy("component", "low", "high").applyInArrow(_search(num, den), "u long, v long")

    links = links.unionByName(same.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    links = links.unionByName(sizes.where("twin is not null").select(F.col("doc_id").alias("u"), F.col("twin").alias("v")))
    labels = connected_components(links)
    return sizes.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("vertex"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; all columns unchanged.

    A row without doc_id stays; rows that repeat a doc_id stay or go together.
    """
    labels = jaccard_components(docs, n, num, den)
    gone = labels.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 3-word shingles, linked at 100 * intersection >= 90 * union."""
    return jaccard_components(read_documents(spark, sf_dir), n=3, num=90, den=100)
