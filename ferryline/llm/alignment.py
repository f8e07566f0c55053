"""Alignment of two tokenisations of the same texts, and how often their tokens meet over the whole corpus.

Text A is a blank and the text in a byte-level file, B the text in a sentencepiece model, which puts the blank in front
itself; both cover the same bytes. Two tokens are linked where their bytes overlap, and the places where tokens of both end
cut a text into groups.

Plan
1. A group of texts (a unit) is encoded, each distinct chunk between blanks once. Then all texts of the unit are merged in
   lockstep: one state vector holds for every lane the current A and B token, a step links them, cuts where both end, and
   advances whichever ends first; lanes that are done are taken out. A text is one lane, a long text several, which
   start at the tokens over every ``LANE``-th byte.
2. A unit lists its distinct id pairs with the number of its texts that hold them, and every text its pairs as numbers in
   this list. All is written once.
3. Spark adds the units' counts up per pair and finds the highest count of each A id. The counts go back to the units by a
   join on the pair, where a frequent pair has one row for each unit, and each unit adds up its texts.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ._shared import documents, groups, materialize, read_documents, tidy
from .tokens import BYTE_ALPHABET, BYTE_BPE, Remembered, Splitter, load, spread, tokenizer_path

PIECE_BPE = "piece_bpe_32k.model"
#: Bytes of text in a unit (a longer text is a unit of its own), and between the starts of a text's lanes.
UNIT_BYTES, LANE = 1_000_000, 512
_BLANK = "▁"


class _PlainSplitter(Splitter):
    """Chunks behind single blanks; names of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path, False)
        self._odd_patterns = self._odd_patterns[len(self.specials) :]
        self.specials = []

    def split_behind_blanks(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """As ``split``, for texts with a blank in front: every chunk starts with its blank."""
        parts = pc.split_pattern(texts, " ")
        edges = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        edges, codes = edges - edges[0], flat.indices.to_numpy(zero_copy_only=False)
        marks = np.concatenate([[0], np.cumsum(self._odd(flat.dictionary)[codes])])
        return pc.binary_join_element_wise("", flat.dictionary, " ").to_pylist(), codes, edges, np.flatnonzero(marks[edges[1:]] > marks[edges[:-1]])


class Aligned:
    """Both tokenisations of a unit's texts, one after the other, with cuts and links.

    ``a``, ``b``: ids; ``a_edges``, ``b_edges``: each text's first token and the end; ``a_cut``, ``b_cut``: whether a group
    ends behind the token; ``link_a``, ``link_b``: the linked tokens, in order.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, a_edges: np.ndarray, b_edges: np.ndarray, a_bytes: np.ndarray, b_bytes: np.ndarray, lane: int):
        self.a, self.b, self.a_edges, self.b_edges = a, b, a_edges, b_edges
        self.a_cut, self.b_cut = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_end, b_end = np.cumsum(a_bytes[a]), np.cumsum(b_bytes[b])
        self._lockstep(a_end, b_end, lane)

    def _lanes(self, a_end: np.ndarray, b_end: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A token, B token, sum of both where the lane ends) at each lane's start."""
        ends = np.r_[0, a_end][self.a_edges]
        begins = ends[:-1][ends[:-1] < ends[1:]]
        starts = np.unique(np.r_[begins, np.arange(lane, ends[-1], lane)])
        i, j = np.searchsorted(a_end, starts, "right"), np.searchsorted(b_end, starts, "right")
        stop = np.r_[(i + j)[1:], len(self.a) + len(self.b)]
        some = i + j < stop
        return i[some], j[some], stop[some]

    def _lockstep(self, a_end: np.ndarray, b_end: np.ndarray, lane: int) -> None:
        i, j, stop = self._lanes(a_end, b_end, lane)
        links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(i):
            links_a.append(i)
            links_b.append(j)
            x, y = a_end[i], b_end[j]
            cut = x == y
            self.a_cut[i[cut]] = True
            self.b_cut[j[cut]] = True
            i, j = i + (x <= y), j + (y <= x)
            live = i + j < stop
            if not live.all():
                i, j, stop = i[live], j[live], stop[live]
        link_a, link_b = np.concatenate(links_a), np.concatenate(links_b)
        # Along the merge the sum of both places grows with every link.
        order = np.argsort(link_a + link_b)
        self.link_a, self.link_b = link_a[order], link_b[order]

    def link_text(self) -> np.ndarray:
        """The text of each link."""
        return np.repeat(np.arange(len(self.a_edges) - 1), np.diff(self.a_edges))[self.link_a]

    def group_counts(self) -> np.ndarray:
        """Groups of each text."""
        return np.diff(np.concatenate([[0], np.cumsum(self.a_cut)])[self.a_edges])

    def written(self, a_names: tuple, b_names: tuple) -> Iterator[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = np.cumsum(self.a_cut) - self.a_cut, np.cumsum(self.b_cut) - self.b_cut
        n_groups = int(self.a_cut.sum())
        until_a, until_b = (np.cumsum(np.bincount(g, minlength=n_groups)) for g in (group_a, group_b))
        # A group's A tokens stand behind the B tokens of the groups before it, its B tokens behind its own A tokens.
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + np.r_[0, until_b][group_a]] = self.a * 2 + self.a_cut
        out[np.arange(len(self.b)) + np.r_[until_a, 0][group_b]] = self.b * 2 + self.b_cut + 2 * a_names[3]
        flat = np.concatenate([a_names[0], b_names[0]])
        starts = np.concatenate([a_names[1], b_names[1] + len(a_names[0])])
        shown, edges = spread(flat, starts, np.concatenate([a_names[2], b_names[2]]), out)
        cuts = edges[self.a_edges + self.b_edges].tolist()
        shown = shown.tobytes()
        for lo, hi in zip(cuts, cuts[1:]):
            yield shown[lo : max(lo, hi - 1)]


def _names(count: int, last: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(signs, starts, lengths, count) of every id with "," and with ``last`` behind it."""
    data = [f"{i}{end}".encode() for i in range(count) for end in (",", last)]
    lengths = np.array([len(x) for x in data], np.int64)
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum(lengths) - lengths, lengths, count


class Aligner:
    """Encodes and merges texts; one per Python worker, with what it remembers of chunks."""

    def __init__(self, a_path: str, b_path: str):
        self.splitter = _PlainSplitter(a_path)
        # Its own copy: here names of special tokens are plain text.
        self.whole_a = Tokenizer.from_file(a_path)
        self.whole_a.no_truncation()
        self.whole_a.no_padding()
        self.whole_a.encode_special_tokens = True
        self.tokenize, self.pieces = load(a_path).model.tokenize, SentencePieceProcessor(model_file=b_path)
        self.n_b = self.pieces.get_piece_size()
        names = {i: t for t, i in self.whole_a.get_vocab(with_added_tokens=True).items()}
        own = {sign: b for b, sign in BYTE_ALPHABET.items()}
        self.a_data = [bytes(own.get(c, ord(c)) for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.b_data = [bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace(_BLANK, " ").encode() for i, piece in enumerate(map(self.pieces.id_to_piece, range(self.n_b)))]
        self.a_bytes, self.b_bytes = (np.array([len(x) for x in data], np.int64) for data in (self.a_data, self.b_data))
        self.a_names, self.b_names = _names(len(self.a_data), "|"), _names(self.n_b, ";")
        #: Chunks may be encoded alone where no piece joins a blank to a sign before it; runs of blanks are odd.
        self.apart = not any(re.search(f"[^{_BLANK}]{_BLANK}", self.pieces.id_to_piece(i)) for i in range(self.n_b))
        self.known = Remembered()

    def _covers(self, texts: list[bytes], sides: tuple[list[bytes], list[bytes]]) -> list[bool]:
        """Whether both tokenisations (ids as bytes) give back each text."""
        out = np.ones(len(texts), bool)
        for ids, data, lengths in zip(sides, (self.a_data, self.b_data), (self.a_bytes, self.b_bytes), strict=True):
            flat, count = np.frombuffer(b"".join(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids)) // 8
            laid, edges = spread(np.frombuffer(b"".join(data), np.uint8), np.cumsum(lengths) - lengths, lengths, flat)
            edges = edges[np.r_[0, np.cumsum(count)]]
            if not np.array_equal(np.diff(edges), np.fromiter(map(len, texts), np.int64, len(texts))) or laid.tobytes() != b"".join(texts):
                laid, edges = laid.tobytes(), edges.tolist()
                out &= np.array([laid[lo:hi] == text for lo, hi, text in zip(edges, edges[1:], texts, strict=False)], bool)
        return out.tolist()

    def _learn(self, chunks: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """(A ids, B ids, whether both cover the chunk) of distinct chunks."""
        words = [self.splitter.words(c) for c in chunks]
        ids = {w: array("q", [t.id for t in self.tokenize(w)]).tobytes() for w in {w for many in words for w in many}}
        a = [ids[many[0]] if len(many) == 1 else b"".join([ids[w] for w in many]) for many in words]
        b = [array("q", x).tobytes() for x in self.pieces.encode([c[1:] for c in chunks], num_threads=1)]
        return list(zip(a, b, self._covers([c.encode() for c in chunks], (a, b)), strict=True))

    def _whole(self, text: str) -> tuple[bytes, bytes, bool]:
        a = array("q", self.whole_a.encode(" " + text, add_special_tokens=False).ids).tobytes()
        b = array("q", self.pieces.encode(text, num_threads=1)).tobytes()
        return a, b, self._covers([b" " + text.encode()], ([a], [b]))[0]

    def align(self, texts: pa.Array, lane: int = LANE) -> Aligned:
        """Texts that are empty or that the tokens do not cover have no tokens."""
        chunks, codes, edges, odd = self.splitter.split_behind_blanks(texts)
        if not self.apart:
            odd = np.arange(len(texts))
        entries = self.known.values(chunks, (np.bincount(codes, minlength=len(chunks)) > 1).tolist(), self._learn) if self.apart else [(b"", b"", True)] * len(chunks)
        covered = np.array([e[2] for e in entries], bool)
        lost = np.concatenate([[0], np.cumsum(~covered[codes])])
        whole = {i: self._whole(texts[i].as_py()) for i in odd.tolist()}
        none = {i for i in np.flatnonzero(lost[edges[1:]] > lost[edges[:-1]]).tolist() if i not in whole}
        none |= {i for i, e in whole.items() if not e[2]} | set(np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0).tolist())
        # A text that is encoded whole, or has no tokens, becomes one entry in the place of its chunks.
        entries = [*entries, (b"", b"", True)]
        parts, sizes, at = [], np.diff(edges), 0
        for i in sorted(none | set(whole)):
            parts += [codes[at : edges[i]], [len(entries) - 1]]
            if i not in none:
                parts[-1] = [len(entries)]
                entries.append(whole[i])
                entries.append((b"", b"", True))
            sizes[i], at = 1, edges[i + 1]
        codes = np.concatenate([*parts, codes[at:]]).astype(np.int64)
        edges = np.r_[0, np.cumsum(sizes)]
        laid = []
        for side in (0, 1):
            own = [e[side] for e in entries]
            lengths, flat = np.fromiter(map(len, own), np.int64, len(own)) // 8, np.frombuffer(b"".join(own), np.int64)
            ids, cuts = spread(flat, np.cumsum(lengths) - lengths, lengths, codes)
            laid.append((ids, cuts[edges]))
        (a, a_edges), (b, b_edges) = laid
        return Aligned(a, b, a_edges, b_edges, self.a_bytes, self.b_bytes, lane)


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


_ROWS = {"unit": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "own": pa.binary(), "times": pa.binary(), "pairs": pa.list_(pa.int64()), "n_docs": pa.list_(pa.int64())}
_ROWS_DDL = "unit long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own binary, times binary, pairs array<long>, n_docs array<long>"


def _unit_rows(found: Aligner, unit: int, doc_ids: pa.Array, texts: pa.Array, lane: int = LANE) -> pa.RecordBatch:
    """The rows of a unit's texts; the first one carries the unit's list of pairs and their numbers of texts."""
    aligned, n = found.align(texts, lane), len(texts)
    space = len(found.a_data) * found.n_b
    pair = aligned.a[aligned.link_a] * found.n_b + aligned.b[aligned.link_b]
    text = aligned.link_text()
    # Distinct (text, pair), by text.
    both, times = np.unique(text * space + pair, return_counts=True)
    text, pair = both // space, both % space
    listed, own, n_docs = np.unique(pair, return_inverse=True, return_counts=True)
    cuts = np.searchsorted(text, np.arange(n + 1)).tolist()
    n_a, n_b = np.diff(aligned.a_edges), np.diff(aligned.b_edges)
    n_links = np.bincount(aligned.link_text(), minlength=n)
    shown = [hashlib.sha256(x).hexdigest() if x else "" for x in aligned.written(found.a_names, found.b_names)]
    own, times = own.astype("<u4"), times.astype("<u4")
    first = [None] * (n - 1)
    columns = [
        [unit] * n,
        doc_ids,
        n_a,
        n_b,
        aligned.group_counts(),
        n_links,
        shown,
        [own[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])],
        [times[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])],
        [listed, *first],
        [n_docs, *first],
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _ROWS.values(), strict=True)], names=list(_ROWS))


def _units(a_path: str, b_path: str, unit_bytes: int, lane: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Units are numbered within their partition; the rows are written once, so a number means one list.
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            for texts in groups(batch.column("text"), unit_bytes):
                yield _unit_rows(aligner(a_path, b_path), unit, batch.column("doc_id").slice(at, len(texts)), texts, lane)
                at += len(texts)
                unit += 1
        tidy()

    return run


_RESULT = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "n_best": pa.int64(), "count_sum": pa.int64(), "groups_sha256": pa.string()}


def _added_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """The texts of a unit with their sums over links."""
    rows = rows.combine_chunks()
    count, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
    at = answers.column("at").to_numpy()
    count[at], best[at] = answers.column("n").to_numpy(), answers.column("best").to_numpy().astype(np.int64)
    own, times = (rows.column(c).combine_chunks() for c in ("own", "times"))
    edges = np.r_[0, np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False) // 4)]
    own, times = (np.frombuffer(b"".join(x.to_pylist()), "<u4").astype(np.int64) for x in (own, times))
    sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[own])])[edges]) for x in (best, count)]
    columns = {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
    return pa.table([columns.get(c, rows.column(c) if c in rows.column_names else None) for c in _RESULT], schema=pa.schema(list(_RESULT.items())))


def pair_counts(written: DataFrame, n_b: int) -> tuple[DataFrame, DataFrame]:
    """(listed, counts): the units' (unit, at, pair, n_docs), and (pair, n, best) over the corpus.

    ``pair`` is A id * ``n_b`` + B id. An A id has at most ``n_b`` pairs, which bounds the groups in which the highest is found.
    """
    listed = written.where("pairs is not null").select("unit", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("at", "p")).select("unit", "at", F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n_docs"))
    counts = listed.groupBy("pair").agg(F.sum("n_docs").alias("n"))
    highest = F.max("n").over(W.partitionBy(F.expr(f"pair div {n_b}")))
    return listed.drop("n_docs"), counts.select("pair", "n", (F.col("n") == highest).alias("best"))


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, unit_bytes: int = UNIT_BYTES, lane: int = LANE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    ``n_best`` counts the links whose pair of ids has the highest count of its A id, where a pair's count is the number of rows that
    hold it linked; ``count_sum`` adds the counts of all links up. ``groups_sha256`` is of the groups as ``a1,a2|b1;a3|b2,b3``.

    * null and empty texts, and texts that either tokenisation does not give back byte by byte, have no tokens: zeros and '';
    * names of special tokens in a text are plain text;
    * repeated rows are counted each and give equal rows; a null doc_id stays null; ties of the highest count all count;
    * a very long text is held by one task; an empty table gives an empty result; further columns are ignored.
    """
    n_b = SentencePieceProcessor(model_file=b_path).get_piece_size()
    written, _ = materialize(documents(docs).mapInArrow(_units(a_path, b_path, unit_bytes, lane), _ROWS_DDL), "aligned")
    listed, counts = pair_counts(written, n_b)
    answers = listed.join(counts, "pair").select(F.col("unit").alias("of_unit"), "at", "n", "best")
    rows = written.drop("pairs", "n_docs")
    return rows.groupBy("unit").cogroup(answers.groupBy("of_unit")).applyInArrow(_added_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _links(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            at = 0
            for texts in groups(batch.column("text"), UNIT_BYTES):
                x = aligner(a_path, b_path).align(texts)
                text = np.searchsorted(x.link_text(), np.arange(len(texts) + 1))
                links = [pa.ListArray.from_arrays(pa.array(text, pa.int32()), pa.array((own - edges[x.link_text()]).astype(np.int32))) for own, edges in ((x.link_a, x.a_edges), (x.link_b, x.b_edges))]
                ids = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(own.astype(np.int32))) for own, edges in ((x.a, x.a_edges), (x.b, x.b_edges))]
                ends = []
                for cut, edges in ((x.a_cut, x.a_edges), (x.b_cut, x.b_edges)):
                    place = np.flatnonzero(cut)
                    owner = np.searchsorted(edges, place, "right") - 1
                    ends.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32()), pa.array((place + 1 - edges[owner]).astype(np.int32))))
                columns = [*ids, *ends, *links]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *(c.cast(ints) for c in columns)], names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends", "link_a", "link_b"])
                at += len(texts)
        tidy()

    return run


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends, link_a, link_b), one row per input row.

    The k-th group holds the A tokens before ``a_ends[k]`` and the B tokens before ``b_ends[k]`` that no group before it
    holds; the k-th link is between the A token ``link_a[k]`` and the B token ``link_b[k]``, numbered from 0 in the text. Texts
    without tokens (see ``alignment_digests``) have empty arrays.
    """
    ints = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_ends", "b_ends", "link_a", "link_b"))
    return documents(docs).mapInArrow(_links(a_path, b_path), f"doc_id long, {ints}")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(read_documents(spark, sf_dir), tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE))
