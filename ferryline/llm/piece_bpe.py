"""Byte-level BPE by a sentencepiece model that is written from a file of ranks.

A file of ranks lists byte strings; the merges join whichever neighbours give the entry of least rank. That is what a
sentencepiece BPE model does with scores, so the ranks become one: every entry is a piece, its bytes shown by the signs
of the byte alphabet, scored by its negative rank, behind a normaliser that changes nothing. Texts are cut by the
pattern of the rank files, each distinct match is encoded once, and ids are decoded by the inverse of the byte mapping.
A match that is itself an entry is that entry, whether the merges reach it or not.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import SentencePieceProcessor

from ._shared import documents, read_documents, tidy
from .tokens import _BLANK, _WHITE, BYTE_ALPHABET, ChunkEncoder, Splitter, spread, tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Numbers of the fields and kinds in a sentencepiece model file.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2
#: Letters and digits below this sign are the same in all versions of Unicode in use.
_SETTLED = "Ͱ"


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, file)}


_SIGN_OF = [BYTE_ALPHABET.get(b, chr(b)) for b in range(256)]


def shown(data: bytes) -> str:
    """Bytes in the signs of the byte alphabet."""
    return "".join(map(_SIGN_OF.__getitem__, data))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes(_PIECES, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def model_file(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model whose ids are the ranks; the unknown piece takes the first free id."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("every byte must have a rank")
    pieces = [_piece(shown(data), -float(rank), _NORMAL) for data, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_piece("⁇", 0.0, _UNKNOWN))
    trainer = _number(3, _BPE) + _number(4, len(pieces)) + _number(40, len(ranks))
    # No change of signs, no blank in front, blanks kept as they are.
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(_TRAINER, trainer) + _bytes(_NORMALIZER, normalizer)


@cache
def _library_classes() -> tuple[str, str]:
    """The letters and numbers of the library's version of Unicode, as sets for a pattern: newer versions have more."""
    signs = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    found = []
    for kind in (r"\p{L}", r"\p{N}"):
        one = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        codes = np.frombuffer(one.decode(one.encode_ordinary(signs)).encode("utf-32-le"), np.uint32)
        first, last = codes[np.r_[True, np.diff(codes) > 1]].tolist(), codes[np.r_[np.diff(codes) > 1, True]].tolist()
        found.append("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last, strict=True)))
    return found[0], found[1]


@cache
def _library_pattern(pattern: str) -> regex.Pattern:
    """``pattern`` with the library's own letters and numbers."""
    letters, numbers = _library_classes()
    within = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]")
    return regex.compile(within.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))


class PatternSplitter(Splitter):
    """Chunks at single blanks, which the pattern of the rank files never joins to what is before them, and a chunk's matches."""

    def __init__(self, pattern: str):
        self.whole_words = False
        self._odd_patterns = [rf"^$|^{_WHITE}|{_WHITE}$"]
        self.text, self.settled = pattern, regex.compile(pattern)

    def words(self, chunk: str) -> list[str]:
        plain = chunk.isascii()
        if plain and chunk[1:].isalpha() and chunk[0] == " ":
            return [_BLANK + chunk[1:]]
        found = (self.settled if plain or max(chunk) < _SETTLED else _library_pattern(self.text)).findall(chunk)
        if plain and chunk.isprintable():
            return [w.replace(" ", _BLANK) for w in found]
        return [shown(w.encode()) for w in found]


class PieceCodec(ChunkEncoder):
    """Encode and decode whole texts as tiktoken's ``encode_ordinary`` and ``decode_bytes`` do."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        ranks = read_ranks(path)
        self.pieces = SentencePieceProcessor(model_proto=model_file(ranks))
        self.entry = {shown(data): array("I", [rank]).tobytes() for data, rank in ranks.items()}
        splitter = PatternSplitter(pattern)

        def compute(chunks: list[str]) -> list[bytes]:
            words = [splitter.words(c) for c in chunks]
            ids = {w: self.entry.get(w) for many in words for w in many}
            new = [w for w, found in ids.items() if found is None]
            ids.update(zip(new, (array("I", x).tobytes() for x in self.pieces.encode(new, num_threads=1)), strict=True))
            return [b"".join([ids[w] for w in many]) for many in words]

        super().__init__(splitter, compute, lambda text: np.frombuffer(compute([text])[0], np.uint32))
        # The inverse of the byte mapping, from the pieces of the model.
        inverse = {sign: b for b, sign in BYTE_ALPHABET.items()}
        data = [bytes(inverse.get(c, ord(c)) for c in self.pieces.id_to_piece(i)) for i in range(len(ranks))]
        self.lengths = np.array([len(x) for x in data], np.int64)
        self.flat, self.starts = np.frombuffer(b"".join(data), np.uint8), np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> bytes:
        return spread(self.flat, self.starts, self.lengths, ids)[0].tobytes()


@cache
def codec(path: str) -> PieceCodec:
    """One codec, with what it remembers, per Python worker."""
    return PieceCodec(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([x.astype(np.int32) for x in codec(path).encode(batch.column("text"))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [codec(path).decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>), one row per input row, by the file of ranks at ``path``; null text: no ids."""
    return documents(docs).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data binary): the bytes of ``encoded(doc_id, ids)``, as ``encode`` gives it."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, data binary")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = codec(path)
        for batch in batches:
            rows = [(len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(found.decode(ids)).hexdigest()) for ids in found.encode(batch.column("text"))]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tidy()

    return run


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row: ids and the bytes decoded from them.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers.

    * null and empty texts have no ids: both digests are those of no bytes;
    * names of special tokens in a text are plain text; a very long text is held by one task;
    * repeated rows give equal rows, a null doc_id stays null; an empty table gives an empty result;
    * further columns are ignored.
    """
    return documents(docs).mapInArrow(_digests(path or tokenizer_path(RANKS)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(read_documents(spark, sf_dir))
