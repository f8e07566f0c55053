"""Encoding whole texts with public tokenizer files, each distinct chunk of a group of texts once.

A tokenizer file is given by its path. Texts are cut at single blanks (byte-level files) or at ASCII white space (word
files), which are always boundaries of the files' own splitting; pyarrow numbers the distinct chunks of a
group of texts, the library's model encodes the words of each once, and numpy lays the ids out in text order.
Texts for which such cuts are not provably boundaries (runs of white space, special tokens) go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from ._shared import groups, tidy

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Chunks whose ids are remembered between groups of texts, at which number the older ones go.
REMEMBERED = 120_000
#: Bytes of text whose chunks are numbered together, and chunks laid out at once: bound what a task holds beside one text.
TOGETHER = 12_000_000
LAID_OUT = 500_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The signs of ASCII but the apostrophe, which may begin a contraction.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space, and the separators that some count as such.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SHOWN = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174]
#: Byte-level files show a byte by its Latin-1 sign, the invisible ones by signs from U+0100 on.
BYTE_ALPHABET = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_BLANK = BYTE_ALPHABET[32]


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


@cache
def load(path: str) -> Tokenizer:
    """The tokenizer, with unused truncation and padding, in one thread per task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Remembered:
    """What was computed for keys that repeat; when full, the older half is forgotten."""

    def __init__(self, size: int = REMEMBERED):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def values(self, keys: list, repeated: list[bool], compute: Callable[[list], list]) -> list:
        """The value of each of the distinct ``keys``; ``compute`` gets all unknown ones at once, and those marked as repeated are kept."""
        young, old = self.young, self.old
        found = [young.get(k) or old.get(k) for k in keys]
        missing = [i for i, value in enumerate(found) if value is None]
        for i, value in zip(missing, compute([keys[i] for i in missing]), strict=True):
            found[i] = value
        for key, value, again in zip(keys, found, repeated, strict=True):
            if again:
                self.young[key] = value
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        return found


class Splitter:
    """Chunks of texts and the words of a chunk (in the file's byte alphabet), as the file's own splitting cuts them."""

    def __init__(self, path: str, words: bool):
        self.tokenizer, self.whole_words = load(path), words
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # An empty chunk, or white space at an end of one, belongs to a run with the blanks around it.
        self._odd_patterns = [re.escape(x) for x in self.specials] + ([] if words else [rf"^$|^{_WHITE}|{_WHITE}$"])
        digits = "[0-9]" if words else " ?[0-9]+"
        blank = "" if words else " ?"
        self._simple = re.compile(f"{blank}[{_LETTERS}]+|{digits}|{blank}[{re.escape(_SIGNS)}]+" + ("" if words else "|\n"))
        #: Whether chunks of Latin letters, digits and signs may be split here, without the library.
        single = [chr(i) for i in range(33, 256) if self._simple.fullmatch(chr(i))]
        probes = [*single, *([] if words else ["a\nb", "a\n\n,b"]), "".join(single), "".join(reversed(single)), "ab,", "Ab12.,c", "12ab", "(é)"]
        self.plain = True
        self.plain = all(self.words(p) == self._by_file(p) for x in probes for p in ((x,) if words else (x, f" {x}")))

    def _by_file(self, chunk: str) -> list[str]:
        normalize = self.tokenizer.normalizer
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normalize.normalize_str(chunk) if normalize else chunk)]

    def words(self, chunk: str) -> list[str]:
        if self.plain and chunk.isascii():
            if self.whole_words and chunk.isalpha():
                return [chunk.lower()]
            if chunk[1:].isalpha() and chunk[0] == " ":
                return [_BLANK + chunk[1:]]
        found = self._simple.findall(chunk)
        if not self.plain or len("".join(found)) != len(chunk):
            return self._by_file(chunk)
        if self.whole_words:
            return [w.lower() if w.isascii() else w.lower().encode().decode("latin-1").translate(BYTE_ALPHABET) for w in found]
        return [w.encode().decode("latin-1").translate(BYTE_ALPHABET) for w in found]

    def _odd(self, chunks: pa.Array) -> np.ndarray:
        """Whether a text with this chunk must go to the library whole."""
        found = np.zeros(len(chunks), bool)
        for pattern in self._odd_patterns:
            found |= pc.match_substring_regex(chunks, pattern).to_numpy(zero_copy_only=False)
        return found

    def split(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(distinct chunks, number of each place's chunk, first place of each text and the end, odd texts).

        In byte-level files a chunk behind a blank starts with it, so the first chunks of texts are numbered apart.
        """
        parts = pc.ascii_split_whitespace(texts) if self.whole_words else pc.split_pattern(texts, " ")
        edges = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        edges = edges - edges[0]
        chunks, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
        odd = self._odd(chunks)
        if self.whole_words:
            chunks = chunks.to_pylist()
        else:
            heads = chunks.take(pa.array(codes[edges[:-1]])).dictionary_encode()
            codes = codes.copy()
            codes[edges[:-1]] = heads.indices.to_numpy(zero_copy_only=False) + len(chunks)
            odd = np.r_[odd, self._odd(heads.dictionary)]
            chunks = pc.binary_join_element_wise("", chunks, " ").to_pylist() + heads.dictionary.to_pylist()
        marks = np.concatenate([[0], np.cumsum(odd[codes])])
        return chunks, codes, edges, np.flatnonzero(marks[edges[1:]] > marks[edges[:-1]])


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[start : start + length]`` of ``codes`` one after the other, and the edges between them."""
    edges = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(lengths[codes], out=edges[1:])
    places = np.arange(edges[-1]) + np.repeat(starts[codes] - edges[:-1], lengths[codes])
    return values[places], edges


class ChunkEncoder:
    """ids of whole texts from the ids of their distinct chunks; odd texts are encoded whole.

    ``splitter`` cuts a group of texts, ``compute`` gives the ids (bytes of unsigned 32-bit integers) of distinct chunks,
    ``whole`` the ids of one text.
    """

    def __init__(self, splitter: Splitter, compute: Callable[[list[str]], list[bytes]], whole: Callable[[str], np.ndarray]):
        self.splitter, self.compute, self.whole = splitter, compute, whole
        self.known = Remembered()

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, in order."""
        for group in groups(texts, TOGETHER):
            chunks, codes, edges, odd = self.splitter.split(group)
            ids = self.known.values(chunks, (np.bincount(codes, minlength=len(chunks)) > 1).tolist(), self.compute)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat, starts = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(lengths) - lengths
            whole = {i: self.whole(group[i].as_py()) for i in odd.tolist()}
            at = 0
            while at < len(group):
                until = max(at + 1, int(np.searchsorted(edges, edges[at] + LAID_OUT, "right")) - 1)
                laid, cuts = spread(flat, starts, lengths, codes[edges[at] : edges[until]])
                cuts = cuts[edges[at : until + 1] - edges[at]].tolist()
                for i in range(at, until):
                    yield whole[i] if i in whole else laid[cuts[i - at] : cuts[i - at + 1]]
                at = until
        tidy()


class BatchEncoder(ChunkEncoder):
    """ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, words: bool):
        self.tokenizer, splitter = load(path), Splitter(path, words)
        tokenize = self.tokenizer.model.tokenize

        def compute(chunks: list[str]) -> list[bytes]:
            words = [splitter.words(c) for c in chunks]
            ids = {w: array("I", [t.id for t in tokenize(w)]).tobytes() for w in {w for many in words for w in many}}
            return [b"".join([ids[w] for w in many]) for many in words]

        super().__init__(splitter, compute, lambda text: np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))


@cache
def encoder(path: str, words: bool) -> BatchEncoder:
    """One encoder, with what it remembers, per Python worker."""
    return BatchEncoder(path, words)
