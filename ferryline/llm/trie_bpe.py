"""BPE encoding and decoding by a depth-first walk over a trie of distinct words.

The encoding of a word is determined by the last token of each of its prefixes: the last token t of a
prefix is the one whose preceding token (the last token of the prefix without t) forms a stable pair
with t, that is, encoding both together gives back exactly the two. The distinct words of a group of texts are walked
in sorted order, which is the depth-first order of their trie: a word starts at the node where it leaves
the word before it, and the last tokens on the path above are not computed again. The tokens that end at a node
come from an automaton of all tokens, longest first. A word's ids are read back along its path.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents, groups, read_documents, tidy
from .tokens import TOGETHER, WORD_BPE, Remembered, Splitter, load, tokenizer_path

_ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


class TrieBpe:
    """The BPE model of a tokenizer file whose words end in a suffix of their last symbol (or in none)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.symbols: dict[str, tuple[str, ...]] = {s: (s,) for s in self.vocab}
        for a, b in merges:
            self.symbols[a + b] = self.symbols[a] + self.symbols[b]
        self.names = {i: s for s, i in self.vocab.items()}
        #: For each token at the right of a pair: whether the token at the left stays apart from it.
        self.stable: dict[int, dict[int, bool]] = {i: {} for i in self.names}
        #: Tokens that the merges reach, inside and at the end of a word, by their bare symbols.
        inside, ends = {}, {}
        last = {s for s in self.vocab if self.suffix and len(s) == 1 + len(self.suffix) and s.endswith(self.suffix)}
        single = [s for s in self.vocab if len(s) == 1] + sorted(last)
        for token in single + [a + b for a, b in merges]:
            symbols = self.symbols[token]
            if self.merge(symbols) == [token]:
                bare = "".join(symbols[:-1]) + symbols[-1][0]
                (ends if symbols[-1] in last else inside)[bare] = self.vocab[token]
        self._automaton(inside, ends if self.suffix else inside)

    def _automaton(self, inside: dict[str, int], ends: dict[str, int]) -> None:
        """States are prefixes of tokens: ``goto`` leads to the longest one that ends the text read so far; ``inside``
        and ``ends`` list the (length, token) that end there, longest first."""
        self.goto: list[dict[str, int]] = [{}]
        own: list[str] = [""]
        for bare in {*inside, *ends}:
            state = 0
            for k, symbol in enumerate(bare):
                after = self.goto[state].get(symbol)
                if after is None:
                    after = self.goto[state][symbol] = len(self.goto)
                    self.goto.append({})
                    own.append(bare[: k + 1])
                state = after
        self.fail = [0] * len(self.goto)
        self.inside: list[tuple] = [()] * len(self.goto)
        self.ends: list[tuple] = [()] * len(self.goto)
        waiting = deque([0])
        while waiting:
            state = waiting.popleft()
            for symbol, after in list(self.goto[state].items()):
                waiting.append(after)
                if state:
                    self.fail[after] = self._go(self.fail[state], symbol)
                for out, tokens in ((self.inside, inside), (self.ends, ends)):
                    found = tokens.get(own[after])
                    out[after] = (((len(own[after]), found),) if found is not None else ()) + out[self.fail[after]]

    def _go(self, state: int, symbol: str) -> int:
        """The state after ``symbol``, without adding to ``goto``."""
        while True:
            after = self.goto[state].get(symbol)
            if after is not None or not state:
                return after or 0
            state = self.fail[state]

    def merge(self, symbols: tuple[str, ...]) -> list[str]:
        """The definition: merge the leftmost pair of least rank until none is left."""
        parts = list(symbols)
        while len(parts) > 1:
            least = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            if (parts[least], parts[least + 1]) not in self.rank:
                break
            parts[least : least + 2] = [parts[least] + parts[least + 1]]
        return parts

    def _is_stable(self, left: int, right: int) -> bool:
        a, b = self.names[left], self.names[right]
        found = self.stable[right][left] = self.merge(self.symbols[a] + self.symbols[b]) == [a, b]
        return found

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """ids of distinct words (in the file's byte alphabet)."""
        out: dict[str, list[int]] = {}
        goto, stable, inside, ends = self.goto, self.stable, self.inside, self.ends
        #: Along the current path, by depth: state, last token of the prefix, and depth before that token.
        states, last, before = [0], [], []
        path = ""
        for word in sorted(words):
            if not word:
                out[word] = []
                continue
            depth, most = 0, min(len(last), len(word) - 1)
            while depth < most and path[depth] == word[depth]:
                depth += 1
            del states[depth + 1 :], last[depth:], before[depth:]
            path, state = word, states[depth]
            end = len(word) - 1
            for at in range(depth, end + 1):
                symbol = word[at]
                after = goto[state].get(symbol)
                state = self._go(state, symbol) if after is None else after
                for n, token in inside[state] if at < end else ends[state]:
                    rest = at - n
                    if rest < 0:
                        break
                    fits = stable[token].get(last[rest])
                    if fits or fits is None and self._is_stable(last[rest], token):
                        break
                else:
                    raise ValueError(f"no encoding of {word[: at + 1]!r}")
                if at < end:
                    states.append(state)
                    last.append(token)
                    before.append(rest)
            ids = [token]
            while rest >= 0:
                ids.append(last[rest])
                rest = before[rest]
            out[word] = ids[::-1]
        return out


@cache
def _model(path: str) -> TrieBpe:
    return TrieBpe(path)


class Codec:
    """Encode and decode as the library does with ``add_special_tokens=False`` and ``skip_special_tokens=False``.

    Normalising and splitting a chunk is the file's own; its words are encoded by the trie.
    """

    def __init__(self, path: str):
        self.tokenizer, self.model, self.splitter = load(path), _model(path), Splitter(path, words=True)
        if self.tokenizer.decoder is not None:
            raise ValueError("only files without a decoder: their tokens are joined by one blank")
        added = self.tokenizer.get_added_tokens_decoder()
        self.special_ids = {t.content: i for i, t in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.special_ids, key=len, reverse=True))) + ")")
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Each id and its token, as they are written, with a blank behind.
        self.shown = {i: (f"{i} ", f"{t} ") for t, i in tokens.items()}
        self.known = Remembered()

    def _entry(self, ids: list[int]) -> tuple[int, str, str]:
        """(number of ids, ids, decoded text), each item with a blank behind it."""
        shown = [self.shown[i] for i in ids]
        return len(ids), "".join([x[0] for x in shown]), "".join([x[1] for x in shown])

    def _learn(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """Encode distinct chunks, all in one trie."""
        words = [self.splitter.words(c) for c in chunks]
        ids = self.model.encode_words({w for many in words for w in many})
        return [self._entry(ids[many[0]] if len(many) == 1 else [i for w in many for i in ids[w]]) for many in words]

    def _with_specials(self, text: str) -> list[tuple[int, str, str]]:
        parts = [(part, _ASCII_SPACE.split(part)) for part in self.special.split(text)]
        chunks = list({c for part, many in parts if part not in self.special_ids for c in many})
        entries = dict(zip(chunks, self._learn(chunks), strict=True))
        return [e for part, many in parts for e in ([self._entry([self.special_ids[part]])] if part in self.special_ids else [entries[c] for c in many])]

    def encode_decode(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """(number of ids, decimal ids joined by one space, decoded text) of each text, in order."""
        for group in groups(texts, TOGETHER):
            chunks, codes, edges, odd = self.splitter.split(group)
            entries = self.known.values(chunks, (np.bincount(codes, minlength=len(chunks)) > 1).tolist(), self._learn)
            special, edges = set(odd.tolist()), edges.tolist()
            for i in range(len(group)):
                found = self._with_specials(group[i].as_py()) if i in special else [entries[c] for c in codes[edges[i] : edges[i + 1]].tolist()]
                yield sum([e[0] for e in found]), "".join([e[1] for e in found])[:-1], "".join([e[2] for e in found])[:-1]


@cache
def _codec(path: str) -> Codec:
    return Codec(path)


def _digest(path: str):
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            rows = [(n, sha(ids), sha(decoded)) for n, ids, decoded in codec.encode_decode(batch.column("text"))]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tidy()

    return run


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row, for the tokenizer file at ``path``.

    Null and empty texts have no ids: both digests are those of the empty string. Special tokens that
    occur in a text are encoded as such, as the library does. Texts of any length are encoded whole.
    Repeated rows give equal rows, a null doc_id stays null; an empty table gives an empty result.
    """
    return documents(docs).mapInArrow(_digest(path or tokenizer_path(WORD_BPE)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_documents(spark, sf_dir))
