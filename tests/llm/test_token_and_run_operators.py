"""Alignment, periodic runs and byte-level BPE against the libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ferryline.llm import alignment, best_fit, exact_dedup, license_scan, line_dedup, periodic_runs, piece_bpe
from ferryline.llm.tokens import BYTE_BPE, tokenizer_path

A_PATH, B_PATH = tokenizer_path(BYTE_BPE), tokenizer_path(alignment.PIECE_BPE)
SCHEMA = "doc_id long, text string, unit long, own string, n_a int, pairs string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def odd_text(rnd, size):
    """Signs of all kinds, blanks in a row, names of special tokens."""
    kinds = [
        lambda: rnd.choice("ab eé '1 \n\t"),
        lambda: chr(rnd.choice([rnd.randrange(0x3000), rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)])),
        lambda: rnd.choice([" ", "  ", "\n", "<|endoftext|>", "<s>", "<0x41>", "'s", "'LL", " the", "ing", "tion "]),
    ]
    return "".join(rnd.choice(kinds)() for _ in range(rnd.randrange(size)))


def corpus():
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in ("lo", "mi", "Tra", "été", "un") for b in ("ra", "xe", "bo", "ni", "que", "s")]

    def prose(n):
        return " ".join(rnd.choice(words) + rnd.choice(["", "", ",", ".\n"]) for _ in range(n))

    def cycle(period, times, rest):
        unit = [rnd.choice(words) for _ in range(period)]
        return " ".join(unit * times + unit[:rest])

    texts = [None, "", " \n\t", "one", "a a a a a a", "a a a a a", "<|endoftext|> <s> it's  done \n", "blank ▁ sign", "\x00 \x1c", prose(1000), "x" * 3000]
    texts += [odd_text(rnd, 60) for _ in range(40)] + [prose(rnd.randint(1, 200)) for _ in range(60)]
    texts += [f"{prose(5)} {cycle(rnd.randint(1, 6), rnd.randint(2, 9), rnd.randint(0, 1))} {cycle(rnd.randint(1, 3), 5, 1)} {prose(9)}" for _ in range(40)]
    texts += texts[50:56]
    rows = [(i * 7 - 14, t, 5, "k", 1, None) for i, t in enumerate(texts)]
    return rows + [rows[60], rows[60], (None, "no id no id no id no id", None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def same(found, expected):
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_byte_bpe(docs, rows, empty):
    path = tokenizer_path(piece_bpe.RANKS)
    library = tiktoken.Encoding("own", pat_str=piece_bpe.public_tokenizers.PATTERN, mergeable_ranks=piece_bpe.read_ranks(path), special_tokens={})
    expected, all_ids = [], []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        all_ids.append((r[0], ids))
        expected.append((r[0], len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(library.decode_bytes(ids))))
    same(piece_bpe.round_trip_digests(docs).collect(), expected)
    encoded = piece_bpe.encode(docs, path)
    same(encoded.collect(), all_ids)
    same([(d, bytes(x)) for d, x in piece_bpe.decode(encoded, path).collect()], [(r[0], (r[1] or "").encode()) for r in rows])
    assert piece_bpe.round_trip_digests(empty).count() == 0


def test_byte_bpe_of_any_signs():
    path = tokenizer_path(piece_bpe.RANKS)
    library = tiktoken.Encoding("own", pat_str=piece_bpe.public_tokenizers.PATTERN, mergeable_ranks=piece_bpe.read_ranks(path), special_tokens={})
    rnd = random.Random(4)
    texts = [odd_text(rnd, 80) for _ in range(3000)] + ["é" * 3000 + " " * 2000]
    codec = piece_bpe.codec(path)
    for text, ids in zip(texts, codec.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_rank_files_with_gaps_are_refused():
    single = {bytes([b]): b for b in range(256)}
    assert piece_bpe.model_file(single)
    for ranks in (single | {b"ab": 300}, {k: v for k, v in single.items() if v < 255}):
        with pytest.raises(ValueError, match="rank"):
            piece_bpe.model_file(ranks)


def entry_bytes(token):
    """A byte-level entry's bytes, by the published rule of its alphabet."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return bytes(signs[c] for c in token)


@pytest.fixture(scope="module")
def tokens_of():
    a_file, b_file = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_file.encode_special_tokens = True

    def tokens(text):
        if not text:
            return [], []
        a = [(i, entry_bytes(a_file.id_to_token(i))) for i in a_file.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if b_file.is_byte(i) else p.replace("▁", " ").encode()) for i in b_file.encode(text) for p in [b_file.id_to_piece(i)]]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    return tokens


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


@pytest.mark.parametrize(("unit_bytes", "lane"), [(3_000_000, 512), (1500, 16)])
def test_alignment(docs, rows, empty, tokens_of, unit_bytes, lane):
    found, held = [], Counter()
    for r in rows:
        a, b = (spans(x) for x in tokens_of(r[1]))
        links = [(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [[",".join(str(i) for i, _, end in side if lo < end <= hi) for side in (a, b)] for lo, hi in zip([0, *cuts], cuts)]
        held.update(set(links))
        found.append((r[0], len(a), len(b), len(cuts), links, ";".join("|".join(g) for g in groups)))
    highest = {}
    for (a, _), n in held.items():
        highest[a] = max(highest.get(a, 0), n)
    expected = [(d, n_a, n_b, n, len(links), sum(held[x] == highest[x[0]] for x in links), sum(held[x] for x in links), sha(g) if g else "") for d, n_a, n_b, n, links, g in found]
    assert sum(e[1] == 0 for e in expected) >= 4 and sum(e[5] for e in expected) < sum(e[4] for e in expected)
    same(alignment.alignment_digests(docs, A_PATH, B_PATH, unit_bytes, lane).collect(), expected)
    if lane == 16:
        assert alignment.alignment_digests(empty, A_PATH, B_PATH).count() == 0
        for r in alignment.alignments(docs.where("doc_id = 49 or doc_id < 0"), A_PATH, B_PATH).collect():
            _, n_a, _, n, links, g = next(x for x in found if x[0] == r["doc_id"])
            assert [(r["a_ids"][i], r["b_ids"][j]) for i, j in zip(r["link_a"], r["link_b"], strict=True)] == links
            edges = list(zip([0, *r["a_ends"]], r["a_ends"], [0, *r["b_ends"]], r["b_ends"]))
            assert ";".join(",".join(map(str, r["a_ids"][a:b])) + "|" + ",".join(map(str, r["b_ids"][c:d])) for a, b, c, d in edges) == g


def brute_runs(w, least, copies):
    out = {}
    for p in range(1, len(w) // copies + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, copies * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


@pytest.mark.parametrize(("least", "copies"), [(6, 4), (6, 2), (1, 2), (12, 3)])
def test_all_runs(least, copies):
    rnd = random.Random(least * copies)
    texts = []
    for _ in range(300):
        kinds, w = rnd.choice([1, 2, 3, 8]), []
        while len(w) < rnd.choice([0, 5, 40, 120]):
            unit = [str(rnd.randrange(kinds)) for _ in range(rnd.randrange(1, 9))]
            w += unit * rnd.randrange(1, 9) + unit[: rnd.randrange(len(unit))] if rnd.random() < 0.3 else unit[:1]
        texts.append(w)
    codes, edges = periodic_runs.word_codes(pa.array([" \n".join(w) + rnd.choice(["", " "]) for w in texts]))
    found = periodic_runs.find_runs(codes, edges, least, copies).tolist()
    assert found == [[k, *r] for k, w in enumerate(texts) for r in brute_runs(w, least, copies)]


def test_run_digests(docs, rows, empty):
    expected, n_planted = [], 0
    for r in rows:
        w = (r[1] or "").encode().split()
        h = zlib.crc32(str(r[0]).encode())
        if r[0] is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            n_planted += 1
        runs = brute_runs(w, 6, 4)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        expected.append((r[0], len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert n_planted > 3 and sum(e[1] > 1 for e in expected) > 3
    same(periodic_runs.run_digests(docs).collect(), expected)
    assert periodic_runs.run_digests(empty).count() == 0


def test_collapsed_texts(docs, rows):
    expected = []
    for r in rows:
        w = (r[1] or "").encode().split()
        runs = brute_runs(w, 6, 4)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        expected.append((r[0], len(runs), b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if runs else r[1] or ""))
    same(periodic_runs.collapse_runs(docs).select("doc_id", F.size("runs"), "text").collect(), expected)


def test_long_runs_take_linear_time():
    for unit in (["a"], ["a", "b"], list("abcdefg")):
        w = unit * (150_000 // len(unit))
        codes, edges = periodic_runs.word_codes(pa.array([" ".join(w)]))
        assert periodic_runs.find_runs(codes, edges).tolist() == [[0, 0, len(w), len(unit)]]


def first_fit_decreasing(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        k = next((i for i, free in enumerate(room) if free >= n), None)
        if k is None:
            room.append(size - n)
        else:
            room[k] -= n
    return len(room)


@pytest.mark.parametrize("family", ["uniform", "middle", "normal", "third"])
def test_packing_is_no_worse_than_first_fit_decreasing(family):
    rnd = random.Random(17)
    draw = {"uniform": lambda: rnd.randint(1, 2048), "middle": lambda: rnd.randint(300, 1100), "normal": lambda: min(2048, max(1, int(rnd.gauss(700, 100)))), "third": lambda: rnd.randint(640, 730)}[family]
    for _ in range(25):
        lengths = [draw() for _ in range(rnd.choice([30, 60, 120]))]
        found = best_fit.plan(Counter(lengths), 2048)
        assert best_fit.lengths_of(found) == Counter(lengths)
        assert all(sum(n * k for n, k in one.items()) <= 2048 for one, _ in found)
        assert -(-sum(lengths) // 2048) <= best_fit.sequences(found) <= first_fit_decreasing(lengths, 2048)


def test_lines_of_one_text_take_linear_time(spark):
    text = "\n".join(f"line {i}" if i % 2 else "everywhere" for i in range(60_000))
    rows = [(0, text, "s0")] + [(k, "everywhere\nown", f"s{k}") for k in range(1, 4)]
    found = line_dedup.site_line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=4).where("doc_id = 0").first()
    assert (found["n_lines"], found["n_removed"]) == (60_000, 30_000)
    assert found["kept_sha256"] == sha("\n".join(f"line {i}" for i in range(1, 60_000, 2)))


def test_copies_in_parts_by_bytes(spark):
    texts = ["x" * 5000] * 9 + ["y" * 10] * 5 + ["z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, parts = (sorted(map(tuple, exact_dedup.exact_groups(docs, bytes_per_salt=b).collect())) for b in (1 << 30, 12_000))
    assert whole == parts and [r[1] for r in whole] == [8] * 9 + [13] * 5 + [14]


def test_statements_that_name_licences(spark):
    cases = {
        "This project is released under the MIT License.": "MIT",
        "SPDX-License-Identifier: MIT": "MIT",
        "// SPDX-License-Identifier: GPL-3.0-or-later\nint main;": "GPL-3.0",
        "# SPDX-License-Identifier: Apache-2.0 OR MIT": "MIT,Apache-2.0",
        "Licensed under the MIT license (see LICENSE).": "MIT",
        "Some prose.\nLicensed under the Apache License, Version 2.0 and the MIT license. More prose.": "MIT,Apache-2.0",
        "License: GPL-3.0-only": "GPL-3.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
        "Available under the BSD 3-Clause License. See LICENSE.txt for details.": "BSD-3-Clause",
        "The library is distributed under the terms of the GNU GPL v2.": "GPL-2.0",
        "The committee was permitted under the terms of the treaty.": "",
        "We had a license to sell fish under the MIT roof.": "",
        "License plates were released under the old rules.": "",
        "": "",
    }
    found = license_scan.license_scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert dict(zip(cases, (r["licenses"] for r in found), strict=True)) == cases


def test_license_sql_of_notices_statements_and_wrapped_sentences(spark):
    """The query's SQL against the operator on every known sentence, whole and wrapped, and random texts of sentences, statements and prose."""
    rnd = random.Random(11)
    known = [*license_scan._IDS]
    names = [*license_scan._NAMED_IDS]
    wrap = lambda s: "".join(rnd.choice(["\n", " \n  ", "\n# "]) if c == " " and rnd.random() < 0.2 else c for c in s)
    statement = lambda: rnd.choice(["This project is licensed under the ", "SPDX-License-Identifier: ", "dual licensed under either the ", "License: "]) + rnd.choice([" and ", " or the ", ", "]).join(rnd.sample(names, rnd.choice([1, 1, 2, 3]))) + rnd.choice(["", " (see LICENSE)", ". See the LICENSE file for details", " clause", " 0"])
    texts = [*known, *map(wrap, known), *("licensed under the " + n for n in names), None, "", " \n"]
    for _ in range(400):
        some = [rnd.choice([rnd.choice(known), wrap(rnd.choice(known)), statement(), wrap(statement()), "Some prose, 12.", ""]) for _ in range(rnd.randrange(1, 9))]
        texts.append("".join(x + rnd.choice([".\n", ". ", "\n\n", "\n", "; ", " "]) for x in some))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, license_scan.license_scan(docs).collect()), key=lambda r: r[0])
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}))
    assert found == sorted(con.execute(license_scan.op1_sql()).fetchall(), key=lambda r: r[0])
    assert sum(r[1] > 1 for r in found) > 200 and len({r[4] for r in found}) > 12
