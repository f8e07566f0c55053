"""Each operator against brute force on a small table with nulls, ties, repeated rows and clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferryline.llm import best_fit, exact_dedup, fingerprint, language_id, license_scan, line_dedup, ngram_jaccard, substring_dedup, token_files, trie_bpe
from ferryline.llm.tokens import BYTE_BPE, WORD_BPE, load, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, runs int, label string"


def corpus():
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in ("lo", "mi", "Tra", "été", "un") for b in ("ra", "xe", "bo", "ni", "que", "s")]

    def prose(n):
        return " ".join(rnd.choice(words) + rnd.choice(["", "", ",", ".\n"]) for _ in range(n))

    texts = [None, "", " \n\t", "12 34 !!", "Released under the MIT License.", "one two", "ONE two", prose(3000), "<|endoftext|> it's  done \n"]
    base = prose(300).split(" ")
    for k in range(40):
        copy = list(base)
        for _ in range(k % 7):
            copy[rnd.randrange(300)] = "neu"
        texts.append(" ".join(copy))
    passage = prose(70)
    texts += [f"{prose(30)} {passage} {prose(20)}" for _ in range(6)] + [prose(rnd.randint(1, 200)) for _ in range(40)]
    texts += texts[9:14] + [texts[20].upper(), texts[20].lower()]
    rows = [(i * 3, t, ("fr", "en", None)[i % 3], f"s{i % 4}", len(t or ""), "k", 1, None) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def key(row):
    return tuple((x is not None, x) for x in row)


def same(found, expected):
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard(docs, rows, n, num):
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := split(r[1], True)) else set() for r in rows]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= num * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[y] = x
    expected = [(r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(rows, sets, strict=True)]
    assert len({e[2] for e in expected}) < len({e[0] for e in expected}) - 5
    same(ngram_jaccard.jaccard_components(docs, n, num, 100).collect(), expected)


def test_jaccard_in_blocks(docs):
    whole, blocks = (sorted(map(tuple, ngram_jaccard.jaccard_components(docs, 3, 90, 100, block_shingles=b).collect()), key=key) for b in (4_000_000, 900))
    assert whole == blocks


def test_exact(docs, rows):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    expected = []
    for r in rows:
        ids = groups[lower(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        expected.append((r[0], keep, len(ids), r[0] == keep, sha(lower(r[1]))))
    for salt in (1024, 2):
        same(exact_dedup.exact_groups(docs, rows_per_salt=salt).collect(), expected)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_polynomial_combines():
    data = bytes(range(256)) * 3
    import numpy as np

    for base, prime in zip(exact_dedup.BASES, exact_dedup.PRIMES, strict=True):
        whole = 0
        for byte in data:
            whole = (whole * base + byte + 1) % prime
        left, right = (exact_dedup.chunk_hash(np.frombuffer(x, np.uint8), base, prime) for x in (data[:300], data[300:]))
        assert exact_dedup.combine(left, right, len(data) - 300, base, prime) == whole


def test_substring(docs, rows):
    first = {}
    for r in rows:
        w = split(r[1])
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if r[0] is not None:
                first[k] = min(first.get(k, r[0]), r[0])
    expected = []
    for r in rows:
        w, gone = split(r[1]), set()
        for i in range(len(w) - 49):
            if r[0] is not None and first[tuple(w[i : i + 50])] < r[0]:
                gone |= set(range(i, i + 50))
        expected.append((r[0], len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sum(e[2] for e in expected) > 1000
    same(substring_dedup.substring_dedup(docs).collect(), expected)
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_bpe_and_packing(docs, rows):
    tokenizer = load(tokenizer_path(WORD_BPE))
    ids = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    same(trie_bpe.encode_digests(docs).collect(), [(r[0], len(x), sha(" ".join(map(str, x))), sha(tokenizer.decode(x, skip_special_tokens=False))) for r, x in zip(rows, ids, strict=True)])
    packed = best_fit.pack(docs, tokenizer_path(WORD_BPE), shard_rows=20).collect()
    expected = Counter()
    for r, x in zip(rows, ids, strict=True):
        x = [*x, 0]
        for p, at in enumerate(range(0, len(x), 2048)):
            part = x[at : at + 2048]
            expected[r[0], p, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter(tuple(p)[:5] for p in packed) == expected
    bins = {}
    for p in packed:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    room = []  # first-fit decreasing, to compare with
    for n in sorted((p["length"] for p in packed), reverse=True):
        k = next((i for i, free in enumerate(room) if free >= n), None)
        room = [*room, 2048 - n] if k is None else [free - n * (i == k) for i, free in enumerate(room)]
    assert len(bins) <= len(room)


def test_token_files(docs, rows, empty):
    tokenizer = load(tokenizer_path(BYTE_BPE))
    found = token_files.token_file_round_trip(docs, tokenizer_path(BYTE_BPE)).collect()
    at, crcs = 0, Counter()
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        crcs[r[0], len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == crcs
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)
    assert token_files.token_file_round_trip(empty, tokenizer_path(BYTE_BPE)).count() == 0


def test_fingerprints(docs, rows, spark):
    found = fingerprint.fingerprint_digests(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    expected = Counter()
    for i, r in enumerate(ordered):
        t, following = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        expected[r[0], len(t), sha(t[: len(t) - half] + following[:half])] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == expected
    long = [r for r in found if r["n_chars"] > 3000]
    assert long and all(0 <= r["near_next"] <= 1 and r["near_edited"] > 0.15 for r in long)
    two = spark.createDataFrame([("a.\nb.\nc", "c\na.\nb."), ("x", "y")], "a string, b string")
    cols = two.select(*fingerprint.paragraph_hashes(F.col("a"), "p"), *fingerprint.paragraph_hashes(F.col("b"), "q"))
    p, q = (fingerprint.fingerprint([F.col(f"{n}{k}") for k in range(4)]) for n in "pq")
    pair = cols.select(p.alias("p"), q.alias("q"))
    assert [r[0] for r in pair.select(F.col("p") == F.col("q")).collect()] == [True, False]
    assert all(r[0] for r in pair.select(fingerprint.subtract(fingerprint.add(F.col("p"), F.col("q")), F.col("q")) == F.col("p")).collect())


def test_likeness_of_repeated_and_long_paragraphs(spark):
    rnd = random.Random(3)
    repeated = "\n".join(["the same line"] * 60 + [f"line {i}" for i in range(60)])
    fewer = "\n".join(["the same line"] * 30 + [f"line {i}" for i in range(60)])
    long = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) for _ in range(2000))
    short = "x " * 20_000  # no cut, one paragraph
    pairs = [(repeated, fewer, 90 / 120), (repeated, repeated[:10] + "\n" + repeated, 120 / 121), (long, long[: len(long) // 2], 0.5), (long, "w " + long, None), (short, short + "y", 0.0), ("", "", 1.0)]
    table = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    cols = table.select("i", *fingerprint.paragraph_hashes(F.col("a"), "p"), *fingerprint.paragraph_hashes(F.col("b"), "q"))
    p, q = ([F.col(f"{n}{k}") for k in range(4)] for n in "pq")
    cols = cols.select("i", fingerprint.fingerprint(p).alias("p"), fingerprint.fingerprint(q).alias("q"), fingerprint.fingerprint(q, p).alias("more"), fingerprint.fingerprint([F.concat(*x) for x in zip(p, q, strict=True)]).alias("both"))
    found = cols.select("i", fingerprint.likeness(F.col("p"), F.col("q")), fingerprint.add(F.col("p"), F.col("more")) == F.col("both"), fingerprint.subtract(F.col("both"), F.col("more")) == F.col("p")).orderBy("i").collect()
    for (_, like, added, taken), (_, _, true) in zip(found, pairs, strict=True):
        assert added and taken
        assert like > 0.9 if true is None else abs(like - true) < 0.12
    cut = table.where("i = 2").select(fingerprint.paragraphs(F.col("a"))).first()[0]
    assert " ".join(cut) == long and max(map(len, cut)) < 250


def test_languages(docs, rows, spark):
    found = language_id.identify_languages(docs).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in found if r["doc_id"] in (0, 3, 6, 9)} == {"und"}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = language_id.identify_languages(real).where("held_out").join(real.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert scored.where("lang_pred = lang").count() >= 0.97 * scored.count()


def test_licenses_and_lines(docs, rows):
    found = {r["doc_id"]: r["licenses"] for r in license_scan.license_scan(docs).collect()}
    assert found[12] == "MIT" and found[0] == ""
    seen = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if line.strip(" ") and r[3] is not None:
                seen.setdefault(line.strip(" "), set()).add(r[3])
    expected = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(seen.get(x.strip(" "), ())) < 3]
        expected.append((r[0], len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    same(line_dedup.site_line_dedup(docs, "source", min_sites=3).collect(), expected)


APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
GPL2 = GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
CC0 = "To the extent possible under law, the author has waived all copyright\nand related or neighboring rights to this work.\n"


def test_published_notices(spark):
    cases = {"Apache-2.0": APACHE, "MIT": MIT, "BSD": BSD, "GPL-3.0": GPL, "GPL-2.0": GPL2, "CC0-1.0": CC0}
    rows, expected = [], {}
    for name, notice in cases.items():
        unwrapped = "\n\n".join(" ".join(p.split()) for p in notice.split("\n\n"))
        for text in (notice, unwrapped, notice.replace("\n", "\r\n"), "".join(f"# {x}\n" for x in notice.split("\n"))):
            expected[len(rows)] = name
            rows.append((len(rows), text))
    tail = APACHE[APACHE.index("you may not") :]
    for text, name in ((tail, "Apache-2.0"), ("All rights\n\nreserved", ""), ("We said: released under\nthe MIT license.", ""), ("a\nReleased under\nthe MIT license\nb", "MIT")):
        expected[len(rows)] = name
        rows.append((len(rows), text))
    found = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in found} == expected


def test_empty_tables(empty, spark):
    for f in (license_scan.license_scan, fingerprint.fingerprint_digests, ngram_jaccard.jaccard_components, exact_dedup.exact_groups, substring_dedup.substring_dedup, language_id.identify_languages, trie_bpe.encode_digests, line_dedup.site_line_dedup):
        assert f(empty).count() == 0, f
    assert best_fit.pack(empty, tokenizer_path(WORD_BPE)).count() == 0


def test_stages(docs, rows, spark):
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, current, "").persist()
        assert after.columns == docs.columns and after.count() <= current.count()
        current = after
    assert corpus_pipeline.STAGES[-1][1](spark, current, "").count() >= current.count()
