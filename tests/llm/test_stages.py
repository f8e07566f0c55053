"""Every stage of the pipeline, and what its operators rest on, against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferryline.llm import fingerprint, key_counts, language_id, ngram_jaccard, token_files, tokens, words
from ferryline.llm.tokens import BYTE_BPE, WORD_BPE, load, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone_id long, _gone long, key string, runs int, row string"


def corpus():
    rnd = random.Random(8)
    pool = {"xx": ["lora", "mixe", "trabo", "quens", "ara"], "yy": ["zkot", "wherf", "gnuck", "strom", "plitz"]}

    def prose(lang, n):
        return " ".join(rnd.choice(pool[lang]) + rnd.choice(["", "a", "o", "en", ",", ".\n"]) for _ in range(n))

    texts = [(None, "xx"), ("", None), (" \n", "xx"), ("12 34", "yy"), (prose("xx", 9000), "xx")]
    base, passage = prose("yy", 200).split(" "), prose("xx", 60)
    for k in range(30):
        copy = list(base)
        for _ in range(k % 6):
            copy[rnd.randrange(200)] = f"neu{k}"
        texts.append((" ".join(copy), "yy"))
    texts += [(f"{prose('xx', 30)} {passage} {prose('xx', 20)}", "xx") for _ in range(5)] + [(prose(lang, rnd.randint(3, 120)), lang) for lang in ("xx", "yy") for _ in range(25)]
    texts += [texts[6], (texts[7][0].upper(), "yy"), ("ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾᛁ", None)]
    rows = [(i * 2, t, lang, f"s{i % 3}", len(t or ""), 1, None, "k", 2, "r") for i, (t, lang) in enumerate(texts)]
    return rows + [rows[9], (None, texts[8][0], *rows[0][2:]), (None, None, *rows[0][2:])]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def buckets(text):
    """n-gram buckets by plain integers."""
    codes, out = [ord(c) for c in f" {text.lower()} "], []
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = n * 0x27D4EB2F & 0xFFFFFFFF
            for j in range(n):
                h = (h ^ codes[i + j]) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[j] & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h >> 17)
    return out


def plain_bayes(rows):
    """(row, language, posterior, fit), by definition."""
    counts, n_docs = defaultdict(Counter), Counter()
    for r in rows:
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[1] is not None and r[2] is not None:
            counts[r[2]].update(buckets(r[1]))
            n_docs[r[2]] += 1
    names, size = sorted(counts), 1 << 15
    total = {x: sum(counts[x].values()) + 0.5 * size for x in names}
    usual = {x: sum((counts[x][b] + 0.5) / total[x] * math.log((counts[x][b] + 0.5) / total[x]) for b in range(size)) for x in names}
    for r in rows:
        if not any(c.isalpha() for c in r[1] or ""):
            yield r, "und", 0.0, 0.0
            continue
        grams = Counter(buckets(r[1]))
        prior = {x: math.log(n_docs[x] / sum(n_docs.values())) for x in names}
        score = {x: prior[x] + sum(n * math.log((counts[x][b] + 0.5) / total[x]) for b, n in grams.items()) for x in names}
        best = max(names, key=score.get)
        yield r, best, 1 / sum(math.exp(min(0, score[x] - score[best])) for x in names), (score[best] - prior[best]) / grams.total() - usual[best]


def same(found, expected):
    def key(r):
        return tuple((x is not None, x) for x in r)

    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)


def test_language_stage(spark, docs, rows):
    plain = list(plain_bayes(rows))
    found = language_id.identify_languages(docs).collect()
    expected = Counter((r[0], best, round(score, 6)) for r, best, score, _ in plain)
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in found) == expected
    kept = {least: [r for r, best, score, fit in plain if best != "und" and score >= 0.5 and fit >= least] for least in (-6, -4)}
    same(corpus_pipeline.language(spark, docs, "").collect(), kept[-6])
    # In this small corpus, letters never seen are less of a surprise than in a large one.
    assert not any("ᚠ" in r[1] for r in kept[-4]) and len(kept[-4]) > 0.9 * len(kept[-6])
    same(language_id.drop_unidentified(docs, min_fit=-4.0).collect(), kept[-4])


def test_counts_do_not_depend_on_the_cut(monkeypatch):
    texts = ["Straße und ähnliche", "", "abc " * 50]
    def total():
        out = Counter()
        for text, bucket, times in language_id._counts(texts):
            for t, b, n in zip(text.tolist(), bucket.tolist(), times.tolist(), strict=True):
                out[t, b] += n
        return out
    whole = total()
    assert whole == Counter((i, b) for i, t in enumerate(texts) for b in buckets(t))
    monkeypatch.setattr(language_id, "_PLACES", 7)
    assert total() == whole


def test_exact_stage(spark, docs, rows):
    best = {}
    for r in rows:
        if lower(r[1]) not in best or (r[0] is not None and (best[lower(r[1])][0] is None or r[0] > best[lower(r[1])][0])):
            best[lower(r[1])] = r
    found = corpus_pipeline.exact(spark, docs, "")
    assert found.columns == docs.columns
    same([(r[0], r[1]) for r in found.collect()], [(r[0], r[1]) for r in best.values()])


def components(rows, n, num):
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := lower(r[1]).encode().split()) else set() for r in rows]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= num * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[y] = x
    return root


def test_near_stage(spark, docs, rows):
    root = components(rows, 5, 80)
    expected = [r for r in rows if r[0] is None or root(r[0]) == r[0]]
    assert len(expected) < len(rows) - 10
    same(corpus_pipeline.near(spark, docs, "").collect(), expected)


def cut(rows, width=50):
    first = {}
    for r in rows:
        w = (r[1] or "").encode().split()
        for i in range(len(w) - width + 1):
            if r[0] is not None:
                first[tuple(w[i : i + width])] = min(first.get(tuple(w[i : i + width]), r[0]), r[0])
    for r in rows:
        w, gone = (r[1] or "").encode().split(), set()
        for i in range(len(w) - width + 1):
            if r[0] is not None and first[tuple(w[i : i + width])] < r[0]:
                gone |= set(range(i, i + width))
        text = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else r[1]
        yield (r[0], text, r[2], r[3], len(text) if gone else r[4], *r[5:])


def test_substring_stage(spark, docs, rows):
    expected = list(cut(rows))
    assert expected != rows
    same(corpus_pipeline.substrings(spark, docs, "").collect(), expected)


def test_stages_of_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, empty, "")
        assert found.columns == empty.columns and found.count() == 0


def test_whole_pipeline(spark, docs, rows, tmp_path):
    """run() on written documents: the pieces are the ids of what the stages, by brute force, leave."""
    docs.where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    left = [r for r, best, score, fit in plain_bayes([r for r in rows if r[0] is not None]) if best != "und" and score >= 0.5 and fit >= -6]
    groups = defaultdict(list)
    for r in left:
        groups[lower(r[1])].append(r)
    left = [max(g, key=lambda r: r[0]) for g in groups.values()]
    root = components(left, 5, 80)
    left = list(cut([r for r in left if root(r[0]) == r[0]]))
    tokenizer, expected = load(tokenizer_path(WORD_BPE)), Counter()
    for r in left:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[r[0], p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == expected


def test_unrelated_sets_never_meet():
    """Sets without a common shingle have no keys; a passage that all share brings no two of them together."""
    rnd = np.random.default_rng(3)
    for size in (300, 1000, 10_000):
        own = [np.sort(rnd.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(20)]
        common = np.sort(rnd.integers(0, 1 << 63, size // 10).astype(np.uint64))
        for sets in (own, [np.sort(np.concatenate([s, common])) for s in own]):
            flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
            _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
            may, owner, _ = ngram_jaccard.rarest(flat, key_counts.frequency_class(counts)[inverse], sizes, 80, 100)
            assert not may.any() and not len(owner)


def test_t_occurrence():
    rnd = random.Random(2)
    for _ in range(200):
        lists = [np.array(sorted(rnd.sample(range(60), rnd.randint(1, 50))), np.int64) for _ in range(rnd.randint(1, 25))]
        needed, skip = rnd.randint(1, len(lists) + 1), np.array([rnd.random() < 0.2 for _ in range(60)])
        counts = Counter(x for y in lists for x in y.tolist() if not skip[x])
        members, found = ngram_jaccard.t_occurrence(lists, needed, skip, mu=rnd.choice([0.001, 0.01, 1.0, 100.0]))
        assert dict(zip(members.tolist(), found.tolist(), strict=True)) == {x: n for x, n in counts.items() if n >= needed}


def test_links_of_large_and_mixed_clusters():
    rnd = random.Random(6)
    sets = []
    for base in range(4):
        core = [rnd.getrandbits(63) for _ in range(50)]
        for _ in range((3, 90, 20, 1)[base]):
            kept = [x if rnd.random() > 0.06 else rnd.getrandbits(63) for x in core]
            sets.append(np.array(sorted(kept), np.uint64))
    rnd.shuffle(sets)

    def trees(pairs):
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in range(len(sets))]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (n := len(set(sets[i].tolist()) & set(sets[j].tolist()))) >= 80 * (100 - n)]
    assert trees(ngram_jaccard.links_within(sets, 80, 100)) == trees(every)


def test_word_hashes_of_long_words_and_texts():
    rnd = random.Random(1)
    texts = ["", " ", "x" * 3_000_000, *(" ".join(rnd.choice(["a", "B", "é", "w" * 300]) for _ in range(rnd.randint(0, 40))) for _ in range(50)), "y " * 900_000]
    for low in (False, True):
        hashes, edges = words.word_hashes(pa.array(texts), low)
        parts = [words.split_words(t, low) for t in texts]
        assert np.diff(edges).tolist() == [len(p) for p in parts]
        pairs = {(h, w) for h, w in zip(hashes.tolist(), (w for p in parts for w in p), strict=True)}
        assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs})


@pytest.mark.parametrize(("name", "whole"), [(BYTE_BPE, False), (WORD_BPE, True)])
def test_encoder(name, whole, monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER", 300)
    monkeypatch.setattr(tokens, "LAID_OUT", 20)
    texts = ["", "", " a", "a ", "a  b", "a\nb", "a\n b", "<|endoftext|> x", "don't it's é1²", "a\u00a0b c", "e\u0301a É", "日本 語", "ÀB ßX İ", "x<|startoftext|>y", "tab\tb", "12 345,6 a1b2", "\n", "_a_ ''s 's 'S", "word " * 400 + "end"]
    encoder = tokens.BatchEncoder(tokenizer_path(name), whole)
    encoder.known.size = 5
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_of_many_batches(spark):
    texts = [(i, ("w%d " % i) * (i % 7 * 3000)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    folder = token_files.fresh_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(docs, folder, tokenizer_path(BYTE_BPE), 2, length=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = token_files.read_token_files(manifest)
    assert read.select(F.spark_partition_id()).distinct().count() > 1
    tokenizer = load(tokenizer_path(BYTE_BPE))
    stream = [x for _, t in texts for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 2]]
    seen = []
    for row in manifest.orderBy("part").collect():
        file = token_files.TokenFile(row["file"])
        own = stream[row["start"] : row["start"] + row["n_tokens"]]
        n = -(-len(own) // 64)
        seen.append(file.ids.num_record_batches)
        for i in {0, n - 1, n // 2, min(n - 1, token_files.ROWS_PER_BATCH)}:
            ids, mask = file.sequence(i)
            part = own[i * 64 : (i + 1) * 64]
            assert ids[mask].tolist() == part and mask.tolist() == [k < len(part) for k in range(64)]
        assert file.tokens(5, len(own) - 5).tolist() == own[5:]
    assert max(seen) > 1 and read.count() == 60


def test_likeness_estimates_the_multiset_jaccard(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 400")
    found = fingerprint.fingerprint_digests(real).select("doc_id", "near_next").collect()
    cut_up = {r[0]: Counter(r[1]) for r in real.select("doc_id", fingerprint.paragraphs(F.col("text"))).collect()}
    order = sorted(cut_up, reverse=True)
    following = dict(zip(order, [*order[1:], order[0]], strict=True))
    gaps = [abs(r["near_next"] - (cut_up[r["doc_id"]] & cut_up[following[r["doc_id"]]]).total() / (cut_up[r["doc_id"]] | cut_up[following[r["doc_id"]]]).total()) for r in found]
    assert len(gaps) > 50 and sum(gaps) / len(gaps) < 0.08 and max(gaps) < 0.4
