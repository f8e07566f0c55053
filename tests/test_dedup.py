"""The search for similar names against brute force, in small and in hot blocks."""

import difflib
import random
import time
import unicodedata

import pytest

from ferryline.operators import dedup, name_index
from ferryline.operators.name_index import Names, candidates

FIRST = ("maria", "joão", "ana", "josé", "antônio", "francisca", "carlos", "paulo", "luiz", "márcia", "zé")
LAST = ("silva", "santos", "oliveira", "souza", "lima", "pereira", "ferreira", "costa", "rodrigues", "almeida", "neves")


def person(rnd):
    name = " ".join([rnd.choice(FIRST), *rnd.sample(LAST, rnd.randint(1, 3))])
    letters = list(name)
    for _ in range(rnd.choice([0, 0, 1, 2, 4])):
        k = rnd.randrange(len(letters))
        letters[k] = rnd.choice(["", "x", letters[k] * 2, rnd.choice("aeiou")])
    return "".join(letters).strip()


def plain(x):
    return "".join(c for c in unicodedata.normalize("NFD", x.lower().strip()) if not unicodedata.combining(c))


def test_filters_lose_no_pair():
    rnd = random.Random(8)
    names = [plain(person(rnd)) for _ in range(250)] + ["a", "", "aa", "b" * 300, "b" * 290 + "c" * 10, "一二三", "一二四"]
    for threshold in (0.6, 0.8, 0.95):
        kept = set(zip(*(x.tolist() for x in candidates(Names(names), Names(names), threshold, False)), strict=True))
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                if (i, j) not in kept:
                    assert difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() < threshold


def brute(rows, exact, threshold=0.8):
    out = []
    rows = sorted(rows)
    for i, (ord_, name, *values) in enumerate(rows):
        if ord_ in exact or not name or not plain(name):
            continue
        for other, prev, *prev_values in rows[:i]:
            hit = next((k for k in (0, 1) if values[k] is not None and values[k] == prev_values[k]), None)
            if hit is not None and prev and plain(prev):
                ratio = difflib.SequenceMatcher(None, plain(name), plain(prev)).ratio()
                if ratio >= threshold:
                    out.append((ord_, other, ("phone", "postal_code")[hit], values[hit], round(ratio, 3)))
                    break
    return sorted(out)


@pytest.mark.parametrize("part_entries", [500, 12])
def test_possible_against_brute_force(spark, part_entries):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([person(rnd), person(rnd).upper(), None, " "]) if k % 9 == 0 else person(rnd), rnd.choice([None, "1", "2", str(k)]), rnd.choice([None, "9", "9", str(k // 3)])) for k in range(420)]
    rows += [(1000 + k, rows[k][1], *rows[k][2:]) for k in range(0, 60, 2)]
    exact = {5, 17, 1004}
    valid = spark.createDataFrame(rows, "_row long, full_name string, phone string, postal_code string")
    known = spark.createDataFrame([(x, 0, "document", "v") for x in exact], "ord long, matched long, key string, value string")
    found = sorted(map(tuple, dedup.find_possible(valid, known, part_entries=part_entries).collect()))
    assert found == brute(rows, exact) and len(found) > 50


@pytest.mark.parametrize("firsts", [1, 3, 64])
def test_first_names_of_a_block_settle_only_what_they_can(spark, firsts):
    """Few early names, so nearly every block has names that are looked for in its parts."""
    rnd = random.Random(5)
    rows = [(k, person(rnd), rnd.choice([None, "1", "2"]), rnd.choice([None, "9", str(k // 50)])) for k in range(300)]
    # Early names that nothing resembles, and a name of over 200 characters, whose ratio with itself is 0.
    rows = [(-9 + k, x * 9, "1", "9") for k, x in enumerate("qwkyzj")] + rows + [(400 + k, "b" * 300, "1", "9") for k in range(2)]
    valid = spark.createDataFrame(rows, "_row long, full_name string, phone string, postal_code string")
    none = spark.createDataFrame([], "ord long, matched long, key string, value string")
    found = sorted(map(tuple, dedup.find_possible(valid, none, part_entries=12, firsts=firsts).collect()))
    assert found == brute(rows, set()) and len(found) > 20


def test_similar_names_are_not_all_compared(monkeypatch):
    """Of names that all resemble the first one, each is compared once: the rest can't be earlier."""
    names = [f"maria e customer#{k:09d} de souza" for k in range(400)]
    compared = []

    class Counted(difflib.SequenceMatcher):
        def ratio(self):
            compared.append(1)
            return super().ratio()

    monkeypatch.setattr(difflib, "SequenceMatcher", Counted)
    found = name_index.earliest(names, names, list(range(400)), 0.8)
    assert [j for _, j, _ in found] == [0] * 399 and len(compared) < 800


def test_order_of_several_files(spark):
    """Rows named by (file, row)."""
    rows = [("b", 1, "maria silva", "1"), ("a", 9, "maria silvo", "1"), ("a", 2, "maria silv", "1"), ("b", 0, "outra pessoa", "1")]
    valid = spark.createDataFrame(rows, "f string, r long, full_name string, phone string").selectExpr("struct(f, r) as at", "full_name", "phone")
    none = valid.selectExpr("at as ord").where("false")
    found = {tuple(r["ord"]): tuple(r["matched"]) for r in dedup.find_possible(valid, none, ord="at").collect()}
    assert found == {("a", 9): ("a", 2), ("b", 1): ("a", 2)}


def test_hot_postal_code(spark):
    """20,000 names under one postal code, each planted copy found; parts that cannot meet do not."""
    rnd = random.Random(3)
    syllables = [a + b for a in "bcdfgjlmnprstvz" for b in "aeiou"]
    names = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 4))) + " " + "".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 5))) for _ in range(19_000)]
    rows = [(k, x, "01310100") for k, x in enumerate(names)] + [(20_000 + k, names[k * 19] + "a", "01310100") for k in range(1000)]
    valid = spark.createDataFrame(rows, "_row long, full_name string, postal_code string").repartition(8).persist()
    none = spark.createDataFrame([], "ord long, matched long, key string, value string")
    began = time.time()
    found = {r["ord"]: (r["matched"], r["similarity"]) for r in dedup.find_possible(valid, none).collect()}
    assert all(20_000 + k in found for k in range(1000))
    for k in rnd.sample(sorted(found), 200):
        name = dict((r[0], r[1]) for r in (rows[k] if k < 19_000 else rows[19_000 + k - 20_000],))[k]
        hits = [r[0] for r in rows if r[0] < k and difflib.SequenceMatcher(None, name, r[1]).real_quick_ratio() >= 0.8 and difflib.SequenceMatcher(None, name, r[1]).quick_ratio() >= 0.8 and difflib.SequenceMatcher(None, name, r[1]).ratio() >= 0.8] if k % 10 == 0 else [found[k][0]]
        assert found[k][0] == min(hits)
    assert time.time() - began < 600
    entries = valid.selectExpr("'postal_code' as key", "postal_code as value", "full_name as name", "_row as first", "_row as last")
    parts = dedup._parts(entries, 500)
    pairs = dedup._part_pairs(parts, 0.8).count()
    n = parts.select("part").distinct().count()
    assert pairs < 0.6 * n * (n + 1) / 2
    valid.unpersist()


def test_ratio_is_that_of_difflib():
    """Matches of equal length, popular characters from 200 on, and characters outside the BMP included."""
    rnd = random.Random(11)
    for _ in range(4000):
        letters = rnd.choice(["ab", "abcdefgh", "maria souza12", "é一a\U0001f600b"])
        a = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 3, 12, 40])))
        b = "".join(rnd.choice([x, x, x, "", rnd.choice(letters)]) for x in a) if rnd.random() < 0.5 else "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert name_index.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)
    for la, lb in ((199, 199), (230, 199), (199, 200), (260, 240)):
        a, b = ("".join(rnd.choice("abcdefghij") for _ in range(n)) for n in (la, lb))
        assert name_index.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_names_meet_the_earliest_ones_together(monkeypatch):
    """Names that resemble the first one are settled in one look at all of them, with one ratio each."""
    names = [f"maria e customer#{k:09d} de souza" for k in range(400)]
    calls, near, ratio = {"near": 0, "ratio": 0}, name_index.near, name_index.ratio

    def counted(name, f):
        def run(*args):
            calls[name] += 1
            return f(*args)

        return run

    monkeypatch.setattr(name_index, "near", counted("near", near))
    monkeypatch.setattr(name_index, "ratio", counted("ratio", ratio))
    assert [j for _, j, _ in name_index.earliest(names, names, list(range(400)), 0.8)] == [0] * 399
    assert calls["near"] < 10 and calls["ratio"] < 800


def test_earliest_against_brute_force():
    """The earliest similar name is found in whatever group it lies, and none from the limit on."""
    rnd = random.Random(12)
    previous = [plain(person(rnd)) for _ in range(300)]
    current = [plain(person(rnd)) for _ in range(80)] + [x + "a" for x in previous[::7]]
    until = [rnd.randint(0, 300) for _ in current]
    for threshold in (0.7, 0.8, 0.9):
        right = []
        for i, x in enumerate(current):
            hits = ((i, j, difflib.SequenceMatcher(None, x, previous[j]).ratio()) for j in range(until[i]))
            right += [hit for hit in hits if hit[2] >= threshold][:1]
        assert name_index.earliest(current, previous, until, threshold) == right and any(j > 60 for _, j, _ in right)


def test_plain_names_are_written_once(spark, monkeypatch):
    """The entries and the rows that look for a match read the names without accents from one table."""
    names, known = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name, *more: (names.append(name), known(df, name, *more))[1])
    valid = spark.createDataFrame([(1, "Ana Lima", "1"), (2, "ana limà", "1")], "_row long, full_name string, phone string")
    none = spark.createDataFrame([], "ord long, matched long, key string, value string")
    found = dedup.find_possible(valid, none)
    assert names[0] == "plain_names" and "_bare(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["ord"], r["matched"]) for r in found.collect()] == [(2, 1)]


def test_tables_are_written_with_methods_that_the_jvm_compiles(spark, monkeypatch):
    """The limit holds while a table is written, and not after it, also where the writing fails."""
    from pyspark.sql import DataFrameWriter

    from ferryline import working

    limit, seen, parquet = "spark.sql.codegen.hugeMethodLimit", [], DataFrameWriter.parquet
    before = spark.conf.get(limit)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *args, **more: (seen.append(int(spark.conf.get(limit))), parquet(self, *args, **more))[1])
    assert working.written(spark.range(5), "numbers")[0].count() == 5
    with pytest.raises(Exception, match="no number"):
        working.written(spark.range(5).selectExpr("raise_error('no number') as x"), "failing")
    assert seen == [8000, 8000] and spark.conf.get(limit) == before


def test_late_names_are_searched_only_where_some_are_left(spark, monkeypatch):
    """One pass over the early names gives the matches and the names without one; without such names, no parts are made."""
    written, parts, known, made = [], [], dedup.written, dedup._parts
    monkeypatch.setattr(dedup, "written", lambda df, name, *more: (written.append(name), known(df, name, *more))[1])
    monkeypatch.setattr(dedup, "_parts", lambda *args: (parts.append(1), made(*args))[1])
    none = spark.createDataFrame([], "ord long, matched long, key string, value string")
    alike = [(k, f"maria souza {k:03d}", "1") for k in range(100)]
    valid = spark.createDataFrame(alike, "_row long, full_name string, phone string")
    assert dedup.find_possible(valid, none, firsts=4).count() == 99 and not parts and written == ["plain_names", "entries", "first_names"]
    other = spark.createDataFrame(alike + [(200, "xyz wvu", "1"), (201, "xyz wvt", "1")], valid.schema)
    found = {r["ord"]: (r["matched"], r["similarity"]) for r in dedup.find_possible(other, none, firsts=4).collect()}
    assert parts and found[201] == (200, 0.857) and 200 not in found and len(found) == 100
