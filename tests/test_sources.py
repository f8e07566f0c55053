"""Readers at small split sizes against the csv module and whole bytes."""

import csv
import hashlib
import io
import random
from contextlib import contextmanager

import pytest

from ferryline.sources.delimited import _lines, ends_open, infer_read_options, physical_lines, read_delimited
from ferryline.sources.pages import read_text_documents
from ferryline.sources.tables import document_text, fingerprint, inspect_pages, route_sources
from ferryline.sources.wide import cut_block, splittable


@contextmanager
def splits_of(spark, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_open_quotes_as_the_csv_reader_sees_them():
    rnd = random.Random(1)
    for _ in range(20_000):
        line = "".join(rnd.choice('";a ') for _ in range(rnd.randrange(9))) + rnd.choice(["\n", "\r\n"])
        for opened in (False, True):
            reader = csv.reader(iter([*(['"\n'] if opened else []), line, ""]), delimiter=";")
            next(reader)
            assert ends_open(line, opened, ";") == (reader.line_num == 2 + opened), (line, opened)


@pytest.mark.parametrize("header_row", [1, 401, 402])
def test_header_in_a_later_block(spark, tmp_path, header_row):
    """400 title rows, one of them quoted over two lines, then a header whose cell crosses blocks; line ends in cells stay."""
    rnd = random.Random(6)
    titles = "".join(f"title {k};x\r\n" for k in range(399)) + '"two\r\nlines";y\r\n'
    header = 'a;"long\r\n' + "h" * 300 + '";c\r\n'
    body = "".join(rnd.choice(['1;"x\r\ny";3\r\n', '"p""q\n";;z\n', "lone;\r", "7;8;9\n"]) for _ in range(300))
    data = (titles + header + body).encode()
    (tmp_path / "t.csv").write_bytes(data)
    with splits_of(spark, "700b"):
        rows, report = read_delimited(spark, str(tmp_path / "t.csv"), header_row=header_row, delimiter=";")
        found = sorted((r["_row"], *(r[c] for c in rows.columns[3:])) for r in rows.collect())
        assert [r["problem"] for r in report.where("encoding is not null").collect()] == [None]
    reader = csv.reader(io.StringIO(data.decode(), newline=""), delimiter=";")
    names = [next(reader) for _ in range(header_row)][-1]
    expected = []
    for cells in reader:
        values = ([x.strip() or None for x in cells] + [None] * 3)[: len(names)]
        if any(values):
            expected.append((reader.line_num, *values))
    assert found == sorted(expected, key=lambda r: r[0])
    if header_row < 402:
        assert any("\r\n" in (x or "") for r in expected for x in r[1:])


def test_fingerprints_of_any_bytes(spark, tmp_path):
    """Split over many tasks, with and without a last newline or a byte order mark, without any newline, and empty."""
    rnd = random.Random(2)
    contents = [rnd.randbytes(60_000), b"a\nb\n", b"a\nb", b"\n", b"\n\n", b"", b"\xef\xbb\xbfa\nb\n", b"\xef\xbb\xbfa\nb", b"\xef\xbb\xbf", b"\r\n\r", b"x" * 5000, rnd.randbytes(3000) + b"\n"]
    for k, data in enumerate(contents):
        (tmp_path / f"{k}.bin").write_bytes(data)
    with splits_of(spark, "900b"):
        found = {int(r["file"].rpartition("/")[2][:-4]): r["sha256"] for r in fingerprint(spark, str(tmp_path)).collect()}
    assert found == {k: hashlib.sha256(data).hexdigest() for k, data in enumerate(contents)}


def test_routes(spark, tmp_path):
    names = {"a.csv": "csv", "b.TXT": "txt", "c.xlsx": "xlsx", "d.Xlsm": "xlsx", "e.docx": "docx", "f.pdf": "pdf", "g.JPEG": "image", "h.tiff": "image", "i.exe": None, "none": None, "j.csv.gz": None, "k.": None}
    (tmp_path / "deep").mkdir()
    for k, name in enumerate(names):
        (tmp_path / ("deep" if k % 2 else ".") / name).write_bytes(b"x")
    found = {r["file"].rpartition("/")[2]: (r["format"], r["tabular"]) for r in route_sources(spark, str(tmp_path)).collect()}
    assert found == {n: (f, None if f is None else f in ("csv", "xlsx")) for n, f in names.items()}


def test_read_options(spark, tmp_path):
    files = {"a": ("x;y\n1;2\n".encode(), "utf-8-sig", ";", ["x", "y"], None), "b": ("é|y\n1|2\n".encode("cp1252"), "cp1252", "|", ["é", "y"], None), "c": (b"\x81,y\n1,2\n", "latin-1", ",", ["\x81", "y"], None), "d": (b"", "utf-8-sig", ",", None, "no header")}
    for name, (data, *_) in files.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    for r in infer_read_options(spark, str(tmp_path)).collect():
        _, encoding, delimiter, header, problem = files[r["file"].rpartition("/")[2][:-4]]
        assert (r["encoding"], r["delimiter"], r["header"]) == (encoding, delimiter, header)
        assert (problem or "") in (r["problem"] or "") and bool(problem) == bool(r["problem"])
        assert bool(r["warning"]) == (encoding != "utf-8-sig")


def test_previews_are_cut_before_they_are_gathered(spark):
    rnd = random.Random(5)
    rows = [(f"f{d}", p, rnd.choice(["", " \n", None, "x" * rnd.randrange(900), "word " * rnd.randrange(300)])) for d in range(30) for p in range(rnd.randrange(1, 12))]
    rows += [("edge", 1, "y" * 301), ("edge", 2, "z" * 9)]
    pages = spark.createDataFrame(rows, "_src_file string, page int, text string")
    for limit in (2000, 700, 301, 302, 303, 1):
        whole = {r["_src_file"]: (r["n_pages"], r["text"][:limit]) for r in document_text(pages).collect()}
        assert {r["_src_file"]: (r["n_pages"], r["preview"]) for r in inspect_pages(pages, limit).collect()} == whole


def test_text_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("um\r\ndois\r".encode("cp1252"))
    (tmp_path / "b.txt").write_bytes(b" \n")
    (tmp_path / "c.txt").write_bytes("três".encode("utf-16"))
    found = {r["_src_file"].rpartition("/")[2]: (r["text"], r["warning"]) for r in read_text_documents(spark, str(tmp_path)).where("_src_file not like '%c.txt'").collect()}
    assert found == {"a.txt": ("um\ndois\n", None), "b.txt": (" \n", "no text")}
    assert read_text_documents(spark, str(tmp_path / "c.txt"), "utf-16").first()["text"] == "três"


def test_blocks_cut_at_wide_newlines():
    """Any cuts of any bytes: heads, lines and tails put together are the bytes, cut only where a newline ends."""
    rnd = random.Random(8)
    for _ in range(3000):
        newline = rnd.choice([b"\n\0", b"\0\n", b"\n\0\0\0", b"\0\0\0\n", b"%"])
        unit = len(newline)
        data = b"".join(rnd.choice([newline, bytes(rnd.choice(b"\n\0%a") for _ in range(unit))]) for _ in range(rnd.randrange(1, 30)))
        places = sorted({0, *(rnd.randrange(len(data)) for _ in range(rnd.randrange(4)))})
        lines, open_part = [], b""
        for lo, hi in zip(places, [*places[1:], len(data)]):
            size = rnd.randrange(1, 9)
            for part, some, closed in cut_block((data[k : min(k + size, hi)] for k in range(lo, hi, size)), lo, newline):
                if part is None:
                    assert not open_part
                    lines.append(some)
                    continue
                open_part += some
                if closed:
                    lines.append(open_part)
                    open_part = b""
        lines.append(open_part)
        assert b"".join(lines) == data
        ends = {k + unit for k in range(0, len(data), unit) if data[k : k + unit] == newline}
        at, cuts = 0, set()
        for line in lines[:-1]:
            at += len(line)
            cuts.add(at)
        assert cuts <= ends


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-be", "utf-32", "cp037"])
def test_wide_encodings_are_split(spark, tmp_path, encoding):
    """Characters whose bytes look like newlines, at many split sizes: the lines of the whole text, and the csv reader's records."""
    rnd = random.Random(9)
    plain = encoding == "cp037"
    cell = lambda: "".join(rnd.choice("ab\x8e \r" if plain else "a\u0a41\u0100\u0a0a\u0a00\u0d0a\u000a\U0001f40a\u010a\r") for _ in range(rnd.randrange(7)))
    texts = ["h;i\n" + "".join(f'{k};"{cell()}"' + rnd.choice(["\n", "\r\n"]) for k in range(40)), "h;i\nx;y", "h;i\n" + "long;" + "z" * 900 + "\nlast;1", "h;i\r\n1;\r\n2;3\r\n"]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.csv").write_bytes(text.encode(encoding))
    (tmp_path / "4.csv").write_bytes(b"")
    assert splittable(encoding)
    for size in ("97b", "500b"):
        with splits_of(spark, size):
            rows = sorted((r["file"][-5], r["block"], r["i"], bytes(r["line"])) for r in _lines(spark, str(tmp_path), encoding).collect())
        for k, text in enumerate(texts):
            assert [r[3] for r in rows if r[0] == str(k)] == physical_lines(text.encode()), (size, k)
            by_block = {}
            for _, block, i, _ in (r for r in rows if r[0] == str(k)):
                by_block.setdefault(block, []).append(i)
            assert all(i == list(range(len(i))) for i in by_block.values()) and 0 in by_block
    with splits_of(spark, "251b"):
        found, report = read_delimited(spark, str(tmp_path), encoding=encoding, delimiter=";")
        got = sorted((r["_src_file"][-5], r["_row"], r["h"], r["i"]) for r in found.collect())
        assert {r["file"][-5]: bool(r["problem"]) for r in report.where("encoding is not null or problem is not null").collect()} == {**dict.fromkeys("0123", False), "4": True}
    expected = []
    for k, text in enumerate(texts):
        reader = csv.reader(io.StringIO(text, newline=""), delimiter=";")
        next(reader)
        for cells in reader:
            h, i = ([x.strip() or None for x in cells] + [None] * 2)[:2]
            if h or i:
                expected.append((str(k), reader.line_num, h, i))
    assert got == sorted(expected, key=lambda r: r[:2])


def test_bytes_outside_a_wide_encoding_concern_their_file(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes("a\n1\n".encode("utf-16"))
    (tmp_path / "odd.csv").write_bytes("a\n1\n".encode("utf-16") + b"x")
    (tmp_path / "lone.csv").write_bytes("a\n1\n".encode("utf-16") + b"\x00\xd8" + "b\n2\n".encode("utf-16-le"))
    with splits_of(spark, "8b"):
        rows, report = read_delimited(spark, str(tmp_path), encoding="utf-16", delimiter=";")
        assert [(r["_src_file"].rpartition("/")[2], r["_row"], r["a"]) for r in rows.collect()] == [("good.csv", 2, "1")]
        problems = {r["file"].rpartition("/")[2]: (r["problem"] or "").partition(":")[0] for r in report.collect()}
    assert problems == {"good.csv": "", "odd.csv": "UnicodeDecodeError", "lone.csv": "UnicodeDecodeError"}


@pytest.mark.parametrize("encoding", ["utf-8-sig", "UTF_8_SIG"])
def test_a_named_encoding_with_a_mark_is_split(spark, tmp_path, encoding):
    text = "é;y\n" + "".join(f'{k};"a\r\nb"\n' for k in range(40))
    (tmp_path / "m.csv").write_bytes(text.encode("utf-8-sig"))
    with splits_of(spark, "100b"):
        assert _lines(spark, str(tmp_path), encoding).select("block").distinct().count() > 3
        rows, report = read_delimited(spark, str(tmp_path), encoding=encoding, delimiter=";")
        assert sorted((int(r["é"]), r["y"], r["_row"]) for r in rows.collect()) == [(k, "a\r\nb", 3 + 2 * k) for k in range(40)]
        assert [r["problem"] for r in report.collect()] == [None]
