import csv
import difflib
import io
import json
import os
import random
import unicodedata
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ferryline.operators import dedup
from ferryline.operators.mapping import CUSTOMERS_CSV, FieldRule, Template, apply_mapping, reconcile_columns, transform_counts
from ferryline.operators.validation import validate
from ferryline.plans import registry
from ferryline.plans.migration import run_migration
from ferryline.sinks import outputs
from ferryline.sources.delimited import read_delimited
from ferryline.sources.pages import labelled_records, page_blocks, recover_pages
from ferryline.streaming.incremental import validate_stream, write_stream

CSV = """Código;Nome Cliente;CPF_CNPJ;Correio Eletrônico;Fone Principal;CEP;Cidade;UF;Data Cadastro
1;MARIA DA SILVA;529.982.247-25;M@x.com;(11) 91234-5678;1234-567;são paulo;sp;01/02/2024

2;"João
Lima";52998224725;m@X.com;N/A;;;;
3;x;1;a;12;1;;ZZ;31/02/2024
4;MARIA DA SILVEIRA;11222333000181;z@x.com;11912345678;;;RJ;
"""


@pytest.fixture
def rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(CSV.encode("cp1252"))
    return read_delimited(spark, str(tmp_path / "a.csv"))


def test_delimited(rows):
    table, report = rows
    assert [r["_row"] for r in table.orderBy("_row").collect()] == [2, 5, 6, 7]
    assert [(r["encoding"], r["delimiter"], r["problem"]) for r in report.collect()] == [("cp1252", ";", None)]


def test_headers_and_problems(spark, tmp_path):
    (tmp_path / "h.csv").write_text("t\na,,a\n1\n2,3,4,5\n")
    table, report = read_delimited(spark, str(tmp_path / "h.csv"), header_row=2)
    assert table.columns[3:] == ["a", "coluna_2", "a (2)"]
    assert sorted(tuple(r)[2:] for r in table.collect()) == [(3, "1", None, None), (4, "2", "3", "4")]
    assert report.where("warning is not null").count() == 2
    assert read_delimited(spark, str(tmp_path / "h.csv"), encoding="no-such")[1].first()["problem"].startswith("LookupError")


def test_delimited_in_blocks(spark, tmp_path):
    """Blocks of a few bytes, records and stray quotes across them, against the csv reader on the whole text."""
    rnd = random.Random(4)
    texts = []
    for k in range(6):
        cells = ['x', '"q;1"', '"two\nlines"', 'in"side', '"a ""b"" c"', '"open\n\n;end"tail', '', ' blank ', "é" * 40, "z"]
        body = "\n".join(";".join(rnd.choice(cells) for _ in range(rnd.randint(1, 4))) for _ in range(60)) + (";" + "y" * 200_000 if k == 5 else "")
        texts.append("a;b;a;a (2)\n" + body + rnd.choice(["", "\n", '\n"never closed;1\n2']))
    texts += [";;\n1;2;3", "", "only;header"]
    for i, x in enumerate(texts):
        texts[i] = x.replace("\n", ("\n", "\r\n", "\r")[i % 3])
        (tmp_path / f"{i}.csv").write_bytes(texts[i].encode("cp1252" if i == 2 else "utf-8"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        table, report = read_delimited(spark, str(tmp_path), delimiter=";")
        found = sorted((int(r["_src_file"].rpartition("/")[2][:-4]), r["_row"], *(r[c] for c in ("a", "b", "a (2)", "coluna_1", "coluna_3"))) for r in table.collect())
        problems = {int(r["file"].rpartition("/")[2][:-4]): (r["encoding"], r["problem"]) for r in report.where("encoding is not null").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = []
    for i, x in enumerate(texts):
        reader = csv.reader(io.StringIO(x, newline=""), delimiter=";")
        next(reader, None)
        for cells in reader:
            c = [v.strip() or None for v in cells] + [None] * 4
            if i == 6:
                expected.append((i, reader.line_num, None, None, None, c[0], c[2]))
            elif any(c[k] for k in ((0, 1, 3) if i < 6 else (0,))):
                expected.append((i, reader.line_num, c[0], c[1], c[3], None, None))
    assert found == sorted(expected, key=lambda r: (r[0], r[1]))
    assert problems == {**{i: ("utf-8-sig", None) for i in (0, 1, 3, 4, 5, 6, 8)}, 2: ("cp1252", None), 7: ("utf-8-sig", "ValueError: no header in row 1")}
    (tmp_path / "late.csv").write_bytes(b"a;b\n" + b"1;2\n" * 5000 + b"\xff;1\n")
    assert read_delimited(spark, str(tmp_path / "late.csv"), encoding="utf-8")[1].first()["problem"].startswith("UnicodeDecodeError")


def test_migration(spark, rows, tmp_path):
    run = run_migration(rows[0], CUSTOMERS_CSV, date(2025, 1, 1), out_folder=str(tmp_path / "out"))
    assert tuple(run.totals.first()) == (4, 3, 1, 1, 1, 0)
    codes = [r["code"] for r in run.annotated.where("_row = 6").select(F.explode("issues.code").alias("code")).collect()]
    assert codes == ["too_short", "invalid_document", "invalid_email", "invalid_phone", "invalid_postal_code", "invalid_state", "invalid_date"]
    found = {(r["ord"], r["matched"], r["kind"], r["key"]) for r in run.duplicates.collect()}
    assert found == {(5, 2, "exact", "document"), (7, 2, "possible", "phone")}
    assert "52998224725" not in run.report.first()["report"]
    folder = tmp_path / "out" / f"run_id={run.run_id}"
    assert sorted(os.listdir(folder)) == ["accepted", "audit", "audit_lines", "duplicates", "rejected", "run_warnings"]
    lines = [(r["part"], json.loads(r["value"])) for r in spark.read.text(str(folder / "audit_lines")).collect()]
    assert sorted((e["ord"], e["matched"], e["kind"]) for part, e in lines if part == "duplicates") == [(5, 2, "exact"), (7, 2, "possible")]
    assert [e["run_id"] for part, e in lines if part == "run"] == [run.run_id] and "52998224725" not in str(lines)


def test_load_is_marked_last(spark, rows, tmp_path):
    run = run_migration(rows[0], CUSTOMERS_CSV, date(2025, 1, 1), dry_run=False, load_folder=str(tmp_path / "lake"))
    assert spark.read.parquet(str(tmp_path / "lake" / "customers")).count() == 3
    assert spark.read.parquet(str(tmp_path / "lake" / "migration_runs")).first()["loaded_records"] == 3
    with pytest.raises(ValueError, match="dry run"):
        outputs.load_lake(run.annotated, run.run_id, lambda: run.record, "customers", str(tmp_path), datetime(2025, 1, 1))


def test_transforms_stay_above_the_joins(spark):
    """Counting transforms puts no copies of them into filters or join conditions."""
    fields = spark.createDataFrame([(1, " A\x00 ", "B")], "k long, `Código` string, `UF` string")
    source = fields.join(spark.createDataFrame([(1, "N/A")], "k long, `Nome Cliente` string"), "k")
    counts = transform_counts(apply_mapping(source, CUSTOMERS_CSV))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if ("Filter" in line or "Join" in line) and "regexp_replace" in line]
    assert {r["transform"]: r["records"] for r in counts.collect()} == {"clean_text": 1, "title_case": 1}


def test_mapping_and_reconciliation(spark):
    df = spark.createDataFrame([(1, " a "), (2, "b")], "_row long, x string")
    template = Template("customers", (FieldRule("full_name", "x", ("strip", "uppercase")), FieldRule("city", "none", default="?")))
    out = apply_mapping(df, template).orderBy("_row").collect()
    assert [(r["full_name"], r["city"], r["_applied"]) for r in out] == [("A", "?", ["strip", "uppercase"]), ("B", "?", ["strip", "uppercase"])]
    headers = spark.createDataFrame([("f", "y")], "file string, column_name string")
    assert {tuple(r) for r in reconcile_columns(headers, template).collect()} == {("f", "missing", "x", True), ("f", "missing", "none", False), ("f", "unmapped", "y", False)}
    with pytest.raises(ValueError, match="unknown"):
        Template("customers", (FieldRule("full_name", "x", ("no_such",)),))


def test_possible_needs_a_shared_key(spark):
    rows = spark.createDataFrame([(1, "Maria Silva", "1", "9"), (2, "Maria Silvo", "2", "9"), (3, "Maria Silva", "3", None), (4, "Zé", "2", "9")], "_row long, full_name string, phone string, postal_code string")
    empty = spark.createDataFrame([], "ord long, matched long, key string, value string")
    assert [tuple(r) for r in dedup.find_possible(rows, empty).collect()] == [(2, 1, "postal_code", "9", 0.909)]


def test_text_sources(spark):
    pages = spark.createDataFrame([("f", 1, "A: 1\nB : \nA: 2"), ("f", 2, ""), ("f", 3, "----------\nC: x")], "_src_file string, page int, text string")
    blocks = page_blocks(pages, "separator", "^-{10,}$")
    found = labelled_records(blocks, ["A", "B", "C"]).orderBy("_row").collect()
    assert [(r["A"], r["B"], r["C"]) for r in found] == [("1", None, None), (None, None, "x")]
    better = spark.createDataFrame([("f", 2, "a@b.com"), ("f", 1, " ")], "_src_file string, page int, text string")
    report = recover_pages(pages, better)[1].first()
    assert (report["recovered"], report["failed"], report["ocr_used"]) == ([2], [1, 3], True)


def test_stream(spark, rows, tmp_path):
    rows[0].write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows[0].schema).parquet(str(tmp_path / "in"))
    write_stream(validate_stream(stream, CUSTOMERS_CSV, date(2025, 1, 1)), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4


def test_partitions_do_not_matter(spark, rows):
    one = validate(apply_mapping(rows[0], CUSTOMERS_CSV), "customers", date(2025, 1, 1))
    a, b = (sorted(map(tuple, dedup.find_exact(x.where("is_valid")).collect())) for x in (one, one.repartition(7)))
    assert a == b


def test_searched_queries(spark):
    """Both searches by brute force, on customers where k and k + 900 share a phone."""
    d, run = "/root/testdata/sf0.01", registry.queries()
    rows = registry._validated(spark, d, "customers").orderBy("_row").collect()
    valid = [r for r in rows if r["is_valid"]]

    def key(r, c):
        return (r[c] or "").strip().lower() or None

    def name(r):
        return "".join(c for c in unicodedata.normalize("NFKD", key(r, "full_name") or "") if not unicodedata.combining(c))

    seen, exact, possible = {}, [], []
    for i, r in enumerate(valid):
        keys = [(k, v) for k in dedup.EXACT_KEYS if k in valid[0] and (v := key(r, k))]
        hit = next((k for k in keys if k in seen), None)
        if hit:
            exact.append((r["_row"], seen[hit], "exata", *hit))
        else:
            for p in valid[:i]:
                k = next((k for k in ("phone", "postal_code") if key(r, k) and key(r, k) == key(p, k)), None)
                if k and name(r) and name(p) and difflib.SequenceMatcher(None, name(r), name(p)).ratio() >= dedup.THRESHOLD:
                    possible.append((r["_row"], p["_row"], outputs.KINDS["possible"], k, key(r, k)))
                    break
        for k in keys:
            seen.setdefault(k, r["_row"])
    assert possible
    codes = Counter(i["code"] for r in rows for i in r["issues"]) + Counter(duplicate_exact=len(exact), duplicate_possible=len(possible))
    assert sorted(tuple(r)[:5] for r in run["duplicates_table"](spark, d).collect()) == sorted(exact + possible)
    assert {r["code"]: r["issues"] for r in run["issues_by_code_customers"](spark, d).collect()} == codes
    totals = {"total_records": len(rows), "valid_records": len(valid), "duplicate_records": len(exact), "possible_duplicates": len(possible)}
    assert {r["metric"]: r["value"] for r in run["flagship"](spark, d).collect()} == totals | {f"issue:{c}": n for c, n in codes.items()}
    found = run["run_totals"](spark, d).first().asDict()
    assert {k: found[k] for k in totals} == totals
    print("searched", totals)
    assert run["masked_duplicates"](spark, d).count() == len(exact + possible)
    assert Counter(r["code"] for r in run["dedup_annotated"](spark, d).collect()) == codes


def test_rows_are_dealt_to_all_cores(spark):
    """Rows with long work are not left to the few tasks that a join's bytes would fill."""
    rows = registry._mapped(spark, "/root/testdata/sf0.001", "invoices")
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_reconciliation_reads_the_headers_once(spark):
    """Files that lack nothing, all, or have a column of two fields; without a join."""
    template = Template("customers", (FieldRule("full_name", "x"), FieldRule("city", "x"), FieldRule("state", "y")), ignored=("z",))
    headers = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "q"), ("b", "p"), ("b", "q"), ("c", "y"), ("d", None)], "file string, column_name string")
    found = reconcile_columns(headers, template)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    gone = [("missing", "x", True), ("missing", "x", False), ("missing", "y", False)]
    assert sorted(map(tuple, found.collect())) == sorted([("b", *g) for g in gone] + [("b", "unmapped", "p, q", False)] + [("c", *g) for g in gone[:2]] + [("d", *g) for g in gone])


def test_rules_are_columns_and_reports_write_what_they_read(spark, monkeypatch):
    """No rule stands below a lambda, where it would not be compiled; the working table of the reports has no typed entity."""
    plan = registry._validated(spark, "/root/testdata/sf0.001", "customers")._jdf.queryExecution().optimizedPlan().toString()
    assert "_issue_0" in plan
    tables, known = {}, registry.written
    monkeypatch.setattr(registry, "written", lambda df, name, *more: (tables.update({name: df.columns}), known(df, name, *more))[1])
    registry._annotated(spark, "/root/testdata/sf0.001")
    assert set(tables["validated"]) == {"_row", "document", "external_id", "email", "full_name", "phone", "postal_code", "issues", "is_valid"}
