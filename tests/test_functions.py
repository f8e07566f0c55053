import random
import re
import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ferryline.functions import checks, dates, money, patterns, text
from ferryline.plans import legacy


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (text.strip, {" a b\t": "a b", "  ": None, None: None}),
        (text.remove_control_characters, {"a\x00b​": "ab", "\x7f": None}),
        (text.collapse_whitespace, {" a \n\t b ": "a b", "": None}),
        (text.remove_accents, {"Ação": "Acao", "é": "e"}),
        (text.title_case, {"MARIA DA SILVA": "Maria da Silva", "almeida s/a": "Almeida S/A", "da": "Da", " ": None}),
        (text.nullify_markers, {"N/A": None, " não informado ": None, " x ": " x ", "?": None}),
        (text.digits_only, {"1.2-3": "123", "n/a": None}),
        (text.brazilian_phone, {"+55 (11) 91234-5678": "11912345678", "5512": "5512"}),
        (text.postal_code, {"1234-567": "01234567", "12345-678": "12345678"}),
        (text.format_postal_code, {"12345678": "12345-678", "12": "12", "1234567": "1234567"}),
        (money.decimal_text, {"R$ 1.234,56": "1234.56", "1.234": "1234", "1,234.56": "1234.56", "(5,0)": "-5.0", "7-": "-7", "1,2,3": None, "x": None, "(0,00)": "0.00", "~5": None, "5)": None, "-5-": None, "(-5)": "-5", "007,50": "7.50", "0000150": "150", "5.": "5", ",5": "0.5", "-,5": "-0.5", ",": None, "R$ ١.٢٣٤,٥٠": "1234.50", "１２": "12", "²": None}),
        (checks.document_type, {"529.982.247-25": "cpf", "11.222.333/0001-81": "cnpj", "52998224725": "cpf", "11222333000181": "cnpj", "11111111111": None, "1": None}),
        (checks.mask_document, {"52998224725": "529.***.***-25", "11222333000181": "11.***.***/****-81", "12": "**", "12345": "12***"}),
        (checks.is_valid_email, {"a@b.c": True, "a@b": False, None: False}),
        (checks.invoice_status, {" Pago ": "paid", "cancelled": "canceled", "x": None}),
    ],
)
def test_table(spark, f, cases):
    assert one(spark, f, *cases) == list(cases.values())


def test_dates(spark):
    cases = {
        "1/2/2024": datetime(2024, 2, 1), "31/02/2024": None, "01/01/69": datetime(1969, 1, 1), "01-01-68": datetime(2068, 1, 1), "2024-02-01T10:11:12": datetime(2024, 2, 1, 10, 11, 12),
        "01022024": datetime(2024, 2, 1), "2024/2/1": datetime(2024, 2, 1), "01.02.2024 10:00": None, "2024-02-01 1:2": datetime(2024, 2, 1, 1, 2), "24-1-1x": None,
        "01/02/2024  10:00": datetime(2024, 2, 1, 10), "01/02/2024\t\u00a010:00:07": datetime(2024, 2, 1, 10, 0, 7), "2024-02-01 \n 1:2": datetime(2024, 2, 1, 1, 2), "01/02/2024 10 :00": None,
    }
    assert one(spark, dates.parse_datetime, *cases) == list(cases.values())
    assert one(spark, lambda c: dates.is_future(dates.parse_date(c), date(2024, 1, 1)), "02/01/2024", "01/01/2024") == [True, False]


def test_patterns(spark):
    page = "CPF: 529.982.247-25 e 52998224725\nTel (11) 91234-5678, CEP 12345-678\nA@B.com a@b.com 01/02/2024 R$ 1.234,50"
    found = [one(spark, f, page)[0] for f in (patterns.find_cpfs, patterns.find_emails, patterns.find_dates, patterns.find_money_values)]
    assert found == [["52998224725"], ["a@b.com"], ["01/02/2024"], ["R$ 1.234,50"]]
    assert one(spark, lambda c: patterns.find_labeled_value(c, "CPF"), page, "x") == ["529.982.247-25 e 52998224725", None]
    assert one(spark, lambda c: patterns.assess_text(c)["is_sufficient"], page, "..", None) == [True, False, False]


def distinct(values):
    return list(dict.fromkeys(values))


def digits_valid(digits, weights):
    """Both check digits of a tax id, by the published rule."""
    if len(set(digits)) == 1:
        return False
    for k, w in enumerate(weights):
        total = sum(int(d) * x for d, x in zip(digits, w, strict=False)) % 11
        if int(digits[len(w)]) != (0 if total < 2 else 11 - total):
            return False
    return True


def found_in(page):
    """Every kind of value by the patterns with Python's engine."""
    cpf_weights = [range(10, 1, -1), range(11, 1, -1)]
    cnpj_weights = [[5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]]

    def ids(pattern, weights):
        return distinct(d for d in (re.sub(r"\D", "", x) for x in re.findall(pattern, page)) if digits_valid(d, weights))

    return {
        "documents": distinct(ids(patterns.CNPJ, cnpj_weights) + ids(patterns.CPF, cpf_weights)),
        "phones": distinct(x.strip() for x in re.findall(patterns.PHONE, page)),
        "money": distinct(x.strip() for x in re.findall(patterns.MONEY, page)),
        "emails": distinct(x.lower() for x in re.findall(patterns.EMAIL, page)),
        "dates": distinct(re.findall(patterns.DATE, page)),
        "codes": distinct(re.findall(patterns.POSTAL_CODE, page)),
    }


@pytest.mark.parametrize("source", ["documents", "forms"])
def test_patterns_of_all_rows_by_brute_force(spark, source):
    """X3, X5, X8 and X11 over every row of the given documents and of the forms made from the customers."""
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text") if source == "documents" else legacy.forms(spark, d).select(F.col("_row").alias("id"), "text")
    kinds = {"documents": patterns.find_documents, "phones": patterns.find_phones, "money": patterns.find_money_values}
    seen = dict.fromkeys(kinds, 0)
    for r in rows.select("text", *(f(F.col("text")).alias(k) for k, f in kinds.items()), patterns.assess_text(F.col("text")).alias("q")).collect():
        page = r["text"] or ""
        expected = found_in(page)
        for k in kinds:
            assert (r[k] or []) == expected[k], (k, page)
            seen[k] += bool(expected[k])
        bare = page.strip()
        solid = [c for c in bare if not c.isspace()]
        ratio = sum(c.isalnum() for c in solid) / len(solid) if solid else 0.0
        hits = any(v for k, v in found_in(bare).items() if k != "money")
        assert (r["q"]["char_count"], r["q"]["has_patterns"], r["q"]["is_sufficient"]) == (len(bare), hits, hits or (len(bare) >= 40 and ratio >= 0.5)), page
        assert abs(r["q"]["ratio"] - ratio) < 1e-9
    assert seen["phones"] > 0 and (source == "documents" or min(seen.values()) > 0)


def test_normal_forms_of_any_text(spark):
    """T4 and T5 on every letter below U+0250, decomposed, Hangul, marks alone and mixed texts, against unicodedata."""
    rnd = random.Random(9)
    letters = [chr(i) for i in range(1, 0x250)]
    values = [*letters, *(unicodedata.normalize("NFD", x) for x in letters), "e\u0301", "\u0301", "\u1112\u1161\u11ab", "한글", "ﬁ", "Å", "q\u0307\u0323", "plain", "", None]
    values += ["".join(rnd.choice([*letters, "\u0301", "\u0327", "한", "ᄒ", "ᅡ", "a"]) for _ in range(6)) for _ in range(500)]
    assert one(spark, text.normalize_unicode, *values) == [v and unicodedata.normalize("NFC", v) if v is not None else None for v in values]
    bare = [v if v is None else "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c)) for v in values]
    assert one(spark, text.remove_accents, *values) == bare


def test_long_formulas_stay_out_of_the_generated_code(spark):
    """The JVM compiles no method of over 8,000 bytes, and a step that is read several times is computed once."""
    rows = spark.range(1).select(F.col("id").cast("string").alias("v"))
    execution = rows.select(money.noted(F.col("v")), dates.parse_datetime(F.col("v")))._jdf.queryExecution()
    parts = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(execution.executedPlan())
    assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000
    assert execution.optimizedPlan().toString().count("regexp_replace") < 30


def test_text_is_measured_once(spark):
    """The quality of a text strips it once, and what is found agrees with the searches."""
    texts = ["", None, " \n ", "x" * 50, "a@b.co", "..-- " * 20, "tel (11) 91234-5678", "01310-100", "em 01/02/2024", "529.982.247-25", "529.982.247-26 @", "11222333000181", "٠١٢٣٤-٥٦٧"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, v string")
    judged = rows.select("i", "v", patterns.assess_text(F.col("v")).alias("q"))
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("]+$") == 1
    hits = F.greatest(*(F.size(f(F.coalesce("v", F.lit("")))) for f in (patterns.find_documents, patterns.find_emails, patterns.find_dates, patterns.find_postal_codes, patterns.find_phones))) > 0
    for r in judged.select("v", "q.*", hits.alias("expected")).collect():
        bare = (r["v"] or "").strip()
        solid = sum(not c.isspace() for c in bare)
        ratio = sum(c.isalnum() for c in bare) / solid if solid else 0.0
        assert (r["char_count"], r["ratio"], r["has_patterns"]) == (len(bare), ratio, r["expected"])
        assert r["is_sufficient"] == (r["expected"] or (len(bare) >= 40 and ratio >= 0.5))


def test_postal_codes_with_one_character_between_them(spark):
    """Both are found, as by the original's pattern; a search that takes the neighbours finds the first only."""
    assert one(spark, patterns.find_postal_codes, "cee14701200d07683836c96e0", "01310-100 01310-200", "013101000") == [["14701200", "07683836"], ["01310-100", "01310-200"], []]


def test_clean_texts_are_told_by_one_look(spark):
    """What is_clean accepts, clean_text leaves as it is: markers, blanks, line ends, characters that fold to ASCII or compose are refused."""
    rnd = random.Random(5)
    words = ["abc", "é", "N/A", "ſ", "\u212a", "\u00e9", "e\u0301", "-", "nao", "informado", "x\x7f", "#N/D", "\u00a0", "\u0345", "ª", "?"]
    gaps = ["", " ", " ", "  ", "\t", "\n", "\u2028", "\u0085"]
    mixed = ["".join(rnd.choice(gaps) + rnd.choice(words) for _ in range(rnd.randint(0, 4))) + rnd.choice(gaps) for _ in range(2000)]
    values = mixed + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) for _ in range(1000)] + ["Maria", "maria e silva", "nulo", "vazio.", "a " * 200_000 + "a", None]
    seen, cleaned = one(spark, text.is_clean, *values), one(spark, text.clean_text, *values)
    assert all(c == v for s, v, c in zip(seen, values, cleaned, strict=True) if s)
    assert seen[-6:] == [True, True, False, True, True, None] and sum(s is True for s in seen) > 100


def test_date_shapes_against_the_chain(spark):
    """Random texts become what the seven shapes make of them one after the other."""
    chain = (
        (r"^(\d{1,2})/(\d{1,2})/(\d{4})( \d{1,2}:\d{1,2}(?::\d{1,2})?)?$", "$3-$2-$1$4"),
        (r"^(\d{1,2})([-.])(\d{1,2})\2(\d{4})$", "$4-$3-$1"),
        (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
        (r"^(\d{1,2})([/-])(\d{1,2})\2([0-5]\d|6[0-8])$", "20$4-$3-$1"),
        (r"^(\d{1,2})([/-])(\d{1,2})\2(69|[7-9]\d)$", "19$4-$3-$1"),
        (r"^(\d{2})(\d{2})(\d{4})$", "$3-$2-$1"),
        (r"^(\d{4}-\d{1,2}-\d{1,2})T(\d{1,2}:\d{1,2}:\d{1,2})$", "$1 $2"),
    )

    def by_chain(c):
        t = F.regexp_replace(text.strip(c), r"(?U)(?<=\d)[\s\x1c-\x1f]+(?=\d{1,2}:)", " ")
        for shape in chain:
            t = F.regexp_replace(t, *shape)
        return F.regexp_extract(t, dates._CANONICAL, 0).try_cast("timestamp_ntz")

    rnd = random.Random(6)
    parts = ["1", "02", "28", "31", "68", "69", "99", "2020", "1999", "0000", "20201231"]

    def made():
        sep = rnd.choice(["/", "-", ".", ""])
        day = sep.join(rnd.choice(parts) for _ in range(3)) if rnd.random() < 0.9 else rnd.choice(parts)
        return rnd.choice(["", " "]) + day + rnd.choice(["", "", "T", " ", "  ", "\n"]) + rnd.choice(["", "", "1:2", "10:11:12", "10:11:12.5"]) + rnd.choice(["", "\t"])

    values = [made() for _ in range(5000)] + [None, ""]
    found = one(spark, dates.parse_datetime, *values)
    assert found == one(spark, by_chain, *values) and sum(x is not None for x in found) > 40
    # Fewer searches than shapes for a text.
    plan = spark.createDataFrame([("x",)], "v string").select(dates.parse_datetime(F.col("v")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 9
