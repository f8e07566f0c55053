"""Values found in free text: distinct, in order of first appearance."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import is_valid_cnpj, is_valid_cpf
from .text import SPACE, let, strip

#: The patterns.
CPF = r"(?<!\d)\d{3}\.?\d{3}\.?\d{3}-?\d{2}(?!\d)"
CNPJ = r"(?<!\d)\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}(?!\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)(?:\+?55[\s-]?)?\(?\d{2}\)?[\s-]?9?\d{4}[\s-]?\d{4}(?!\d)"
POSTAL_CODE = r"(?<!\d)\d{5}-?\d{3}(?!\d)"
DATE = r"(?<!\d)(?:\d{2}[/.-]\d{2}[/.-]\d{4}|\d{4}-\d{2}-\d{2})(?!\d)"
MONEY = r"R\$\s?\d{1,3}(?:\.\d{3})*(?:,\d{2})?|(?<![\d,.])\d{1,3}(?:\.\d{3})+,\d{2}(?![\d])"
MIN_CHARACTERS, MIN_RATIO = 40, 0.5


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def _distinct(values: Column) -> Column:
    return F.array_distinct(values)


def find_cpfs(text: Column) -> Column:
    """X1"""
    return _distinct(F.filter(F.transform(_found(text, CPF), lambda x: F.regexp_replace(x, r"(?U)\D", "")), lambda d: is_valid_cpf(d)))


def find_cnpjs(text: Column) -> Column:
    """X2"""
    return _distinct(F.filter(F.transform(_found(text, CNPJ), lambda x: F.regexp_replace(x, r"(?U)\D", "")), lambda d: is_valid_cnpj(d)))


def find_documents(text: Column) -> Column:
    """CNPJs first, then CPFs"""
    return F.array_union(find_cnpjs(text), find_cpfs(text))


def find_emails(text: Column) -> Column:
    """X4"""
    return _distinct(F.transform(_found(text, EMAIL), lambda x: F.lower(x)))


def find_phones(text: Column) -> Column:
    """X5"""
    return _distinct(F.transform(_found(text, PHONE), lambda x: strip(x)))


def find_postal_codes(text: Column) -> Column:
    """X6"""
    return _distinct(_found(text, POSTAL_CODE))


def find_dates(text: Column) -> Column:
    """X7"""
    return _distinct(_found(text, DATE))


def find_money_values(text: Column) -> Column:
    """X8"""
    return _distinct(F.transform(_found(text, MONEY), lambda x: strip(x)))


def find_labeled_value(text: Column, label: str) -> Column:
    """The value behind ``label:`` or ``label|`` on the first line that has one."""
    found = F.regexp_extract(text, rf"(?imduU)^\s*{re.escape(label)}\s*[:|]\s*(.+?)\s*$", 1)
    return F.nullif(found, F.lit(""))


def alphanumeric_ratio(text: Column) -> Column:
    """Letters and digits among the characters that are no white space; 0 where there is none."""
    solid = F.length(F.regexp_replace(text, f"(?U){SPACE}+", ""))
    return let(solid, lambda n: F.when(n > 0, F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")) / n).otherwise(F.lit(0.0)))


def _has_patterns(text: Column) -> Column:
    """Whether any of the searches above finds something: the cheap ones first, up to the first that does."""
    found = [text.rlike(f"(?U){p}") for p in (DATE, POSTAL_CODE, PHONE)]
    return (text.contains("@") & text.rlike(f"(?U){EMAIL}")) | found[0] | found[1] | found[2] | (F.size(find_documents(text)) > 0)


def assess_text(text: Column) -> Column:
    """X11: struct(char_count, ratio, has_patterns, is_sufficient, reason) of the stripped text, which is stripped and measured once."""

    def judged(m: Column) -> Column:
        n, ratio, hits = m["n"], m["ratio"], m["hits"]
        enough = hits | ((n >= MIN_CHARACTERS) & (ratio >= MIN_RATIO))
        reason = F.when(hits, "expected patterns found").when(n < MIN_CHARACTERS, "text too short").when(ratio < MIN_RATIO, "low share of letters and digits").otherwise("text sufficient")
        return F.struct(n.alias("char_count"), ratio.alias("ratio"), hits.alias("has_patterns"), enough.alias("is_sufficient"), reason.alias("reason"))

    def measured(bare: Column) -> Column:
        return F.struct(F.length(bare).alias("n"), alphanumeric_ratio(bare).alias("ratio"), _has_patterns(bare).alias("hits"))

    return let(let(let(strip(text), lambda bare: F.coalesce(bare, F.lit(""))), measured), judged)
