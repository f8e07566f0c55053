"""Amounts in Brazilian, American and accounting notation."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let, strip

#: Fixed value: the notation that goes first, with the point between thousands and the decimal comma.
_BRAZILIAN = r"^-?\d{1,3}(\.\d{3})*(,\d+)?$|^-?\d+(,\d+)?$"


#: Decimal digits of all scripts but ASCII's, and the digits they stand for.
_OTHER_DIGITS = "".join(chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd")
_THEIR_VALUES = "".join(str(unicodedata.decimal(x)) for x in _OTHER_DIGITS)


def _ascii_digits(c: Column) -> Column:
    """Digits of any script as ASCII ones; most texts have no others and are left alone."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, _OTHER_DIGITS, _THEIR_VALUES)).otherwise(c)


def noted(c: Column) -> Column:
    """N1, first step: the bare notation, without currency signs and blanks; "-" behind it where the amount is negative by
    parentheses or a trailing minus, whatever sign it has. Each step is computed once and read by the next."""
    return let(strip(c), lambda stripped: let(_ascii_digits(stripped), _bare_notation))


def _bare_notation(text: Column) -> Column:
    bracketed = text.rlike(r"(?s)^\(.*\)$")
    inside = F.when(bracketed, F.regexp_replace(text, r"(?s)^\((.*)\)$", "$1")).otherwise(text)

    def marked(bare: Column) -> Column:
        accounting = F.when(bracketed, F.concat(F.regexp_replace(bare, "^-", ""), F.lit("-"))).otherwise(bare)
        return F.when(bare.rlike("^[0-9.,]+-$"), bare).when(bare.rlike("^-?[0-9.,]+$"), accounting)

    return let(F.regexp_replace(inside, rf"(?iU)r\$|brl|{SPACE}", ""), marked)


def plain(text: Column) -> Column:
    """N1, second step: plain digits with their own scale, null where ``text`` (a result of ``noted``) is no number.

    The "~" below stands before the digits for a moment only: ``noted`` lets none through.
    """
    return let(F.regexp_replace(text, "(?<=.)-$", ""), lambda bare: let(_plain_digits(bare), lambda number: _signed(text.endswith("-"), number)))


def _plain_digits(bare: Column) -> Column:
    """A decimal number, written with one zero before the point, none before other digits and no point at the end; empty where it is none."""
    number = (
        F.when(bare.rlike(_BRAZILIAN), F.translate(bare, ",.", "."))
        .when(bare.rlike(r",.*\.[^.,]*$"), F.replace(bare, F.lit(","), F.lit("")))
        .when(bare.rlike(r"\..*\."), F.replace(bare, F.lit("."), F.lit("")))
        .when(~bare.rlike(",.*,"), F.replace(bare, F.lit(","), F.lit(".")))
    )
    number = F.regexp_extract(number, r"^-?(\d+\.?\d*|\.\d+)$", 0)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(number, r"^(-?)0+(?=\d)", "$1"), r"^(-?)(?=\.)", "$10"), r"\.$", "")


def _signed(negative: Column, number: Column) -> Column:
    """By parentheses or a trailing minus an amount is negative whatever its sign, and zero has none then."""
    marked = F.regexp_replace(F.regexp_replace(F.concat(F.lit("~"), number), "^~-?(?=.*[1-9])", "-"), "^~-?", "")
    return let(F.when(negative, marked).otherwise(number), lambda x: F.when(x != "", x))


def decimal_text(c: Column) -> Column:
    """The amount as plain digits with its own scale ("-1234.50"), null where it is no number.

    "1.234" is one thousand two hundred thirty-four: Brazilian notation goes first.
    """
    return let(noted(c), plain)


def parse_decimal(c: Column) -> Column:
    """N1 as decimal(38,10); amounts with over 28 integer digits count as no number."""
    return decimal_text(c).try_cast("decimal(38,10)")
