"""Text transforms as column expressions; null in, null out, for every one of them.

White space means what it means to the sources' rules (Unicode white space and U+001C to U+001F), which is
wider than Spark's ``trim``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x1c-\x1f]"
_SPACES = f"(?U){SPACE}+"
#: Fixed value: characters that are removed.
_INVISIBLE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\u200B-\u200F\u202A-\u202E\uFEFF]"

#: Texts that stand for "no value".
NULL_MARKERS = (
    "-", "--", "---", ".", "..", "n/a", "n.a.", "na", "nd", "n/d", "null", "nulo", "none", "nenhum",
    "nao informado", "não informado", "nao informada", "não informada", "sem informacao", "sem informação",
    "vazio", "#n/d", "#n/a", "#valor!", "?",
)
#: Company forms stay upper-case, particles lower-case except at the start.
COMPANY_FORMS = ("s/a", "s.a.", "s.a", "sa", "ltda", "ltda.", "me", "epp", "eireli", "mei", "s/s", "cia", "cia.")
PARTICLES = ("da", "de", "do", "das", "dos", "e", "di", "du", "van", "von", "del", "la")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f reads it. For short formulas: f is not compiled into the stage's code."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def or_null(c: Column) -> Column:
    """Null for an empty text; ``c`` is computed once."""
    return F.nullif(c, F.lit(""))


def digits(c: Column) -> Column:
    """The decimal digits alone; may give an empty text."""
    return F.regexp_replace(c, r"(?U)\D", "")


def strip(c: Column) -> Column:
    """T1"""
    return or_null(F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", ""))


def remove_control_characters(c: Column) -> Column:
    """T2"""
    return or_null(F.regexp_replace(c, _INVISIBLE, ""))


def collapse_whitespace(c: Column) -> Column:
    """T3"""
    return or_null(F.trim(F.regexp_replace(c, _SPACES, " ")))


def _each(values: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """``f`` of every text; a batch without texts, as most are, goes back as it came."""
    if values.null_count == len(values):
        return values
    return pa.array([None if x is None else f(x) for x in values.to_pylist()], values.type)


@F.arrow_udf(T.StringType())
def _nfc(values: pa.Array) -> pa.Array:
    return _each(values, lambda x: unicodedata.normalize("NFC", x))


@F.arrow_udf(T.StringType())
def _bare(values: pa.Array) -> pa.Array:
    return _each(values, lambda x: "".join(ch for ch in unicodedata.normalize("NFD", x) if not unicodedata.combining(ch)))


#: No character below U+0300 changes by NFC, whatever stands beside it.
_COMPOSED = r"^[\x00-\u02FF]*$"
#: A text that ``clean_text`` leaves as it is: words of visible characters below U+0300, one blank between two, and no marker. Possessive, so that
#: a long text neither backtracks nor recurses; flags are for the markers alone, as they would let other characters into the classes.
_CLEAN = rf"^(?!(?iU:{'|'.join(re.escape(m) for m in NULL_MARKERS)})\z)[!-~\u00A1-\u02FF]++(?: [!-~\u00A1-\u02FF]++)*+\z"
#: Letters below U+0250 that decompose, and what is left of them without their marks.
_ACCENTED = {chr(i): unicodedata.normalize("NFD", chr(i))[0] for i in range(0x250) if len(unicodedata.normalize("NFD", chr(i))) > 1}
_LATIN = r"^[\x00-\u024F]*$"


def normalize_unicode(c: Column) -> Column:
    """T4: NFC. Texts that can't change stay in the JVM; only others reach the Arrow UDF, which Spark lacks a function for."""
    settled = c.rlike(_COMPOSED)
    return F.when(settled, c).otherwise(_nfc(F.when(~settled, c)))


def remove_accents(c: Column) -> Column:
    """T5: decompose and drop combining marks; may give an empty text. Latin texts stay in the JVM; only others reach the Arrow UDF."""
    latin = c.rlike(_LATIN)
    return F.when(latin, F.translate(c, "".join(_ACCENTED), "".join(_ACCENTED.values()))).otherwise(_bare(F.when(~latin, c)))


def lowercase(c: Column) -> Column:
    """T6"""
    return F.lower(c)


def uppercase(c: Column) -> Column:
    """T7"""
    return F.upper(c)


def title_case(c: Column) -> Column:
    """Capitalised words, company forms upper-case, particles lower-case; blank gives null."""

    def word(w: Column, i: Column) -> Column:
        capital = F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
        return F.when(w.isin(*COMPANY_FORMS), F.upper(w)).when((i > 0) & w.isin(*PARTICLES), w).otherwise(capital)

    return F.array_join(F.transform(F.split(F.lower(collapse_whitespace(c)), " "), word), " ")


def nullify_markers(c: Column) -> Column:
    """Null for texts that stand for nothing; others unchanged."""
    marker = "|".join(re.escape(m) for m in NULL_MARKERS)
    return or_null(F.regexp_replace(c, f"(?iU)^{SPACE}*(?:{marker})?{SPACE}*$", ""))


def clean_visible(c: Column) -> Column:
    """T10 for a text without control characters."""
    return nullify_markers(collapse_whitespace(normalize_unicode(c)))


def is_clean(c: Column) -> Column:
    """Whether one look tells that ``clean_text`` changes nothing; null for null."""
    return c.rlike(_CLEAN)


def clean_text(c: Column) -> Column:
    """Control characters, NFC, white space, markers, in this order."""
    return clean_visible(remove_control_characters(c))


def digits_only(c: Column) -> Column:
    """Cleaning first would change nothing, for no digit is removed by it and no marker holds one."""
    return or_null(digits(c))


def brazilian_phone(c: Column) -> Column:
    """Digits without the country code 55 where 10 or 11 remain."""
    return F.regexp_replace(digits_only(c), r"(?U)^55(\d{10,11})$", "$1")


def postal_code(c: Column) -> Column:
    """Digits, a lost leading zero restored."""
    return F.regexp_replace(digits_only(c), r"(?U)^(\d{7})$", "0$1")


def email(c: Column) -> Column:
    """T14"""
    return F.lower(clean_text(c))


def uf(c: Column) -> Column:
    """T15"""
    return F.upper(clean_text(c))


def format_postal_code(c: Column) -> Column:
    """00000-000 for 8 digits, else the digits as they are."""
    return F.regexp_replace(digits_only(c), r"(?U)^(\d{5})(\d{3})$", "$1-$2")


#: The closed catalogue of a mapping. The last two only mark a type; conversion belongs to validation.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "strip": strip,
    "remove_control_characters": remove_control_characters,
    "collapse_whitespace": collapse_whitespace,
    "normalize_unicode": normalize_unicode,
    "remove_accents": remove_accents,
    "lowercase": lowercase,
    "uppercase": uppercase,
    "title_case": title_case,
    "nullify_markers": nullify_markers,
    "clean_text": clean_text,
    "digits_only": digits_only,
    "brazilian_phone": brazilian_phone,
    "postal_code": postal_code,
    "email": email,
    "uf": uf,
    "brazilian_date": lambda c: c,
    "brazilian_money": lambda c: c,
}

#: Transforms that begin by removing control characters, and what they do to the result of that. It is read several times there, so a
#: mapping keeps it as a column of its own.
AFTER_CONTROL: dict[str, Callable[[Column], Column]] = {
    "clean_text": clean_visible,
    "email": lambda c: F.lower(clean_visible(c)),
    "uf": lambda c: F.upper(clean_visible(c)),
}
#: What the same transforms do to a text that is clean already.
AFTER_CLEAN: dict[str, Callable[[Column], Column]] = {"clean_text": lambda c: c, "email": F.lower, "uf": F.upper}


def apply_transforms(c: Column, names: Iterable[str]) -> Column:
    """M5: the named transforms from left to right; an unknown name is an error."""
    return reduce(lambda acc, name: TRANSFORMS[name](acc), names, c)
