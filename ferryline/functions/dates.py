"""Dates as they occur in legacy exports, day first."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let, strip

#: Shapes with a year of four digits, of which a text has one at most, and the year, month, day and time in them; eight digits are day, month, year.
_FULL = r"^(?:(\d{1,2})/(\d{1,2})/(\d{4})( \d{1,2}:\d{1,2}(?::\d{1,2})?)?|(\d{1,2})([-.])(\d{1,2})\6(\d{4})|(\d{4})/(\d{1,2})/(\d{1,2})|(\d{2})(\d{2})(\d{4}))$"
_FULL_AS = "$3$8$9$14-$2$7$10$13-$1$5$11$12$4"
#: Two-digit years, in texts of at most eight characters: 00 to 68 are 20xx, 69 to 99 are 19xx (D3).
_SHORT = (
    (r"^(\d{1,2})([/-])(\d{1,2})\2([0-5]\d|6[0-8])$", "20$4-$3-$1"),
    (r"^(\d{1,2})([/-])(\d{1,2})\2(69|[7-9]\d)$", "19$4-$3-$1"),
)
_WITH_T = (r"^(\d{4}-\d{1,2}-\d{1,2})T(\d{1,2}:\d{1,2}:\d{1,2})$", "$1 $2")
_CANONICAL = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?$"


def parse_datetime(c: Column) -> Column:
    """timestamp_ntz; null for impossible dates and other shapes. Year 0 and seconds above 59 give null.

    Any white space may stand between the date and the time.
    """
    # In a let: the chain of patterns would make the stage's generated code too long for the JVM to compile it. A text that gives no match is empty, and no time.
    return let(strip(c), _moment)


def _moment(text: Column) -> Column:
    # Only texts that can have a shape are searched for it.
    spaced = F.when(F.contains(text, F.lit(":")), F.regexp_replace(text, rf"(?U)(?<=\d){SPACE}+(?=\d{{1,2}}:)", " ")).otherwise(text)
    return let(F.regexp_replace(spaced, _FULL, _FULL_AS), lambda t: F.regexp_extract(_rest(t), _CANONICAL, 0).try_cast("timestamp_ntz"))


def _rest(text: Column) -> Column:
    short = reduce(lambda acc, shape: F.regexp_replace(acc, *shape), _SHORT, text)
    return F.when(F.length(text) <= 8, short).when(F.contains(text, F.lit("T")), F.regexp_replace(text, *_WITH_T)).otherwise(text)


def parse_date(c: Column) -> Column:
    """D2"""
    return parse_datetime(c).cast("date")


def is_future(value: Column, reference: date) -> Column:
    """The date part lies after ``reference``, which is always given."""
    return value.cast("date") > F.lit(reference)
