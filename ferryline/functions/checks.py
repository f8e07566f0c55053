"""Predicates on single fields, tax ids and their masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits, let, strip

#: State codes.
STATES = ("AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO")
#: Invoice states by their labels.
STATUS_LABELS = {
    "open": ("open", "aberto", "em aberto", "pendente"),
    "paid": ("paid", "pago", "quitado"),
    "overdue": ("overdue", "vencido", "atrasado"),
    "canceled": ("canceled", "cancelled", "cancelado"),
}
#: Weights of the check digits.
CPF_WEIGHTS = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))
CNPJ_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))


#: Fixed value: the shape of an e-mail address.
_EMAIL = r"(?U)^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"


def _digit(number: Column, size: int, i: int) -> Column:
    """The i-th of ``size`` digits of a whole number."""
    return F.call_function("div", number, F.lit(10 ** (size - 1 - i))) % 10


def _weighted(number: Column, size: int, weights: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, (_digit(number, size, i) * w for i, w in enumerate(weights)))


def _number(c: Column, size: int, bare: bool = False) -> Column:
    """The digits of ``c`` as a whole number where there are ``size`` of them, not all equal; else null. Masks do not matter; a ``bare`` text has none."""
    return let(c if bare else digits(c), lambda d: let(F.when(F.length(d) == size, d.try_cast("long")), lambda n: F.when(n % ((10**size - 1) // 9) != 0, n)))


def is_valid_cpf(c: Column, bare: bool = False) -> Column:
    """The check digits of the 11 digits in ``c``, masked or not."""

    def right(n: Column) -> Column:
        first, second = (_weighted(n, 11, w) * 10 % 11 % 10 == _digit(n, 11, len(w)) for w in CPF_WEIGHTS)
        return first & second

    return F.coalesce(let(_number(c, 11, bare), right), F.lit(False))


def is_valid_cnpj(c: Column, bare: bool = False) -> Column:
    """The check digits of the 14 digits in ``c``, masked or not."""

    def right(n: Column) -> Column:
        # 11 - rest, and 0 where that is 10 or 11
        first, second = ((11 - _weighted(n, 14, w) % 11) % 11 % 10 == _digit(n, 14, len(w)) for w in CNPJ_WEIGHTS)
        return first & second

    return F.coalesce(let(_number(c, 14, bare), right), F.lit(False))


def document_type(c: Column, bare: bool = False) -> Column:
    """Cpf or cnpj for a valid tax id, masked or not; else null. A ``bare`` text is known to hold digits alone."""
    return F.when(is_valid_cpf(c, bare), "cpf").when(is_valid_cnpj(c, bare), "cnpj")


def document_problem(c: Column) -> Column:
    """Why a tax id is refused; null for valid ones and for null."""
    n = F.length(digits(c))
    return F.when(c.isNull() | document_type(c).isNotNull(), F.lit(None)).when(n == 11, "the CPF check digits do not match").when(n == 14, "the CNPJ check digits do not match").otherwise("a CPF has 11 digits and a CNPJ 14")


def mask_document(c: Column) -> Column:
    """P4"""
    return let(digits(c), _masked)


def _masked(d: Column) -> Column:
    n = F.length(d)
    cpf = F.concat(F.substring(d, 1, 3), F.lit(".***.***-"), F.substring(d, 10, 2))
    cnpj = F.concat(F.substring(d, 1, 2), F.lit(".***.***/****-"), F.substring(d, 13, 2))
    return F.when(n == 11, cpf).when(n == 14, cnpj).when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(d, 1, 2), F.repeat(F.lit("*"), n - 2)))


def is_valid_email(c: Column) -> Column:
    """P5"""
    return F.coalesce(strip(c).rlike(_EMAIL), F.lit(False))


def is_valid_phone(c: Column) -> Column:
    """10 to 13 digits"""
    return F.coalesce(F.length(digits(c)).between(10, 13), F.lit(False))


def is_valid_postal_code(c: Column) -> Column:
    """8 digits"""
    return F.coalesce(F.length(digits(c)) == 8, F.lit(False))


def is_valid_uf(c: Column) -> Column:
    """P8"""
    return F.coalesce(F.upper(strip(c)).isin(*STATES), F.lit(False))


def invoice_status(c: Column) -> Column:
    """Open, paid, overdue or canceled; null for unknown labels."""
    table = F.create_map(*(F.lit(x) for status, labels in STATUS_LABELS.items() for label in labels for x in (label, status)))
    return F.try_element_at(table, F.lower(strip(c)))
