"""Validation: every row gets all its issues at once; data never raises.

An issue is struct(code, severity, field, message, original_value, normalized_value); the array keeps the
order of the rules. An error rejects the row, a warning does not.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.dates import parse_datetime
from ..functions.money import noted, plain
from ..functions.text import digits

ISSUE = "struct<code:string,severity:string,field:string,message:string,original_value:string,normalized_value:string>"
MASKED_FIELDS = ("document", "customer_document")

#: Messages by code; {field} is the field's name.
MESSAGES = {
    "required_field": "{field} is required and was not given",
    "too_short": "{field} is too short",
    "invalid_document": "{field} is not a valid CPF or CNPJ",
    "invalid_email": "{field} is not an e-mail address",
    "invalid_phone": "{field} needs 10 to 13 digits",
    "invalid_postal_code": "{field} needs 8 digits; it is left out",
    "invalid_state": "{field} is no state code",
    "invalid_date": "{field} is not a date",
    "future_date": "{field} lies in the future",
    "invalid_amount": "{field} is not an amount",
    "negative_amount": "{field} is negative",
    "unknown_status": "{field} has an unknown label",
    "missing_contact_channel": "neither e-mail nor phone can be used",
    "due_before_issue": "{field} lies before the issue date",
}


def issue(code: str, field: str, original: Column | None = None, normalized: Column | None = None, severity: str = "error") -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        F.lit(field).alias("field"),
        F.lit(MESSAGES[code].format(field=field)).alias("message"),
        (null if original is None else original.cast("string")).alias("original_value"),
        (null if normalized is None else normalized.cast("string")).alias("normalized_value"),
    )


def required_text(field: str, min_length: int = 1) -> Column:
    """V1"""
    c = F.col(field)
    return F.when(c.isNull(), issue("required_field", field)).when(F.length(c) < min_length, issue("too_short", field, c))


def document(field: str) -> Column:
    """V2: ``_{field}_type`` holds the kind of a valid tax id; masks do not matter."""
    c = F.col(field)
    return F.when(c.isNull(), issue("required_field", field)).when(F.col(f"_{field}_type").isNull(), issue("invalid_document", field, c))


def optional_email(field: str = "email") -> Column:
    """V3"""
    return F.when(F.col(field).isNotNull() & ~checks.is_valid_email(F.col(field)), issue("invalid_email", field, F.col(field)))


def optional_phone(field: str = "phone") -> Column:
    """V4"""
    return F.when(F.col(field).isNotNull() & ~checks.is_valid_phone(F.col(field)), issue("invalid_phone", field, F.col(field)))


def optional_postal_code(field: str = "postal_code") -> Column:
    """V5: only a warning"""
    return F.when(F.col(field).isNotNull() & ~checks.is_valid_postal_code(F.col(field)), issue("invalid_postal_code", field, F.col(field), severity="warning"))


def optional_state(field: str = "state") -> Column:
    """V6"""
    return F.when(F.col(field).isNotNull() & ~checks.is_valid_uf(F.col(field)), issue("invalid_state", field, F.col(field)))


def date_field(field: str, required: bool, not_after: date | None = None) -> Column:
    """V7: ``_{field}`` holds the parsed value."""
    c, parsed = F.col(field), F.col(f"_{field}")
    out = F.when(c.isNull(), issue("required_field", field) if required else F.lit(None)).when(parsed.isNull(), issue("invalid_date", field, c))
    if not_after is not None:
        out = out.when(parsed.cast("date") > F.lit(not_after), issue("future_date", field, c, F.date_format(parsed.cast("date"), "yyyy-MM-dd")))
    return out


def amount(field: str = "amount") -> Column:
    """V8: ``_amount`` holds the parsed value; zero is fine."""
    c, parsed = F.col(field), F.col("_amount")
    return F.when(c.isNull(), issue("required_field", field)).when(parsed.isNull(), issue("invalid_amount", field, c)).when(parsed < 0, issue("negative_amount", field, c, F.col("_amount_text")))


def status(field: str = "status") -> Column:
    """V9: ``_status`` holds the state of a known label."""
    c = F.col(field)
    return F.when(c.isNull(), issue("required_field", field)).when(F.col("_status").isNull(), issue("unknown_status", field, c))


def contact_channel() -> Column:
    """No e-mail and no phone left after their own checks."""
    mail, phone = checks.is_valid_email(F.col("email")), checks.is_valid_phone(F.col("phone"))
    return F.when(~mail & ~phone, issue("missing_contact_channel", "email"))


def due_before_issue() -> Column:
    """Compared with the time of day."""
    return F.when(F.col("_due_at") < F.col("_issued_at"), issue("due_before_issue", "due_at", F.col("due_at")))


def _tax_id(field: str) -> list[dict[str, Column]]:
    """Helper columns of a tax id, in steps: its digits, then its kind."""
    return [{f"_{field}": digits(F.col(field))}, {f"_{field}_type": checks.document_type(F.col(f"_{field}"), bare=True)}]


def _plan(entity: str, reference: date) -> tuple[list[dict[str, Column]], list[Column], Column]:
    """Helper columns in steps (each reads those before it as plain columns), rules in order, and the typed entity.

    The entity carries a tax id's digits, whatever mask it came with.
    """
    if entity == "customers":
        first, second = _tax_id("document")
        helpers = [first | {"_created_at": parse_datetime(F.col("created_at"))}, second]
        rules = [required_text("full_name", 2), document("document"), optional_email(), optional_phone(), optional_postal_code(), optional_state(), date_field("created_at", False, reference)]
        code = F.col("postal_code")
        typed = F.struct(
            *(F.col(c) for c in ("external_id", "full_name")),
            F.col("_document").alias("document"),
            F.col("_document_type").alias("document_type"),
            *(F.col(c) for c in ("email", "phone")),
            F.when(checks.is_valid_postal_code(code), code).alias("postal_code"),
            *(F.col(c) for c in ("city", "state")),
            F.col("_created_at").alias("created_at"),
        )
    elif entity == "contacts":
        helpers = _tax_id("customer_document")
        rules = [document("customer_document"), required_text("name", 2), optional_email(), optional_phone(), contact_channel()]
        typed = F.struct("external_id", F.col("_customer_document").alias("customer_document"), "name", "role", "email", "phone")
    elif entity == "invoices":
        first, second = _tax_id("customer_document")
        first |= {"_issued_at": parse_datetime(F.col("issued_at")), "_due_at": parse_datetime(F.col("due_at")), "_amount_noted": noted(F.col("amount")), "_status": checks.invoice_status(F.col("status"))}
        helpers = [first, second | {"_amount_text": plain(F.col("_amount_noted"))}, {"_amount": F.col("_amount_text").try_cast("decimal(38,10)")}]
        rules = [required_text("external_id"), document("customer_document"), date_field("issued_at", True), date_field("due_at", True), amount(), status(), due_before_issue()]
        typed = F.struct(
            "external_id",
            F.col("_customer_document").alias("customer_document"),
            "description",
            F.col("_issued_at").cast("date").alias("issued_at"),
            F.col("_due_at").cast("date").alias("due_at"),
            F.col("_amount").alias("amount"),
            F.col("_amount_text").alias("amount_text"),
            F.col("_status").alias("status"),
        )
    else:
        raise ValueError(f"no such entity: {entity}")
    return helpers, rules, typed


def validate(mapped: DataFrame, entity: str, reference: date) -> DataFrame:
    """``mapped`` with issues, is_valid and entity (null unless valid).

    ``reference`` is the day after which a date lies in the future. One narrow stage.
    """
    helpers, rules, typed = _plan(entity, reference)
    rows = mapped
    for step in helpers:
        rows = rows.select("*", *(v.alias(k) for k, v in step.items()))
    # A partition number (always true here) is not deterministic for the optimizer, so it computes the rules once instead of copying
    # them into every filter on is_valid or on the issues above. A rule is a column of its own: below a lambda it would not be compiled.
    once, names = F.spark_partition_id() >= 0, [f"_issue_{i}" for i in range(len(rules))]
    rows = rows.select("*", *(F.when(once, r.cast(ISSUE)).alias(n) for n, r in zip(names, rules, strict=True)))
    accepted = reduce(lambda a, b: a & b, (F.coalesce(F.col(n)["severity"] != "error", F.lit(True)) for n in names))
    rows = rows.select("*", F.filter(F.when(once, F.array(*names)), lambda i: i.isNotNull()).alias("issues"), accepted.alias("is_valid")).drop(*names)
    return rows.withColumn("entity", F.when(F.col("is_valid"), typed)).drop(*(k for step in helpers for k in step))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected)"""
    return validated.where("is_valid"), validated.where("not is_valid")


def issues_for_display(issues: Column) -> Column:
    """P10: tax ids masked in original and normalised values."""

    def masked(i: Column) -> Column:
        hidden = i["field"].isin(*MASKED_FIELDS)
        return reduce(lambda acc, c: acc.withField(c, F.when(hidden, checks.mask_document(i[c])).otherwise(i[c])), ("original_value", "normalized_value"), i)

    return F.transform(issues, masked)


def masked_preview(rows: DataFrame) -> DataFrame:
    """``rows`` with the tax id columns masked, and values of tax id keys in duplicate tables."""
    new = {c: checks.mask_document(F.col(c)) for c in MASKED_FIELDS if c in rows.columns}
    for key, value in (("chave", "valor"), ("campo", "valor"), ("key", "value")):
        if key in rows.columns and value in rows.columns:
            new[value] = F.when(F.col(key).isin(*MASKED_FIELDS), checks.mask_document(F.col(value))).otherwise(F.col(value))
    return rows.withColumns(new)
