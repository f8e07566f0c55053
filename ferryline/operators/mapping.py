"""Projection of source columns to canonical fields, and its checks against the files' headers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import AFTER_CLEAN, AFTER_CONTROL, TRANSFORMS, apply_transforms, is_clean, remove_control_characters

#: Canonical fields of each entity and whether they are required.
SCHEMAS: dict[str, dict[str, bool]] = {
    "customers": {"external_id": False, "full_name": True, "document": True, "email": False, "phone": False, "postal_code": False, "city": False, "state": False, "created_at": False},
    "contacts": {"external_id": False, "customer_document": True, "name": True, "role": False, "email": False, "phone": False},
    "invoices": {"external_id": True, "customer_document": True, "description": False, "issued_at": True, "due_at": True, "amount": True, "status": True},
}
PROVENANCE = ("_src_file", "_sheet", "_row")


@dataclass(frozen=True)
class FieldRule:
    """One canonical field: its source column, transforms in order, and what a null becomes."""

    target: str
    source: str
    transforms: tuple[str, ...] = ()
    default: str | None = None
    required: bool = False


@dataclass(frozen=True)
class Template:
    """Rules of one entity; ``ignored`` columns are known and not reported as unmapped."""

    entity: str
    fields: tuple[FieldRule, ...]
    ignored: tuple[str, ...] = ()
    source_format: str | None = None

    def __post_init__(self) -> None:
        known = SCHEMAS[self.entity]
        targets = [f.target for f in self.fields]
        unknown = [t for t in targets if t not in known] + [n for f in self.fields for n in f.transforms if n not in TRANSFORMS]
        if unknown or len(set(targets)) < len(targets):
            raise ValueError(f"unknown fields or transforms {unknown}, or a field mapped twice: {targets}")

    def is_blocking(self, field: FieldRule) -> bool:
        return field.required or SCHEMAS[self.entity][field.target]


def apply_mapping(df: DataFrame, template: Template) -> DataFrame:
    """M1, M4: canonical columns, provenance columns that ``df`` has, and ``_applied``.

    A source column that ``df`` lacks gives nulls (see ``reconcile_columns`` for what that means).
    ``_applied`` names every transform of the fields whose value changed, a default included.
    """
    raw = {f.target: (df[f"`{f.source}`"] if f.source in df.columns else F.lit(None)).cast("string") for f in template.fields}
    kept = [df[c] for c in PROVENANCE if c in df.columns]
    # Values first, as columns of their own: each is read again by _applied and by validation.
    values = df.select(*kept, *(raw[f.target].alias(f"raw_{f.target}") for f in template.fields))
    cleaned = [f for f in template.fields if f.transforms and f.transforms[0] in AFTER_CONTROL]
    # Most texts are clean as they come, which one search tells; only the others go through the steps of cleaning.
    values = values.select("*", *(is_clean(F.col(f"raw_{f.target}")).alias(f"clean_{f.target}") for f in cleaned))
    values = values.select("*", *(F.when(~F.coalesce(F.col(f"clean_{f.target}"), F.lit(False)), remove_control_characters(F.col(f"raw_{f.target}"))).alias(f"seen_{f.target}") for f in cleaned))

    def value(f: FieldRule) -> Column:
        if f in cleaned:
            first, rest = f.transforms[0], f.transforms[1:]
            made = F.when(F.col(f"clean_{f.target}"), AFTER_CLEAN[first](F.col(f"raw_{f.target}"))).otherwise(AFTER_CONTROL[first](F.col(f"seen_{f.target}")))
            return apply_transforms(made, rest)
        return apply_transforms(F.col(f"raw_{f.target}"), f.transforms)

    values = values.select("*", *(_filled(value(f), f.default).alias(f.target) for f in template.fields))
    changed = [F.when(~F.col(f.target).eqNullSafe(F.col(f"raw_{f.target}")), F.array(*map(F.lit, f.transforms))) for f in template.fields if f.transforms]
    applied = F.array_distinct(F.flatten(F.filter(F.array(*changed), lambda x: x.isNotNull()))) if changed else F.array().cast("array<string>")
    # A partition number (always true here) is not deterministic for the optimizer: without it, exploding _applied puts a filter on its size, with
    # copies of all transforms, below the source's joins.
    applied = F.when(F.spark_partition_id() >= 0, applied)
    missing = [F.lit(None).cast("string").alias(name) for name in SCHEMAS[template.entity] if name not in raw]
    return values.select(*(c for c in PROVENANCE if c in df.columns), *(f.target for f in template.fields), *missing, applied.alias("_applied"))


def _filled(value: Column, default: str | None) -> Column:
    return value if default is None else F.coalesce(value, F.lit(default))


def reconcile_columns(headers: DataFrame, template: Template, formats: DataFrame | None = None) -> DataFrame:
    """M2, M3, M6: what the headers of many files lack or have too much: (file, problem, columns, blocking).

    ``headers(file, column_name)``; ``formats(file, format)`` where formats are to be checked. Problems:
    ``missing`` (blocking where the field is required), ``unmapped`` (a warning, columns in ascending
    order) and ``format`` (blocking).
    """
    sources = {f.source: sum(1 << i for i, g in enumerate(template.fields) if g.source == f.source) for f in template.fields}
    known = [*sources, *template.ignored]
    name = F.col("column_name")
    # One pass: a bit for each field whose column a file has, and the names of its other columns.
    seen = F.coalesce(F.bit_or(F.coalesce(*(F.when(name == source, F.lit(bits)) for source, bits in sources.items()))), F.lit(0))
    files = headers.groupBy("file").agg(seen.alias("seen"), F.collect_set(F.when(~name.isin(known), name)).alias("extra"))

    def problem(kind: str, columns: Column, blocking: bool) -> Column:
        return F.struct(F.lit(kind).alias("problem"), columns.alias("columns"), F.lit(blocking).alias("blocking"))

    missing = [F.when(F.col("seen").bitwiseAND(F.lit(1 << i)) == 0, problem("missing", F.lit(f.source), template.is_blocking(f))) for i, f in enumerate(template.fields)]
    extra = F.when(F.size("extra") > 0, problem("unmapped", F.array_join(F.array_sort("extra"), ", "), False))
    out = files.select("file", F.explode(F.filter(F.array(*missing, extra), lambda x: x.isNotNull())).alias("p")).select("file", "p.problem", "p.columns", "p.blocking")
    if formats is not None and template.source_format:
        wrong = formats.where(F.col("format") != template.source_format).select("file", F.lit("format").alias("problem"), F.col("format").alias("columns"), F.lit(True).alias("blocking"))
        out = out.unionByName(wrong)
    return out


def transform_counts(mapped: DataFrame) -> DataFrame:
    """A3: records changed per transform."""
    return mapped.select(F.explode("_applied").alias("transform")).groupBy("transform").agg(F.count("*").alias("records"))


CUSTOMERS_CSV = Template(
    "customers",
    (
        FieldRule("external_id", "Código", ("clean_text",)),
        FieldRule("full_name", "Nome Cliente", ("clean_text", "title_case")),
        FieldRule("document", "CPF_CNPJ", ("digits_only",)),
        FieldRule("email", "Correio Eletrônico", ("email",)),
        FieldRule("phone", "Fone Principal", ("brazilian_phone",)),
        FieldRule("postal_code", "CEP", ("postal_code",)),
        FieldRule("city", "Cidade", ("clean_text", "title_case")),
        FieldRule("state", "UF", ("uf",)),
        FieldRule("created_at", "Data Cadastro", ("clean_text", "brazilian_date")),
    ),
    ignored=("Observação Interna Antiga",),
    source_format="csv",
)
CONTACTS = Template(
    "contacts",
    (
        FieldRule("external_id", "Código Cliente", ("clean_text",)),
        FieldRule("customer_document", "CPF_CNPJ Cliente", ("digits_only",)),
        FieldRule("name", "Nome Contato", ("clean_text", "title_case")),
        FieldRule("role", "Cargo", ("clean_text", "title_case")),
        FieldRule("email", "Correio Eletrônico", ("email",)),
        FieldRule("phone", "Fone", ("brazilian_phone",)),
    ),
)
INVOICES = Template(
    "invoices",
    (
        FieldRule("external_id", "Documento", ("clean_text",)),
        FieldRule("customer_document", "CPF_CNPJ Cliente", ("digits_only",)),
        FieldRule("description", "Historico", ("clean_text",)),
        FieldRule("issued_at", "Data Emissao", ("clean_text", "brazilian_date")),
        FieldRule("due_at", "Data Vencimento", ("clean_text", "brazilian_date")),
        FieldRule("amount", "Valor", ("clean_text", "brazilian_money")),
        FieldRule("status", "Situacao", ("clean_text", "lowercase")),
    ),
    source_format="csv",
)
