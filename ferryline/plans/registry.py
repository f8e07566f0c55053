"""Registered queries: every operator over the given tables or tables that Spark derives from them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, dates, money, patterns, text
from ..operators import audit, dedup
from ..operators.mapping import CONTACTS, CUSTOMERS_CSV, INVOICES, SCHEMAS, FieldRule, Template, apply_mapping, reconcile_columns, transform_counts
from ..operators.validation import masked_preview, validate
from ..sinks import outputs
from ..sources import pages as page_ops
from ..sources.delimited import infer_read_options, normalize_headers, read_delimited
from ..sources.tables import coerce_to_text, fingerprint, inspect_pages, records_from_cells, route_sources
from . import legacy, oracles
from .migration import both_searches, run_migration
from .oracles import with_
from ..working import fresh_folder, written

Query = Callable[[SparkSession, str], DataFrame]
REFERENCE = date.fromisoformat(oracles.REFERENCE)
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_SOURCES = {"customers": (legacy.customers, CUSTOMERS_CSV), "contacts": (legacy.contacts, CONTACTS), "invoices": (legacy.invoices, INVOICES)}
_CUST = f"WITH legacy AS ({legacy.CUSTOMERS})"
_INV = f"WITH legacy AS ({legacy.INVOICES})"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _late(name: str) -> Callable[[], Column]:
    """A column made when a session exists: registering needs none."""
    return lambda: F.col(name)


def _columns(name: str, source: Query, cte: str, cols: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A query of one expression per output column, over a derived table with _row."""
    sql = f"{cte} SELECT _row, {', '.join(f'{q} AS {c}' for c, (_, q) in cols.items())} FROM legacy"
    query(name, sql)(lambda spark, d: source(spark, d).select("_row", *(e().alias(c) for c, (e, _) in cols.items())))


def _text_queries() -> None:
    name, doc, mail, fone, cep, uf = (_late(c) for c in ("Nome Cliente", "CPF_CNPJ", "Correio Eletrônico", "Fone Principal", "CEP", "UF"))
    n, d, m, f, p, u = ('"Nome Cliente"', '"CPF_CNPJ"', '"Correio Eletrônico"', '"Fone Principal"', '"CEP"', '"UF"')
    o = oracles
    c = (legacy.customers, _CUST)
    _columns("text_strip_collapse", *c, {"stripped": (lambda: text.strip(name()), o.strip(n)), "collapsed": (lambda: text.collapse_whitespace(name()), o.collapse(n))})
    _columns("text_control_chars", *c, {"cleaned": (lambda: text.remove_control_characters(name()), o.control(n))})
    _columns("text_null_markers", *c, {"name": (lambda: text.nullify_markers(name()), o.markers(n)), "phone": (lambda: text.nullify_markers(fone()), o.markers(f))})
    _columns("text_title_case", *c, {"titled": (lambda: text.title_case(name()), o.title(n))})
    _columns("text_case", *c, {"lower_name": (lambda: text.lowercase(name()), f"lower({n})"), "upper_name": (lambda: text.uppercase(name()), f"upper({n})")})
    _columns("text_clean", *c, {"cleaned": (lambda: text.clean_text(name()), o.clean(n)), "nfc": (lambda: text.normalize_unicode(name()), f"nfc_normalize({n})")})
    _columns("text_unaccent", *c, {"plain": (lambda: text.remove_accents(name()), f"strip_accents({n})")})
    _columns("digits_only", *c, {"digits": (lambda: text.digits_only(doc()), o.digits(d))})
    _columns("phone_normalize", *c, {"phone": (lambda: text.brazilian_phone(fone()), o.phone(f))})
    _columns("postal_code_normalize", *c, {"postal_code": (lambda: text.postal_code(cep()), o.postal(p))})
    _columns("postal_code_format", *c, {"postal_code": (lambda: text.format_postal_code(cep()), o.postal_shown(p))})
    _columns("email_normalize", *c, {"email": (lambda: text.email(mail()), f"lower({o.clean(m)})")})
    _columns("uf_normalize", *c, {"uf": (lambda: text.uf(uf()), f"upper({o.clean(u)})")})
    made = '"Data Cadastro"'
    _columns("parse_dates", *c, {"at": (lambda: F.date_format(dates.parse_datetime(F.col("Data Cadastro")), "yyyy-MM-dd HH:mm:ss"), f"strftime({o.moment(made)}, '%Y-%m-%d %H:%M:%S')"), "day": (lambda: F.date_format(dates.parse_date(F.col("Data Cadastro")), "yyyy-MM-dd"), f"strftime({o.moment(made)}, '%Y-%m-%d')")})
    _columns("future_dates", *c, {"is_future": (lambda: dates.is_future(dates.parse_datetime(F.col("Data Cadastro")), REFERENCE), f"{o.moment(made)}::DATE > DATE '{o.REFERENCE}'")})
    i = (legacy.invoices, _INV)
    _columns("parse_money", *i, {"amount_text": (lambda: money.decimal_text(F.col("Valor")), o.amount_text('"Valor"')), "amount": (lambda: money.parse_decimal(F.col("Valor")).cast("decimal(18,2)").cast("string"), f"{o.amount_text(chr(34) + 'Valor' + chr(34))}::DECIMAL(18,2)::VARCHAR")})
    _columns("parse_invoice_dates", *i, {"issued": (lambda: F.date_format(dates.parse_date(F.col("Data Emissao")), "yyyy-MM-dd"), "strftime(" + o.moment('"Data Emissao"') + ", '%Y-%m-%d')"), "due": (lambda: F.date_format(dates.parse_date(F.col("Data Vencimento")), "yyyy-MM-dd"), "strftime(" + o.moment('"Data Vencimento"') + ", '%Y-%m-%d')")})
    bare = f"regexp_replace({d}, '[^0-9]', '', 'g')"
    _columns("cpf_valid", *c, {"is_cpf": (lambda: checks.is_valid_cpf(doc()), o.cpf_valid(bare))})
    _columns("cnpj_valid", *c, {"is_cnpj": (lambda: checks.is_valid_cnpj(doc()), o.cnpj_valid(bare))})
    _columns("document_parse", *c, {"kind": (lambda: checks.document_type(doc()), o.doc_type(bare)), "refused": (lambda: checks.document_problem(doc()).isNotNull(), f"({o.doc_type(bare)}) IS NULL")})
    _columns("document_mask", *c, {"masked": (lambda: checks.mask_document(doc()), o.mask(d))})
    _columns("email_valid", *c, {"ok": (lambda: checks.is_valid_email(mail()), f"coalesce({o.email_ok(m)}, false)")})
    _columns("phone_valid", *c, {"ok": (lambda: checks.is_valid_phone(fone()), f"length(regexp_replace({f}, '[^0-9]', '', 'g')) BETWEEN 10 AND 13")})
    _columns("postal_code_valid", *c, {"ok": (lambda: checks.is_valid_postal_code(cep()), f"length(regexp_replace({p}, '[^0-9]', '', 'g')) = 8")})
    _columns("uf_valid", *c, {"ok": (lambda: checks.is_valid_uf(uf()), f"upper(trim({u})) IN {o._list(checks.STATES)}")})
    _columns("status_map", *i, {"status": (lambda: checks.invoice_status(F.col("Situacao")), o.status_of('"Situacao"'))})


_text_queries()


def _found(name: str, find: Callable[[Column], Column], sql: str | None, forms: bool = False) -> None:
    """Distinct finds per document (or form page), joined by ' ; '."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = legacy.forms(spark, d).select(F.col("_row").alias("id"), "text") if forms else spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
        return rows.select("id", F.array_join(find(F.col("text")), " ; ").alias("found"))

    query(name, sql)(run)


_FORMS_SQL = f"{_CUST}, forms AS ({legacy.FORMS})"


def _firsts(rows: str, pattern: str, value: str = "x", group: int = 0, keep: str = "true") -> str:
    """DuckDB: distinct matches in order of appearance, as 'a ; b'."""
    return f"""{rows} SELECT id, array_to_string(list_transform(list_filter(list_transform(m, lambda x: {value}), lambda x, i: list_position(list_transform(m, lambda x: {value}), x) = i AND {keep}), lambda x: x), ' ; ') AS found
FROM (SELECT id, regexp_extract_all(text, '{pattern}', {group}) AS m FROM src)"""


_DOCS, _PAGES = "WITH src AS (SELECT doc_id AS id, text FROM documents)", f"{_FORMS_SQL}, src AS (SELECT _row AS id, text FROM forms)"
_found("find_emails", patterns.find_emails, _firsts(_DOCS, patterns.EMAIL, "lower(x)"))
_found("find_phones", patterns.find_phones, None)
_found("find_postal_codes", patterns.find_postal_codes, _firsts(_DOCS, r"(?:^|[^0-9])([0-9]{5}-?[0-9]{3})(?:$|[^0-9])", group=1))
_found("find_dates", patterns.find_dates, _firsts(_PAGES, r"(?:^|[^0-9])([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?:$|[^0-9])", group=1), forms=True)
_found("find_money", patterns.find_money_values, None, forms=True)
_found("find_cpfs", patterns.find_cpfs, _firsts(_PAGES, r"(?:^|[^0-9])([0-9]{3}[.]?[0-9]{3}[.]?[0-9]{3}-?[0-9]{2})(?:$|[^0-9])", "regexp_replace(x, '[^0-9]', '', 'g')", 1, oracles.cpf_valid("x")), forms=True)
_found("find_cnpjs", patterns.find_cnpjs, _firsts(_PAGES, r"(?:^|[^0-9])([0-9]{2}[.]?[0-9]{3}[.]?[0-9]{3}/?[0-9]{4}-?[0-9]{2})(?:$|[^0-9])", "regexp_replace(x, '[^0-9]', '', 'g')", 1, oracles.cnpj_valid("x")), forms=True)
_found("find_documents", patterns.find_documents, None, forms=True)


@query("labeled_value", _FORMS_SQL + r" SELECT _row, nullif(regexp_extract(text, '(?im)^\s*CPF/CNPJ\s*[:|]\s*(.+?)\s*$', 1), '') AS document, nullif(regexp_extract(text, '(?im)^\s*Vazio\s*[:|]\s*(.+?)\s*$', 1), '') AS empty FROM forms")
def labeled_value(spark: SparkSession, d: str) -> DataFrame:
    return legacy.forms(spark, d).select("_row", patterns.find_labeled_value(F.col("text"), "CPF/CNPJ").alias("document"), patterns.find_labeled_value(F.col("text"), "Vazio").alias("empty"))


@query("text_quality")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", patterns.assess_text(F.col("text")).alias("q")).select("doc_id", "q.*")


@query("alphanumeric_ratio", r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS n_alnum, length(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]', '', 'g')) AS n_solid FROM documents")
def alphanumeric(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    solid = F.length(F.regexp_replace("text", f"(?U){text.SPACE}", ""))
    return docs.select("doc_id", F.round(patterns.alphanumeric_ratio(F.col("text")) * solid).cast("int").alias("n_alnum"), solid.alias("n_solid"))


def _mapped(spark: SparkSession, d: str, entity: str) -> DataFrame:
    source, template = _SOURCES[entity]
    return apply_mapping(source(spark, d), template)


def _validated(spark: SparkSession, d: str, entity: str) -> DataFrame:
    return validate(_mapped(spark, d, entity), entity, REFERENCE)


def _rows(spark: SparkSession, d: str, entity: str) -> DataFrame:
    """The validated rows, written once: what searches them and reports on them has a short plan."""
    return written(_validated(spark, d, entity), "validated")[0]


def _exact(spark: SparkSession, d: str, entity: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, d, entity)
    return rows, dedup.find_exact(rows.where("is_valid"))


def _per_entity() -> None:
    for entity, (_, template) in _SOURCES.items():
        cols = [f.target for f in template.fields]
        query(f"map_{entity}", with_(oracles.mapped(entity), f"SELECT _row, {', '.join(cols)} FROM mapped"))(lambda s, d, e=entity, c=cols: _mapped(s, d, e).select("_row", *c))
        query(f"transform_counts_{entity}", with_(f"{oracles.mapped(entity)}, {oracles.applied(template)}", "SELECT transform, count(*) AS records FROM applied GROUP BY 1"))(lambda s, d, e=entity: transform_counts(_mapped(s, d, e)))
        query(f"validate_{entity}", with_(oracles.validated(entity), "SELECT _row, pos, code, severity, field, message, original_value, normalized_value FROM issues"))(
            lambda s, d, e=entity: _validated(s, d, e).select("_row", F.posexplode("issues").alias("pos", "i")).select("_row", F.col("pos").cast("long").alias("pos"), "i.*")
        )
        query(f"rejected_{entity}", with_(oracles.validated(entity), f"SELECT _row AS linha, NULL::VARCHAR AS aba, field AS campo, code AS codigo, severity AS severidade, message AS mensagem, {', '.join('c.' + c for c in SCHEMAS[entity])} FROM issues JOIN checked c USING (_row) WHERE severity = 'error'"))(
            lambda s, d, e=entity: outputs.rejected_rows(_validated(s, d, e), e)
        )
        shown = {"created_at": "strftime(m_created_at, '%Y-%m-%d %H:%M:%S')", "issued_at": "strftime(m_issued_at, '%Y-%m-%d')", "due_at": "strftime(m_due_at, '%Y-%m-%d')", "amount": "m_amount", "status": oracles.status_of("status"), "postal_code": "CASE WHEN length(regexp_replace(postal_code, '[^0-9]', '', 'g')) = 8 THEN postal_code END"}
        query(f"accepted_{entity}", with_(oracles.validated(entity), f"SELECT {', '.join(f'{shown.get(c, c)} AS {c}' for c in SCHEMAS[entity])} FROM valid"))(lambda s, d, e=entity: outputs.accepted_rows(_validated(s, d, e), e))
        query(f"issues_by_code_{entity}")(lambda s, d, e=entity: audit.issues_by_code(_annotated(s, d, e)[0]))
        query(f"issues_by_code_{entity}_validation", with_(oracles.validated(entity), "SELECT code, count(*) AS issues FROM issues GROUP BY 1"))(lambda s, d, e=entity: audit.issues_by_code(_validated(s, d, e)))
        query(f"dedup_exact_{entity}", with_(f"{oracles.validated(entity)}, {oracles.exact(entity)}", "SELECT ord, matched, key, value FROM exact"))(lambda s, d, e=entity: _exact(s, d, e)[1])


_per_entity()
_CHECKED = f"{oracles.validated('customers')}, {oracles.exact('customers')}"


def _exact_only(spark: SparkSession, d: str, entity: str = "customers") -> tuple[DataFrame, DataFrame]:
    """Rows annotated with exact duplicates, and these: what SQL can state. The names of such queries end in ``exact``."""
    rows, exact = _exact(spark, d, entity)
    found = dedup.duplicates(exact, exact.selectExpr("*", "cast(null as double) AS similarity").where("false"))
    return dedup.annotate_duplicates(rows, found), found


#: Columns of validated rows that the searches and the reports on annotated rows read; Spark leaves out what no other column needs.
_READ = ("_row", *dedup.EXACT_KEYS, "full_name", "name", "phone", "postal_code", "issues", "is_valid")


def _annotated(spark: SparkSession, d: str, entity: str = "customers") -> tuple[DataFrame, DataFrame]:
    """Annotated rows and duplicates of both searches, as in run_migration. SQL can't express the name ratio, so these queries have none."""
    rows = _validated(spark, d, entity)
    rows, _ = written(rows.select(*(c for c in _READ if c in rows.columns)), "validated")
    found, _, _ = both_searches(rows)
    return dedup.annotate_duplicates(rows, found), found


_ALL = "all_issues AS (SELECT _row, pos, code, severity, field, message, original_value, normalized_value FROM issues UNION ALL SELECT ord, coalesce((SELECT count(*) FROM issues i WHERE i._row = ord), 0), 'duplicate_exact', 'warning', key, 'same ' || key || ' as row ' || matched, value, NULL FROM exact)"
_HIDDEN = "CASE WHEN field IN ('document', 'customer_document') THEN {} ELSE {} END"


def _both(name: str, sql: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """``name`` over all duplicates, and ``name_exact`` over the exact ones alone, with its SQL."""
    query(name)(lambda spark, d: f(*_annotated(spark, d)))
    query(f"{name}_exact", sql)(lambda spark, d: f(*_exact_only(spark, d)))


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select("_row", F.posexplode("issues").alias("pos", "i")).select("_row", F.col("pos").cast("long").alias("pos"), "i.code", "i.severity", "i.field", "i.message")


def _record(rows: DataFrame, found: DataFrame) -> DataFrame:
    record = audit.run_record(audit.run_totals(rows, found), "run", "customers", "customer", "", datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 0, 1, 500_000))
    return record.select("run_id", "entity", "status", "total_records", "duplicate_records", "duration_ms")


_both("dedup_annotated", with_(f"{_CHECKED}, {_ALL}", "SELECT _row, pos, code, severity, field, message FROM all_issues"), lambda rows, found: _listed(rows))
_both("duplicates_table", with_(_CHECKED, "SELECT ord AS linha, matched AS linha_correspondente, 'exata' AS tipo, key AS chave, value AS valor, NULL::VARCHAR AS similaridade FROM exact"), lambda rows, found: outputs.duplicate_rows(found))
_both("masked_duplicates", with_(_CHECKED, f"SELECT ord AS linha, key AS chave, CASE WHEN key = 'document' THEN {oracles.mask('value')} ELSE value END AS valor FROM exact"), lambda rows, found: masked_preview(outputs.duplicate_rows(found)).select("linha", "chave", "valor"))
_both("run_totals", with_(_CHECKED, "SELECT (SELECT count(*) FROM checked) AS total_records, (SELECT count(*) FROM valid) AS valid_records, (SELECT count(*) FROM checked) - (SELECT count(*) FROM valid) AS rejected_records, (SELECT count(*) FROM exact) AS duplicate_records, 0 AS possible_duplicates, 0 AS loaded_records"), audit.run_totals)
_both("migration_run", with_(_CHECKED, "SELECT 'run' AS run_id, 'customers' AS entity, 'dry_run' AS status, (SELECT count(*) FROM checked) AS total_records, (SELECT count(*) FROM exact) AS duplicate_records, 1500 AS duration_ms"), _record)


@query("dedup_possible")
def dedup_possible(spark: SparkSession, d: str) -> DataFrame:
    rows, exact = _exact(spark, d, "customers")
    return dedup.find_possible(rows.where("is_valid"), exact)


@query("issue_details_top500", with_(f"{_CHECKED}, {_ALL}", f"SELECT _row AS row, pos, code, field, message, {_HIDDEN.format(oracles.mask('original_value'), 'original_value')} AS original_value, {_HIDDEN.format(oracles.mask('normalized_value'), 'normalized_value')} AS normalized_value FROM all_issues WHERE severity = 'error' ORDER BY _row, pos LIMIT 500"))
def issue_details_top500(spark: SparkSession, d: str) -> DataFrame:
    """Errors alone: duplicates are warnings, so these are the same with either search."""
    return audit.issue_details(_annotated(spark, d)[0], "error").withColumn("pos", F.col("pos").cast("long"))


@query("target_rows_invoices", with_(oracles.validated("invoices"), f"SELECT external_id, customer_document, issued_at_d AS issued_at, due_at_d AS due_at, amount_d AS amount, s AS status FROM (SELECT external_id, customer_document, strftime(m_issued_at, '%Y-%m-%d') AS issued_at_d, strftime(m_due_at, '%Y-%m-%d') AS due_at_d, m_amount::DECIMAL(18,2)::VARCHAR AS amount_d, {oracles.status_of('status')} AS s FROM valid)"))
def target_rows_invoices(spark: SparkSession, d: str) -> DataFrame:
    rows = outputs.target_rows(_validated(spark, d, "invoices"), "invoices", "run", datetime(2026, 1, 1))
    return rows.select("external_id", "customer_document", *(F.col(c).cast("string").alias(c) for c in ("issued_at", "due_at", "amount", "status")))


@query("mapping_defaults", _CUST + " SELECT _row, CASE WHEN \"CEP\" <> '' THEN \"Fone Principal\" ELSE 'unknown' END AS phone, NULL::VARCHAR AS city FROM legacy")
def mapping_defaults(spark: SparkSession, d: str) -> DataFrame:
    template = Template("customers", (FieldRule("phone", "Fone Principal", ("strip",), default="unknown"), FieldRule("city", "no such column")))
    source = legacy.customers(spark, d).withColumn("Fone Principal", F.when(F.col("CEP") != "", F.col("Fone Principal")).otherwise(F.lit(" ")))
    return apply_mapping(source, template).select("_row", "phone", "city")


#: One file per customer, its header made from the customer's values.
_HEADER_SQL = "headers AS (SELECT 'f' || c_custkey AS file, unnest(['Código', 'Nome Cliente', CASE WHEN c_custkey % 2 = 0 THEN 'CPF_CNPJ' ELSE c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'CEP' END, ' Código ']) AS name, generate_subscripts([1, 2, 3, 4, 5], 1) AS idx FROM customer)"
_NAMED_SQL = "named AS (SELECT file, idx, CASE WHEN trim(name) = '' THEN 'coluna_' || idx ELSE trim(name) END AS base FROM headers), final AS (SELECT file, idx, base || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS column_name FROM (SELECT *, row_number() OVER (PARTITION BY file, base ORDER BY idx) AS k FROM named))"


def _headers(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    names = F.array(F.lit("Código"), F.lit("Nome Cliente"), F.when(key % 2 == 0, "CPF_CNPJ").otherwise(F.col("c_mktsegment")), F.when(key % 3 == 0, "").otherwise("CEP"), F.lit(" Código "))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("f"), key).alias("file"), F.posexplode(names).alias("at", "name"))
    return rows.select("file", (F.col("at") + 1).alias("idx"), "name")


@query("headers_normalized", f"WITH {_HEADER_SQL}, {_NAMED_SQL} SELECT file, idx::INT AS idx, column_name FROM final")
def headers_normalized(spark: SparkSession, d: str) -> DataFrame:
    return normalize_headers(_headers(spark, d)).select("file", "idx", "column_name")


_RULES_SQL = "rules(source, blocking) AS (VALUES " + ", ".join(f"('{f.source}', {str(CUSTOMERS_CSV.is_blocking(f)).lower()})" for f in CUSTOMERS_CSV.fields) + ")"


@query("column_reconciliation", f"WITH {_HEADER_SQL}, {_NAMED_SQL}, {_RULES_SQL} SELECT f.file, 'missing' AS problem, source AS columns, blocking FROM (SELECT DISTINCT file FROM final) f, rules WHERE NOT EXISTS (SELECT 1 FROM final h WHERE h.file = f.file AND h.column_name = source) UNION ALL SELECT file, 'unmapped', string_agg(DISTINCT column_name, ', ' ORDER BY column_name), false FROM final WHERE column_name NOT IN (SELECT source FROM rules) AND column_name <> 'Observação Interna Antiga' GROUP BY file")
def column_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return reconcile_columns(normalize_headers(_headers(spark, d)).select("file", "column_name"), CUSTOMERS_CSV)


@query("run_warnings", f"WITH {_HEADER_SQL}, {_NAMED_SQL}, {_RULES_SQL} SELECT f.file, 'missing' AS problem, source AS columns FROM (SELECT DISTINCT file FROM final) f, rules WHERE NOT blocking AND NOT EXISTS (SELECT 1 FROM final h WHERE h.file = f.file AND h.column_name = source) UNION ALL SELECT file, 'unmapped', string_agg(DISTINCT column_name, ', ' ORDER BY column_name) FROM final WHERE column_name NOT IN (SELECT source FROM rules) AND column_name <> 'Observação Interna Antiga' GROUP BY file UNION ALL SELECT file, 'header', 'blank header in column ' || idx FROM headers WHERE trim(name) = '' UNION ALL SELECT file, 'header', 'repeated header ' || base FROM (SELECT *, row_number() OVER (PARTITION BY file, base ORDER BY idx) AS k FROM named) WHERE k > 1")
def all_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of the mapping and of the reader's headers, one table."""
    named = normalize_headers(_headers(spark, d))
    mapping = reconcile_columns(named.select("file", "column_name"), CUSTOMERS_CSV).where("not blocking").select("file", "problem", "columns")
    return audit.run_warnings(mapping, named.where("warning is not null").select("file", F.lit("header").alias("problem"), F.col("warning").alias("columns")))


@query("wrong_formats", "SELECT 'f' || c_custkey AS file, 'format' AS problem, CASE WHEN c_custkey % 4 = 1 THEN 'xlsx' ELSE 'pdf' END AS columns, true AS blocking FROM customer WHERE c_custkey % 4 IN (1, 3)")
def wrong_formats(spark: SparkSession, d: str) -> DataFrame:
    """M6: the files whose format is not the one the template declares."""
    key = F.col("c_custkey")
    formats = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("f"), key).alias("file"), F.when(key % 4 == 1, "xlsx").when(key % 4 == 3, "pdf").otherwise("csv").alias("format"))
    return reconcile_columns(_headers(spark, d).select("file", F.col("name").alias("column_name")), CUSTOMERS_CSV, formats).where("problem = 'format'")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("_src_file"), F.col("turn").cast("int").alias("page"), "text")


@query("page_blocks", "SELECT conv_id::VARCHAR AS _src_file, turn::INT AS origin, text AS block FROM conversations")
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return page_ops.page_blocks(_turns(spark, d))


@query("separator_blocks", "WITH t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1), p AS (SELECT conv_id, string_split(text, ' the ') AS parts FROM t) SELECT conv_id::VARCHAR AS _src_file, generate_subscripts(parts, 1)::INT AS origin, unnest(parts) AS block FROM p")
def separator_blocks(spark: SparkSession, d: str) -> DataFrame:
    return page_ops.page_blocks(_turns(spark, d), "separator", " the ")


@query("labelled_records", _FORMS_SQL + ", l AS (SELECT _row, string_split(text, chr(10)) AS lines FROM forms), p AS (SELECT _row, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM l), q AS (SELECT _row, k, trim(split_part(line, ':', 1)) AS label, nullif(trim(line[strpos(line, ':') + 1:], ' ' || chr(9)), '') AS value FROM p WHERE contains(line, ':')), f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY _row, label ORDER BY k) = 1) SELECT _row::VARCHAR AS _src_file, max(value) FILTER (WHERE label = 'Código') AS codigo, max(value) FILTER (WHERE label = 'CPF/CNPJ') AS documento, max(value) FILTER (WHERE label = 'E-mail') AS correio, max(value) FILTER (WHERE label = 'Vazio') AS vazio FROM f GROUP BY 1")
def labelled_records(spark: SparkSession, d: str) -> DataFrame:
    pages = legacy.forms(spark, d).select(F.col("_row").cast("string").alias("_src_file"), F.lit(1).alias("page"), "text")
    rows = page_ops.labelled_records(page_ops.page_blocks(pages), ["Código", "CPF/CNPJ", "E-mail", "Vazio"])
    return rows.select("_src_file", F.col("Código").alias("codigo"), F.col("CPF/CNPJ").alias("documento"), F.col("E-mail").alias("correio"), F.col("Vazio").alias("vazio"))


@query("page_recovery", "SELECT doc_id::VARCHAR AS _src_file, 1 AS page, CASE WHEN doc_id % 3 = 0 THEN text ELSE '..' END AS text, CASE WHEN doc_id % 3 = 0 THEN 'ocr' ELSE 'native' END AS origin FROM documents WHERE trim(text) <> ''")
def page_recovery(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").where("trim(text) <> ''")
    native = docs.select(F.col("doc_id").cast("string").alias("_src_file"), F.lit(1).alias("page"), F.lit("..").alias("text"))
    known = docs.select(F.col("doc_id").cast("string").alias("_src_file"), F.lit(1).alias("page"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.lit(" ")).alias("text"))
    return page_ops.recover_pages(native, known)[0]


@query("inspect_preview", "SELECT conv_id::VARCHAR AS _src_file, count(*) AS n_pages, substr(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> ''), ''), 1, 2000) AS preview FROM conversations GROUP BY 1")
def inspect_preview(spark: SparkSession, d: str) -> DataFrame:
    return inspect_pages(_turns(spark, d))


_NUMBER = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END"
_DAY = "CASE WHEN {0} = date_trunc('day', {0}) THEN strftime({0}, '%Y-%m-%d') ELSE strftime({0}, '%Y-%m-%d %H:%M:%S') END"


@query("coerce_to_text", f"SELECT l_orderkey::VARCHAR AS l_orderkey, l_partkey::VARCHAR AS l_partkey, l_suppkey::VARCHAR AS l_suppkey, l_linenumber::VARCHAR AS l_linenumber, {', '.join(f'{_NUMBER.format(c)} AS {c}' for c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))}, nullif(trim(l_returnflag), '') AS l_returnflag, nullif(trim(l_linestatus), '') AS l_linestatus, {_DAY.format('l_shipdate')} AS l_shipdate, CASE WHEN l_quantity > 25 THEN 'true' WHEN l_quantity < 20 THEN 'false' END AS many, l_extendedprice::DECIMAL(12, 2)::VARCHAR AS exact, strftime(l_shipdate, '%Y-%m-%d') AS day, strftime(l_shipdate, '%Y-%m-%d') || ' 07:30:00' AS moment FROM lineitem")
def coerce(spark: SparkSession, d: str) -> DataFrame:
    """S7 over all columns of the table, and a boolean with nulls, a decimal, a date and a time of day beside them."""
    lines, day = spark.read.parquet(f"{d}/lineitem.parquet"), F.col("l_shipdate").cast("date")
    many = F.when(F.col("l_quantity") > 25, True).when(F.col("l_quantity") < 20, False)
    moment = day.cast("timestamp_ntz") + F.expr("interval '7:30' hour to minute")
    return coerce_to_text(lines.select("*", many.alias("many"), F.col("l_extendedprice").cast("decimal(12,2)").alias("exact"), day.alias("day"), moment.alias("moment")))


@query("cells_to_records", "SELECT 'book' || p_partkey % 7 AS _src_file, CASE WHEN p_partkey % 7 = 3 THEN 'first' ELSE 'parts' END AS _sheet, p_partkey + 3 AS _row, nullif(trim(p_name), '') AS nome, CASE WHEN p_partkey % 7 <> 5 THEN p_size::VARCHAR END AS tamanho, CASE WHEN p_partkey % 7 = 5 THEN p_size::VARCHAR END AS \"tamanho (cm)\" FROM part")
def cells_to_records(spark: SparkSession, d: str) -> DataFrame:
    """Seven workbooks, one with another first sheet and one with another header; all have a second sheet, which is not read."""
    part, key = spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey")

    def cells(rows: DataFrame, row: Column, first: Column, second: Column) -> DataFrame:
        both = F.array(F.struct(F.lit(1).alias("col"), first.alias("value")), F.struct(F.lit(2).alias("col"), second.alias("value")))
        return rows.select("book", row.cast("long").alias("row"), F.explode(both).alias("c"))

    rows = part.withColumn("book", key % 7)
    head = cells(rows.select("book").distinct(), F.lit(2), F.lit(" nome "), F.when(F.col("book") == 5, "tamanho (cm)").otherwise("tamanho"))
    body = cells(rows, key + 3, F.col("p_name"), F.col("p_size").cast("string"))
    own = head.unionByName(body).select(F.concat(F.lit("book"), "book").alias("file"), F.when(F.col("book") == 3, "first").otherwise("parts").alias("sheet"), F.lit(1).alias("sheet_pos"), "row", "c.col", "c.value")
    other = own.select("file", F.lit("notes").alias("sheet"), F.lit(2).alias("sheet_pos"), "row", "col", F.lit("not read").alias("value"))
    return records_from_cells(own.unionByName(other), header_row=2)


@query("delimited_read", _CUST + ' SELECT "Código" AS codigo, nullif(trim("Nome Cliente", chr(9) || \' \'), \'\') AS nome, nullif("CEP", \'\') AS cep FROM legacy')
def delimited_read(spark: SparkSession, d: str) -> DataFrame:
    """Write the customers as delimited files and read them back."""
    folder = fresh_folder(spark, "delimited")
    legacy.customers(spark, d).drop("_row").write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    rows, _ = read_delimited(spark, f"{folder}/*.csv")
    return rows.select(F.col("Código").alias("codigo"), F.col("Nome Cliente").alias("nome"), F.col("CEP").alias("cep"))


#: One delimited file, and one text file, for each nation, so that the files grow with the table.
_OF_NATION = "of_nation AS (SELECT c_nationkey AS nation, c_custkey AS k, c_custkey || ': ' || c_name || ' (' || c_mktsegment || ')' AS line, CASE WHEN c_nationkey % 3 = 0 THEN '|' WHEN c_nationkey % 3 = 1 THEN ';' ELSE ',' END AS cut, c_nationkey % 4 = 0 AS accents FROM customer)"


def _of_nation(spark: SparkSession, d: str) -> DataFrame:
    """(nation, k, line, cut, accents) of every customer."""
    customers = spark.read.parquet(f"{d}/customer.parquet")
    nation = F.col("c_nationkey")
    line = F.concat(F.col("c_custkey"), F.lit(": "), "c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))
    return customers.select(nation.alias("nation"), F.col("c_custkey").alias("k"), line.alias("line"), F.when(nation % 3 == 0, "|").when(nation % 3 == 1, ";").otherwise(",").alias("cut"), (nation % 4 == 0).alias("accents"))


def _written_lines(lines: DataFrame, folder: str, encoding: str = "utf-8") -> None:
    """``lines(nation, k, at, line)`` as one text file for each nation, by k and at. A file's rows are in one task, as a single file's must be."""
    ordered = lines.repartition("nation").sortWithinPartitions("nation", "k", "at").select("nation", F.encode("line", "ISO-8859-1").alias("value") if encoding == "cp1252" else F.col("line").cast("binary").alias("value"))
    # The text writer takes strings; bytes that are no UTF-8 pass through it unchanged.
    ordered.select("nation", F.col("value").cast("string").alias("value")).write.mode("append").partitionBy("nation").text(folder)


def _nation_of(file: str) -> Column:
    return F.regexp_extract(file, "nation=([0-9]+)", 1).cast("long")


def _tables(spark: SparkSession, d: str) -> str:
    """A folder of delimited files; every fourth one has letters that are no UTF-8."""
    folder, rows = fresh_folder(spark, "tables"), _of_nation(spark, d)
    header = rows.groupBy("nation").agg(F.first("cut").alias("cut"), F.first("accents").alias("accents")).select("nation", F.lit(0).cast("long").alias("k"), F.lit(1).alias("at"), F.concat(F.lit("code"), "cut", F.when(F.col("accents"), "endereço").otherwise("name"), "cut", F.lit("rest")).alias("line"), "accents")
    body = rows.select("nation", "k", F.lit(2).alias("at"), F.concat("k", "cut", "line", "cut", F.lit("x")).alias("line"), "accents")
    lines = header.unionByName(body)
    _written_lines(lines.where("not accents"), folder)
    _written_lines(lines.where("accents"), folder, "cp1252")
    return folder


@query("read_options", f"WITH {_OF_NATION} SELECT nation::BIGINT AS nation, CASE WHEN accents THEN 'cp1252' ELSE 'utf-8-sig' END AS encoding, cut AS delimiter, 'code|' || CASE WHEN accents THEN 'endereço' ELSE 'name' END || '|rest' AS header, NULL::VARCHAR AS problem, CASE WHEN accents THEN 'read as cp1252' END AS warning FROM of_nation GROUP BY nation, accents, cut")
def read_options(spark: SparkSession, d: str) -> DataFrame:
    """Encoding, delimiter, header, problem and warning of each written file."""
    found = infer_read_options(spark, f"{_tables(spark, d)}/*/*.txt")
    return found.select(_nation_of("file").alias("nation"), "encoding", "delimiter", F.array_join("header", "|").alias("header"), "problem", "warning")


#: Extensions of the files of a nation, by its key: known ones in any case, and unknown ones.
_KINDS = ("csv", "TXT", "xlsx", "Xlsm", "docx", "pdf", "png", "JPG", "jpeg", "tif", "TIFF", "parquet", "exe", "")


@query("route_sources", f"WITH {_OF_NATION}, n AS (SELECT nation, lower({oracles._list(_KINDS).replace('(', '[').replace(')', ']')}[nation % {len(_KINDS)} + 1]) AS extension, count(*) AS lines FROM of_nation GROUP BY nation) SELECT nation::BIGINT AS nation, CASE WHEN extension IN ('csv', 'txt', 'docx', 'pdf') THEN extension WHEN extension IN ('xlsx', 'xlsm') THEN 'xlsx' WHEN extension IN ('png', 'jpg', 'jpeg', 'tif', 'tiff') THEN 'image' END AS format, CASE WHEN extension IN ('csv', 'xlsx', 'xlsm') THEN true WHEN extension IN ('parquet', 'exe', '') THEN NULL ELSE false END AS tabular FROM n")
def routed(spark: SparkSession, d: str) -> DataFrame:
    """S16 over one written file for each nation, renamed to an extension by its key; some are known, others not."""
    folder = fresh_folder(spark, "sources")
    rows = _of_nation(spark, d).select("nation", "k", F.lit(1).alias("at"), "line")
    _written_lines(rows, f"{folder}/written")
    jvm = spark._jvm.org.apache.hadoop.fs
    system = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    # One rename for each file: 25 nations.
    for found in system.globStatus(jvm.Path(f"{folder}/written/nation=*/part-*")):
        nation = int(found.getPath().getParent().getName().rpartition("=")[2])
        kind = _KINDS[nation % len(_KINDS)]
        system.mkdirs(jvm.Path(f"{folder}/named"))
        system.rename(found.getPath(), jvm.Path(f"{folder}/named/n{nation}" + (f".{kind}" if kind else "")))
    return route_sources(spark, f"{folder}/named").select(F.regexp_extract("file", r"/n([0-9]+)[^/]*$", 1).cast("long").alias("nation"), "format", "tabular")


@query("file_fingerprint", f"WITH {_OF_NATION} SELECT nation::BIGINT AS nation, sha256(string_agg(line, chr(10) ORDER BY k) || chr(10)) AS sha256 FROM of_nation GROUP BY nation")
def file_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each written file."""
    folder = fresh_folder(spark, "files")
    _written_lines(_of_nation(spark, d).select("nation", "k", F.lit(1).alias("at"), "line"), folder)
    return fingerprint(spark, f"{folder}/*/*.txt").select(_nation_of("file").alias("nation"), "sha256")


@query("text_documents", f"WITH {_OF_NATION} SELECT nation::BIGINT AS nation, 1 AS page, string_agg(line, chr(10) ORDER BY k) || chr(10) AS text, 'native' AS origin, NULL::VARCHAR AS warning FROM of_nation GROUP BY nation")
def text_documents(spark: SparkSession, d: str) -> DataFrame:
    """Text and origin of each written text file."""
    folder = fresh_folder(spark, "texts")
    _written_lines(_of_nation(spark, d).select("nation", "k", F.lit(1).alias("at"), "line"), folder)
    return page_ops.read_text_documents(spark, f"{folder}/*/*.txt").select(_nation_of("_src_file").alias("nation"), "page", "text", "origin", "warning")


@query("ragged_rows", f"WITH {_OF_NATION}, n AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY k) AS line_no FROM of_nation) SELECT nation::BIGINT AS nation, line_no + 1 AS _row, 'x' AS a, CASE WHEN k % 4 = 1 THEN k::VARCHAR END AS b FROM n WHERE k % 4 IN (0, 1)")
def ragged_rows(spark: SparkSession, d: str) -> DataFrame:
    """One written line for each customer, short, long or blank by its key; blank ones go, short ones are padded, and the numbering goes on."""
    folder, key = fresh_folder(spark, "ragged"), F.col("k")
    line = F.when(key % 4 == 0, "x").when(key % 4 == 1, F.concat(F.lit("x;"), key, F.lit(";more"))).when(key % 4 == 2, " ; ").otherwise("")
    rows = _of_nation(spark, d)
    header = rows.select("nation").distinct().select("nation", F.lit(0).cast("long").alias("k"), F.lit(1).alias("at"), F.lit("a;b").alias("line"))
    _written_lines(header.unionByName(rows.select("nation", F.col("k").cast("long").alias("k"), F.lit(2).alias("at"), line.alias("line"))), folder)
    found, _ = read_delimited(spark, f"{folder}/*/*.txt", delimiter=";")
    return found.select(_nation_of("_src_file").alias("nation"), "_row", "a", "b")


@query("documents_without_records", _FORMS_SQL + " SELECT _row::VARCHAR AS _src_file FROM forms WHERE _row % 5 = 0")
def documents_without_records(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth form loses its separators and has no record then."""
    pages = legacy.forms(spark, d).select(F.col("_row").cast("string").alias("_src_file"), F.lit(1).alias("page"), F.when(F.col("_row") % 5 == 0, F.translate("text", ":", " ")).otherwise(F.col("text")).alias("text"))
    blocks = page_ops.page_blocks(pages)
    return page_ops.without_records(blocks, page_ops.labelled_records(blocks)).select("_src_file")


@query("flagship_exact", with_(f"{_CHECKED}, {_ALL}", "SELECT 'total_records' AS metric, (SELECT count(*) FROM checked) AS value UNION ALL SELECT 'valid_records', (SELECT count(*) FROM valid) UNION ALL SELECT 'duplicate_records', (SELECT count(*) FROM exact) UNION ALL SELECT 'issue:' || code, count(*) FROM all_issues GROUP BY code"))
def flagship_exact(spark: SparkSession, d: str) -> DataFrame:
    """The flagship with the exact search alone."""
    return _metrics(*_exact_only(spark, d)).where("metric <> 'possible_duplicates'")


@query("flagship")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Map, validate and search the customers for duplicates: totals, and issues by code after annotation."""
    return _metrics(*_annotated(spark, d))


def _metrics(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(metric, value): rows, valid rows and issues by code in one aggregate over the rows, duplicates in another."""
    counted = rows.select(F.explode(F.concat(F.array(F.lit("total_records")), F.when(F.col("is_valid"), F.array(F.lit("valid_records"))).otherwise(F.array().cast("array<string>")), F.transform("issues", lambda i: F.concat(F.lit("issue:"), i["code"])))).alias("metric"))
    kinds = found.agg(F.count_if(F.col("kind") == "exact").alias("duplicate_records"), F.count_if(F.col("kind") == "possible").alias("possible_duplicates"))
    return counted.groupBy("metric").agg(F.count("*").alias("value")).unionByName(kinds.unpivot([], ["duplicate_records", "possible_duplicates"], "metric", "value"))


@query("run_migration")
def migration(spark: SparkSession, d: str) -> DataFrame:
    """R1 whole: columns reconciled, both searches, record and report; the parts of the record that do not depend on the clock."""
    run = run_migration(legacy.customers(spark, d), CUSTOMERS_CSV, REFERENCE, source_name="customer", source_format="csv")
    return run.record.select("entity", "source_filename", "status", "total_records", "valid_records", "rejected_records", "duplicate_records", "possible_duplicates", "loaded_records")


@query("audit_report")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """K4: the report's parts, from its JSON text: name and number of entries."""
    report = run_migration(legacy.customers(spark, d), CUSTOMERS_CSV, REFERENCE, source_name="customer", source_format="csv").report
    parts = ("transforms_applied", "issues_by_code", "errors", "warnings", "duplicates", "run_warnings")
    return report.select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.json_array_length(F.get_json_object("report", f"$.{p}")).alias("entries")) for p in parts))).alias("x")).select("x.*")


@query("audit_lines_exact", with_(f"{_CHECKED}, {_ALL}", "SELECT 'issues_by_code' AS part, code AS name, count(*) AS n FROM all_issues GROUP BY code UNION ALL SELECT 'duplicates', key, count(*) FROM exact GROUP BY key UNION ALL SELECT 'errors', code, count(*) FROM (SELECT code FROM all_issues WHERE severity = 'error' ORDER BY _row, pos LIMIT 500) GROUP BY code UNION ALL SELECT 'warnings', code, count(*) FROM (SELECT code FROM all_issues WHERE severity = 'warning' ORDER BY _row, pos LIMIT 500) GROUP BY code"))
def audit_lines_exact(spark: SparkSession, d: str) -> DataFrame:
    """K4 in parts, with the exact search alone: counts of the entries by name; every duplicate is listed."""
    rows, found = _exact_only(spark, d)
    record = spark.createDataFrame([("run",)], "run_id string")
    lines = audit.report_lines(rows, found, record).where("part in ('issues_by_code', 'errors', 'warnings', 'duplicates')")
    name = F.coalesce(F.get_json_object("entry", "$.code"), F.get_json_object("entry", "$.key"))
    n = F.coalesce(F.get_json_object("entry", "$.issues").cast("long"), F.lit(1).cast("long"))
    return lines.groupBy("part", name.alias("name")).agg(F.sum(n).alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
