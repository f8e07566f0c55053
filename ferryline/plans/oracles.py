"""DuckDB SQL with the meaning of the registered queries, put together from small pieces.

Independent of the Spark expressions: own functions of the other engine, own order of steps.
"""

from __future__ import annotations

from ..functions.checks import STATES, STATUS_LABELS
from ..functions.text import COMPANY_FORMS, NULL_MARKERS, PARTICLES
from ..operators.mapping import CONTACTS, CUSTOMERS_CSV, INVOICES, SCHEMAS, Template
from ..operators.validation import MESSAGES
from . import legacy

REFERENCE = "2026-01-01"


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def strip(c: str) -> str:
    return rf"nullif(regexp_replace({c}, '^[\s\x0B\x1C-\x1F]+|[\s\x0B\x1C-\x1F]+$', '', 'g'), '')"


def control(c: str) -> str:
    return rf"nullif(regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{FEFF}}]', '', 'g'), '')"


def collapse(c: str) -> str:
    return rf"nullif(trim(regexp_replace({c}, '[\s\x0B\x1C-\x1F]+', ' ', 'g')), '')"


def markers(c: str) -> str:
    return f"CASE WHEN {strip(c)} IS NULL OR lower({strip(c)}) IN {_list(NULL_MARKERS)} THEN NULL ELSE {c} END"


def clean(c: str) -> str:
    return markers(collapse(f"nfc_normalize({control(c)})"))


def title(c: str) -> str:
    word = f"CASE WHEN w IN {_list(COMPANY_FORMS)} THEN upper(w) WHEN i > 1 AND w IN {_list(PARTICLES)} THEN w ELSE upper(w[1]) || w[2:] END"
    return f"array_to_string(list_transform(string_split(lower({collapse(c)}), ' '), lambda w, i: {word}), ' ')"


def digits(c: str) -> str:
    return f"nullif(regexp_replace({clean(c)}, '[^0-9]', '', 'g'), '')"


def phone(c: str) -> str:
    return f"CASE WHEN {digits(c)}[1:2] = '55' AND length({digits(c)}) IN (12, 13) THEN {digits(c)}[3:] ELSE {digits(c)} END"


def postal(c: str) -> str:
    return f"CASE WHEN length({digits(c)}) = 7 THEN '0' || {digits(c)} ELSE {digits(c)} END"


def postal_shown(c: str) -> str:
    # Only exactly eight digits are shown with a dash; a lost leading zero is not restored here.
    return f"CASE WHEN length({digits(c)}) = 8 THEN ({digits(c)})[1:5] || '-' || ({digits(c)})[6:] ELSE {digits(c)} END"


SQL_TRANSFORMS = {
    "clean_text": clean,
    "title_case": title,
    "digits_only": digits,
    "email": lambda c: f"lower({clean(c)})",
    "brazilian_phone": phone,
    "postal_code": postal,
    "uf": lambda c: f"upper({clean(c)})",
    "lowercase": lambda c: f"lower({c})",
    "brazilian_date": lambda c: c,
    "brazilian_money": lambda c: c,
}


def cpf_valid(c: str) -> str:
    def s(n: int) -> str:
        return " + ".join(f"try_cast({c}[{i + 1}] AS INT) * {n + 1 - i}" for i in range(n))

    return f"coalesce(regexp_full_match({c}, '[0-9]{{11}}') AND {c} <> repeat({c}[1], 11) AND ({s(9)}) * 10 % 11 % 10 = try_cast({c}[10] AS INT) AND ({s(10)}) * 10 % 11 % 10 = try_cast({c}[11] AS INT), false)"


def cnpj_valid(c: str) -> str:
    def digit(n: int) -> str:
        total = " + ".join(f"try_cast({c}[{i + 1}] AS INT) * {(n - 1 - i) % 8 + 2}" for i in range(n))
        return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END = try_cast({c}[{n + 1}] AS INT))"

    return f"coalesce(regexp_full_match({c}, '[0-9]{{14}}') AND {c} <> repeat({c}[1], 14) AND {digit(12)} AND {digit(13)}, false)"


def doc_type(c: str) -> str:
    return f"CASE WHEN {cpf_valid(c)} THEN 'cpf' WHEN {cnpj_valid(c)} THEN 'cnpj' END"


def mask(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return f"CASE length({d}) WHEN 11 THEN {d}[1:3] || '.***.***-' || {d}[10:11] WHEN 14 THEN {d}[1:2] || '.***.***/****-' || {d}[13:14] WHEN 0 THEN '' WHEN 1 THEN '*' WHEN 2 THEN '**' ELSE {d}[1:2] || repeat('*', length({d}) - 2) END"


def moment(c: str) -> str:
    """Timestamp of a legacy date text."""
    t = strip(c)
    shapes = [
        (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}", "%d/%m/%Y %H:%M"),
        (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"),
        (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"),
        (r"\d{1,2}\.\d{1,2}\.\d{4}", "%d.%m.%Y"),
        (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"),
        (r"\d{4}/\d{1,2}/\d{1,2}", "%Y/%m/%d"),
        (r"\d{8}", "%d%m%Y"),
    ]
    parts = [f"CASE WHEN regexp_full_match({t}, '{shape}') THEN try_strptime({t}, '{fmt}') END" for shape, fmt in shapes]
    for sep in "/-":
        short = rf"regexp_full_match({t}, '\d{{1,2}}{sep}\d{{1,2}}{sep}\d{{2}}')"
        parts.append(f"CASE WHEN {short} THEN try_strptime({t}[:-3] || CASE WHEN {t}[-2:] < '69' THEN '20' ELSE '19' END || {t}[-2:], '%d{sep}%m{sep}%Y') END")
    return f"coalesce({', '.join(parts)})"


def amount_text(c: str) -> str:
    t = strip(c)
    paren = f"coalesce({t}[1] = '(' AND {t}[-1] = ')', false)"
    inner = rf"regexp_replace(CASE WHEN {paren} THEN trim({t}[2:-2]) ELSE {t} END, '(?i)r\$|brl|\s', '', 'g')"
    minus = rf"regexp_full_match({inner}, '[0-9.,]+-')"
    x = f"CASE WHEN {minus} THEN ({inner})[:-2] ELSE {inner} END"
    return f"""(SELECT CASE WHEN neg AND regexp_matches(n, '[1-9]') THEN '-' || ltrim(n, '-') WHEN neg THEN ltrim(n, '-') ELSE n END FROM (
      SELECT neg, CASE WHEN regexp_full_match(m, '-?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN regexp_replace(regexp_replace(regexp_replace(m, '^(-?)0+([0-9])', '\\1\\2'), '^(-?)[.]', '\\10.'), '[.]$', '') END AS n FROM (
      SELECT neg, CASE WHEN NOT regexp_full_match(x, '-?[0-9.,]+') THEN NULL
        WHEN regexp_full_match(x, '-?[0-9]{{1,3}}([.][0-9]{{3}})*(,[0-9]+)?|-?[0-9]+(,[0-9]+)?') THEN replace(replace(x, '.', ''), ',', '.')
        WHEN regexp_matches(x, ',.*[.][^,.]*$') THEN replace(x, ',', '')
        WHEN regexp_matches(x, '[.].*[.]') THEN replace(x, '.', '')
        WHEN regexp_matches(x, ',.*,') THEN NULL ELSE replace(x, ',', '.') END AS m
      FROM (SELECT {x} AS x, ({paren}) OR coalesce({minus}, false) AS neg))))"""


def status_of(c: str) -> str:
    whens = " ".join(f"WHEN lower({strip(c)}) IN {_list(v)} THEN '{k}'" for k, v in STATUS_LABELS.items())
    return f"CASE {whens} END"


def email_ok(c: str) -> str:
    return rf"regexp_full_match({strip(c)}, '[^@\s]+@[^@\s.]+([.][^@\s.]+)+')"


TABLES = {"customers": (legacy.CUSTOMERS, CUSTOMERS_CSV), "contacts": (legacy.CONTACTS, CONTACTS), "invoices": (legacy.INVOICES, INVOICES)}


def mapped(entity: str) -> str:
    """CTEs legacy, raw and mapped."""
    sql, template = TABLES[entity]
    cols = []
    for f in template.fields:
        value = f'"{f.source}"'
        steps = list(f.transforms)
        # Each step reads a plain column, so nested steps become nested selects of one value.
        for name in steps:
            value = f"(SELECT {SQL_TRANSFORMS[name]('v')} FROM (SELECT {value} AS v))"
        if f.default is not None:
            value = f"coalesce({value}, '{f.default}')"
        cols.append(f"{value} AS {f.target}")
    sources = ", ".join(f'"{f.source}" AS raw_{f.target}' for f in template.fields)
    return f"legacy AS ({sql}), mapped AS (SELECT _row, {sources}, {', '.join(cols)} FROM legacy)"


def applied(template: Template) -> str:
    """Long table (_row, transform) over mapped."""
    parts = [f"SELECT _row, unnest([{', '.join(repr(n) for n in f.transforms)}]) AS transform FROM mapped WHERE {f.target} IS DISTINCT FROM raw_{f.target}" for f in template.fields if f.transforms]
    return f"applied AS (SELECT DISTINCT _row, transform FROM ({' UNION ALL '.join(parts)}))"


def _rules(entity: str) -> list[tuple[str, str, str, str, str, str]]:
    """(condition, code, field, severity, original, normalized), in order."""
    def required(f: str) -> tuple:
        return (f"{f} IS NULL", "required_field", f, "error", "NULL", "NULL")

    def bad(cond: str, code: str, f: str, severity: str = "error", normalized: str = "NULL") -> tuple:
        return (f"{f} IS NOT NULL AND {cond}", code, f, severity, f, normalized)

    mail = bad(f"NOT {email_ok('email')}", "invalid_email", "email")
    call = bad("NOT length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 10 AND 13", "invalid_phone", "phone")

    def tax(f: str) -> list[tuple]:
        return [required(f), bad(f"({doc_type(f)}) IS NULL", "invalid_document", f)]

    if entity == "customers":
        return [
            required("full_name"), bad("length(full_name) < 2", "too_short", "full_name"), *tax("document"), mail, call,
            bad("length(regexp_replace(postal_code, '[^0-9]', '', 'g')) <> 8", "invalid_postal_code", "postal_code", "warning"),
            bad(f"upper(trim(state)) NOT IN {_list(STATES)}", "invalid_state", "state"),
            bad("m_created_at IS NULL", "invalid_date", "created_at"),
            bad(f"m_created_at::DATE > DATE '{REFERENCE}'", "future_date", "created_at", normalized="strftime(m_created_at, '%Y-%m-%d')"),
        ]
    if entity == "contacts":
        none = f"NOT coalesce({email_ok('email')}, false) AND NOT coalesce(length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 10 AND 13, false)"
        return [*tax("customer_document"), required("name"), bad("length(name) < 2", "too_short", "name"), mail, call, (none, "missing_contact_channel", "email", "error", "NULL", "NULL")]
    return [
        required("external_id"), *tax("customer_document"),
        required("issued_at"), bad("m_issued_at IS NULL", "invalid_date", "issued_at"), required("due_at"), bad("m_due_at IS NULL", "invalid_date", "due_at"),
        required("amount"), bad("m_amount IS NULL", "invalid_amount", "amount"), bad("m_amount::DECIMAL(38,10) < 0", "negative_amount", "amount", normalized="m_amount"),
        required("status"), bad(f"({status_of('status')}) IS NULL", "unknown_status", "status"),
        ("m_due_at < m_issued_at", "due_before_issue", "due_at", "error", "due_at", "NULL"),
    ]


def validated(entity: str) -> str:
    """CTEs up to checked (helper columns), issues (one row each, pos from 0) and valid."""
    helpers = {"customers": f", {moment('created_at')} AS m_created_at", "contacts": "", "invoices": f", {moment('issued_at')} AS m_issued_at, {moment('due_at')} AS m_due_at, {amount_text('amount')} AS m_amount"}[entity]
    parts = [f"SELECT _row, {i} AS rule, '{code}' AS code, '{severity}' AS severity, '{field}' AS field, '{MESSAGES[code].format(field=field)}' AS message, {original} AS original_value, {normalized} AS normalized_value FROM checked WHERE {cond}" for i, (cond, code, field, severity, original, normalized) in enumerate(_rules(entity))]
    return f"""{mapped(entity)}, checked AS (SELECT *{helpers} FROM mapped),
found AS ({' UNION ALL '.join(parts)}),
issues AS (SELECT *, row_number() OVER (PARTITION BY _row ORDER BY rule) - 1 AS pos FROM found),
valid AS (SELECT * FROM checked WHERE _row NOT IN (SELECT _row FROM issues WHERE severity = 'error'))"""


def exact(entity: str) -> str:
    keys = [k for k in ("document", "customer_document", "external_id", "email") if k in SCHEMAS[entity]]
    parts = " UNION ALL ".join(f"SELECT _row, {i} AS priority, '{k}' AS key, lower({strip(k)}) AS value FROM valid" for i, k in enumerate(keys))
    return f"""keys AS (SELECT *, min(_row) OVER (PARTITION BY key, value) AS matched FROM ({parts}) WHERE value IS NOT NULL),
exact AS (SELECT _row AS ord, matched, key, value FROM keys WHERE matched < _row QUALIFY row_number() OVER (PARTITION BY _row ORDER BY priority) = 1)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"
