"""Legacy-looking tables derived from the given tables by SQL that both engines run alike.

They carry the dirt the engine is for: masked and bare tax ids, some with wrong digits, mixed date and number formats,
markers for "nothing", outer blanks, repeated keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.checks import CNPJ_WEIGHTS, CPF_WEIGHTS, STATES
from ..sources.tables import spread


def _sum(digits: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"cast(substr({digits}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights)) + ")"


def _cpf_digit(digits: str, k: int) -> str:
    return f"cast({_sum(digits, CPF_WEIGHTS[k])} * 10 % 11 % 10 as string)"


def _cnpj_digit(digits: str, k: int) -> str:
    rest = f"({_sum(digits, CNPJ_WEIGHTS[k])} % 11)"
    return f"cast(case when {rest} < 2 then 0 else 11 - {rest} end as string)"


def tax_ids(key: str, table: str) -> str:
    """(key, cpf, cnpj): two valid tax ids for every key of a table."""
    return f"""
SELECT k, c10 || {_cpf_digit('c10', 1)} AS cpf, d13 || {_cnpj_digit('d13', 1)} AS cnpj FROM (
SELECT k, c9 || {_cpf_digit('c9', 0)} AS c10, d12 || {_cnpj_digit('d12', 0)} AS d13 FROM (
SELECT k, lpad(cast(k * 7919 % 1000000000 as string), 9, '0') AS c9, lpad(cast((k * 104729 + 17) % 1000000000000 as string), 12, '0') AS d12
FROM (SELECT DISTINCT {key} AS k FROM {table}) AS keys) AS bases) AS firsts"""


def _shape(cpf: str) -> str:
    return f"substr({cpf}, 1, 3) || '.' || substr({cpf}, 4, 3) || '.' || substr({cpf}, 7, 3) || '-' || substr({cpf}, 10, 2)"


def _two(x: str) -> str:
    return f"lpad(cast({x} as string), 2, '0')"


CUSTOMERS = f"""
WITH ids AS ({tax_ids('c_custkey', 'customer')}),
base AS (
  SELECT c_custkey AS k, c_name AS n, c_mktsegment AS seg, n_name AS nation, cpf, cnpj
  FROM customer JOIN ids ON c_custkey = k LEFT JOIN nation ON c_nationkey = n_nationkey),
rows AS (
  SELECT k,
    'ERP-' || cast(k as string) AS codigo,
    CASE WHEN k % 43 = 0 THEN 'N/A' WHEN k % 47 = 0 THEN 'x' WHEN k % 6 = 0 THEN '  ' || upper(n) || '  S/A ' WHEN k % 6 = 1 THEN lower(n) || ' da  silva ltda'
         WHEN k % 6 = 2 THEN chr(9) || n || ' DOS SANTOS' WHEN k % 6 = 3 THEN 'José Ávila ' || n || chr(127) ELSE 'maria e ' || n || ' de souza' END AS nome,
    CASE WHEN k % 13 = 0 THEN '111.111.111-11' WHEN k % 11 = 0 THEN substr(cpf, 1, 10) || cast((cast(substr(cpf, 11, 1) as int) + 1) % 10 as string)
         WHEN k % 53 = 0 THEN '-' WHEN k % 5 = 0 THEN cnpj WHEN k % 3 = 0 THEN {_shape('cpf')} ELSE cpf END AS documento,
    CASE WHEN k % 19 = 0 THEN 'usuario@' WHEN k % 23 = 0 THEN 'nulo' WHEN k % 4 = 0 THEN ' User' || cast(k as string) || '@EXAMPLE.com' ELSE 'user' || cast(k as string) || '@example.com' END AS correio,
    CASE WHEN k % 7 = 0 THEN '+55 42 9' || lpad(cast(k % 500 as string), 4, '0') || '-5094' WHEN k % 29 = 0 THEN '12' WHEN k % 17 = 1 THEN 'N/A' ELSE '119' || lpad(cast(k % 900 as string), 8, '0') END AS fone,
    CASE WHEN k % 31 = 0 THEN '12-34' WHEN k % 8 = 0 THEN '' WHEN k % 8 = 1 THEN cast(1000000 + k % 400 as string) ELSE lpad(cast(69000 + k % 300 as string), 5, '0') || '-5' || _two2 END AS cep,
    nation AS cidade,
    CASE WHEN k % 37 = 0 THEN 'XX' WHEN k % 2 = 0 THEN lower(substr('{''.join(STATES)}', cast(k % 27 as int) * 2 + 1, 2)) ELSE substr('{''.join(STATES)}', cast(k % 27 as int) * 2 + 1, 2) END AS uf,
    CASE WHEN k % 41 = 0 THEN '31/02/2020' WHEN k % 59 = 0 THEN '01/01/2099' WHEN k % 5 = 0 THEN y || '-' || m || '-' || d WHEN k % 5 = 1 THEN d || '/' || m || '/' || y
         WHEN k % 5 = 2 THEN d || '-' || m || '-' || y || ' ' WHEN k % 5 = 3 THEN d || '/' || m || '/' || substr(y, 3, 2) ELSE d || '/' || m || '/' || y || ' 13:0' || cast(k % 10 as string) END AS cadastro,
    CASE WHEN k % 2 = 0 THEN 'N/A' ELSE '' END AS obs
  FROM (SELECT *, {_two('k % 90')} AS _two2, cast(1995 + k % 28 as string) AS y, {_two('1 + k % 12')} AS m, {_two('1 + k % 28')} AS d FROM base) AS parts)
SELECT k * 2 AS _row, codigo AS "Código", nome AS "Nome Cliente", documento AS "CPF_CNPJ", correio AS "Correio Eletrônico", fone AS "Fone Principal", cep AS "CEP",
  cidade AS "Cidade", uf AS "UF", cadastro AS "Data Cadastro", obs AS "Observação Interna Antiga" FROM rows
UNION ALL
SELECT k * 2 + 100001, codigo || '-DUP', nome, CASE WHEN k % 2 = 0 THEN documento ELSE '' END, upper(correio), fone, cep, cidade, uf, cadastro, obs FROM rows WHERE k % 17 = 0
"""

INVOICES = f"""
WITH ids AS ({tax_ids('o_custkey', 'orders')}),
base AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p, cast(o_orderdate as date) AS day, cpf FROM orders JOIN ids ON o_custkey = k),
parts AS (SELECT *, cast(year(day) as string) AS y, {_two('month(day)')} AS m, {_two('day(day)')} AS d,
  cast(cast(floor(p) as bigint) as string) AS whole, cast(10 + k % 90 as string) AS cents,
  cast(year(day) + CASE WHEN k % 9 = 0 THEN -1 ELSE 1 END as string) AS y2 FROM base)
SELECT k AS _row, CASE WHEN k % 61 = 0 THEN NULL WHEN k % 97 = 0 THEN 'F-' || cast(k - 1 as string) ELSE 'F-' || cast(k as string) END AS "Documento",
  cpf AS "CPF_CNPJ Cliente", 'pedido ' || cast(k as string) AS "Historico",
  CASE WHEN k % 3 = 0 THEN y || '-' || m || '-' || d WHEN k % 3 = 1 THEN d || '/' || m || '/' || y ELSE d || m || y END AS "Data Emissao",
  CASE WHEN k % 71 = 0 THEN 'amanhã' ELSE d || '.' || m || '.' || y2 END AS "Data Vencimento",
  CASE WHEN k % 83 = 0 THEN '1,2,3' WHEN k % 89 = 0 THEN '~' || whole WHEN k % 79 = 0 THEN '00' || whole || ',50' WHEN k % 73 = 0 THEN '000' || whole || '.' WHEN k % 101 = 0 THEN ',5' WHEN k % 103 = 0 THEN '(-' || whole || ')' WHEN k % 107 = 0 THEN '-' || whole || '-' WHEN k % 7 = 0 THEN '(' || whole || ',' || cents || ')' WHEN k % 7 = 1 THEN 'R$ ' || whole || ',' || cents WHEN k % 7 = 2 THEN whole || '.' || cents
       WHEN k % 7 = 3 AND length(whole) > 3 THEN substr(whole, 1, length(whole) - 3) || '.' || substr(whole, length(whole) - 2, 3) || ',' || cents
       WHEN k % 7 = 4 AND length(whole) > 3 THEN substr(whole, 1, length(whole) - 3) || ',' || substr(whole, length(whole) - 2, 3) || '.' || cents
       WHEN k % 7 = 5 THEN whole || ',5-' ELSE whole END AS "Valor",
  CASE WHEN k % 67 = 0 THEN 'talvez' WHEN s = 'F' THEN ' Pago ' WHEN s = 'O' THEN 'EM ABERTO' ELSE 'vencido' END AS "Situacao"
FROM parts
"""

CONTACTS = f"""
WITH ids AS ({tax_ids('s_suppkey', 'supplier')})
SELECT k + again AS _row, 'ERP-' || cast(k as string) AS "Código Cliente", CASE WHEN k % 9 = 0 THEN '123' ELSE {_shape('cpf')} END AS "CPF_CNPJ Cliente",
  CASE WHEN k % 10 = 0 THEN ' ' ELSE s_name || ' de almeida' END AS "Nome Contato", CASE WHEN k % 3 = 0 THEN 'GERENTE DE VENDAS' ELSE 'comprador' END AS "Cargo",
  CASE WHEN k % 4 = 0 THEN '' WHEN k % 11 = 0 THEN 'sem-arroba.com' ELSE 'C' || cast(k as string) || '@example.com' END AS "Correio Eletrônico",
  CASE WHEN k % 4 = 1 OR k % 8 = 0 THEN '' ELSE '(11) 3' || lpad(cast(k % 1000 as string), 3, '0') || '-4000' END AS "Fone"
FROM supplier JOIN ids ON s_suppkey = k JOIN (SELECT 0 AS again UNION ALL SELECT 1000000) AS twice ON again = 0 OR k % 5 = 2
"""

#: One page of labelled text per customer.
FORMS = """
SELECT _row, 'Relatório' || chr(10) || 'Código: ' || "Código" || chr(10) || 'CPF/CNPJ : ' || "CPF_CNPJ" || chr(10) || 'E-mail:' || "Correio Eletrônico" || chr(10)
  || 'CEP: ' || "CEP" || chr(10) || 'Código: repetido' || chr(10) || 'Data de Cadastro: ' || "Data Cadastro" || ' R$ 1.234,50 e 2.000,00' || chr(10) || 'Vazio:' AS text
FROM legacy
"""

#: Tables whose rows are dealt to all cores before the long expressions over them, and the keys by which they meet their tax ids.
_SPREAD = {"customer": "c_custkey", "orders": "o_custkey", "supplier": "s_suppkey"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the given tables; double quotes name columns in both engines."""
    found = re.compile(rf"(FROM|JOIN) ({'|'.join(TABLES)})\b")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in {m[2] for m in found.finditer(sql)}}
    frames = {t: spread(df, _SPREAD[t]) if t in _SPREAD else df for t, df in frames.items()}
    text = found.sub(r"\1 <\2>", sql).replace("{", "{{").replace("}", "}}").replace('"', "`")
    text = re.sub(r"<(\w+)>", r"{\1}", text)
    return spark.sql(text, **frames)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CUSTOMERS)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, INVOICES)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CONTACTS)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, f"WITH legacy AS ({CUSTOMERS}) {FORMS}")
