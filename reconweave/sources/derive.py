"""Reconciliation frames derived from the benchmark tables, in SQL that Spark and DuckDB share.

Every frame has an ordinal (bid or pid) that follows from its source row alone, so
no global numbering is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINES = """
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_tax AS DECIMAL(4,2)) AS rate
  FROM lineitem"""
_GSTIN = "'27ABCDE' || lpad(CAST(l_suppkey % 10000 AS STRING), 4, '0') || 'F1Z' || CAST(l_suppkey % 10 AS STRING)"
_PARTY = "'Supplier ' || lpad(CAST(l_suppkey AS STRING), 6, '0')"


def _split(inter: str) -> str:
    half = "CAST(round(tax * CAST(0.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2))"
    return f"""CASE WHEN {inter} THEN CAST(0 AS DECIMAL(18,2)) ELSE {half} END AS cgst,
    CASE WHEN {inter} THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(tax - {half} AS DECIMAL(18,2)) END AS sgst,
    CASE WHEN {inter} THEN tax ELSE CAST(0 AS DECIMAL(18,2)) END AS igst,
    CAST(0 AS DECIMAL(18,2)) AS cess, tax AS total_tax, CAST(taxable + tax AS DECIMAL(18,2)) AS invoice_value"""


_TAX = "CAST(round({0} * rate, 2) AS DECIMAL(18,2))"

BOOKS = f"""
SELECT bid, gstin, party_name, invoice_number, document_type, invoice_date, taxable AS taxable_value, {_split("l_suppkey % 3 = 0")}
FROM (SELECT (l_orderkey * 10 + l_linenumber) * 100 + k AS bid, l_suppkey, {_GSTIN} AS gstin, {_PARTY} AS party_name,
    'B' || CAST(l_linenumber AS STRING) || 'Z/' || CAST(l_orderkey AS STRING) AS invoice_number, 'Invoice' AS document_type,
    CAST(l_shipdate AS DATE) AS invoice_date, price AS taxable, {_TAX.format("price")} AS tax
  FROM ({_LINES}) x) y"""

_DEAR = "CASE WHEN l_orderkey % 11 = 0 THEN CAST(round(price * CAST(1.05 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) ELSE price END"
PORTAL = f"""
SELECT pid, gstin, party_name, invoice_number, document_type, invoice_date, taxable AS taxable_value, {_split("(l_suppkey % 3 = 0) <> (l_orderkey % 31 = 0)")}
FROM (SELECT pid, l_suppkey, l_orderkey, gstin, party_name, invoice_number, document_type, invoice_date, taxable, {_TAX.format("taxable")} AS tax
  FROM (SELECT (l_orderkey * 10 + l_linenumber) * 100 + k AS pid, l_suppkey, l_orderkey, rate, {_GSTIN} AS gstin, {_PARTY} AS party_name,
      'B' || CAST(l_linenumber AS STRING) || 'Z/' || CASE WHEN l_orderkey % 7 = 0 THEN '000' ELSE '' END || CAST(l_orderkey AS STRING) || CASE WHEN l_orderkey % 5 = 0 THEN '/2025-26' ELSE '' END AS invoice_number,
      CASE WHEN l_orderkey % 29 = 0 THEN 'SEZ' ELSE 'Invoice' END AS document_type,
      CAST(CASE WHEN l_orderkey % 13 = 0 THEN CAST(l_shipdate AS DATE) + INTERVAL 3 DAY ELSE CAST(l_shipdate AS DATE) END AS DATE) AS invoice_date, {_DEAR} AS taxable
    FROM ({_LINES}) a WHERE l_orderkey % 17 <> 0
    UNION ALL
    SELECT ((l_orderkey + 1000000000) * 10 + l_linenumber) * 100 + k AS pid, l_suppkey, l_orderkey, rate, {_GSTIN} AS gstin, {_PARTY} AS party_name,
      'X' || CAST(l_linenumber AS STRING) || '/' || CAST(l_orderkey + 1000000000 AS STRING) AS invoice_number, 'Invoice' AS document_type,
      CAST(l_shipdate AS DATE) AS invoice_date, price AS taxable
    FROM ({_LINES}) b WHERE l_returnflag = 'R' AND l_orderkey % 19 = 0) z) y"""

_PAN = "'AAAPA' || lpad(CAST(l_suppkey % 10000 AS STRING), 4, '0') || 'K'"
_SECTION = "CASE l_suppkey % 4 WHEN 0 THEN '194C' WHEN 1 THEN '194J' WHEN 2 THEN '194H' ELSE '194A' END"
_TDS_TAX = "CAST(round(price * CASE l_suppkey % 4 WHEN 0 THEN CAST(0.02 AS DECIMAL(4,2)) WHEN 1 THEN CAST(0.10 AS DECIMAL(4,2)) WHEN 2 THEN CAST(0.05 AS DECIMAL(4,2)) ELSE CAST(0.10 AS DECIMAL(4,2)) END, 2) AS DECIMAL(18,2))"

TDS_BOOKS = f"""
SELECT (l_orderkey * 10 + l_linenumber) * 100 + k AS bid, CASE WHEN l_orderkey % 37 = 0 THEN '' ELSE {_PAN} END AS pan, {_PARTY} AS deductee_name, {_SECTION} AS section,
  price AS amount_paid_credited, CASE WHEN l_orderkey % 41 = 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN l_orderkey % 43 = 0 THEN CAST(round({_TDS_TAX} * CAST(0.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) ELSE {_TDS_TAX} END AS tax_deducted,
  CASE WHEN l_orderkey % 41 = 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN l_orderkey % 47 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE {_TDS_TAX} END AS tax_deposited,
  CAST(l_shipdate AS DATE) AS deposit_date, CASE WHEN l_orderkey % 3 = 0 THEN 'CH' || CAST((l_orderkey * 10 + l_linenumber) * 100 + k AS STRING) ELSE '' END AS challan_number
FROM ({_LINES}) x"""

TDS_PORTAL = f"""
SELECT bid AS pid, pan, deductee_name, section, amount_paid_credited,
  CASE WHEN bid % 13 = 0 THEN CAST(tax_deducted + CAST(25 AS DECIMAL(4,0)) AS DECIMAL(18,2)) WHEN bid % 11 = 0 THEN CAST(tax_deducted + CAST(1 AS DECIMAL(4,0)) AS DECIMAL(18,2)) ELSE tax_deducted END AS tax_deducted,
  CAST(deposit_date + INTERVAL 2 DAY AS DATE) AS deposit_date, challan_number
FROM ({TDS_BOOKS}) t WHERE bid % 19 <> 0"""

NOTES_BOOKS = f"""
SELECT (l_orderkey * 10 + l_linenumber) * 100 + k AS nid, {_GSTIN} AS gstin, {_PARTY} AS party_name, CAST(NULL AS STRING) AS note_type,
  'V' || CAST(l_orderkey AS STRING) AS voucher_number,
  CASE WHEN l_orderkey % 5 = 0 THEN 'CREDIT NOTE NO. CN/' || CAST((l_orderkey * 10 + l_linenumber) * 100 + k AS STRING) || '/25-26' WHEN l_orderkey % 5 = 1 THEN 'Credit Note No CD-' || CAST((l_orderkey * 10 + l_linenumber) * 100 + k AS STRING)
    WHEN l_orderkey % 5 = 2 THEN 'being rate difference' ELSE 'CREDIT NOTE NO.  ' || CAST((l_orderkey * 10 + l_linenumber) * 100 + k AS STRING) || '.' END AS narration,
  CAST(l_shipdate AS DATE) AS note_date, price AS taxable_value, {_TAX.format("price")} AS total_tax, CAST(price + {_TAX.format("price")} AS DECIMAL(18,2)) AS invoice_value
FROM ({_LINES}) x WHERE l_returnflag = 'R'"""

OTHER_BOOKS = """
SELECT o_orderkey AS bid, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'REF' || CAST(o_orderkey AS STRING) END AS reference, CAST(o_orderdate AS DATE) AS date,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount, 'Customer ' || CAST(o_custkey AS STRING) || ' paid order ' || CAST(o_orderkey AS STRING) AS narration
FROM orders"""
OTHER_PORTAL = """
SELECT o_orderkey AS pid, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 8 = 0 THEN 'NEFT/REF' || CAST(o_orderkey AS STRING) || '/X' ELSE 'REF' || CAST(o_orderkey AS STRING) END AS reference,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 DAY AS DATE) AS date,
  CASE WHEN o_orderkey % 10 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(5 AS DECIMAL(4,0)) AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
  'order ' || CAST(o_orderkey AS STRING) || ' Customer ' || CAST(o_custkey AS STRING) AS narration
FROM orders WHERE o_orderkey % 14 <> 0"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived frame over the tables of a folder."""
    for name in ("lineitem", "orders"):
        sql = sql.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(sql)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, BOOKS)


def portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, PORTAL)
