"""DuckDB twins of the registered queries, written from their definitions."""

from __future__ import annotations

from reconweave.sources import derive

HEADS = ("cgst", "sgst", "igst", "cess")
FIELDS = ("gstin", "party_name", "invoice_number", "document_type", "invoice_date", "taxable_value", *HEADS, "total_tax", "invoice_value")


def within(a: str, b: str, absolute: float = 10, percent: float = 1) -> str:
    return f"(abs({a} - {b}) <= {absolute} OR abs({a} - {b}) * 100 <= {percent} * greatest(abs({a}), abs({b})))"


def within_of(a: str, b: str) -> str:
    return f"(abs({a} - {b}) <= 10 OR ({b} <> 0 AND abs({a} - {b}) * 100 <= abs({b})))"


def _bare(n: str) -> str:
    return f"regexp_replace({n}, '[0-9]{{4}}-[0-9]{{2}}$', '')"


def fy(n: str) -> str:
    return f"upper(regexp_replace({_bare(n)}, '[/]', '', 'g'))"


def norm(n: str) -> str:
    return rf"regexp_replace({fy(n)}, '([^0-9])0+([0-9])', '\1\2', 'g')"


def core(n: str) -> str:
    return rf"regexp_replace(regexp_extract({_bare(n)}, '([0-9]+)/?$', 1), '^0+([0-9])', '\1')"


def print_key(n: str) -> str:
    return rf"regexp_replace(upper(regexp_replace({n}, '[/-]', '', 'g')), '([^0-9])0+([0-9])', '\1\2', 'g')"


def keyed(frame: str) -> str:
    return f"SELECT *, {norm('invoice_number')} AS norm, {core('invoice_number')} AS core, {fy('invoice_number')} AS fy FROM ({frame}) f"


def quarter(d: str) -> str:
    m = f"({d} - INTERVAL 3 MONTH)"
    return f"'Q' || CAST(quarter({m}) AS VARCHAR) || '-' || CAST(year({m}) AS VARCHAR)"


def _sides(side: str) -> str:
    return ", ".join(f"{side}.{c} AS {side}_{c}" for c in FIELDS)


def _sum(side: str) -> str:
    return "(" + " + ".join(f"{side}_{h}" for h in HEADS) + ")"


def _double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


_X, _Y = _double(_sum("b")), _double(_sum("p"))
_BX, _PX = f"abs({_double('b_taxable_value')})", f"abs({_double('p_taxable_value')})"
_RATES = f"({_BX} > 0 AND {_PX} > 0 AND abs(abs({_X}) * {_PX} - abs({_Y}) * {_BX}) * 100 > 0.5 * {_BX} * {_PX})"
_HEADS_OK = "(" + " AND ".join(within(f"b_{h}", f"p_{h}") for h in HEADS) + ")"
_SHARES = "(" + " OR ".join(f"abs({_double(f'b_{h}')} * {_Y} - {_double(f'p_{h}')} * {_X}) > 0.02 * {_X} * {_Y}" for h in HEADS) + ")"
_SPLIT = f"({_X} > 0 AND {_Y} > 0 AND {_SHARES})"
_TV_OK = within("b_taxable_value", "p_taxable_value")
_ISSUES = f"""list_filter([CASE WHEN NOT {_TV_OK} THEN 'Taxable Value Difference' END,
  CASE WHEN NOT {within(_sum('b'), _sum('p'))} AND {_RATES} AND {_TV_OK} THEN 'Tax Amount Difference' END,
  CASE WHEN NOT {_HEADS_OK} AND {_SPLIT} THEN 'Tax Split Mismatch' END,
  CASE WHEN b_document_type <> p_document_type THEN 'Document Type Mismatch' END], lambda x: x IS NOT NULL)"""


def run(books: str = derive.BOOKS, portal: str = derive.PORTAL) -> str:
    """The exact run with flattened records."""
    return f"""
SELECT *, CASE WHEN classification <> 'Amount Difference' THEN CAST(0 AS DECIMAL(18,2)) WHEN basis = 'total_tax' THEN p_total_tax - b_total_tax
    WHEN basis = 'taxable_value' THEN p_taxable_value - b_taxable_value ELSE p_invoice_value - b_invoice_value END AS difference,
  CASE classification WHEN 'Not in Books' THEN {_sum('p')} WHEN 'Not in Portal' THEN {_sum('b')} WHEN 'Amount Difference' THEN abs({_sum('p')} - {_sum('b')}) ELSE 0 END AS itc_at_risk,
  CASE classification WHEN 'Not in Books' THEN p_invoice_value WHEN 'Not in Portal' THEN b_invoice_value ELSE 0 END AS gross_value,
  CASE WHEN confidence_score >= 92 THEN 'High' WHEN confidence_score >= 65 THEN 'Medium' ELSE 'Low' END AS confidence_band
FROM (
  SELECT *, CASE WHEN difference_type IN ('Tax Amount Difference', 'Tax Split Mismatch', 'Rate Mismatch') THEN 'total_tax' WHEN difference_type = 'Taxable Value Difference' THEN 'taxable_value'
      WHEN abs(b_taxable_value - p_taxable_value) >= abs(b_total_tax - p_total_tax) AND abs(b_taxable_value - p_taxable_value) >= abs(b_invoice_value - p_invoice_value) THEN 'taxable_value'
      WHEN abs(b_total_tax - p_total_tax) >= abs(b_invoice_value - p_invoice_value) THEN 'total_tax' ELSE 'invoice_value' END AS basis
  FROM (
    SELECT *, CASE WHEN bid IS NULL THEN NULL WHEN pid IS NULL THEN CASE WHEN copies > 1 THEN 'Duplicate in Books' END
        WHEN len(issues) > 1 THEN 'Unexplained' WHEN len(issues) = 1 THEN issues[1] WHEN {_RATES} THEN 'Rate Mismatch' END AS difference_type,
      CASE WHEN bid IS NULL THEN 'Not in Books' WHEN pid IS NULL THEN 'Not in Portal' WHEN len(issues) = 0 AND NOT {_RATES} THEN 'Matched' ELSE 'Amount Difference' END AS classification,
      CASE WHEN bid IS NULL OR pid IS NULL THEN 0.0 WHEN b_fy = p_fy THEN 98.0 ELSE 90.0 END AS confidence_score
    FROM (SELECT *, {_ISSUES} AS issues FROM (
      SELECT bid, pid, b.fy AS b_fy, p.fy AS p_fy, b.copies, {_sides('b')}, {_sides('p')}
      FROM (SELECT *, row_number() OVER (PARTITION BY gstin, norm ORDER BY bid) AS k, count(*) OVER (PARTITION BY gstin, norm) AS copies FROM ({keyed(books)}) x) b
      FULL JOIN (SELECT *, row_number() OVER (PARTITION BY gstin, norm ORDER BY pid) AS k FROM ({keyed(portal)}) y) p
        ON b.gstin = p.gstin AND b.norm = p.norm AND b.k = p.k) j) i) c) d"""


RUN = run()
_SHA = f"""substring(sha256('GST|' || CASE WHEN bid IS NULL THEN 'portal' ELSE 'books' END || '|' || coalesce(b_gstin, p_gstin) || '|' || {print_key('coalesce(b_invoice_number, p_invoice_number)')} || '|' ||
  CASE WHEN coalesce(b_invoice_value, p_invoice_value) < 0 THEN 'Credit Note' ELSE 'Invoice' END), 1, 24)"""


def prints(inner: str = RUN) -> str:
    return f"""SELECT * EXCLUDE (base, n), CASE WHEN n = 1 THEN base ELSE base || '#' || CAST(n AS VARCHAR) END AS fingerprint
FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY bid NULLS LAST, pid NULLS LAST) AS n FROM (SELECT *, {_SHA} AS base FROM ({inner}) r) s) t"""


_DIFF = f"""SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, a.classification AS class_a, b.classification AS class_b,
  CASE WHEN a.fingerprint IS NULL THEN 'added' WHEN b.fingerprint IS NULL THEN 'removed' WHEN a.classification = b.classification THEN 'same' ELSE 'changed' END AS status
FROM ({prints()}) a FULL JOIN ({prints(run(f'SELECT * FROM ({derive.BOOKS}) q WHERE bid % 23 <> 0', f'SELECT * FROM ({derive.PORTAL}) q WHERE pid % 29 <> 0'))}) b ON a.fingerprint = b.fingerprint"""

_TAX = "coalesce(p_total_tax, b_total_tax)"
_LOOSE = f"""SELECT * REPLACE (CASE WHEN bid % 12 = 1 THEN invoice_value + 5 ELSE invoice_value END AS invoice_value, CASE WHEN bid % 14 = 1 THEN sgst + 1 ELSE sgst END AS sgst, CASE WHEN bid % 15 = 1 THEN gstin || '9' ELSE gstin END AS gstin) FROM ({derive.BOOKS}) q"""
_VALID = "(length(gstin) = 15 AND regexp_matches(gstin, '^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z][A-Z][0-9A-Z]$'))"
_ARITHMETIC = "abs(taxable_value + cgst + sgst + igst + cess - invoice_value) > 1"
_MIRROR = "abs(cgst - sgst) > 0.01"

_RATE_ROWS = "(VALUES ('194C', [2.0, 1.0], 30000, 100000), ('194J', [2.0, 10.0], 30000, 0), ('194A', [10.0], 0, 40000), ('194H', [5.0], 0, 15000)) s(section, rates, single_threshold, annual_threshold)"
_AT_RATE = "list_bool_or(list_transform(rates, lambda r: abs(CAST({0} AS DOUBLE) - CAST(b.amount_paid_credited AS DOUBLE) * r / 100) <= 2))"
_NOTE_NUMBER = "CAST(nid AS VARCHAR)"
_NOTE_REFERENCE = "CASE (nid // 1000) % 5 WHEN 0 THEN 'CN/' || {n} || '/25-26' WHEN 1 THEN 'CD-' || {n} WHEN 2 THEN NULL ELSE {n} END".format(n=_NOTE_NUMBER)
_NOTE_KEY = "CASE (nid // 1000) % 5 WHEN 0 THEN 'CN' || {n} WHEN 1 THEN 'CD' || {n} WHEN 2 THEN NULL ELSE {n} END".format(n=_NOTE_NUMBER)
_NOTES = f"SELECT *, {_NOTE_REFERENCE} AS note_reference, {_NOTE_KEY} AS note_key, CASE WHEN (nid // 1000) % 5 = 2 THEN 'debit' ELSE 'credit' END AS note_kind FROM ({derive.NOTES_BOOKS}) q"

_ALIGNED = f"""SELECT coalesce(bid, pid) AS id, classification AS engine_class, confidence_score, difference_type,
  CASE coalesce(bid, pid) % 20 WHEN 1 THEN 'Matched' WHEN 2 THEN 'Amount Difference' WHEN 3 THEN 'Not in Portal' ELSE classification END AS baseline_class FROM ({RUN}) r"""
_PR = f"""SELECT c AS class, count(*) FILTER (engine_class = c AND baseline_class = c) AS tp, count(*) FILTER (engine_class = c AND baseline_class <> c) AS fp,
  count(*) FILTER (engine_class <> c AND baseline_class = c) AS fn
FROM ({_ALIGNED}) a CROSS JOIN (VALUES ('Matched'), ('Amount Difference'), ('Not in Books'), ('Not in Portal')) v(c) GROUP BY c"""
_PR = f"""SELECT *, round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END, 4) AS recall FROM ({_PR}) q"""


def _collisions(side: str, frame: str) -> list[str]:
    return [f"SELECT '{side}' AS side, '{k}' AS key_kind, gstin, {k} AS key_value, count(DISTINCT invoice_number) AS numbers, min(invoice_number) AS first_number FROM ({keyed(frame)}) q GROUP BY gstin, {k} HAVING count(DISTINCT invoice_number) > 1" for k in ("norm", "core")]


_WORD = "list_element(['R', 'SEZ', 'DE', 'CDN', 'ISD', 'IMPG', 'weird', 'reverse charge'], CAST(pid % 8 + 1 AS BIGINT))"
_TYPE = "CASE w WHEN 'R' THEN 'Invoice' WHEN 'SEZ' THEN 'SEZ' WHEN 'DE' THEN 'Deemed Export' WHEN 'CDN' THEN 'Credit Note' WHEN 'ISD' THEN 'ISD' WHEN 'IMPG' THEN 'Import' WHEN 'reverse charge' THEN 'Reverse Charge' ELSE CASE WHEN v < 0 THEN 'Credit Note' ELSE 'Invoice' END END"

_FIELD = " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(b_{f} AS VARCHAR) <> CAST(p_{f} AS VARCHAR) AS differs, " + ("abs(b_{0} - p_{0}) > 10".format(f) if f in ("taxable_value", "total_tax", "invoice_value") else f"b_{f} <> p_{f}") + " AS material FROM both_sides"
    for f in ("gstin", "document_type", "taxable_value", "total_tax", "invoice_value")
)
_CAUSE = """CASE WHEN classification = 'Not in Books' THEN 'missing_in_books' WHEN classification = 'Not in Portal' THEN 'missing_in_portal' WHEN difference_type = 'Document Type Mismatch' THEN 'document_type_mismatch'
  WHEN difference_type = 'Timing Difference' THEN 'timing_difference' WHEN b_taxable_value = 0 AND b_total_tax = 0 AND abs(b_invoice_value - p_invoice_value) <= 10 THEN 'likely_ingestion_gap'
  WHEN abs(difference) <= 2 THEN 'rounding_only' WHEN difference_type IS NULL AND abs(difference) < 10000 THEN 'below_materiality' ELSE 'value_difference' END"""

ORACLES: dict[str, str] = {
    "gst_exact_summary": f"SELECT classification, count(*) AS results, sum({_TAX}) AS tax FROM ({RUN}) r GROUP BY classification",
    "gst_results": f"SELECT bid, pid, difference_type, classification, difference, itc_at_risk, gross_value, confidence_score, confidence_band FROM ({RUN}) r",
    "gst_key_normalisation": f"SELECT pid, invoice_number, norm, core, fy, {print_key('invoice_number')} AS print_key, {_VALID} AS valid, length(gstin) <> 15 AS malformed FROM ({keyed(derive.PORTAL)}) q",
    "gst_duplicate_keys": f"SELECT gstin, norm, count(*) AS copies FROM ({keyed(derive.BOOKS)}) q GROUP BY gstin, norm HAVING count(*) > 1",
    "gst_key_collisions": " UNION ALL ".join(_collisions("books", derive.BOOKS) + _collisions("portal", derive.PORTAL)),
    "gst_variant_pass": f"SELECT bid, pid, b.core AS b_core FROM ({keyed(derive.BOOKS)}) b JOIN ({keyed(derive.PORTAL)}) p ON b.gstin = p.gstin AND b.core = p.core WHERE {within('b.invoice_value', 'p.invoice_value')}",
    "gst_amount_date_pass": f"SELECT bid, pid FROM ({derive.BOOKS}) b JOIN ({derive.PORTAL}) p ON b.gstin = p.gstin WHERE {within('b.invoice_value', 'p.invoice_value')} AND abs(date_diff('day', b.invoice_date, p.invoice_date)) <= 5",
    "gst_amendments": f"""
WITH p AS (SELECT pid, gstin, invoice_number FROM ({derive.PORTAL}) q),
o AS (SELECT *, row_number() OVER (PARTITION BY gstin, invoice_number ORDER BY pid) AS k FROM p WHERE pid % 7 <> 1),
a AS (SELECT pid + 5000000000000000 AS pid, gstin, invoice_number, row_number() OVER (PARTITION BY gstin, invoice_number ORDER BY pid) AS k FROM p WHERE pid % 10 = 1)
SELECT o.pid, a.pid IS NOT NULL AS superseded, CAST(NULL AS BIGINT) AS amends FROM o LEFT JOIN a USING (gstin, invoice_number, k)
UNION ALL SELECT a.pid, false, o.pid FROM a LEFT JOIN o USING (gstin, invoice_number, k)""",
    "gst_value_at_risk": f"SELECT classification, difference_type, count(*) AS results, sum(difference) AS difference, sum(itc_at_risk) AS itc_at_risk, sum(gross_value) AS gross_value FROM ({RUN}) r GROUP BY classification, difference_type",
    "gst_fingerprints": f"SELECT bid, pid, fingerprint FROM ({prints()}) r",
    "gst_cross_period": f"SELECT bid, pid, strftime(b_invoice_date, '%Y-%m') AS books_period, strftime(p_invoice_date, '%Y-%m') AS portal_period FROM ({RUN}) r WHERE bid IS NOT NULL AND pid IS NOT NULL AND abs(date_diff('month', b_invoice_date, p_invoice_date)) = 1",
    "gst_document_pools": f"""SELECT document_type, CASE WHEN document_type IN ('Credit Note', 'Debit Note') THEN 'notes' WHEN document_type = 'ISD' THEN 'isd' WHEN document_type = 'Reverse Charge' THEN 'reverse_charge' WHEN document_type = 'Import' THEN 'import' ELSE 'regular' END AS pool, count(*) AS documents, sum(v) AS value
FROM (SELECT v, {_TYPE} AS document_type FROM (SELECT CASE WHEN pid % 3 = 0 THEN -invoice_value ELSE invoice_value END AS v, {_WORD} AS w FROM ({derive.PORTAL}) q) x) y GROUP BY ALL""",
    "gst_field_comparison": f"WITH both_sides AS (SELECT * FROM ({RUN}) r WHERE bid IS NOT NULL AND pid IS NOT NULL) SELECT field, count(*) AS pairs, count(*) FILTER (differs) AS differing, count(*) FILTER (material) AS material FROM ({_FIELD}) f GROUP BY field",
    "tds_quarters": f"SELECT section, {quarter('deposit_date')} AS quarter, CAST(year(deposit_date - INTERVAL 3 MONTH) AS VARCHAR) || '-' || lpad(CAST((year(deposit_date - INTERVAL 3 MONTH) + 1) % 100 AS VARCHAR), 2, '0') AS fy, count(*) AS rows, sum(tax_deducted) AS tax FROM ({derive.TDS_BOOKS}) b GROUP BY ALL",
    "tds_challan_pass": f"""SELECT bid, pid, CASE WHEN near THEN 'Matched' ELSE 'Amount Difference' END AS classification,
  CASE WHEN near THEN NULL WHEN amount > 0 AND NOT at_b AND NOT at_p THEN 'Rate Mismatch' WHEN abs(x - y) > 0 AND abs(x - y) <= 2 THEN 'Rounding' WHEN x < y THEN 'Short Deduction' WHEN x > y THEN 'Excess Deduction' ELSE 'Unexplained' END AS difference_type
FROM (SELECT bid, pid, b.tax_deducted AS x, p.tax_deducted AS y, b.amount_paid_credited AS amount, {within_of('b.tax_deducted', 'p.tax_deducted')} AS near, {_AT_RATE.format('b.tax_deducted')} AS at_b, {_AT_RATE.format('p.tax_deducted')} AS at_p
  FROM ({derive.TDS_BOOKS}) b JOIN ({derive.TDS_PORTAL}) p ON b.challan_number = p.challan_number AND b.challan_number <> '' JOIN {_RATE_ROWS} ON b.section = s.section
  WHERE abs(date_diff('day', b.deposit_date, p.deposit_date)) <= 7) q""",
    "tds_aggregated_pass": f"""
WITH b AS (SELECT pan, section, {quarter('deposit_date')} AS quarter, sum(tax_deducted) AS books_tax, count(*) AS books_rows, min(bid) AS books_first FROM ({derive.TDS_BOOKS}) x WHERE pan <> '' GROUP BY ALL),
p AS (SELECT pan, section, {quarter('deposit_date')} AS quarter, sum(tax_deducted) AS portal_tax, count(*) AS portal_rows, min(pid) AS portal_first FROM ({derive.TDS_PORTAL}) x WHERE pan <> '' GROUP BY ALL)
SELECT * FROM b JOIN p USING (pan, section, quarter) WHERE {within_of('books_tax', 'portal_tax')}""",
    "tds_section_validation": f"""
WITH r AS (SELECT *, CAST(tax_deducted AS DOUBLE) AS tax, CAST(amount_paid_credited AS DOUBLE) AS amount FROM ({derive.TDS_BOOKS}) b JOIN {_RATE_ROWS} USING (section)),
n AS (SELECT *, list_min(list_transform(rates, lambda r: {{'gap': abs(amount * r / 100 - tax), 'expected': amount * r / 100}})) AS near FROM r),
f AS (SELECT bid, 'rate' AS check_name, CASE WHEN tax < near.expected THEN 'Short Deduction' ELSE 'Excess Deduction' END AS difference_type FROM n WHERE near.gap > 2
UNION ALL SELECT bid, 'missing_pan', 'Rate Mismatch' FROM r WHERE pan = '' AND abs(tax - amount * 20 / 100) > 2
UNION ALL SELECT bid, 'single_threshold', 'Short Deduction' FROM r WHERE single_threshold > 0 AND amount > single_threshold AND tax = 0)
SELECT check_name, difference_type, count(*) AS rows, count(DISTINCT bid) AS books_rows FROM f GROUP BY ALL""",
    "tds_threshold_breaches": f"""
SELECT pan, section, sum(amount_paid_credited) AS paid, sum(tax) AS tax, count(*) AS rows
FROM (SELECT *, CAST(CASE WHEN pan <> '' AND CAST(substring(pan, 6, 4) AS INTEGER) % 3 = 1 THEN 0 ELSE tax_deducted END AS DECIMAL(18,2)) AS tax FROM ({derive.TDS_BOOKS}) q) b JOIN {_RATE_ROWS} USING (section)
WHERE pan <> '' AND annual_threshold > 0 GROUP BY pan, section, annual_threshold HAVING sum(amount_paid_credited) > annual_threshold AND sum(tax) = 0""",
    "tds_rate_as_of": f"""
WITH r(section, f, t, rate) AS (VALUES ('194C', DATE '1990-01-01', DATE '1997-12-31', 1.0), ('194C', DATE '1998-01-01', NULL, 2.0), ('194J', DATE '1996-04-01', NULL, 10.0), ('194H', DATE '1990-01-01', DATE '1999-12-31', 5.0))
SELECT b.section, b.canonical, r.rate, count(*) AS rows, sum(amount_paid_credited) AS paid FROM (SELECT *, CASE section WHEN '194A' THEN '194J' ELSE section END AS canonical FROM ({derive.TDS_BOOKS}) x) b
LEFT JOIN r ON b.canonical = r.section AND r.f <= b.deposit_date AND (r.t IS NULL OR b.deposit_date <= r.t) GROUP BY ALL""",
    "tds_chain": f"""
WITH r AS (SELECT b.bid, p.pid IS NOT NULL AS seen, b.tax_deducted AS d, b.tax_deposited AS q, b.bid % 10 = 3 AS mismatch FROM ({derive.TDS_BOOKS}) b LEFT JOIN ({derive.TDS_PORTAL}) p ON b.bid = p.pid),
s AS (SELECT 1 AS step, 'applicability' AS stage, 'complete' AS state FROM r
UNION ALL SELECT 2, 'rate', CASE WHEN mismatch THEN 'gap' ELSE 'complete' END FROM r
UNION ALL SELECT 3, 'deduction', CASE WHEN d > 0 THEN 'complete' ELSE 'gap' END FROM r
UNION ALL SELECT 4, 'deposit', CASE WHEN d > 0 AND q >= d - 1 THEN 'complete' ELSE 'gap' END FROM r
UNION ALL SELECT 5, 'return', CASE WHEN seen THEN 'complete' ELSE 'timing_lag' END FROM r
UNION ALL SELECT 6, 'reflection', CASE WHEN seen THEN 'complete' ELSE 'timing_lag' END FROM r)
SELECT step, stage, state, count(*) AS rows FROM s GROUP BY ALL""",
    "note_reference_keys": f"SELECT nid, note_reference, note_key, note_kind FROM ({_NOTES}) n",
    "note_summary": f"SELECT note_kind, CASE WHEN note_key IS NULL THEN 'no reference' ELSE 'referenced' END AS state, count(*) AS notes, sum(total_tax) AS tax, sum(invoice_value) AS gross FROM ({_NOTES}) n GROUP BY ALL",
    "note_pass": f"SELECT nid AS bid, nid AS pid, note_kind FROM ({_NOTES}) n WHERE note_key IS NOT NULL AND nid % 13 <> 0",
    "other_reference_pass": f"SELECT bid, pid, b.amount AS books_amount, p.amount AS portal_amount FROM ({derive.OTHER_BOOKS}) b JOIN ({derive.OTHER_PORTAL}) p ON b.reference = p.reference AND b.reference <> '' WHERE {within('b.amount', 'p.amount')}",
    "other_amount_date_pass": f"SELECT bid, pid FROM ({derive.OTHER_BOOKS}) b JOIN ({derive.OTHER_PORTAL}) p ON abs(date_diff('day', b.date, p.date)) <= 7 AND {within('b.amount', 'p.amount')} WHERE b.reference = '' AND p.reference = ''",
    "guard_verdicts": f"""
WITH l AS ({_LOOSE}), c AS (SELECT count(*) AS rows, count(*) FILTER ({_ARITHMETIC}) AS a, count(*) FILTER ({_MIRROR}) AS m, count(*) FILTER (NOT {_VALID}) AS g, count(*) FILTER (strftime(invoice_date, '%Y-%m') <> '1996-05') AS d FROM l)
SELECT check_name, rows, failed, CASE WHEN failed = 0 THEN 'pass' WHEN stops AND failed > 0.2 * rows THEN 'hard_stop' ELSE 'row_flag' END AS result
FROM (SELECT 'tax_arithmetic' AS check_name, rows, a AS failed, true AS stops FROM c UNION ALL SELECT 'mirror', rows, m, true FROM c UNION ALL SELECT 'gstin', rows, g, false FROM c UNION ALL SELECT 'date', rows, d, false FROM c) q""",
    "guard_tax_arithmetic": f"SELECT bid, invoice_value FROM ({_LOOSE}) l WHERE {_ARITHMETIC}",
    "guard_mirror": f"SELECT bid, cgst, sgst FROM ({_LOOSE}) l WHERE {_MIRROR}",
    "guard_implied_rate": f"SELECT gstin, count(*) AS rows FROM ({_LOOSE}) l WHERE abs(total_tax * 100 - taxable_value * 4) > 100 GROUP BY gstin",
    "guard_row_accounting": f"""SELECT *, rows_read = rows_parsed + blank + total_row + negative AS balanced FROM (SELECT count(*) AS rows_read, count(*) FILTER (r = 'blank') AS blank, count(*) FILTER (r = 'total_row') AS total_row, count(*) FILTER (r = 'negative') AS negative, count(*) FILTER (r IS NULL) AS rows_parsed
FROM (SELECT CASE WHEN bid % 10 = 1 THEN 'blank' WHEN invoice_value > 90000 THEN 'total_row' WHEN bid % 6 = 1 THEN 'negative' END AS r FROM ({_LOOSE}) l) q) z""",
    "guard_duplicates": f"SELECT bid, gstin, invoice_number, copies FROM (SELECT *, count(*) OVER (PARTITION BY gstin, invoice_number) AS copies FROM ({derive.BOOKS}) b) q WHERE copies > 1",
    "guard_control_totals": f"""SELECT gstin, parsed, stated, CASE WHEN stated IS NULL OR abs(parsed - stated) <= 1 THEN 'pass' ELSE 'hard_stop' END AS result
FROM (SELECT gstin, sum(invoice_value) AS parsed, CASE right(gstin, 1) WHEN '7' THEN NULL WHEN '3' THEN sum(invoice_value) + 2 ELSE sum(invoice_value) END AS stated FROM ({derive.BOOKS}) b GROUP BY gstin) q""",
    "guard_required_fields": f"""WITH c AS (SELECT count(*) FILTER (pan <> '') AS a, count(*) AS s, count(*) FILTER (challan_number <> '') AS n, count(tax_deducted) AS t FROM ({derive.TDS_BOOKS}) b)
SELECT *, filled > 0 AS present FROM (SELECT 'pan' AS field, a AS filled FROM c UNION ALL SELECT 'section', s FROM c UNION ALL SELECT 'challan_number', n FROM c UNION ALL SELECT 'tax_deducted', t FROM c) q""",
    "guard_structural_issues": f"""WITH l AS ({_LOOSE}) SELECT 'malformed_gstin' AS issue, 'gstin' AS field, gstin AS value, count(*) AS rows, min(bid) AS first_row FROM l WHERE NOT {_VALID} GROUP BY gstin
UNION ALL SELECT 'impossible_date', 'invoice_date', strftime(invoice_date, '%Y-%m-%d'), count(*), min(bid) FROM l WHERE year(invoice_date) NOT BETWEEN 2000 AND 2100 GROUP BY invoice_date""",
    "document_key_aggregation": f"SELECT gstin, split_part(invoice_number, '/', 2) AS document, sum(taxable_value) AS taxable_value, sum(total_tax) AS total_tax, sum(invoice_value) AS invoice_value, arg_min(invoice_number, bid) AS first_line, count(*) AS lines FROM ({derive.BOOKS}) b GROUP BY gstin, split_part(invoice_number, '/', 2)",
    "run_summary": f"""WITH r AS ({RUN}) SELECT dimension, label, count(*) AS results, sum(gross_value) AS gross FROM (SELECT 'class' AS dimension, classification AS label, gross_value FROM r UNION ALL SELECT 'band', confidence_band, gross_value FROM r UNION ALL SELECT 'type', coalesce(difference_type, 'none'), gross_value FROM r) q GROUP BY ALL""",
    "run_diff": f"SELECT * FROM ({_DIFF}) d WHERE status <> 'same'",
    "run_movement": f"SELECT coalesce(class_a, 'absent') AS class_a, coalesce(class_b, 'absent') AS class_b, count(*) AS results FROM ({_DIFF}) d GROUP BY ALL",
    "review_overlay": f"""SELECT classification, reviewed, reviewed AND i % 2 = 1 AND classification <> 'Matched' AS stale, count(*) AS results
FROM (SELECT classification, coalesce(bid, pid) AS i, coalesce(bid, pid) % 3 = 1 AND coalesce(bid, pid) % 5 <> 1 AS reviewed FROM ({RUN}) r) q GROUP BY ALL""",
    "override_overlay": f"SELECT CASE WHEN bid % 4 = 1 THEN 'Corrected' ELSE b_party_name END AS party_name, b_document_type AS document_type, bid % 4 = 1 AS overridden, count(*) AS results FROM ({RUN}) r WHERE bid IS NOT NULL GROUP BY ALL",
    "review_kpis": f"SELECT count(*) AS results, count(*) FILTER (classification = 'Matched') AS matched, count(*) FILTER (classification <> 'Matched') AS open_results, sum({_TAX}) AS period_tax, sum(itc_at_risk) AS at_stake FROM ({RUN}) r",
    "review_causes": f"SELECT {_CAUSE} AS cause, count(*) AS results, sum(abs(difference)) AS value, sum(itc_at_risk) AS tax FROM ({RUN}) r WHERE classification <> 'Matched' GROUP BY 1",
    "supplier_ranking": f"SELECT coalesce(p_party_name, b_party_name) AS party, count(*) AS exceptions, sum(itc_at_risk) AS tax FROM ({RUN}) r WHERE classification <> 'Matched' GROUP BY 1",
    "supplier_top8": f"SELECT coalesce(p_party_name, b_party_name) AS party, count(*) AS exceptions, sum(itc_at_risk) AS tax FROM ({RUN}) r WHERE classification <> 'Matched' GROUP BY 1 ORDER BY tax DESC, party LIMIT 8",
    "eligible_credit": f"""SELECT *, greatest(matched - blocked, 0) AS eligible FROM (SELECT sum({_TAX}) AS total, sum(CASE WHEN classification = 'Matched' THEN {_TAX} ELSE 0 END) AS matched, sum(CASE WHEN classification <> 'Matched' THEN {_TAX} ELSE 0 END) AS at_risk,
  sum(CASE WHEN classification = 'Matched' AND bid % 9 = 1 THEN {_TAX} ELSE 0 END) AS blocked, sum(CASE WHEN p_document_type = 'SEZ' THEN {_TAX} ELSE 0 END) AS reverse_charge FROM ({RUN}) r) q""",
    "exceptions_priority": f"""SELECT classification, CASE WHEN value > 10000 THEN 'escalated' WHEN confidence_band = 'Low' OR classification = 'Amount Difference' THEN 'high' ELSE 'normal' END AS priority,
  CASE WHEN classification = 'Not in Books' THEN 'Reject' WHEN classification = 'Not in Portal' THEN 'Pending' WHEN difference_type = 'Rounding' THEN 'Accept' ELSE 'Pending' END AS recommendation,
  CASE WHEN classification = 'Not in Books' THEN 90 WHEN classification = 'Not in Portal' THEN 75 WHEN difference_type = 'Rounding' THEN 92 WHEN difference_type = 'Timing Difference' THEN 80 ELSE 60 END AS confidence_pct, count(*) AS exceptions, sum(value) AS value
FROM (SELECT *, coalesce(nullif(gross_value, 0), abs(difference)) AS value FROM ({RUN}) r WHERE classification <> 'Matched') q GROUP BY ALL""",
    "queue_counts": "SELECT o_orderpriority AS priority, age >= 365 AS age_escalated, count(*) AS items, max(age) AS oldest FROM (SELECT o_orderpriority, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01'), 0) AS age FROM orders) q GROUP BY ALL",
    "filing_calendar": """SELECT obligation, period, strftime(due, '%Y-%m-%d') AS due, date_diff('day', DATE '1998-08-01', due) AS days_until FROM (SELECT obligation, period, CASE WHEN d <= day(last_day(m)) THEN CAST(m + to_days(d - 1) AS DATE) END AS due
FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS m FROM orders) p CROSS JOIN (VALUES ('GSTR-1', 11), ('GSTR-3B', 20), ('TDS', 31)) o(obligation, d)) q""",
    "period_trend": f"""SELECT *, lag(rate) OVER (PARTITION BY client ORDER BY period) AS previous_rate FROM (SELECT client, period, matched, results, round(CAST(matched AS DOUBLE) * 100 / results, 2) AS rate FROM (
SELECT coalesce(b_party_name, p_party_name) AS client, strftime(coalesce(b_invoice_date, p_invoice_date), '%Y-%m') AS period, count(*) FILTER (classification = 'Matched') AS matched, count(*) AS results FROM ({RUN}) r GROUP BY 1, 2) q) z""",
    "sync_failures": """SELECT user_id, coalesce(min(CASE WHEN value >= 50 OR value IS NULL THEN n END), count(*) + 1) - 1 AS failures, coalesce(min(CASE WHEN value >= 50 OR value IS NULL THEN n END), count(*) + 1) - 1 >= 3 AS escalated
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) q WHERE n <= 50 GROUP BY user_id""",
    "rule_resolution": """SELECT s_suppkey AS client_id, rule_key, CASE WHEN rule_key = 'window' AND s_suppkey % 4 = 1 THEN CAST(s_suppkey AS VARCHAR) ELSE v END AS value, CASE WHEN rule_key = 'window' AND s_suppkey % 4 = 1 THEN 'client' ELSE 'firm' END AS scope
FROM supplier CROSS JOIN (VALUES ('materiality', '12000'), ('window', '5')) f(rule_key, v)""",
    "indian_money_format": f"""
WITH a AS (SELECT bid, CAST(taxable_value * CASE bid % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 1000 END AS DECIMAL(18,2)) AS amount FROM ({derive.BOOKS}) b),
t AS (SELECT *, split_part(CAST(abs(amount) AS VARCHAR), '.', 1) AS w, split_part(CAST(abs(amount) AS VARCHAR), '.', 2) AS c FROM a),
h AS (SELECT *, CASE WHEN length(w) > 3 THEN left(w, length(w) - 3) ELSE '' END AS head, right(w, 3) AS tail FROM t)
SELECT bid, amount, CASE WHEN amount < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN head = '' THEN '' ELSE reverse(rtrim(regexp_replace(reverse(head), '([0-9]{{2}})', '\\1,', 'g'), ',')) || ',' END || tail || '.' || c AS shown FROM h""",
    "tax_rate_variants": """SELECT p_partkey, l AS label, r AS rate FROM part JOIN (VALUES (0, 'professional', 10.0), (0, 'technical', 2.0), (1, 'default', 5.0), (2, 'individual /', 1.0), (2, 'company', 2.0)) v(m, l, r) ON p_partkey % 3 = m""",
    "verify_confusion": f"SELECT coalesce(baseline_class, 'Total') AS baseline_class, coalesce(engine_class, 'Total') AS engine_class, count(*) AS pairs FROM ({_ALIGNED}) a GROUP BY CUBE (baseline_class, engine_class)",
    "verify_precision_recall": _PR,
    "verify_calibration": f"SELECT least(CAST(floor(confidence_score / 10) AS INT), 9) AS decile, count(*) AS pairs, count(*) FILTER (engine_class = baseline_class) AS agreed, round(CAST(count(*) FILTER (engine_class = baseline_class) AS DOUBLE) / count(*), 4) AS accuracy FROM ({_ALIGNED}) a GROUP BY 1",
    "verify_coverage": f"""WITH r AS (SELECT count(bid) AS engine_rows, count(pid) AS baseline_rows, count(*) FILTER (bid IS NOT NULL AND pid IS NOT NULL) AS aligned FROM ({RUN}) q)
SELECT *, round(CAST(aligned AS DOUBLE) / greatest(engine_rows, baseline_rows), 4) AS coverage, round(CAST(aligned AS DOUBLE) / greatest(engine_rows, baseline_rows), 4) >= 0.8 AS enough FROM r""",
    "verify_disagreements": f"""SELECT engine_class, baseline_class, CASE WHEN d LIKE '%duplicate%' THEN 'duplicate' WHEN d LIKE '%rate%' THEN 'rate' WHEN d LIKE '%timing%' OR d LIKE '%period%' THEN 'timing' WHEN d LIKE '%ambigu%' THEN 'ambiguous' ELSE 'unexplained' END AS cause, count(*) AS pairs
FROM (SELECT *, lower('pass ' || coalesce(difference_type, 'duplicate')) AS d FROM ({_ALIGNED}) a) q WHERE engine_class <> baseline_class GROUP BY ALL""",
    "verify_criteria": f"""SELECT t.metric, m.value, t.threshold, CASE WHEN t.threshold IS NULL OR m.value IS NULL THEN 'NOT YET ASSESSABLE' WHEN m.value >= t.threshold THEN 'PASS' ELSE 'FAIL' END AS result
FROM (VALUES ('recall Matched', 0.95), ('recall Not in Books', 0.5), ('recall Amount Difference', NULL)) t(metric, threshold) LEFT JOIN (SELECT 'recall ' || class AS metric, recall AS value FROM ({_PR}) p) m ON t.metric = m.metric""",
    "amount_proximity": f"""SELECT CAST(floor(greatest(0.0, 1 - CAST(abs(b_invoice_value - p_invoice_value) AS DOUBLE) / greatest(10.0, CAST(greatest(abs(b_invoice_value), abs(p_invoice_value)) AS DOUBLE) * CAST(0.01 AS DOUBLE))) * 10) AS INT) AS tenth, count(*) AS pairs FROM ({RUN}) r WHERE bid IS NOT NULL AND pid IS NOT NULL GROUP BY 1""",
    "document_fields": f"""
WITH t AS (SELECT *, bid % 2 = 0 AS even FROM ({derive.BOOKS}) b),
f AS (SELECT 'vendor_gstin' AS field, gstin AS value, true AS asks FROM t UNION ALL SELECT 'invoice_number', invoice_number, true FROM t UNION ALL SELECT 'invoice_date', strftime(invoice_date, '%d/%m/%Y'), true FROM t
UNION ALL SELECT 'taxable_value', CAST(taxable_value AS VARCHAR), true FROM t UNION ALL SELECT 'cgst_amount', CAST(cgst AS VARCHAR), true FROM t UNION ALL SELECT 'cgst_rate', CASE WHEN even THEN '9' END, false FROM t
UNION ALL SELECT 'sgst_rate', CASE WHEN even THEN '9' END, false FROM t UNION ALL SELECT 'sgst_amount', CASE WHEN NOT even THEN CAST(sgst AS VARCHAR) END, NOT even FROM t
UNION ALL SELECT 'invoice_total', CAST(invoice_value AS VARCHAR), true FROM t UNION ALL SELECT 'place_of_supply', 'Delhi (07)', true FROM t
UNION ALL SELECT x, NULL, x <> 'igst_rate' FROM t CROSS JOIN (VALUES ('vendor_name'), ('hsn_sac'), ('item_description'), ('quantity'), ('rate'), ('igst_rate'), ('igst_amount'), ('total_tax'), ('reference_po')) v(x))
SELECT field, CASE WHEN value IS NULL THEN 'not present' ELSE 'auto' END AS state, value IS NULL AND asks AS reviewable, count(*) AS documents, max(value) AS greatest FROM f GROUP BY ALL""",
    "document_uploads": f"""SELECT bid, upper(invoice_number) AS invoice_number, gstin AS vendor_gstin, copies, first_copy FROM (
SELECT *, count(*) OVER (PARTITION BY gstin, upper(invoice_number)) AS copies, min(bid) OVER (PARTITION BY gstin, upper(invoice_number)) AS first_copy FROM ({derive.BOOKS}) b) q WHERE copies > 1""",
    "stream_event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, sum(CAST(value AS DECIMAL(18,4))) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) e GROUP BY ALL",
    "result_reasons": f"""
WITH r AS (SELECT *, regexp_replace(coalesce(b_invoice_number, p_invoice_number), '[0-9][0-9,./-]*', '#', 'g') AS n, abs(date_diff('day', b_invoice_date, p_invoice_date)) AS days FROM ({RUN}) q)
SELECT classification, difference_type, regexp_replace(CASE classification WHEN 'Not in Books' THEN 'Invoice ' || n || ' is on the portal but not in the books'
  WHEN 'Not in Portal' THEN 'Invoice ' || n || ' is in the books but not on the portal' || CASE WHEN difference_type = 'Duplicate in Books' THEN '; the books have its number more than once' ELSE '' END
  ELSE 'Invoice ' || n || ': ' || CASE WHEN confidence_score >= 98 THEN 'GSTIN and invoice number agree' ELSE 'GSTIN and the numeric part of the number agree' END || '; ' ||
    CASE WHEN classification = 'Matched' THEN 'taxable value and all tax heads agree'
      WHEN difference_type = 'Taxable Value Difference' THEN difference_type || ' (taxable value: books ₹#, portal ₹#)'
      WHEN difference_type IN ('Tax Amount Difference', 'Tax Split Mismatch', 'Rate Mismatch') THEN difference_type || ' (tax: books ₹#, portal ₹#)'
      WHEN difference_type = 'Document Type Mismatch' THEN difference_type || ' (books ' || b_document_type || ', portal ' || p_document_type || ')'
      ELSE difference_type || ' (invoice value: books ₹#, portal ₹#)' END ||
    CASE WHEN difference_type = 'Unexplained' AND days <> 0 THEN '; dates differ by # days' ELSE '' END END || '.', '#, portal', '# portal') AS reason, count(*) AS results
FROM r GROUP BY ALL""",
    "review_narrative": f"""
WITH k AS (SELECT count(*) AS n, count(*) FILTER (classification = 'Matched') AS m, CAST(sum(itc_at_risk) AS DECIMAL(18,2)) AS a FROM ({RUN}) r),
t AS (SELECT *, split_part(CAST(a AS VARCHAR), '.', 1) AS w, split_part(CAST(a AS VARCHAR), '.', 2) AS c FROM k),
h AS (SELECT *, CASE WHEN length(w) > 3 THEN left(w, length(w) - 3) ELSE '' END AS head FROM t)
SELECT CAST(m AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' documents (' || CAST(round(CAST(m AS DOUBLE) * 100 / n, 1) AS VARCHAR) || '%) agree; ₹' || CASE WHEN head = '' THEN '' ELSE reverse(rtrim(regexp_replace(reverse(head), '([0-9]{{2}})', '\\1,', 'g'), ',')) || ',' END || right(w, 3) || '.' || c
  || ' of tax is at stake in ' || CAST(n - m AS VARCHAR) || ' open ones.' AS text FROM h""",
    "narrative_check": """SELECT 'region ' || CAST(r_regionkey AS VARCHAR) || ' has 1,234.50 and 24 of 25' AS text, x AS raw FROM region CROSS JOIN (VALUES ('1,234.50', 1234.5), ('24', 24), ('25', 25)) v(x, y) WHERE y NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'region ' || CAST(r_regionkey AS VARCHAR) || ' has 1,234.50 and 24 of 25', CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey NOT IN (SELECT n_nationkey FROM nation)""",
    "slot_detection": """
WITH f AS (SELECT p_partkey AS file, CASE p_partkey % 6 WHEN 0 THEN 'purchase register tally csv' WHEN 1 THEN 'gstr2b aug xlsx' WHEN 2 THEN 'form26as csv' WHEN 3 THEN 'bank statement csv' WHEN 4 THEN 'misc csv' ELSE 'ledger loan csv' END AS n,
  CASE p_partkey % 4 WHEN 0 THEN 'gstin | voucher no' WHEN 1 THEN 'utr | withdrawal' WHEN 2 THEN 'itc availability | gstin' ELSE 'a | b' END AS h FROM part),
t(slot, token, w) AS (VALUES ('tally', 'tally', 2), ('tally', 'purchase register', 2), ('tally', 'voucher', 1), ('gstr2b', 'gstr2b', 2), ('gstr2b', '2b', 1), ('gstr2b', 'itc availability', 2), ('ims', 'ims', 2), ('ims', 'ims action', 2),
  ('form26as', '26as', 2), ('form26as', 'form 26as', 2), ('tds', 'tds', 2), ('tds', 'challan', 1), ('tds', 'deductee', 2), ('bank', 'bank', 2), ('bank', 'withdrawal', 2), ('bank', 'utr', 1),
  ('vendor_ledger', 'ledger', 2), ('opening_balances', 'opening', 2), ('loan_sheet', 'loan', 2), ('salary', 'salary', 2), ('credit_notes', 'credit note', 2)),
s AS (SELECT file, slot, sum(CASE WHEN contains(n, token) THEN 3 * w ELSE 0 END + CASE WHEN contains(h, token) THEN w ELSE 0 END) AS points FROM f CROSS JOIN t GROUP BY file, slot),
m AS (SELECT *, max(points) OVER (PARTITION BY file) AS top FROM s)
SELECT file, CASE WHEN count(*) = 1 AND max(top) > 0 THEN min(slot) END AS slot, CAST(max(top) AS BIGINT) AS points FROM m WHERE points = top GROUP BY file""",
    "declarative_sheet": f"SELECT gstin, count(*) AS rows, sum(taxable_value) AS taxable, sum(cgst + sgst) AS state_tax, 0 AS cess, strftime(min(invoice_date), '%Y-%m-%d') AS first_date FROM ({derive.BOOKS}) b WHERE bid % 9 <> 1 GROUP BY gstin",
}
