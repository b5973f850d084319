"""The registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reconweave.llm import decontaminate, hard_negatives, html_mincut, importance, kd_shards, langid, line_quality, minhash, packing, substring, token_counts, token_files, toxicity

#: File names of the public tokenizers; tokenizer_path() finds their place.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents by four-word shingles; see minhash."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), spark, shingle=4, percent=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those not held out; see langid."""
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs.filter(~langid.held_out())))
    return out.withColumn("held_out", langid.held_out())


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes; see kd_shards."""
    return kd_shards.shard(_table(spark, sf_dir, "documents"), spark, shards=8)


def op4_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page; see html_mincut."""
    return html_mincut.extract(_table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; see packing."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), spark, tokenizer_path(WORD_BPE))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each document; see token_counts."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), spark, tokenizer_path(BYTE_BPE))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, and where; see decontaminate."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), spark)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that repeat over documents, and the document that keeps each; see substring."""
    return substring.repeats(_table(spark, sf_dir, "documents"), spark)


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of each document; see line_quality."""
    return line_quality.line_quality(_table(spark, sf_dir, "documents"), spark)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to files and read back; see token_files."""
    return token_files.round_trip(_table(spark, sf_dir, "documents"), spark, tokenizer_path(BYTE_BPE))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic each document is, learned from labels that are not held out; see toxicity."""
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"), spark), spark)
    return out.withColumn("held_out", toxicity.held_out())


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector's positives; see hard_negatives."""
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), spark, positives=5, negatives=10)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's texts; see importance."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), spark, percent=25, least_words=20, seed=7, buckets=10_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_dedup, op2_language_id, op3_kd_shards, op4_html_mincut, op5_best_fit_packing, op6_token_counts, op7_decontamination, op8_substring_dedup, op9_line_quality, op10_token_files, op11_toxicity, op12_hard_negatives, op13_importance_resampling)
}

_OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS s
  FROM words),
rows_of AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM rows_of a JOIN rows_of b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, other) AS (
  SELECT u, v FROM both_ways
  UNION
  SELECT r.doc_id, e.v FROM reach r JOIN both_ways e ON r.other = e.u),
least_of AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(l.m, s.doc_id)) AS kept
FROM sets s LEFT JOIN least_of l ON s.doc_id = l.doc_id
"""

_OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT rid, source, line, list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: length(x))) AS chars,
    array_to_string(regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[^\x20\x09-\x0D]+'), ' ') AS norm
  FROM (SELECT rid, source, unnest(string_split(t, chr(10))) AS line FROM d) q WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
hosts AS (SELECT source, greatest(5, count(*) * 10 // 100) AS most FROM d GROUP BY source),
frequent AS (SELECT l.source, l.norm FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, l.norm, h.most HAVING count(DISTINCT rid) > h.most),
removed AS (SELECT rid, sum(chars) AS n FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY rid),
windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2) q),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM windows) q WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY rid),
m AS (
  SELECT d.rid, d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS removed_chars
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN removed USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (word_chars - removed_chars) >= 30 * word_chars AS kept, CAST(removed_chars AS BIGINT) AS removed_chars
FROM m
"""

_OP12 = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) AS place
  FROM scores WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, place ORDER BY score DESC, vec_id, rid) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor = s.anchor AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

_OP13 = r"""
WITH texts AS (
  SELECT 0 AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
worded AS (
  SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
features AS (
  SELECT side, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded),
counted AS (SELECT side, rid, f, count(*) AS n FROM features GROUP BY side, rid, f),
octets AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted) q),
steps AS (
  SELECT f, list_concat([4294967295], flatten(list_transform(range(1, len(x), 2), lambda i: [CAST('0x' || x[i:i + 1] AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS s FROM octets),
buckets AS (
  SELECT f, xor(list_reduce(s, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 10000 AS b FROM steps),
totals AS (SELECT b, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counted JOIN buckets USING (f) GROUP BY b),
alls AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM totals),
gains AS (
  SELECT b, CAST(floor(1000 * ln((CAST(o.t AS DOUBLE) + 1) * (CAST(a.s AS DOUBLE) + 10000) / ((CAST(o.s AS DOUBLE) + 1) * (CAST(a.t AS DOUBLE) + 10000)))) AS BIGINT) AS g FROM totals o CROSS JOIN alls a),
weights AS (SELECT rid, sum(n) AS n, CAST(floor(CAST(sum(n * g) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM counted JOIN buckets USING (f) JOIN gains USING (b) WHERE side = 0 GROUP BY rid),
scored AS (
  SELECT d.rid, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM worded d LEFT JOIN weights USING (rid) WHERE side = 0),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, weight DESC, n_features) AS r, count(*) OVER () AS n FROM scored WHERE words >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (rid)
"""

ORACLE_SQL: dict[str, str] = {"op1_minhash_dedup": _OP1, "op9_line_quality": _OP9, "op12_hard_negatives": _OP12, "op13_importance_resampling": _OP13}
