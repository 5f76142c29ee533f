"""The corpus operators as queries over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, licenses, linededup, mil, minhash, packing, qualityrules, suffixdedup, toxicity
from .common import doc_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(doc_id(), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(suffixdedup.remove_repeats(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = toxicity.fold(F.col("row.doc_id"), 3) == 1
    return found.select(doc_id(), held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qualityrules.quality_rules(table(spark, sf_dir, "documents"))
    return found.select(doc_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_language(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mil.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = toxicity.fold(F.col("row.doc_id"), 5) == 0
    return found.select(doc_id(), held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(table(spark, sf_dir, "documents")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(minhash.near_duplicates(table(spark, sf_dir, "documents"), ngram=4))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_suffix_array_dedup, op3_toxicity, op4_quality_rules, op5_lm_scoring, op6_quality_classifier, op7_line_dedup, op8_minhash_near_dedup, op9_benchmark_decontamination, op10_packing)}


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
TOKENS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + ", '[^\\x20\\x09-\\x0D]+')"

ORACLES = {
    "op2_suffix_array_dedup": """WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
 s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS p FROM d)),
 r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS turn FROM s) WHERE turn > 1),
 b AS (SELECT doc_id, p, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
 g AS (SELECT doc_id, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b),
 x AS (SELECT doc_id, run, min(p) AS lo, max(p) + 100 AS hi FROM g GROUP BY 1, 2),
 k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS next FROM x),
 a AS (SELECT d.doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)) || CASE WHEN next IS NULL THEN substr(h, 2 * hi + 1) ELSE '' END, '' ORDER BY lo) AS rest
  FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY 1)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id""",
    "op7_line_dedup": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
 l AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS i FROM d),
 k AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
 f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last IS NOT NULL AND doc_id <> last) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR doc_id = last), '')) AS kept_sha256 FROM k LEFT JOIN f ON f.key = k.key GROUP BY 1""",
    "op8_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {TOKENS} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r(v, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v),
 m AS (SELECT v, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept FROM w JOIN m ON m.v = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id""",
    "op9_benchmark_decontamination": f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
 p AS (SELECT DISTINCT item, len(g) AS m, array_to_string(g, ' ') AS g FROM (SELECT item, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 8 THEN [w] ELSE list_transform(range(1, len(w) - 6), lambda i: w[i:i + 7]) END) AS g FROM i)),
 d AS (SELECT doc_id, {WORDS} AS w FROM documents),
 x AS (SELECT doc_id, m, pos, array_to_string(w[pos:pos + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS pos FROM d CROSS JOIN (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
 h AS (SELECT doc_id, item, pos, x.m FROM x JOIN p ON p.m = x.m AND p.g = x.g),
 c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS q FROM h) GROUP BY 1),
 n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the others are held against plain versions in the tests."""
    return dict(ORACLES)
