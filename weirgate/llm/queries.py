"""The registered queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm import exact_dedup, langid, licenses, minhash_dedup, mixing, packing, quality, substring_dedup, toxicity, url_filter

SEQ_LEN, END_ID = 4096, 1
LABEL_FOLDS, LABEL_TEST = 4, 2  # op4 holds out this fold
LANG_FOLDS, LANG_TEST = 5, 0  # op5 holds out this fold
TOXIC_SCORE = 0.3
URL_RULES = (
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
)
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="weirgate-py-")) / "weirgate_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_documents(spark, sf_dir), k=4, threshold=0.8)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path(), END_ID, SEQ_LEN)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(_documents(spark, sf_dir))
    return entries.select("doc_id", *quality.MEASURES, quality.fails(quality.BASE).alias("base_failed"), (~quality.fails(quality.STANDARD)).alias("kept"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    fold = lambda c: F.coalesce(langid.fold(c, LABEL_FOLDS) == LABEL_TEST, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold(F.col("doc_id"))).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.fold(F.col("doc_id"), LANG_FOLDS) == LANG_TEST, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir), weights=(3, 1, 2), budget=1.5, cap=2.0)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(_documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir), keep="largest")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).drop("component")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_minhash_near_dedup, op2_best_fit_packing, op3_quality_rules, op4_toxicity, op5_language_id, op6_license_scan, op7_source_mixing, op8_substring_dedup, op9_exact_dedup, op10_url_filter)
    return {f.__name__: f for f in ops}


_OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
t AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER s AS b, lead(word, 2) OVER s AS c FROM p WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k.k) AS n_repeat_words FROM n, (VALUES (0), (1), (2)) k(k) WHERE n >= 2 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars > 25 * n_words OR word_chars < 2 * n_words) AS kept
FROM f
"""

_OP9 = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""




def _op6() -> str:
    rows, marks = [], licenses.anchors([n for ns in licenses.TEMPLATES.values() for n in ns])
    for name, notices in licenses.TEMPLATES.items():
        for n in notices:
            wanted = licenses.template_shingles(n)
            size = licenses.size_class(len(wanted))
            stride = max(1, size // 4)
            listed = ", ".join(f"'{x}'" for x in wanted)
            rows.append(f"('{name}', {stride}, {size + stride - 1}, [{listed}])")
    return f"""
WITH t(license, stride, n, wanted) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS tokens FROM documents WHERE regexp_matches(lower(text), '{"|".join(marks)}')),
c AS (SELECT DISTINCT stride, n FROM t),
b AS (SELECT doc_id, tokens, stride, n, unnest(range(0, len(tokens) - 4, stride)) AS first_word FROM d, c WHERE len(tokens) >= 5),
w AS (SELECT doc_id, stride, n, first_word, tokens[first_word + 1 : first_word + n + 4] AS words FROM b),
s AS (SELECT doc_id, stride, n, first_word, list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) AS shingles FROM w),
m AS (SELECT doc_id, license, first_word, len(list_intersect(wanted, shingles)) / len(wanted) AS containment FROM s JOIN t USING (stride, n) WHERE list_has_any(wanted, shingles))
SELECT doc_id, license, max(containment) AS containment, CAST(min(first_word) AS INTEGER) AS first_word FROM m WHERE containment >= 0.8 GROUP BY doc_id, license
"""


_OP10 = r"""
WITH RECURSIVE r(verdict, rule, rule_host, rule_path) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
parts AS (SELECT page_id, url, html,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
fits AS (SELECT page_id, max_by({'rule': rule, 'verdict': r.verdict}, length(rule)) AS fit FROM parts, r
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
nodes AS (SELECT p.*, fit, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/index)?(\.html?)?/*$', '')
  || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS node
  FROM (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)=')), '&') AS q FROM parts) p LEFT JOIN fits USING (page_id)),
links AS (SELECT node, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target FROM nodes WHERE regexp_matches(html, '(?i)canonical')),
edges AS (SELECT node AS a, regexp_replace(regexp_extract(target, '://([^/?#]*)', 1), '^www\.', '') || regexp_replace(regexp_extract(target, '://[^/?#]*([^?#]*)', 1), '(/index)?(\.html?)?/*$', '') AS b FROM links WHERE node IS NOT NULL AND target LIKE '%://%'),
near AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT DISTINCT node AS a, node AS b FROM nodes WHERE node IS NOT NULL UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
said AS (SELECT r.a AS node, bool_or(n.fit.verdict = 'allow') AS allow, bool_or(n.fit.verdict = 'block') AS block FROM reach r JOIN nodes n ON r.b = n.node WHERE n.fit IS NOT NULL GROUP BY r.a)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN allow THEN 'allow' WHEN block THEN 'block' END, 'allow') AS verdict FROM nodes LEFT JOIN said USING (node)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _OP3, "op6_license_scan": _op6(), "op9_exact_dedup": _OP9, "op10_url_filter": _OP10}
