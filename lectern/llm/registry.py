"""Queries of the training-data operators and, where SQL can say them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, decontamination, infill, langid, lines, mixing, passages, secrets, simhash, tokens, toxicity, urls, whitening
from lectern.llm.common import table


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The stages of corpus_pipeline.py, which lies beside the package and not in it."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {
    "op1_ann_learned_partitions": lambda spark, d: ann.search(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0),
    "op2_simhash_dedup": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op3_toxicity": lambda spark, d: toxicity.scored(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_secret_scan": lambda spark, d: secrets.scan_documents(table(spark, d, "documents")),
    "op5_decontamination": lambda spark, d: decontamination.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op6_source_mixing": lambda spark, d: mixing.mix(table(spark, d, "documents")),
    "op7_language_id": lambda spark, d: langid.identified(table(spark, d, "documents")),
    "op8_token_counts": lambda spark, d: tokens.count_tokens(table(spark, d, "documents")),
    "op9_repeated_passages": lambda spark, d: passages.repeated_passages(table(spark, d, "documents")),
    "op10_fuzzy_lines": lambda spark, d: lines.report(table(spark, d, "documents")),
    "op11_infill_transform": lambda spark, d: infill.digests(table(spark, d, "documents")),
    "op12_url_filter": lambda spark, d: urls.judged(table(spark, d, "pages"), urls.rule_table(spark)),
    "op13_embedding_whitening": lambda spark, d: whitening.whitened(table(spark, d, "embeddings")),
    "pipeline": pipeline,
    "secret_rescan": lambda spark, d: secrets.rescan_documents(table(spark, d, "documents")),
}
ORACLE_SQL: dict[str, str] = {
    # Every item of the table has five words or more.
    "op5_decontamination": r"""
WITH parts AS (
 SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
worded AS (
 SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{-\x7f]+') AS w FROM parts),
shingled AS (
 SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM worded WHERE len(w) >= 5),
sizes AS (SELECT id, count(*) AS n FROM shingled WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, min(n) AS shingles, count(*) / min(n) AS containment
FROM shingled d JOIN shingled i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id HAVING count(*) * 10 >= min(n) * 8""",
    "op11_infill_transform": r"""
WITH hashed AS (
 SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (
 SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM hashed),
cuts AS (
 SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
 FROM numbers)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t
  WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
  ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
 sha256(t) AS restored_sha256
FROM cuts""",
    # The operator's rules written out; host rules from the longest on.
    "op12_url_filter": r"""
WITH named AS (
 SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
 SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM named),
ruled AS (
 SELECT page_id, host, path,
  CASE WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
   WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
   WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
   WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
  (SELECT min('||' || w || '-') FROM unnest(['ads', 'adult', 'casino', 'cheap', 'free', 'spam']) AS x(w) WHERE contains('.' || host, '.' || w || '-')) AS any_pattern
 FROM parts)
SELECT page_id, host, path, rule,
 CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IN ('net/', 'example.com/de/') OR any_pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
 any_pattern AS pattern
FROM ruled""",
}
