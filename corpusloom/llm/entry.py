"""Queries of this subpackage for `__spark_entry__`: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, grammar_store, jaccard_join, languages, main_text, merkle, packing, passages, quality, toxicity, vantage, vector_codes, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_store.stored_documents(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_quality, op3_ngram_jaccard, op4_decontamination, op5_nearest_neighbours, op6_token_files, op7_warc, op8_packing, op9_substring_dedup, op10_main_text, op11_merkle_manifest, op12_language_id, op13_vector_codes]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Queries whose whole result SQL can give; the rest is held against brute force in tests/llm."""
    return {"op4_decontamination": DECONTAMINATION_SQL, "op11_merkle_manifest": MERKLE_SQL, "op13_vector_codes": CODES_SQL}


DECONTAMINATION_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS phrase
  FROM (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: w[i:i + 9])) AS x FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths)),
found AS (SELECT d.doc_id, d.i, d.n, w.item_id FROM doc_windows d JOIN windows w USING (n, phrase)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_LEAF = "sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || coalesce(strlen(TEXT) || ':' || TEXT, '-'))"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of the trees over leaves (tree, i, d), their tops, and what is beside each node in its run."""
    return f"""{name}_nodes AS (SELECT tree, 0 AS level, i, d, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL SELECT tree, level + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (n + 15) // 16 FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, i // 16, n),
{name}_top AS (SELECT tree, d FROM {name}_nodes WHERE n = 1),
{name}_beside AS (SELECT tree, level, i, coalesce(string_agg(d, '') OVER (PARTITION BY tree, level, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(d, '') OVER (PARTITION BY tree, level, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}_nodes WHERE n > 1),
{name}_ways AS (SELECT tree, i AS leaf, level, i, before, after FROM {name}_beside WHERE level = 0
  UNION ALL SELECT w.tree, leaf, b.level, b.i, b.before, b.after FROM {name}_ways w JOIN {name}_beside b ON b.tree = w.tree AND b.level = w.level + 1 AND b.i = w.i // 16)"""


MERKLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)) AS v FROM range(256) r(i))),
hashed AS (SELECT doc_id, coalesce('1' || source, '0') AS source, {_LEAF.replace("TEXT", "text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.replace("TEXT", _LOWER)} END AS tampered FROM documents, crc),
placed AS (SELECT doc_id, leaf, coalesce(tampered, leaf) AS changed, dense_rank() OVER (ORDER BY source) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
own AS (SELECT tree, i, leaf AS d FROM placed),
{_tree_sql("low", "own")},
roots AS (SELECT 0 AS tree, tree AS i, d FROM low_top),
{_tree_sql("high", "roots")},
ways AS (SELECT tree, leaf AS i, level, before, after FROM low_ways UNION ALL SELECT p.tree, p.i, 1000 + level, before, after FROM placed p JOIN high_ways h ON h.leaf = p.tree),
steps AS (SELECT tree, i, list({{'b': before, 'a': after}} ORDER BY level) AS s, string_agg(before || after, '' ORDER BY level) AS joined FROM ways GROUP BY tree, i),
folded AS (SELECT doc_id, leaf, p.tree, sha256(coalesce(joined, '')) AS proof_sha256,
  list_reduce(list_prepend({{'b': changed, 'a': ''}}, coalesce(s, [])), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root FROM placed p LEFT JOIN steps USING (tree, i))
SELECT doc_id, leaf, l.d AS subroot, h.d AS root, proof_sha256, folded_root, folded_root = h.d AS verified FROM folded f JOIN low_top l USING (tree) CROSS JOIN high_top h
"""


def _round_sql(before: str, after: str) -> str:
    return f"""{before}_near AS MATERIALIZED (SELECT r, pos, any_value(p.x) AS x, min(CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + k) AS best FROM parts p JOIN {before} c USING (pos) GROUP BY r, pos),
{before}_means AS (SELECT pos, k, list(m ORDER BY i) AS x FROM (SELECT pos, best % 64 AS k, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM {before}_near, (SELECT unnest([1, 2, 3, 4]) AS i) GROUP BY ALL) GROUP BY pos, k),
{after} AS MATERIALIZED (SELECT pos, k, coalesce(m.x, c.x) AS x FROM {before} c LEFT JOIN {before}_means m USING (pos, k))"""


CODES_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, pos, v[pos * 4 + 1:pos * 4 + 4] AS x FROM kept, (SELECT unnest(range(16)) AS pos)),
c0 AS MATERIALIZED (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS k, x FROM parts QUALIFY k < 64),
{_round_sql("c0", "c1")},
{_round_sql("c1", "c2")},
last AS (SELECT r, pos, min(CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + k) AS best FROM parts p JOIN c2 c USING (pos) GROUP BY r, pos),
coded AS (SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY pos) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM last GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, k)) AS h FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r) CROSS JOIN book
"""
