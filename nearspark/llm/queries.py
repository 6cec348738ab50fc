"""Registered queries ``opN_<name>`` and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearspark.llm import (ann, decontam, divergence, idcodec, jaccard, langid, licenses, lmscore, packing,
                           quality, repair, toxicity, warc_chunks)
from nearspark.llm.repair_sql import REPAIR_SQL

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.round_trip(_table(spark, sf_dir, "pages"))


def op7_shard_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_table(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_token_id_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = idcodec.write_ids(_table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1)
    return idcodec.read_ids(chunks, digest_only=True)


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_segmentation_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs, PIECES))


def op8_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_TOKENIZER, capacity=2048, end_id=0)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.templates_table(spark))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lmscore.score(docs, *lmscore.fit(docs))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(_table(spark, sf_dir, "conversations"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingle_sql(name: str, source: str, key: str, clean: str) -> str:
    """CTEs ``{name}``(key, p, s): every shingle of every text with its word position."""
    return f"""
{name}_w AS (SELECT {key}, {clean} AS w FROM {source}),
{name} AS (
  SELECT {key}, p, array_to_string(w[p + 1:p + 5], ' ') AS s
  FROM (SELECT {key}, w, unnest(range(greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS p
        FROM {name}_w))"""


_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"
_TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_ALNUM = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _containment_sql(items: str, key: str, clean: str, columns: str) -> str:
    return f"""
WITH {items}{_shingle_sql('i', 'items', key, clean)},
{_shingle_sql('d', 'documents', 'doc_id', clean)},
iset AS (SELECT DISTINCT {key}, s FROM i),
isize AS (SELECT {key}, count(*) AS n FROM iset GROUP BY ALL),
dset AS (SELECT doc_id, s, min(p) AS p FROM d GROUP BY ALL),
m AS (SELECT doc_id, {key}, count(*) AS c, min(p) AS lo, max(p) AS hi
      FROM dset JOIN iset USING (s) GROUP BY ALL)
SELECT {columns} FROM m JOIN isize USING ({key}) WHERE 10 * c >= 8 * n"""


def _license_values() -> str:
    rows = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')"
                     for k, v in licenses.TEMPLATES.items())
    return f"items(license, text) AS (VALUES {rows}),"


QUERIES = {
    "op1_line_crf_quality": (op1_line_crf_quality, None),
    "op2_chunked_warc": (op2_chunked_warc, """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM r"""),
    "op4_token_id_codec": (op4_token_id_codec, None),
    "op5_ordinal_toxicity": (op5_ordinal_toxicity, None),
    "op6_segmentation_langid": (op6_segmentation_langid, None),
    "op7_shard_hnsw": (op7_shard_hnsw, None),
    "op8_bin_slack_packing": (op8_bin_slack_packing, None),
    "op3_license_scan": (op3_license_scan, _containment_sql(
        _license_values(), "license", _ALNUM,
        "doc_id, license, n::INTEGER AS n_template, c::INTEGER AS n_shared, lo::INTEGER AS start_word, "
        "(hi + 5)::INTEGER AS end_word")),
    "op9_ngram_jaccard": (op9_ngram_jaccard, None),
    "op10_decontamination": (op10_decontamination, _containment_sql(
        "items AS (SELECT item_id, text FROM benchmark),", "item_id", _WORDS,
        "doc_id, item_id, n::INTEGER AS n_item, c::INTEGER AS n_shared")),
    "op11_suffix_tree_score": (op11_suffix_tree_score, None),
    "op12_source_divergence": (op12_source_divergence, f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS terms
  FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
size AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grpn AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
g AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (g.n + v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (total + 1)) // (size.n + v)::HUGEINT AS q
  FROM grpn g JOIN size USING (lang) JOIN kept k USING (lang)
  LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
result AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM g WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM result QUALIFY part = 'pair' OR rank <= 200"""),
    "op13_conversation_repair": (op13_conversation_repair, REPAIR_SQL),
}
