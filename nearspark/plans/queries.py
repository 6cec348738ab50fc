"""Named queries over the driver tables, each with its DuckDB oracle.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Every query reads whole tables; pair queries use the library's pruned plans,
oracles use brute force. Floats are rounded to 6 places on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspark.functions import text as tx
from nearspark.functions.hashing import md5_mod, term_hash32
from nearspark.llm.staging import partitions_for
from nearspark.operators import cosine as CS
from nearspark.operators import evaluate as EV
from nearspark.operators import graph as GR
from nearspark.operators import lsa as LS
from nearspark.operators import minhash as MH
from nearspark.operators import pairs as PR
from nearspark.operators import simhash as SH
from nearspark.operators import text as TX
from nearspark.operators import weights as WT
from nearspark.operators.counts import StageCounts, rows
from nearspark.plans import oracle_sql as O
from nearspark.plans import workflow as WF
from nearspark.session import materialize, shared_path
from nearspark.sources import index as IX
from nearspark.sources import pages as PG
from nearspark.sources import warc as WA

QUERIES: dict[str, tuple] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def one_bag(spark: SparkSession, sf_dir: str, stem: bool = False) -> DataFrame:
    """The documents' bag, for queries that read it once; it has as many parts as its texts need."""
    docs = read(spark, sf_dir, "documents")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return TX.bag_of_words(docs, "doc_id", "text", stem=stem, partitions=partitions_for(spark, n_bytes))


def doc_bag(spark: SparkSession, sf_dir: str, stem: bool = False) -> DataFrame:
    """The documents' bag, checkpointed for pipelines that read it several times
    (corpus size, document frequencies, weights)."""
    return materialize(one_bag(spark, sf_dir, stem), keep_partitioning=True)


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ------------------------------------------------------------------ MinHash ---

@register("minhash_pairs", O.minhash_pairs_sql())
def minhash_pairs(spark, sf_dir):
    pairs = MH.minhash_pairs(one_bag(spark, sf_dir), "doc_id")
    return pairs.select("id1", "id2", r6("value"))


def doc_vectors(spark, sf_dir, stem: bool = False):
    """Bag and smoothed L2 TF-IDF vectors of the documents (the label input)."""
    bag = doc_bag(spark, sf_dir, stem)
    return bag, WT.tfidf_l2(bag, "doc_id")


def doc_labels(spark, sf_dir, threshold: float = 0.8, stem: bool = False):
    """Components of the TF-IDF cosine graph (> threshold) over non-empty documents."""
    bag, vecs = doc_vectors(spark, sf_dir, stem)
    return labels_of(bag, vecs, "doc_id", threshold)


def labels_of(bag, vecs, id_col: str, threshold: float = 0.8):
    """Components over links: equal bags hang on one of them, so no clique of copies is written."""
    classes = materialize(CS.equal_classes(bag, id_col))
    links = CS.cosine_links(vecs, classes, id_col, threshold, strict=True)
    nodes, edges = GR.similarity_graph(links, classes, id_col, threshold, strict=True)
    return GR.connected_components(nodes, edges)


def cosine_pairs(bag, vecs, id_col: str, threshold: float = 0.8, strict: bool = False):
    classes = materialize(CS.equal_classes(bag, id_col))
    return CS.sparse_cosine_pairs(vecs, id_col, threshold, strict, classes=classes)


# ---------------------------------------------------------- text and bags ---

@register("clean_text", O.clean_text_sql())
def clean_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@register("tokens", O.tokens_sql())
def tokens(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    tk = tx.tokens(tx.clean_text(F.col("text")))
    return d.select("doc_id", F.size(tk).alias("n_tokens"), F.array_join(tk, " ").alias("tokens"))


@register("bag_of_words", O.bag_sql())
def bag_of_words(spark, sf_dir):
    return one_bag(spark, sf_dir)


@register("nonempty_docs", f"WITH {O.doc_bag_cte()} SELECT DISTINCT id AS doc_id FROM bag")
def nonempty_docs(spark, sf_dir):
    return one_bag(spark, sf_dir).select("doc_id").distinct()


@register("flatten_bag", f"""WITH {O.doc_bag_cte()}
SELECT id AS doc_id, term || k::VARCHAR AS feature
FROM (SELECT id, term, unnest(range(1, tf + 1)) AS k FROM bag)""")
def flatten_bag(spark, sf_dir):
    return TX.flatten_bag(one_bag(spark, sf_dir), "doc_id")


@register("idf_raw", f"""WITH {O.doc_bag_cte()}, {O.idf_raw_cte()}
SELECT term, df, round(idf, 6) AS idf FROM idf""")
def idf_raw(spark, sf_dir):
    return WT.idf_raw(doc_bag(spark, sf_dir), "doc_id").select("term", "df", r6("idf"))


@register("tfidf_raw", f"""WITH {O.doc_bag_cte()}, {O.idf_raw_cte()}
SELECT id AS doc_id, term, round(weight, 6) AS weight FROM wts""")
def tfidf_raw(spark, sf_dir):
    return WT.tfidf_raw(doc_bag(spark, sf_dir), "doc_id").select("doc_id", "term", r6("weight"))


@register("tfidf_l2", f"""WITH {O.doc_bag_cte()}, {O.tfidf_l2_cte()}
SELECT id AS doc_id, term, round(w, 6) AS w FROM vec""")
def tfidf_l2(spark, sf_dir):
    return WT.tfidf_l2(doc_bag(spark, sf_dir), "doc_id").select("doc_id", "term", r6("w"))


# ------------------------------------------------------ MinHash internals ---

@register("feature_hash", f"""WITH {O.doc_bag_cte()}
SELECT id AS doc_id, term || k::VARCHAR AS feature, {O.md5_mod_sql("term || k::VARCHAR")} AS x
FROM (SELECT id, term, unnest(range(1, tf + 1)) AS k FROM bag)""")
def feature_hash(spark, sf_dir):
    f = TX.flatten_bag(one_bag(spark, sf_dir), "doc_id")
    return f.select("doc_id", "feature", md5_mod(F.col("feature")).alias("x"))


@register("minhash_sig", f"""WITH {O.doc_bag_cte()}, {O.minhash_sig_cte()}
SELECT id AS doc_id, string_agg(h::VARCHAR, ',' ORDER BY i) AS signature FROM sigl GROUP BY id""")
def minhash_sig(spark, sf_dir):
    s = MH.signatures(one_bag(spark, sf_dir), "doc_id")
    return s.select("doc_id", F.array_join("signature", ",").alias("signature"))


@register("lsh_index", f"""WITH {O.doc_bag_cte()}, {O.minhash_sig_cte()},
sig AS (SELECT id, list(h ORDER BY i) AS s FROM sigl GROUP BY id)
SELECT band, md5('(' || array_to_string(list_slice(s, band * 8 + 1, band * 8 + 8), ', ') || ')') AS bucket,
       id AS doc_id
FROM sig, range(16) t(band)""")
def lsh_index(spark, sf_dir):
    return MH.lsh_index(MH.signatures(one_bag(spark, sf_dir), "doc_id"), "doc_id", 16, 8)


@register("lsh_probe", f"""WITH {O.doc_bag_cte()}, {O.minhash_sig_cte()},
sig AS (SELECT id, list(h ORDER BY i) AS s FROM sigl GROUP BY id),
idx AS (
  SELECT band, md5('(' || array_to_string(list_slice(s, band * 8 + 1, band * 8 + 8), ', ') || ')') AS bucket, id
  FROM sig, range(16) t(band))
SELECT DISTINCT a.id AS probe_id, b.id AS doc_id FROM idx a JOIN idx b USING (band, bucket)""")
def lsh_probe(spark, sf_dir):
    """Every document probes an index holding every document (itself included)."""
    sigs = materialize(MH.signatures(one_bag(spark, sf_dir), "doc_id"))
    index = MH.lsh_index(sigs, "doc_id", 16, 8)
    return MH.lsh_probe(index, sigs.withColumnRenamed("doc_id", "probe_id"), "doc_id", "probe_id")


@register("minhash_candidates", f"""WITH {O.doc_bag_cte()}, {O.minhash_sig_cte()},
matches AS (SELECT a.id AS id1, b.id AS id2, a.i FROM sigl a JOIN sigl b ON a.i = b.i AND a.h = b.h AND a.id < b.id),
per_band AS (SELECT id1, id2, i // 8 AS band, count(*) AS c FROM matches GROUP BY id1, id2, i // 8),
shared AS (SELECT DISTINCT id1, id2 FROM per_band WHERE c = 8),
scored AS (SELECT id1, id2, count(*) AS m FROM matches GROUP BY id1, id2)
SELECT s.id1, s.id2, round(m / (256.0 - m), 6) AS value FROM scored s JOIN shared USING (id1, id2)""")
def minhash_candidates(spark, sf_dir):
    """Every LSH candidate pair with its signature similarity (no threshold)."""
    pairs = MH.minhash_pairs(one_bag(spark, sf_dir), "doc_id", jaccard_threshold=0.0)
    return pairs.select("id1", "id2", r6("value"))


# ---------------------------------------------------------------- SimHash ---

@register("simhash_fp", f"""WITH {O.doc_bag_cte()}, {O.idf_raw_cte()}, {O.simhash_fp_cte(64)}
SELECT id AS doc_id, votes, tail FROM fp""")
def simhash_fp(spark, sf_dir):
    feats = SH.weighted_features(doc_bag(spark, sf_dir), "doc_id", "md5")
    return SH.fingerprints(feats, "doc_id", 64).select("doc_id", "votes", "tail")


@register("simhash_pairs", O.simhash_pairs_sql(64, 3))
def simhash_pairs(spark, sf_dir):
    feats = SH.weighted_features(doc_bag(spark, sf_dir), "doc_id", "md5")
    fps = SH.fingerprints(feats, "doc_id", 64)
    return SH.simhash_pairs(fps, "doc_id", 64, 3)


@register("simhash_pairs_32", O.simhash_pairs_sql(32, 6))
def simhash_pairs_32(spark, sf_dir):
    feats = SH.weighted_features(doc_bag(spark, sf_dir), "doc_id", "md5")
    return SH.simhash_pairs(SH.fingerprints(feats, "doc_id", 32), "doc_id", 32, 6)


# ------------------------------------------------- cosine, graph, labels ---

@register("tfidf_cosine_pairs", f"""WITH {O.doc_bag_cte()}, {O.tfidf_l2_cte()}, {O.cosine_pairs_cte(0.8, False)}
SELECT id1, id2, round(value, 6) AS value FROM edges""")
def tfidf_cosine_pairs(spark, sf_dir):
    return cosine_pairs(*doc_vectors(spark, sf_dir), "doc_id").select("id1", "id2", r6("value"))


@register("lsa_pairs", f"""WITH {O.doc_bag_cte()}, {O.tfidf_l2_cte()}, {O.cosine_pairs_cte(0.8, False)}
SELECT id1, id2, round(value, 6) AS value FROM edges""")
def lsa_pairs(spark, sf_dir):
    """LSA with all components: at full rank, LSA cosine = TF-IDF cosine."""
    bag, vecs = doc_vectors(spark, sf_dir)
    return LS.lsa_pairs(bag, "doc_id", cosine_threshold=0.8, method="full_rank") \
        .select("id1", "id2", r6("value"))


@register("similarity_graph", f"""WITH {O.doc_bag_cte()}, {O.tfidf_l2_cte()}, {O.cosine_pairs_cte(0.8, True)}
SELECT id1 AS src, id2 AS dst, round(value, 6) AS weight FROM edges""")
def similarity_graph(spark, sf_dir):
    bag, vecs = doc_vectors(spark, sf_dir)
    pairs = cosine_pairs(bag, vecs, "doc_id", strict=True)
    _nodes, edges = GR.similarity_graph(pairs, bag, "doc_id", 0.8)
    return edges.select("src", "dst", r6("weight"))


LABEL_CTES = f"{O.doc_bag_cte()}, {O.tfidf_l2_cte()}, {O.cosine_pairs_cte(0.8, True)}, {O.components_cte()}"


@register("components", f"WITH RECURSIVE {LABEL_CTES} SELECT id, component FROM comps")
def components(spark, sf_dir):
    return doc_labels(spark, sf_dir)


@register("pseudo_labels", f"""WITH RECURSIVE {LABEL_CTES}
SELECT a.id AS id1, b.id AS id2 FROM comps a JOIN comps b ON a.component = b.component AND a.id < b.id""")
def pseudo_labels(spark, sf_dir):
    return GR.pseudo_labels(doc_labels(spark, sf_dir)).select("id1", "id2")


# ------------------------------------------------------------- evaluation ---

def _eval_sql(results_cte: str, min_value: float = 0.6) -> str:
    return f"""WITH RECURSIVE {LABEL_CTES}, {results_cte},
hits AS (
  SELECT count(*) AS h FROM res r JOIN comps a ON r.id1 = a.id JOIN comps b ON r.id2 = b.id
  WHERE a.component = b.component AND r.value >= {min_value}
),
labels AS (SELECT sum(m * (m - 1) / 2)::BIGINT AS n FROM (SELECT count(*) AS m FROM comps GROUP BY component))
SELECT (SELECT count(*) FROM res) AS n_results, (SELECT n FROM labels) AS n_labels, (SELECT h FROM hits) AS hits,
  round((SELECT h FROM hits)::DOUBLE / nullif((SELECT count(*) FROM res), 0), 6) AS precision,
  round((SELECT h FROM hits)::DOUBLE / nullif((SELECT n FROM labels), 0), 6) AS recall"""


def _eval_out(df):
    return df.select("n_results", "n_labels", "hits", r6("precision"), r6("recall"))


@register("eval_minhash", _eval_sql(O.minhash_res_cte()))
def eval_minhash(spark, sf_dir):
    bag, vecs = doc_vectors(spark, sf_dir)
    comps = labels_of(bag, vecs, "doc_id")
    res = MH.minhash_pairs(bag, "doc_id")
    return _eval_out(EV.evaluate(res, comps))


@register("eval_minhash_direct", f"""WITH {O.doc_bag_cte()}, {O.tfidf_l2_cte()}, {O.cosine_pairs_cte(0.8, True)}, {O.minhash_res_cte()},
hits AS (SELECT count(*) AS h FROM res JOIN edges USING (id1, id2) WHERE res.value >= 0.6),
labels AS (SELECT count(*) AS n FROM edges)
SELECT (SELECT count(*) FROM res) AS n_results, (SELECT n FROM labels) AS n_labels, (SELECT h FROM hits) AS hits,
  round((SELECT h FROM hits)::DOUBLE / nullif((SELECT count(*) FROM res), 0), 6) AS precision,
  round((SELECT h FROM hits)::DOUBLE / nullif((SELECT n FROM labels), 0), 6) AS recall""")
def eval_minhash_direct(spark, sf_dir):
    """MinHash pairs against the cosine pairs themselves: labels without the closure over components."""
    bag, vecs = doc_vectors(spark, sf_dir)
    labels = cosine_pairs(bag, vecs, "doc_id", strict=True)
    return _eval_out(EV.evaluate_pairs(MH.minhash_pairs(bag, "doc_id"), labels))


@register("minhash_pairs_match_fraction", f"""WITH {O.doc_bag_cte()}, {O.minhash_sig_cte()},
mt AS (SELECT a.id AS id1, b.id AS id2, a.i FROM sigl a JOIN sigl b ON a.i = b.i AND a.h = b.h AND a.id < b.id),
sh AS (SELECT DISTINCT id1, id2 FROM (SELECT id1, id2, i // 8 AS band, count(*) AS c FROM mt GROUP BY ALL) WHERE c = 8),
sc AS (SELECT id1, id2, count(*) AS m FROM mt GROUP BY ALL)
SELECT id1, id2, round(m / 128.0, 6) AS value FROM sc JOIN sh USING (id1, id2) WHERE m / 128.0 >= 0.6""")
def minhash_pairs_match_fraction(spark, sf_dir):
    """Pairs by the share of equal signature positions, the unbiased estimate of their Jaccard similarity."""
    pairs = MH.minhash_pairs(one_bag(spark, sf_dir), "doc_id", estimator="match_fraction")
    return pairs.select("id1", "id2", r6("value"))


@register("eval_simhash", _eval_sql("""
{fp},
res AS (
  SELECT id1, id2, value FROM (
    SELECT a.id AS id1, b.id AS id2, bit_count(xor(a.votes, b.votes))
           + CASE WHEN a.tail <> b.tail THEN 32 ELSE 0 END AS value
    FROM fp a JOIN fp b ON a.id < b.id) WHERE value <= 3
)""".replace("{fp}", O.idf_raw_cte() + ",\n" + O.simhash_fp_cte(64))))
def eval_simhash(spark, sf_dir):
    bag, vecs = doc_vectors(spark, sf_dir)
    comps = labels_of(bag, vecs, "doc_id")
    feats = SH.weighted_features(bag, "doc_id", "md5")
    res = SH.simhash_pairs(SH.fingerprints(feats, "doc_id", 64), "doc_id", 64, 3)
    return _eval_out(EV.evaluate(res, comps))


@register("eval_lsa", _eval_sql(
    "res AS (SELECT id1, id2, value FROM cos WHERE value >= 0.8)"))
def eval_lsa(spark, sf_dir):
    bag, vecs = doc_vectors(spark, sf_dir)
    comps = labels_of(bag, vecs, "doc_id")
    res = LS.lsa_pairs(bag, "doc_id", cosine_threshold=0.8, method="full_rank")
    return _eval_out(EV.evaluate(res, comps))


# ------------------------------------------------------------------ pages ---

def page_bag(spark, sf_dir, weight: bool = False, stem: bool = False):
    return materialize(TX.page_bags(read(spark, sf_dir, "pages"), "url", "html",
                                    weight=weight, stem=stem))


def _token_string(c):
    toks = F.split(F.trim(tx.clean_text(c)), " +")
    return F.array_join(F.filter(toks, lambda t: F.length(t) > 0), " ")


@register("extract_fields", O.extract_fields_sql())
def extract_fields(spark, sf_dir):
    f = TX.extract_fields(read(spark, sf_dir, "pages").select("url", "html"))
    return f.select("url", _token_string(F.col("heavy")).alias("heavy_tokens"),
                    _token_string(F.col("light")).alias("light_tokens"))


@register("page_bag", f"WITH {O.page_bag_cte(False)} SELECT id AS url, term, tf FROM bag")
def page_bag_q(spark, sf_dir):
    return page_bag(spark, sf_dir).withColumnRenamed("doc_id", "url")


@register("bag_weighted", f"WITH {O.page_bag_cte(True)} SELECT id AS url, term, tf FROM bag")
def bag_weighted(spark, sf_dir):
    return page_bag(spark, sf_dir, weight=True)


@register("page_minhash_pairs", f"""WITH {O.page_bag_cte(False)}, {O.minhash_res_cte()}
SELECT id1, id2, round(value, 6) AS value FROM res""")
def page_minhash_pairs(spark, sf_dir):
    pairs = MH.minhash_pairs(page_bag(spark, sf_dir), "url")
    return pairs.select("id1", "id2", r6("value"))


@register("page_simhash_pairs", f"""WITH {O.page_bag_cte(True)}, {O.idf_raw_cte()}, {O.simhash_fp_cte(64)},
d AS (SELECT a.id AS id1, b.id AS id2, bit_count(xor(a.votes, b.votes))
             + CASE WHEN a.tail <> b.tail THEN 32 ELSE 0 END AS value
      FROM fp a JOIN fp b ON a.id < b.id)
SELECT id1, id2, value::INTEGER AS value FROM d WHERE value <= 3""")
def page_simhash_pairs(spark, sf_dir):
    """SimHash over weighted page bags (heavy text counted twice)."""
    feats = SH.weighted_features(page_bag(spark, sf_dir, weight=True), "url", "md5")
    return SH.simhash_pairs(SH.fingerprints(feats, "url", 64), "url", 64, 3)


@register("page_labels", f"""WITH RECURSIVE {O.page_bag_cte(False)}, {O.tfidf_l2_cte()}, {O.cosine_pairs_cte(0.8, True)},
{O.components_cte()}
SELECT id AS url, component FROM comps""")
def page_labels(spark, sf_dir):
    bag = page_bag(spark, sf_dir)
    return labels_of(bag, WT.tfidf_l2(bag, "url"), "url").withColumnRenamed("id", "url")


# ----------------------------------------------------------------- ingest ---
# Index records are derived from ``pages`` the same way on both sides:
# language from the URL path, status 301 for URLs with a query string,
# no language field on mobile hosts, a second language when the URL has a
# fragment, offsets from page_id.

_LANG = "regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1)"
_IDX_SQL = f"""
idx AS (
  SELECT url, 'text/html' AS mime,
    CASE WHEN contains(url, '?') THEN '301' ELSE '200' END AS status,
    CASE WHEN regexp_matches(url, '^[a-z]+://m[.]') THEN NULL
         WHEN contains(url, '#') THEN code || ',fra' ELSE code END AS languages,
    'UTF-8' AS encoding, 'crawl/' || lang || '.warc.gz' AS filename,
    (page_id * 100000)::VARCHAR AS "offset", length(html)::VARCHAR AS length
  FROM (SELECT *, {_LANG} AS lang,
          CASE {_LANG} WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu'
                       WHEN 'es' THEN 'spa' END AS code FROM pages)
)"""
_IDX_COLS = 'url, mime, status, languages, encoding, filename, "offset", length'


def index_lines(spark, sf_dir):
    """JSON index lines built from ``pages`` (fields are strings, nulls omitted)."""
    p = read(spark, sf_dir, "pages")
    lang = F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})/", 1)
    code = (F.when(lang == "en", "eng").when(lang == "fr", "fra").when(lang == "de", "deu")
            .when(lang == "es", "spa"))
    languages = (F.when(F.col("url").rlike(r"^[a-z]+://m[.]"), F.lit(None))
                 .when(F.col("url").contains("#"), F.concat(code, F.lit(",fra"))).otherwise(code))
    rec = F.struct(
        F.col("url"), F.lit("text/html").alias("mime"),
        F.when(F.col("url").contains("?"), "301").otherwise("200").alias("status"),
        languages.alias("languages"), F.lit("UTF-8").alias("encoding"),
        F.concat(F.lit("crawl/"), lang, F.lit(".warc.gz")).alias("filename"),
        (F.col("page_id") * 100000).cast("string").alias("offset"),
        F.length("html").cast("string").alias("length"))
    return p.select(F.to_json(rec).alias("line"))


@register("index_scan", f"WITH {_IDX_SQL} SELECT {_IDX_COLS} FROM idx")
def index_scan(spark, sf_dir):
    return IX.parse_index_lines(index_lines(spark, sf_dir))


@register("index_file_scan", f"""WITH {_IDX_SQL}
SELECT {_IDX_COLS}, NULL AS corrupt FROM idx
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no json ' || page_id FROM pages WHERE contains(url, '?')""")
def index_file_scan(spark, sf_dir):
    """Index files of JSON lines on shared storage, some lines corrupt, read with the fixed schema."""
    path = shared_path(spark, "index")
    bad = read(spark, sf_dir, "pages").filter(F.contains(F.col("url"), F.lit("?"))).select(
        F.concat(F.lit("no json "), F.col("page_id").cast("string")).alias("line"))
    index_lines(spark, sf_dir).unionByName(bad).select(F.col("line").alias("value")).write.text(path)
    return IX.read_index(spark, path, corrupt_col="corrupt")


@register("index_filter", f"""WITH {_IDX_SQL} SELECT {_IDX_COLS} FROM idx
WHERE starts_with(url, 'https') AND mime = 'text/html' AND status = '200'
  AND languages = 'eng' AND encoding = 'UTF-8'""")
def index_filter(spark, sf_dir):
    return IX.filter_index(IX.parse_index_lines(index_lines(spark, sf_dir)))


@register("domain_filter", f"""WITH {_IDX_SQL},
h AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM idx)
SELECT {_IDX_COLS} FROM h WHERE host = 'example.com' OR ends_with(host, '.example.com')""")
def domain_filter(spark, sf_dir):
    return IX.domain_filter(IX.parse_index_lines(index_lines(spark, sf_dir)), "example.com")


@register("byte_ranges", f"""WITH {_IDX_SQL}
SELECT {_IDX_COLS}, "offset"::BIGINT AS start, "offset"::BIGINT + length::BIGINT - 1 AS "end",
  'bytes=' || "offset" || '-' || ("offset"::BIGINT + length::BIGINT - 1)::VARCHAR AS range
FROM idx WHERE starts_with(url, 'https') AND mime = 'text/html' AND status = '200'
  AND languages = 'eng' AND encoding = 'UTF-8'""")
def byte_ranges(spark, sf_dir):
    return IX.byte_ranges(IX.filter_index(IX.parse_index_lines(index_lines(spark, sf_dir))))


def _duplicated_pages(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    first = p.select("url", "html", F.lit("crawl/a.warc.gz").alias("filename"),
                     (F.col("page_id") * 100000).alias("offset"))
    second = p.select("url", F.concat("html", F.lit("<!-- copy -->")).alias("html"),
                      F.when(F.col("url").contains("?"), "crawl/0.warc.gz")
                      .otherwise("crawl/a.warc.gz").alias("filename"),
                      (F.col("page_id") * 100000 + 50000).alias("offset"))
    return first.unionByName(second)


@register("dedupe_url", """WITH d AS (
  SELECT url, html, 'crawl/a.warc.gz' AS filename, page_id * 100000 AS "offset" FROM pages
  UNION ALL
  SELECT url, html || '<!-- copy -->',
         CASE WHEN contains(url, '?') THEN 'crawl/0.warc.gz' ELSE 'crawl/a.warc.gz' END,
         page_id * 100000 + 50000 FROM pages)
SELECT url, html, filename, "offset" FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY filename, "offset") AS rn FROM d) WHERE rn = 1""")
def dedupe_url(spark, sf_dir):
    return PG.dedupe_urls(_duplicated_pages(spark, sf_dir))


@register("insert_or_ignore", """SELECT url,
  CASE WHEN contains(url, '?') THEN html || '<!-- copy -->' ELSE html END AS html FROM pages""")
def insert_or_ignore(spark, sf_dir):
    """Two loads that overlap, the second one repeated: URLs without a query string come with the first,
    all with the second, whose copies of stored URLs are ignored."""
    path = shared_path(spark, "page-store")
    both = _duplicated_pages(spark, sf_dir)
    copy = F.endswith(F.col("html"), F.lit("<!-- copy -->"))
    PG.insert_or_ignore(both.filter(~copy & ~F.contains(F.col("url"), F.lit("?"))), path, load=1)
    for _ in range(2):
        PG.insert_or_ignore(both.filter(copy), path, load=2)
    return PG.read_pages(spark, path)


def _warc_roundtrip(spark, sf_dir, broken_every: int = 0):
    out = shared_path(spark, "warc")
    index = materialize(WA.write_warc(read(spark, sf_dir, "pages"), out,
                                      broken_every=broken_every))
    plan = IX.byte_ranges(index)
    return plan, WA.fetch_records(plan)


@register("warc_pages", "SELECT url, html FROM pages")
def warc_pages(spark, sf_dir):
    """pages -> .warc.gz files (shared folder) -> byte-range fetch -> first-wins pages."""
    _plan, fetched = _warc_roundtrip(spark, sf_dir)
    good = fetched.filter(F.col("error").isNull())
    return PG.dedupe_urls(good.select("url", "html", "filename", "offset")).select("url", "html")


@register("warc_skips", """SELECT 2 * count(*) AS planned, count_if(page_id % 7 <> 0) AS pages,
  count_if(page_id % 7 = 0) AS skipped FROM pages""")
def warc_skips(spark, sf_dir):
    """Planned records, pages read and records skipped, where the response of every 7th page id is corrupt;
    counted while the pages are written, without a second fetch."""
    counts = StageCounts()
    pages = read(spark, sf_dir, "pages").withColumn("broken", F.col("page_id") % 7 == 0)
    index = counts.taken(WA.write_warc(pages, shared_path(spark, "warc"), broken_col="broken"), planned=rows())
    counts.taken(WA.fetch_records(IX.byte_ranges(index)), pages=F.count("url"), skipped=F.count("error"))
    n = counts.numbers
    return spark.createDataFrame([(n["planned"], n["pages"], n["skipped"])], "planned long, pages long, skipped long")


@register("saved_pairs", _eval_sql(O.minhash_res_cte()))
def saved_pairs(spark, sf_dir):
    """Stored pairs, bucketed and sorted by their first id, read back and evaluated."""
    bag, vecs = doc_vectors(spark, sf_dir)
    comps = labels_of(bag, vecs, "doc_id")
    table = "pairs_" + uuid.uuid4().hex
    PG.save_pairs(MH.minhash_pairs(bag, "doc_id"), shared_path(spark, "pairs"), table=table)
    return _eval_out(EV.evaluate(PG.load_pairs(spark, table=table), comps))


def _eval_pages(spark, sf_dir, method: str, **options):
    bag = WF.page_bag(read(spark, sf_dir, "pages"), method)
    return _eval_out(WF.run(bag, method, "url", shared_path(spark, f"run-{method}"), **options))


_PAGE_LABELS = f"{O.page_bag_cte(False)}, {O.tfidf_l2_cte()}, {O.cosine_pairs_cte(0.8, True)}, {O.components_cte()}"


@register("eval_pages_minhash", _eval_sql(O.minhash_res_cte()).replace(LABEL_CTES, _PAGE_LABELS))
def eval_pages_minhash(spark, sf_dir):
    """Pages end to end by method name: bag, detect, rank, save, label, evaluate."""
    return _eval_pages(spark, sf_dir, "minhash_lsh")


@register("eval_pages_lsa", _eval_sql("res AS (SELECT id1, id2, value FROM cos WHERE value >= 0.8)")
          .replace(LABEL_CTES, _PAGE_LABELS))
def eval_pages_lsa(spark, sf_dir):
    """The same with LSA over all components."""
    return _eval_pages(spark, sf_dir, "latent_semantic", cosine_threshold=0.8, all_components=True)


@register("stage_counts_all", f"""WITH RECURSIVE {LABEL_CTES}, {O.minhash_res_cte()}
SELECT 'bag_rows' AS stage, count(*) AS n FROM bag
UNION ALL SELECT 'features', sum(tf)::BIGINT FROM bag
UNION ALL SELECT 'signatures', count(DISTINCT id) FROM bag
UNION ALL SELECT 'index_entries', 16 * count(DISTINCT id) FROM bag
UNION ALL SELECT 'pairs', count(*) FROM res
UNION ALL SELECT 'label_nodes', count(*) FROM comps
UNION ALL SELECT 'components', count(DISTINCT component) FROM comps
UNION ALL SELECT 'labels', (sum(m * (m - 1)) // 2)::BIGINT
          FROM (SELECT count(*) AS m FROM comps GROUP BY component)""")
def stage_counts_all(spark, sf_dir):
    """Sizes of all stages of a MinHash run over the documents, taken while the stages run."""
    counts = StageCounts()
    WF.run(one_bag(spark, sf_dir), "minhash_lsh", "doc_id", shared_path(spark, "run-counts"), counts=counts)
    return counts.frame(spark)


@register("page_scan", "SELECT url, html FROM pages")
def page_scan(spark, sf_dir):
    path = shared_path(spark, "pages")
    PG.write_pages(read(spark, sf_dir, "pages"), path)
    return PG.read_pages(spark, path)


# ------------------------------------------------------- shared / reports ---

@register("ranked_pairs", f"""WITH {O.doc_bag_cte()}, {O.minhash_res_cte()}
SELECT id1, id2, round(value, 6) AS value,
       row_number() OVER (ORDER BY value DESC, id1, id2) AS rank FROM res""")
def ranked_pairs(spark, sf_dir):
    pairs = MH.minhash_pairs(one_bag(spark, sf_dir), "doc_id")
    return PR.rank_pairs(pairs, ascending=False).select("id1", "id2", r6("value"), "rank")


@register("stage_counts", f"""WITH {O.doc_bag_cte()}
SELECT 'documents' AS stage, count(*) AS n FROM documents
UNION ALL SELECT 'bags', count(DISTINCT id) FROM bag
UNION ALL SELECT 'bag_rows', count(*) FROM bag
UNION ALL SELECT 'features', sum(tf)::BIGINT FROM bag
UNION ALL SELECT 'terms', count(DISTINCT term) FROM bag""")
def stage_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    bag = doc_bag(spark, sf_dir)
    zero = F.lit(0).cast("bigint")
    a = docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("stage"), "n")
    b = bag.agg(F.count_distinct("doc_id").alias("bags"), F.count(F.lit(1)).alias("bag_rows"),
                F.coalesce(F.sum("tf"), zero).alias("features"),
                F.count_distinct("term").alias("terms"))
    stacked = b.select(F.expr("stack(4, 'bags', bags, 'bag_rows', bag_rows, 'features', features, "
                              "'terms', terms) AS (stage, n)"))
    return a.unionByName(stacked)


# --------------------------------------------------------- dense vectors ---

@register("embedding_cosine_pairs", """WITH e AS (
  SELECT vec_id, i, x::DOUBLE AS x FROM (
    SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM e GROUP BY vec_id),
d AS (SELECT a.vec_id AS id1, b.vec_id AS id2, sum(a.x * b.x) AS dot
      FROM e a JOIN e b ON a.i = b.i AND a.vec_id < b.vec_id GROUP BY a.vec_id, b.vec_id)
SELECT id1, id2, round(dot / (n1.nrm * n2.nrm), 6) AS value
FROM d JOIN n n1 ON d.id1 = n1.vec_id JOIN n n2 ON d.id2 = n2.vec_id
WHERE n1.nrm > 0 AND n2.nrm > 0 AND dot / (n1.nrm * n2.nrm) >= 0.5""")
def embedding_cosine_pairs(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    vec = e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return CS.dense_cosine_pairs(vec, "vec_id", "embedding", 0.5).select("id1", "id2", r6("value"))


@register("cosine_dense", """WITH e AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)
SELECT a.vec_id AS id1, b.vec_id AS id2,
       round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS value
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1
WHERE list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0""")
def cosine_dense(spark, sf_dir):
    """Cosine of each vector with the one of the next id, as a column expression."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("id2"), F.col("v").alias("v2"))
    value = CS.dense_cosine(F.col("v"), F.col("v2")).alias("value")
    pairs = e.join(nxt, "vec_id").select(F.col("vec_id").alias("id1"), "id2", value)
    return pairs.filter("value IS NOT NULL").select("id1", "id2", r6("value"))


@register("image_text", """SELECT url, trim('words ' || (page_id * 7)::VARCHAR || ' ' || regexp_extract(url, '/([a-z]{2})/', 1)) AS light,
  'head' AS heavy FROM pages""")
def image_text(spark, sf_dir):
    """Text that stands for images: alt text in the body counts, in a heading it is lost, and an image without one gives nothing."""
    lang = F.regexp_extract("url", r"/([a-z]{2})/", 1)
    html = F.concat(F.lit("<html><body><h1>head <img src='x.png' alt='"), F.col("page_id").cast("string"), F.lit("'></h1><p>words <img alt='"),
                    (F.col("page_id") * 7).cast("string"), F.lit("' src='y.png'> "), lang, F.lit("<img src='z.png'></p></body></html>"))
    f = TX.extract_fields(read(spark, sf_dir, "pages").select("url", html.alias("html")))

    def one_space(c):
        return F.trim(F.regexp_replace(F.col(c), r"\s+", " ")).alias(c)
    return f.select("url", one_space("light"), one_space("heavy"))


# -------------------------------------- reference defaults without oracle ---
# Porter stemming and Murmur3 have no DuckDB counterpart; these run the
# reference's default settings and are checked by unit tests instead.

@register("stem_vocab", None)
def stem_vocab(spark, sf_dir):
    vocab = one_bag(spark, sf_dir).select("term").distinct()
    return vocab.select("term", TX.stem_column(F.col("term")).alias("stem"))


@register("minhash_pairs_stemmed", None)
def minhash_pairs_stemmed(spark, sf_dir):
    pairs = MH.minhash_pairs(one_bag(spark, sf_dir, stem=True), "doc_id")
    return pairs.select("id1", "id2", r6("value"))


@register("simhash_pairs_murmur", None)
def simhash_pairs_murmur(spark, sf_dir):
    feats = SH.weighted_features(doc_bag(spark, sf_dir, stem=True), "doc_id", "murmur3")
    return SH.simhash_pairs(SH.fingerprints(feats, "doc_id", 64), "doc_id", 64, 3)


@register("term_hash_murmur", None)
def term_hash_murmur(spark, sf_dir):
    vocab = one_bag(spark, sf_dir).select("term").distinct()
    return vocab.select("term", term_hash32(F.col("term"), "murmur3").alias("h"))


@register("pseudo_labels_stemmed", None)
def pseudo_labels_stemmed(spark, sf_dir):
    return GR.pseudo_labels(doc_labels(spark, sf_dir, stem=True)).select("id1", "id2")


@register("lsa_pairs_k64", None)
def lsa_pairs_k64(spark, sf_dir):
    """Truncated LSA (64 components, randomized SVD on Spark), cosine >= 0.8."""
    bag = doc_bag(spark, sf_dir)
    return LS.lsa_pairs(bag, "doc_id", n_components=64, cosine_threshold=0.8) \
        .select("id1", "id2", r6("value"))


# -------------------------------------------------------------- streaming ---

@register("stream_lsh_probe", f"""WITH {O.doc_bag_cte()}, {O.minhash_sig_cte()},
sig AS (SELECT id, list(h ORDER BY i) AS s FROM sigl GROUP BY id),
idx AS (
  SELECT band, md5('(' || array_to_string(list_slice(s, band * 8 + 1, band * 8 + 8), ', ') || ')') AS bucket, id
  FROM sig, range(16) t(band))
SELECT DISTINCT a.id AS probe_id, b.id AS doc_id FROM idx a JOIN idx b USING (band, bucket)""")
def stream_lsh_probe(spark, sf_dir):
    """Store the index of all documents, then stream the documents table through
    the probe (Structured Streaming, availableNow) and read the sink back."""
    from nearspark.streaming import lsh_probe as ST
    base = shared_path(spark, "stream")
    sigs = MH.signatures(one_bag(spark, sf_dir), "doc_id")
    ST.save_index(sigs, f"{base}/lsh")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # A glob of one name: a stream takes a folder of files as well as one file by it.
    q = ST.start_probe_stream(spark, f"{sf_dir}/documents.parque[t]", f"{base}/lsh", f"{base}/out", f"{base}/ckpt",
                              schema=docs.schema)
    q.awaitTermination()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return spark.read.schema(f"probe_id {kind}, doc_id {kind}, epoch int").parquet(f"{base}/out").drop("epoch")


@register("stream_lsh_grow", QUERIES["minhash_pairs"][1])
def stream_lsh_grow(spark, sf_dir):
    """Stream the documents in four micro-batches through a store that starts empty and grows by each:
    pairs across batches are found as well, so the sink holds what one batch over all would give."""
    from nearspark.streaming import lsh_store as ST
    base = shared_path(spark, "grow")
    read(spark, sf_dir, "documents").select("doc_id", "text").repartition(4, "doc_id").write.parquet(f"{base}/in")
    q = ST.start_stream(spark, f"{base}/in", f"{base}/store", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id1", "id2", r6("value"))


@register("lsa_topics", None)
def lsa_topics(spark, sf_dir):
    """Topic-word matrix (V^T) of a 16-component LSA, long form."""
    _bag, vecs = doc_vectors(spark, sf_dir)
    _emb, topics, _var = LS.lsa_model(vecs, "doc_id", n_components=16)
    return topics.select("component", "term", r6("weight"))


@register("lsa_variance", None)
def lsa_variance(spark, sf_dir):
    """Explained-variance ratio of each of 16 LSA components."""
    _bag, vecs = doc_vectors(spark, sf_dir)
    _emb, _topics, var = LS.lsa_model(vecs, "doc_id", n_components=16)
    return var.select("component", r6("explained_variance_ratio"))


@register("lsa_certificate", f"""WITH {O.doc_bag_cte()}, {O.tfidf_l2_cte()}
SELECT count(DISTINCT id) AS n_docs, count(DISTINCT term) AS n_terms, round(sum(w * w), 6) AS frobenius2,
       round(sum(w * w), 6) AS captured_and_residual, TRUE AS projects, TRUE AS u_orthonormal, TRUE AS v_orthonormal,
       TRUE AS values_fall
FROM vec""")
def lsa_certificate(spark, sf_dir):
    """Proof of a 32-component SVD: what it captures and what it leaves add up to the matrix's squared norm,
    its factors are orthonormal, and the matrix's projection on them is what their values say."""
    _bag, vecs = doc_vectors(spark, sf_dir)
    c = LS.lsa_certificate(vecs, "doc_id", n_components=32, n_iter=2)
    near = F.abs(F.col("projected") - F.col("captured")) < F.lit(1e-9) * F.col("frobenius2")
    return c.select("n_docs", "n_terms", r6("frobenius2"),
                    F.round(F.col("captured") + F.col("residual2"), 6).alias("captured_and_residual"),
                    near.alias("projects"), (F.col("u_error") < 1e-9).alias("u_orthonormal"),
                    (F.col("v_error") < 1e-9).alias("v_orthonormal"), "values_fall")


@register("lsa_pairs_svd", f"""WITH {O.page_bag_cte(False)}, {O.tfidf_l2_cte()}, {O.cosine_pairs_cte(0.8, False)}
SELECT id1, id2, round(value, 4) AS value FROM edges""")
def lsa_pairs_svd(spark, sf_dir):
    """LSA of pages by URL at full rank, where its cosines are the TF-IDF cosines: the sparse join, since
    an SVD of that rank would be as wide as the table is long."""
    return LS.lsa_pairs(page_bag(spark, sf_dir), "url", cosine_threshold=0.8, method="full_rank") \
        .select("id1", "id2", F.round("value", 4).alias("value"))


@register("lsa_pairs_pages_k64", None)
def lsa_pairs_pages_k64(spark, sf_dir):
    """Truncated LSA of pages by URL (64 components, randomized SVD on Spark), cosine >= 0.8."""
    return LS.lsa_pairs(page_bag(spark, sf_dir), "url", n_components=64, cosine_threshold=0.8) \
        .select("id1", "id2", r6("value"))


# ------------------------------------------------- small tiles, same answers ---

@register("minhash_pairs_tiled", QUERIES["minhash_pairs"][1])
def minhash_pairs_tiled(spark, sf_dir):
    pairs = MH.minhash_pairs(one_bag(spark, sf_dir), "doc_id", tile_size=4)
    return pairs.select("id1", "id2", r6("value"))


@register("simhash_pairs_tiled", QUERIES["simhash_pairs"][1])
def simhash_pairs_tiled(spark, sf_dir):
    feats = SH.weighted_features(doc_bag(spark, sf_dir), "doc_id", "md5")
    return SH.simhash_pairs(SH.fingerprints(feats, "doc_id", 64), "doc_id", 64, 3, tile_size=4)


@register("pseudo_labels_tiled", QUERIES["pseudo_labels"][1])
def pseudo_labels_tiled(spark, sf_dir):
    return GR.pseudo_labels(doc_labels(spark, sf_dir), tile_size=4).select("id1", "id2")
