"""The registered queries of the subpackage: thin digests over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import divergence, html_main, langid, licenses, line_dedup, mixing, packing, passages, ranked, simhash, spotsigs, stock_packing, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def tokenizer_files() -> dict:
    """Where the installed public tokenizer files are; parameters of the operators that need them."""
    import public_tokenizers as public

    return {"tokenizer": public.path("byte_bpe_50k.json"), "ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), **tokenizer_files())


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, ~langid.held_out())
    return langid.identify(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model).drop("text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select(
        "doc_id", F.coalesce("source", F.lit(mixing.NONE)).alias("source"), F.coalesce("lang", F.lit(mixing.NONE)).alias("lang"), F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 6).alias("weight"), F.round("mix_chance", 6).alias("chance"), F.col("mix_kept").alias("kept"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.fingerprint_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sigs, changed, following = F.col("sigs"), F.col("edited_sigs"), F.col("next_sigs")
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        spotsigs.digest(sigs).alias("fingerprint"), spotsigs.digest(changed).alias("edited_fingerprint"),
        spotsigs.likeness(sigs, changed).alias("near_edited"), spotsigs.likeness(sigs, following).alias("near_next"), "sigs",
    )
    return spotsigs.with_groups(rows)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 20 == 0)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranked.search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("item_id", "rank", "doc_id", "score")


RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), docs AS (SELECT *, len(words)::BIGINT AS n FROM d WHERE len(words) > 0
), totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs
), postings AS (SELECT row, id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, id, n, unnest(words) AS term FROM docs) GROUP BY ALL
), weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, big_n
), uses AS (
  SELECT DISTINCT query, item_id, unnest(words) AS term FROM (
    SELECT row_number() OVER () AS query, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark)
), scored AS (
  SELECT query, item_id, row, id AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM uses JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id, row)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), groups AS (SELECT DISTINCT lang, source FROM d
), tokens AS (SELECT row, lang, source, unnest(words) AS term FROM d
), kept AS (SELECT lang, term, count(*)::BIGINT AS total FROM tokens GROUP BY ALL HAVING count(DISTINCT row) >= 3
), langs AS (SELECT lang, count(*)::BIGINT AS v, sum(total)::BIGINT AS n FROM kept GROUP BY lang
), counts AS (SELECT lang, source, term, count(*)::BIGINT AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sums AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::BIGINT AS n FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (s.n + l.v) AS p,
         1 + (1000000000 * (k.total + 1)) // (l.n + l.v) AS q
  FROM sums s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON (c.lang, c.source, c.term) = (s.lang, s.source, k.term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON (p.lang, p.source, p.item) = (a.lang, a.source, b.source)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""

def op13_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock_packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), **tokenizer_files())


TOPK_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.r AS other, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r AND len(c.v) = len(q.v)
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT rowid AS doc, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS at
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc) >= 3
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (r.keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.at) FILTER (r.keeper IS NULL OR r.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeated r ON k.key = r.key
GROUP BY k.doc, k.doc_id
"""

QUERIES = {
    "op1_html": op1_html,
    "op2_packing": op2_packing,
    "op3_langid": op3_langid,
    "op4_mixing": op4_mixing,
    "op5_passages": op5_passages,
    "op6_simhash": op6_simhash,
    "op7_spotsigs": op7_spotsigs,
    "op8_topk": op8_topk,
    "op9_licenses": op9_licenses,
    "op10_line_dedup": op10_line_dedup,
    "op11_ranked": op11_ranked,
    "op12_divergence": op12_divergence,
    "op13_stock_packing": op13_stock_packing,
}

ORACLES = {
    "op4_mixing": mixing.mix_sql(),
    "op9_licenses": licenses.scan_sql(),
    "op8_topk": TOPK_SQL,
    "op10_line_dedup": LINE_DEDUP_SQL,
    "op11_ranked": RANKED_SQL,
    "op12_divergence": DIVERGENCE_SQL,
}
