"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import exact, html, langid, licenses, mixing, pieces, pii, simhash, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text: their number, a digest of the ids, and whether decoding gives the text back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, decoded_col="decoded")
    return coded.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.lower(F.hex(F.xxhash64("ids"))).alias("ids_xxh64"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0)).drop("depth")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(_table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(number(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(pii.listed(F.col("spans")), 256).alias("base_sha256"),
        pii.listed(F.concat("spans", "extra")).alias("spans"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.capture_histories(_table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_pos")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix, op2_sentencepiece, op3_langid, op4_simhash, op5_html, op6_exact_dedup, op7_topk, op8_pii, op9_warc, op10_licenses)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                              sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
                 w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY len DESC, doc_id) AS keep_id,
                              count(*) OVER (PARTITION BY h) AS group_size FROM d)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w""",
        "op7_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                       FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 s AS (SELECT a.vec_id AS query_id, b.vec_id,
                              CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
                       FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
                 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
        "op9_warc": r"""
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h, coalesce(url, '') AS url FROM pages),
                 f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
                              regexp_extract(url, '^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)', 1) AS host,
                              regexp_extract(url, '^(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*([^#]*)', 1) AS path,
                              regexp_matches(url, '^(?:[a-zA-Z][\w+.-]*:)?//') AS full_url FROM p),
                 g AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(host), '^.*@', ''), ':(?:80|443)?$', ''), '^www\d*\.', '') AS name FROM f),
                 k AS (SELECT *, CASE WHEN full_url
                                      THEN array_to_string(list_reverse(string_split(string_split(name, ':')[1], '.')), ',')
                                           || CASE WHEN contains(name, ':') THEN substr(name, instr(name, ':')) ELSE '' END
                                           || ')' || CASE WHEN path = '' THEN '/' ELSE path END
                                      ELSE lower(string_split(url, '#')[1]) END AS url_key FROM g)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
                   CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to, url_key,
                   row_number() OVER (ORDER BY url_key, page_id % 2147483648, page_id) AS history_pos FROM k""",
    }
