"""The registered queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import encode_decode

    rows = encode_decode(documents(spark, sf_dir), vocabulary_file())
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    rows = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=3, min_chars=20)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH line AS (
  SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
held AS (
  SELECT k, max(doc_id) AS keeper FROM line WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM line LEFT JOIN held USING (k) GROUP BY doc_id"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_ids(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import search

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import imatch

    return imatch(documents(spark, sf_dir))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    rows = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"), length=200)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import dedup_passages

    rows = dedup_passages(documents(spark, sf_dir).select("doc_id", "text"), length=50)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def captures(pages: DataFrame) -> DataFrame:
    """Pages as full responses (but every eleventh) and, 1000 pages later, a revisit of each.

    A revisit's validators depend on the page's length; pages of remainder 5 by 13 send none.
    """
    etag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    modified, turn = F.concat(F.lit("day "), F.floor(F.col("page_id") / 7).cast("string")), F.length("html") % 5
    text = lambda c: c.cast("string")
    stored = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), etag, F.lit("Last-Modified"), modified, F.lit("Content-Length"), text(F.length("html")), F.lit("Cache-Control"), F.lit("max-age=60"))
    sent = F.when(turn == 0, F.concat(F.lit("W/"), etag)).when(turn == 2, F.concat(F.lit('"x'), F.substring(etag, 2, 99))).when(turn > 2, etag)
    sends = F.col("page_id") % 13 != 5
    fresh = F.map_filter(F.create_map(F.lit("etag"), F.when(sends, sent), F.lit("last-modified"), F.when(sends, modified), F.lit("Content-Length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=90"), F.lit("expires"), text(F.col("page_id"))), lambda k, v: v.isNotNull())
    response = pages.where("page_id % 11 <> 0").select((F.col("page_id") * 2).alias("id"), "url", (F.col("page_id") * 2).alias("date"), F.lit("response").alias("kind"), F.lit(200).alias("status"), stored.alias("headers"), F.col("html").alias("payload"))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("id"), "url", (F.col("page_id") * 2 + 2001).alias("date"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), fresh.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import resolve_revisits

    done = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    spelled = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return done.select("id", "canonical", "refers_to", "resolved", "reason", spelled.alias("headers"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"))


OP4_SQL = r"""
WITH page AS (
  SELECT page_id, html, md5(html) AS tag, length(html) % 5 AS turn, 'day ' || page_id // 7 AS modified, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS rest FROM pages),
named AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS canonical
  FROM (SELECT *, list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')) AS q FROM page)),
ask AS (
  SELECT page_id, canonical, CASE WHEN page_id % 13 <> 5 THEN modified END AS modified, page_id * 2 + 1 AS id, page_id * 2 + 2001 AS date,
    CASE WHEN page_id % 13 = 5 THEN NULL WHEN turn = 0 OR turn > 2 THEN '"' || tag || '"' WHEN turn = 2 THEN '"x' || tag || '"' END AS bare,
    CASE WHEN page_id % 13 = 5 THEN NULL WHEN turn = 0 THEN 'W/"' || tag || '"' WHEN turn > 2 THEN '"' || tag || '"' WHEN turn = 2 THEN '"x' || tag || '"' END AS sent FROM named),
stored AS (SELECT * FROM named WHERE page_id % 11 <> 0),
near AS (
  SELECT ask.*, f.page_id AS p, f.tag, f.modified AS fm, f.html FROM ask
  LEFT JOIN (SELECT ask.id, max(f.page_id) AS p FROM ask JOIN stored f ON f.canonical = ask.canonical AND f.page_id * 2 < ask.date GROUP BY ask.id) m USING (id) LEFT JOIN stored f ON f.page_id = m.p),
judged AS (SELECT *, coalesce(CASE WHEN bare IS NULL THEN modified = fm ELSE bare = '"' || tag || '"' END, false) AS ok FROM near)
SELECT id, canonical, CASE WHEN ok THEN p * 2 END AS refers_to, ok AS resolved,
  CASE WHEN ok THEN NULL WHEN p IS NULL THEN 'no earlier response' WHEN bare IS NULL AND modified IS NULL THEN 'no validator' ELSE 'validator mismatch' END AS reason,
  CASE WHEN ok THEN 'cache-control=max-age=90;content-length=' || length(html) || ';content-type=text/html;etag=' || coalesce(sent, '"' || tag || '"') || ';expires=' || page_id || ';last-modified=' || modified
       ELSE 'cache-control=max-age=90;content-length=0' || coalesce(';etag=' || sent, '') || ';expires=' || page_id || coalesce(';last-modified=' || modified, '') END AS headers,
  CASE WHEN ok THEN sha256(html) END AS payload_sha256
FROM judged"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_line_dedup, op3_toxicity, op4_warc_revisits, op5_probminhash, op6_suffix_trees, op7_byte_bpe, op8_imatch, op9_suffix_array_dedup, op10_learned_partitions)}
ORACLE: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op4_warc_revisits": OP4_SQL}
