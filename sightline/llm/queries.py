"""The registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, lm, quality, sharding, vptree
from .common import id_fold
from .decontaminate import contaminated
from .near_duplicates import near_duplicates
from .packing import pack
from .token_files import token_index
from .tokens import tokenizer_file
from .warc import archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of whole ``documents``."""
    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


#: Exact: every pair sharing a shingle is compared on full sets.
ORACLE["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM toks),
sizes AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM grams),
one AS (SELECT doc_id, unnest(g) AS s FROM grams),
inter AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM one a JOIN one b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM inter JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
sym AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT s.v, r.root FROM reach r JOIN sym s ON s.u = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, s.n AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sizes s JOIN comp c ON c.node = s.doc_id
"""


@query
def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; fold 0 of 5 is held out."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(id_fold(F.col("doc_id"), 5) != 0))
    out = quality.score(docs, model)
    return out.select("doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 1 of 3 is held out."""
    docs = _table(spark, sf_dir, "documents")
    profiles = language_id.train(docs.where(id_fold(F.col("doc_id"), 3) != 1))
    out = language_id.predict(docs, profiles)
    return out.select("doc_id", (id_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op3_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes, by a slot map that is stored and read back."""
    out = sharding.shard(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


@query
def op4_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written as range-coded files and read back."""
    return token_index(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 2)


@query
def op6_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in sequences of at most 2048."""
    return pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 0)


@query
def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, repeated payloads as revisits, read back."""
    out = archive(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op8_warc_revisits"] = r"""
WITH h AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS x FROM pages),
o AS (SELECT page_id, CAST(octet_length(encode(p)) AS BIGINT) AS payload_bytes, x, min(page_id) OVER (PARTITION BY x) AS first FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST(i // 4 AS INT) * 5 + 1, 5) AS INT) >> CAST(5 * (3 - i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM o
"""


@query
def op5_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return vptree.search(_table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document, within edits."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op9_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document; fold 1 of 5 is held out."""
    return lm.score(_table(spark, sf_dir, "documents"), id_fold(F.col("doc_id"), 5) == 1)
