"""Registered queries of this package: thin readers of one operator each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship
from .line_dedup import dedup_lines
from .materialise import materialise, scratch_path
from .minhash import near_duplicates
from .mixing import mix
from .order_minhash import neighbours_compared
from .packing import packed_pieces
from .pii import found_spans, span_digest
from .ranked_search import rank_documents
from .spelling import spelling_variants
from .topk import top_inner_products
from .toxicity import fit_lexicon, score_toxicity
from .token_counts import token_counts
from .tokens import vocabulary

from .vector_dedup import near_duplicate_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), scratch_path(spark))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit_lexicon(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score_toxicity(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(found_spans(table(spark, sf_dir, "documents")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "chunks_removed", "words_removed")


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"),
                         length=2048, end_id=1)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours_compared(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_materialise": op1_materialise,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_minhash": op8_minhash,
    "op9_packing": op9_packing,
    "op10_topk": op10_topk,
    "op11_ranked_search": op11_ranked_search,
    "op12_spelling": op12_spelling,
    "op13_order_minhash": op13_order_minhash,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES: dict[str, str] = {
    "op11_ranked_search": rf"""
WITH documents_ AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM documents_ WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
counts AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM documents_) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counts, whole GROUP BY term, big_n),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark WHERE text IS NOT NULL),
scores AS (
  SELECT i.item_id, c.r, l.doc_id,
         sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (100 - 50 + ((50 * l.n * big_n) // big_l)))))::BIGINT AS score
  FROM items i JOIN weights w USING (term) JOIN counts c USING (term) JOIN lengths l USING (r), whole
  GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
  FROM scores WHERE score > 0) WHERE rank <= 50
""",
}
