"""A corpus pipeline: raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``. SQL can express neither the
learned lexicon, the sampled signatures nor the rounding, so ``ORACLE_SQL`` is
None and the stages are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.llm.common import discard, shared_folder, ship
from regframe.llm.line_dedup import dedup_lines
from regframe.llm.minhash import one_of_each
from regframe.llm.mixing import mixed_documents
from regframe.llm.packing import packed_pieces
from regframe.llm.tokens import vocabulary
from regframe.llm.toxicity import fit_lexicon, score_toxicity


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, after a change of the texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the lexicon is learned from ``labels``.

    Missing and empty texts have no hits and stay, as do all documents if no
    label is toxic; repeated rows score alike. An empty table stays empty.
    """
    ship(spark)
    lexicon = fit_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, lexicon).filter("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines leave the texts; no document goes.

    The first copy by document id stays; rows that repeat an id and a text count
    as one document, and rows without an id keep their text. Missing texts stay
    missing; a text may become empty. An empty table stays empty.
    """
    ship(spark)
    return _recounted(dedup_lines(docs).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id.

    Rows that repeat an id and a text are one, also without an id. Empty texts
    are one class, missing ones are classes of their own. An empty table stays
    empty.
    """
    ship(spark)
    return one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without a word, missing ones too, are no mass and are not taken; a
    missing source is a source. Rows that repeat an id and a text share their
    copies, and reruns agree. An empty table stays empty.
    """
    ship(spark)
    return mixed_documents(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    A missing or empty text is its end id alone; repeated rows are packed as
    often as they occur. An empty table gives no pieces.
    """
    ship(spark)
    return packed_pieces(docs, vocabulary("word_bpe_49k.json"), length=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through every stage, each written to the shared folder and read again.

    A stage's table goes when the next one is written; the last is the caller's.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
