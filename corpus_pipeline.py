"""From raw documents to token pieces: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return rows with the columns of ``docs``.  What a stage returns is written
before the next one starts, which is when the tables it was made from go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.exact_dedup import ExactDedup
from intervale.llm.language_id import fit, predict_column
from intervale.llm.mixing import Mixture
from intervale.llm.queries import vocabulary
from intervale.llm.runtime import Scratch, drop_finished, id_remainder, prepare
from intervale.llm.sentencepiece_unigram import SentencePieces
from intervale.llm.simhash import without_similar


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language, with the one found as their ``lang``; null texts and those without a letter go.

    Learns from labelled documents outside the held-out third, as op6 does.
    Rows that repeat stay; without any labelled document nothing is known and all go.
    """
    prepare(spark)
    drop_finished(spark, "stage")
    known = fit(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    marked = docs.withColumn("lang", predict_column(spark, known, F.col("text"))["lang_pred"])
    return marked.where("lang <> 'und'").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest id.

    Null counts as empty; of rows that repeat an id the one that landed last stays.
    """
    drop_finished(spark, "stage")
    return ExactDedup(docs, label="stage").kept()


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles are alike by 0.8 or more, the document with the smallest id.

    Groups are components of such pairs.  Null and wordless texts are one group;
    null ids come last; of rows that repeat an id the first that landed stays.
    """
    drop_finished(spark, "stage")
    return without_similar(docs, width=5, similarity=0.8, label="stage")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, so that no source is repeated over twice as often as another.

    A null source is a source; a null text has no tokens and is passed with its block.
    """
    drop_finished(spark, "stage")
    return Mixture(docs, max_repeat=2.0, label="stage").documents()


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the SentencePiece ids of the text; none for a null or empty text.

    A document that the mixture repeats is a row each time, as the training run
    is to read it; its units are encoded once a batch.
    """
    drop_finished(spark, "stage")
    codec = SentencePieces(spark, vocabulary("piece_bpe_32k.model"))
    return docs.select("doc_id", "source", "lang", codec.encode(F.col("text")).alias("ids"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", pieces),
]

#: SQL can't express the language model, SimHash or piece segmentation; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(prepare(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
