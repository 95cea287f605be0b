"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece round trip.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsift.llm import decontaminate, language, lines, near, pieces
from binsift.llm._spark import saved, table

#: Columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of letters times posterior with which a language is accepted; below it a text is no text of any language.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep rows that are text of a learned language: not `und`, with a score of at least LEAST_SCORE.

    The model is learned from the stage's own documents; null languages teach nothing. Each row is judged by its own text,
    whatever its id: null and empty texts go, rows that repeat a good one stay.
    """
    found = language.identify(docs, language.train(docs), carry=COLUMNS)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later repeated runs of lines; documents of which nothing is left go. n_chars follows the text.

    Null and empty texts stay; rows that repeat id and text lose the same lines, none of them to each other.
    """
    cut = lines.dedup(docs)
    kept = cut.filter("n_removed = 0 OR trim(BOTH FROM replace(text, '\n', '')) != ''")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the least id, a null id last, then the least text hash.

    Rows of one id with unlike texts are judged apart; of rows that repeat id and text one stays; texts without words stay.
    """
    return near.one_of_each(docs).select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a copy of a test item go; rows of the same id, null or not, without one stay, as do empty texts."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, exact of every row left; null and empty texts have no ids and are exact."""
    return pieces.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each on what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID, alignment and piece encoding can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
