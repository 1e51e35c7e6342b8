"""From raw documents to token digests, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs.

1. quality: documents scored below QUALITY_FROM go.
2. line_dedup: repeated and near-repeated lines go but for the first of each;
   a document that is left without any line goes with them.
3. ngram_jaccard: of documents linked by word shingles, one stays.
4. mixing: sources are repeated up to REPEAT_LIMIT times towards equal weights;
   every document is read once at least.
5. sentencepiece: each reading is encoded and decoded.

Defined results: null and empty texts are scored like others, and those that
are kept have no lines and no words, so they stay as they are; repeated rows
(same id and text) stay together through the first two stages and are one from
the third on; a null id is a document of its own; an empty table gives an empty
one. Columns beside id, text and source are carried along to the fourth stage,
whatever their names; n_chars, if there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import jaccard_join, line_dedup, mixing, quality, tokenize
from larkspur.llm.queries import QUALITY_FROM, piece_model_path
from larkspur.llm.storage import fresh, table, written

#: The classifier can't be written in SQL.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), QUALITY_FROM)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n, n_kept = fresh(docs, "n_lines"), fresh(docs, "n_kept")
    kept = line_dedup.dedup_lines(docs, short=True, counts=(n, n_kept))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.where((F.col(n_kept) > 0) | (F.col(n) == 0)).select(*docs.columns)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, added=(fresh(docs, "n_tokens"), fresh(docs, "epoch"))).select(*docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenize.round_trip_digests(docs, piece_model_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over sf_dir's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
