"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps. ``run`` writes
every stage's rows to the shared folder and reads them for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubhouse.llm import mixing, nearcopies, pieces, quality, repeats
from clubhouse.session import written

MODEL = "piece_bpe_32k.model"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, accepts."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return nearcopies.representatives(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that have stood in an earlier window."""
    cut = repeats.without_repeats(docs, carry=True)
    fresh = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(
        *[(fresh[c] if c in fresh else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks for."""
    taken = mixing.materialized(docs)
    if "n_chars" in docs.columns:
        taken = taken.withColumn("n_chars", F.length("text").cast("long"))
    return taken


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, their byte spans, and the decoded text."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path(MODEL))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", no_near_copies),
    ("substring dedup", no_repeats),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

# The first stage is a trained classifier and the last a library's encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
