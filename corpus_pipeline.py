"""From raw documents to token ids: quality, exact copies, near copies, mixture, encoding.

Each stage takes what its predecessor kept, as Parquet, and returns the columns of ``documents``; the
last one returns token ids. Columns of documents may have any names besides ``doc_id, text, lang,
source``, which a stage reads; null ids, names and texts, repeated rows and empty tables go through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, exact_dedup, mixing, ngram_join, quality
from quern.llm.queries import domain_of, table, vocabulary
from quern.llm.runtime import alone, n_written, packed

#: What is left after deduplication, weighed anew: German, Spanish and curated sources above their
#: share. A document is used once, so what a source lacks goes to others.
MIX = mixing.Mix(
    weights={("hub",): 0.05, ("curated",): 0.4, ("web",): 0.55, ("*", "en"): 0.55, ("*", "de"): 0.18, ("*", "es"): 0.12, ("*", "fr"): 0.15},
    share=0.85,
    max_epochs=1,
    seed=17,
)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least the cut. Null texts are judged as empty ones; a null id has no
    label to learn from; rows that repeat are judged each; an empty table stays empty."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = "__score"
    while name in docs.columns:
        name += "_"
    return quality.score(docs, model, name=name).where(F.col(name) >= quality.CUT).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts. Null and empty texts are one group; of rows
    alike in id and text one stays; a null id comes after all others."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-gram similarity of 0.8 connects. Texts without words stay; a row
    is dropped for its own text and not for its id."""
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of ``MIX``, as often as it takes them. Null languages and sources are
    nodes of their own; texts without words are taken as often as their neighbours in the order."""
    rows = mixing.taken(packed(docs, doc_id=F.col("doc_id"), lang=F.col("lang"), source=F.col("source"), text=F.col("text")), MIX, domain_of(F.col("source")), F.col("lang"), F.col("source"), mixing.word_count(F.col("text")))
    return rows.where("__copies > 0").select("__row", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select("__row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of each row. Null texts have no ids."""
    rows = bpe.encode(docs, vocabulary())
    return rows.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("mixing", mixture),
    ("bpe", encoding),
]

#: The classifier's weights, near copies and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), n_written()
    for _, stage in STAGES[:-1]:
        docs = alone(stage(spark, docs, sf_dir), since)
    return STAGES[-1][1](spark, docs, sf_dir)
