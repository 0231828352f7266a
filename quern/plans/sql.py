"""The compressor as a table function for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="sent_idx int, sentence string, score double, kept boolean")
class CompressTable:
    """``quern_compress(context, question, rate, context_type)``: a row for each sentence."""

    def eval(self, context: str, question: str, rate: float, context_type: str):
        from quern.plans.rowwise import compress

        got = compress(context or "", question or "", rate=rate, context_type=context_type or "english")
        kept = set(got["preserved_indices"])
        for i, (sentence, score) in enumerate(zip(got["sentences"], got["sentence_scores"], strict=True)):
            yield i, sentence, score, i in kept


def register(spark: SparkSession, name: str = "quern_compress") -> None:
    spark.udtf.register(name, CompressTable)
