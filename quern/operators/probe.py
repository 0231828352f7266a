"""Attention of one query position onto the context, pooled by sentence.

Keys are rows ``sample_id, layer, head, tok_idx, k array``; queries ``sample_id, layer, head, q array``.
With grouped queries, ``expand_heads`` gives each query head the keys of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.align import span_tokens

EPSILON = 1e-8
_HEAD = ["sample_id", "layer", "head"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def expand_heads(keys: DataFrame, queries: DataFrame, group: int) -> DataFrame:
    """Queries joined to the keys of their group, ``kv_head = head div group``."""
    q = queries.withColumn("kv_head", F.expr(f"head div {group}").cast("int"))
    k = keys.withColumnRenamed("head", "kv_head").withColumn("kv_head", F.col("kv_head").cast("int"))
    return q.join(k, ["sample_id", "layer", "kv_head"])


def raw_scores(met: DataFrame, scale: float) -> DataFrame:
    return met.withColumn("raw", dot(F.col("q"), F.col("k")) * F.lit(float(scale)))


def softmax(scores: DataFrame, mask: Column | None = None) -> DataFrame:
    """``p``: softmax of ``raw`` over each head's tokens; masked tokens get -1e4 before."""
    w = Window.partitionBy(*_HEAD)
    raw = F.col("raw") if mask is None else F.when(mask, F.col("raw") - 1e4).otherwise(F.col("raw"))
    e = scores.withColumn("e", F.exp(raw - F.max(raw).over(w)))
    return e.withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def renormalise(attention: DataFrame, in_context: Column) -> DataFrame:
    """Attention on context tokens only, divided by its sum there (at least ``EPSILON``), NaN as 0."""
    w = Window.partitionBy(*_HEAD)
    return attention.where(in_context).withColumn("ratio", F.nanvl(F.col("p") / F.greatest(F.sum("p").over(w), F.lit(EPSILON)), F.lit(0.0)))


def context_softmax(scores: DataFrame, in_context: Column) -> DataFrame:
    """``softmax`` and ``renormalise`` in one: the denominator over all tokens cancels, so tokens outside
    the context are dropped before the exponentials."""
    return renormalise(softmax(scores.where(in_context)), F.lit(True))


def clamp_span(start: Column, end: Column, context_start: Column, context_end: Column) -> tuple[Column, Column]:
    """A token span relative to the context and inside it, at least one token long."""
    last = context_end - context_start
    inside = lambda c: F.greatest(F.least(c - context_start, last), F.lit(0))
    return inside(start), F.greatest(inside(end), inside(start))


def sentence_mean(ratios: DataFrame, spans: DataFrame) -> DataFrame:
    """``value``: mean ratio of a sentence's tokens, by layer and head. A sentence without tokens has no row."""
    met = ratios.join(span_tokens(spans), ["sample_id", "tok_idx"])
    return met.groupBy("sample_id", "sent_idx", "layer", "head").agg(F.avg("ratio").alias("value"))


def features(means: DataFrame) -> DataFrame:
    """``features``: one array per sentence, layer by layer and head by head."""
    ordered = F.array_sort(F.collect_list(F.struct("layer", "head", "value")))  # layers times heads long
    return means.groupBy("sample_id", "sent_idx").agg(F.transform(ordered, lambda x: x["value"]).alias("features"))
