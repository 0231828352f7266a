"""Characters, tokens and sentences: which tokens a sentence covers.

``token_rows``, ``true_spans``, ``aligned``, ``aligned_tokens``, ``context_tokens`` and ``align_prompt`` work on a sample's row. The other tables are long: one row per token or sentence. ``sample_id`` is in every key, so joins are hash or
sort-merge joins with the overlap as residual condition, and all steps share one partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tokens import RegexTokenCounter, TokenCounter
from quern.operators import placed


def sentence_rows(samples: DataFrame, sentences: Column) -> DataFrame:
    """``sample_id, sent_idx, text`` of an array of sentences."""
    return samples.select("sample_id", F.posexplode(sentences).alias("sent_idx", "text"))


def char_spans(rows: DataFrame, start: Column | int = 0) -> DataFrame:
    """Sentences of ``sentence_rows`` with ``char_start, char_end``, as if they lay end to end from
    ``start`` on (a running sum of lengths)."""
    before = Window.partitionBy("sample_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) + (F.lit(start) if isinstance(start, int) else start)
    return rows.withColumn("char_start", at.cast("int")).withColumn("char_end", (at + F.length("text")).cast("int"))


def true_spans(samples: DataFrame, text: Column, sentences: Column) -> DataFrame:
    """Sentences with the places at which they stand in the text, each looked for from the end of the
    one before; ``char_start`` is null for one that isn't there. Arrow batches, in time linear in the text."""

    def work(batch):
        first, flat = placed.lists(batch.column(2))
        c0, c1, gone = placed.found(batch.column(1), first, flat, placed.lengths(flat))
        rows, at = placed.within(first)
        return rows, [placed.ints(at), flat.cast(pa.string()), placed.ints(c0, gone), placed.ints(c1, gone)]

    return _on_rows(samples, [text, sentences], work, "sent_idx int, text string, char_start int, char_end int")


def _on_rows(samples: DataFrame, columns: list[Column], work, schema: str) -> DataFrame:
    """Rows made of each sample where it is: ``work`` gives from a batch of ``sample_id`` and ``columns`` the
    row that each new row is of, and the new columns."""
    given = samples.select("sample_id", *(c.alias(f"c{i}") for i, c in enumerate(columns)))
    names = [x.split()[0] for x in ("sample_id x, " + schema).split(", ")]

    def run(batches):
        for batch in placed.slices(batches):
            rows, out = work(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *out], names)

    return given.mapInArrow(run, f"sample_id {given.schema['sample_id'].dataType.simpleString()}, {schema}")


def token_rows(samples: DataFrame, text: Column, counter: RegexTokenCounter | None = None, max_tokens: int | None = None) -> DataFrame:
    """``sample_id, tok_idx, token, char_start, char_end``, the first ``max_tokens`` of each sample."""

    def work(batch):
        t = placed.tokens(batch.column(1), counter)
        rows, at = placed.within(t.first)
        start, end, surface = t.start - t.at[rows], t.end - t.at[rows], t.surface
        if max_tokens is not None:
            few = at < max_tokens
            rows, at, start, end, surface = rows[few], at[few], start[few], end[few], surface.filter(pa.array(few))
        return rows, [placed.ints(at), surface, placed.ints(start), placed.ints(end)]

    return _on_rows(samples, [text], work, "tok_idx int, token string, char_start int, char_end int")


#: Characters of a bin of the overlap join.
BIN = 256


def _bins(start: Column, end: Column) -> Column:
    """The bins that characters ``[start, end)`` touch."""
    return F.sequence(F.floor(start / BIN).cast("int"), F.floor(F.greatest(end - 1, start) / BIN).cast("int"))


def token_spans(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences with ``tok_start, tok_end`` (inclusive) and ``n_tokens`` of the tokens whose characters
    overlap theirs; null and 0 if there are none.

    Both sides fall into bins of characters and meet on (sample, bin), so a long sample costs what its
    neighbours in the text cost, not tokens times sentences."""
    t = tokens.select("sample_id", "tok_idx", F.col("char_start").alias("t0"), F.col("char_end").alias("t1"), F.explode(_bins(F.col("char_start"), F.col("char_end"))).alias("bin"))
    s = sentences.withColumn("bin", F.explode(F.when(F.col("char_start").isNull(), F.array(F.lit(-1))).otherwise(_bins(F.col("char_start"), F.col("char_end")))))
    on = (F.col("s.sample_id") == F.col("t.sample_id")) & (F.col("s.bin") == F.col("t.bin")) & (F.col("t.t1") > F.col("s.char_start")) & (F.col("t.t0") < F.col("s.char_end"))
    met = s.alias("s").join(t.alias("t"), on, "left").select(*(f"s.{c}" for c in sentences.columns), "t.tok_idx")
    keys = [F.col(c) for c in sentences.columns]
    spans = met.groupBy(*keys).agg(F.min("tok_idx").alias("tok_start"), F.max("tok_idx").alias("tok_end"))
    # tokens stand in order and apart, so those between the first and the last overlap too
    return spans.withColumn("n_tokens", F.coalesce(F.col("tok_end") - F.col("tok_start") + 1, F.lit(0)))


def span_tokens(spans: DataFrame) -> DataFrame:
    """``sample_id, sent_idx, tok_idx`` of each token of each span."""
    held = spans.where(F.col("tok_start").isNotNull() & (F.col("tok_end") >= F.col("tok_start")))
    return held.select("sample_id", "sent_idx", F.explode(F.sequence("tok_start", "tok_end")).alias("tok_idx"))


def drop_empty(spans: DataFrame) -> DataFrame:
    """Without sentences that have no token."""
    return spans.where("n_tokens > 0")


def context_span(tokens: DataFrame, windows: DataFrame) -> DataFrame:
    """First and last token that overlap each sample's characters ``[c0, c1)``; null if none does."""
    w = windows.select("sample_id", "c0", "c1").alias("w")
    on = (F.col("w.sample_id") == F.col("t.sample_id")) & (F.col("t.char_end") > F.col("w.c0")) & (F.col("t.char_start") < F.col("w.c1"))
    return w.join(tokens.alias("t"), on, "left").groupBy("w.sample_id").agg(F.min("t.tok_idx").alias("context_start"), F.max("t.tok_idx").alias("context_end"))


def token_sentence(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """``sample_id, tok_idx, sent_idx``: the sentence that a token belongs to, the last one if several."""
    last = span_tokens(spans).groupBy("sample_id", "tok_idx").agg(F.max("sent_idx").alias("sent_idx"))
    return tokens.select("sample_id", "tok_idx").join(last, ["sample_id", "tok_idx"], "left")


def align_prompt(starts: list[int], ends: list[int], context: str, sentences: list[str], context_at: int = 0) -> tuple[list[tuple[int, int] | None], tuple[int, int] | None]:
    """The first and last token of each sentence and of the context, of one prompt whose tokens stand at
    ``starts`` to ``ends`` and whose context begins at ``context_at``. Sentences are looked for in the context in order, each from
    the end of the one before; None for one that isn't there or that no token overlaps."""
    first, last = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    c0, c1, at = [0], [len(context)], 0
    for s in sentences:
        here = context.find(s, at)
        there = here >= 0 and len(s) > 0
        at = here + len(s) if here >= 0 else at
        c0.append(here if there else -1)
        c1.append(at if there else -1)
    lo, hi = np.searchsorted(last, np.add(c0, context_at), "right").tolist(), (np.searchsorted(first, np.add(c1, context_at), "left") - 1).tolist()
    spans = [(a, b) if c >= 0 and a <= b else None for c, a, b in zip(c0, lo, hi, strict=True)]
    return spans[1:], spans[0]


def _met(batch, counter: TokenCounter | None, end_to_end: bool):
    """A batch's tokens; where each row's sentences begin; the first and last token of each sentence, the last before the first if none overlaps."""
    t = placed.tokens(batch.column(1), counter)
    first, flat = placed.lists(batch.column(2))
    n, rows = placed.lengths(flat), placed.within(first)[0]
    if end_to_end:
        (c0, c1), gone = placed.laid(first, n), np.zeros(len(n), bool)
    else:
        c0, c1, gone = placed.found(batch.column(1), first, flat, n)
        gone |= n == 0
    # what lies behind the text's end meets no token of the next text
    lo, hi = t.between(*(np.minimum(c + t.at[rows], t.at[rows + 1]) for c in (c0, c1)))
    return t, first, lo, np.where(gone, lo - 1, hi)


def aligned(samples: DataFrame, text: Column, sentences: Column, counter: TokenCounter | None = None, end_to_end: bool = False) -> DataFrame:
    """``sample_id, sent_idx, tok_start, tok_end, n_tokens`` of the sentences of each text, at their true places
    or as if they lay ``end_to_end``. Tokens and sentences of a sample meet on its row, in Arrow batches:
    nothing is shuffled and no token is a row."""

    def work(batch):
        t, first, lo, hi = _met(batch, counter, end_to_end)
        rows, at = placed.within(first)
        none = hi < lo
        return rows, [placed.ints(at), placed.ints(lo - t.first[rows], none), placed.ints(hi - t.first[rows], none), placed.ints(np.where(none, 0, hi - lo + 1))]

    return _on_rows(samples, [text, sentences], work, "sent_idx int, tok_start int, tok_end int, n_tokens int")


def aligned_tokens(samples: DataFrame, text: Column, sentences: Column, counter: TokenCounter | None = None, end_to_end: bool = False) -> DataFrame:
    """``token_sentence`` on each sample's row: ``sample_id, tok_idx, sent_idx``, null for a token of no sentence."""

    def work(batch):
        t, first, lo, hi = _met(batch, counter, end_to_end)
        some = np.flatnonzero(hi >= lo)  # first and last tokens of these rise from one to the next
        last = some[np.maximum(np.searchsorted(lo[some], np.arange(len(t.start)), "right") - 1, 0)] if len(some) else np.zeros(len(t.start), np.int64)
        rows, at = placed.within(t.first)
        here = np.arange(len(t.start))
        none = (lo[last] > here) | (hi[last] < here) if len(some) else np.ones(len(here), bool)
        return rows, [placed.ints(at), placed.ints(last - first[rows], none)]

    return _on_rows(samples, [text, sentences], work, "tok_idx int, sent_idx int")


def context_tokens(samples: DataFrame, text: Column, c0: Column, c1: Column, counter: TokenCounter | None = None) -> DataFrame:
    """``context_span`` on each sample's row: ``sample_id, context_start, context_end`` of characters ``[c0, c1)``."""

    def work(batch):
        t = placed.tokens(batch.column(1), counter)
        begins, ends = t.at[:-1], t.at[1:]
        a, b = (np.clip(c.to_numpy(zero_copy_only=False) + begins, begins, ends) for c in batch.columns[2:])
        lo, hi = t.between(a, b)
        none = hi < lo
        return np.arange(batch.num_rows), [placed.ints(lo - t.first[:-1], none), placed.ints(hi - t.first[:-1], none)]

    return _on_rows(samples, [text, c0.cast("long"), c1.cast("long")], work, "context_start int, context_end int")
