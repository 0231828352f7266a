"""Cutting a context that is too long for one forward pass into chunks of sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import has_chinese, split_context
from quern.functions.tokens import TokenCounter
from quern.operators.select import bind, total

_RANGES = "array<struct<first:int,last:int,is_piece:boolean>>"


def needs_chunking(sentence_tokens: Column, room: Column, disabled: bool = False) -> Column:
    return F.lit(False) if disabled else (F.size(sentence_tokens) > 0) & (total(sentence_tokens) > room)


def token_windows(text: Column, size: Column, counter: TokenCounter) -> Column:
    """A text's tokens in windows of ``size``, joined as they stand; a text that fits is left whole."""
    return bind(lambda t, n, tokens: F.when(F.size(tokens) <= n, F.array(t)).otherwise(_windows(tokens, n)), text, size, counter.tokens(text))


def _windows(tokens, size):
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), size), lambda i: F.array_join(F.slice(tokens, i + 1, size), ""))


def pack(sentences: Column, sentence_tokens: Column, size: Column, context_type: Column) -> Column:
    """``array<struct<sentences, is_piece, first>>``: sentences in order, each chunk filled while it fits. A
    joined sentence costs one token more unless the text is Chinese. A sentence larger than a chunk
    closes the open one and stands alone as ``is_piece``."""
    return bind(_pack, sentences, sentence_tokens, size, context_type)


def _pack(sentences, sentence_tokens, size, context_type):
    """The fold carries places only: the open chunk's first sentence (-1: none) and the closed chunks."""
    start = F.struct(F.lit(0).alias("used"), F.lit(-1).alias("first"), F.lit(0).alias("i"), F.array().cast(_RANGES).alias("out"))
    join = F.when(has_chinese(context_type, sentences), 0).otherwise(1)

    def range_(first, last, piece):
        return F.array(F.struct(first.alias("first"), last.alias("last"), F.lit(piece).alias("is_piece")))

    def closed(acc):
        return F.when(acc["first"] >= 0, F.concat(acc["out"], range_(acc["first"], acc["i"], False))).otherwise(acc["out"])

    def step(acc, n):
        used = F.when(acc["first"] >= 0, acc["used"] + join).otherwise(0) + n
        fits, huge = used <= size, n > size
        return F.struct(
            F.when(fits, used).when(huge, 0).otherwise(n).alias("used"),
            F.when(fits & (acc["first"] >= 0), acc["first"]).when(~fits & huge, -1).otherwise(acc["i"]).alias("first"),
            (acc["i"] + 1).alias("i"),
            F.when(fits, acc["out"]).when(huge, F.concat(closed(acc), range_(acc["i"], acc["i"] + 1, True))).otherwise(closed(acc)).alias("out"),
        )

    ranges = F.aggregate(sentence_tokens, start, step, closed)
    return F.transform(ranges, lambda r: F.struct(F.slice(sentences, r["first"] + 1, r["last"] - r["first"]).alias("sentences"), r["is_piece"].alias("is_piece"), r["first"].alias("first")))


def chunk_sentences(sentences: Column, sentence_tokens: Column, room: Column, context_type: Column, counter: TokenCounter, min_words: int = 1, disabled: bool = False, windows: Column | None = None) -> Column:
    """``array<array<string>>``: the sentences of each chunk, one chunk if all fit. Pieces of an oversized
    sentence are cut into sentences again. ``windows`` has the pieces of each sentence for counters that are not Column expressions."""
    if windows is None:
        return bind(lambda s, n, r, k: _chunk_sentences(s, n, r, k, lambda c: token_windows(c["sentences"][0], r, counter), min_words, disabled), sentences, sentence_tokens, room, context_type)
    return bind(lambda s, n, r, k, w: _chunk_sentences(s, n, r, k, lambda c: F.element_at(w, c["first"] + 1), min_words, disabled), sentences, sentence_tokens, room, context_type, windows)


def _chunk_sentences(sentences, sentence_tokens, room, context_type, pieces, min_words, disabled):
    cut = F.flatten(
        F.transform(
            pack(sentences, sentence_tokens, room, context_type),
            lambda c: F.when(c["is_piece"], F.transform(pieces(c), lambda p: split_context(p, context_type, min_words))).otherwise(F.array(c["sentences"])),
        )
    )
    return F.when(needs_chunking(sentence_tokens, room, disabled), cut).otherwise(F.array(sentences))
