"""Where sentence scores come from.

A provider turns a chunk's sentences and the question into one feature array per sentence; a
detector turns features into scores. The default one is lexical: Column expressions only and no
quality claim. Models come in as ``FunctionProvider``, whose function runs in Arrow batches and is
loaded once per Python worker, or as ``TableProvider`` with features computed elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.prompt import PROMPT_HEAD, PROMPT_MIDDLE, PROMPT_TAIL
from quern.functions.tokens import RegexTokenCounter, TokenCounter
from quern.operators.align import align_prompt
from quern.operators.detector import Detector
from quern.operators.placed import encode_each
from quern.operators.select import let

LEXICAL_DETECTOR = Detector(coef=(4.0, 0.5, 0.8, 0.5), intercept=-1.5)


class ScoreProvider(Protocol):
    def score(self, samples: DataFrame, chunks: Column) -> Column:
        """``array<double>``: scores of all chunks' sentences, in order. ``samples`` has ``sample_id``,
        ``question`` and ``context_type``."""


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1))


@dataclass(frozen=True)
class LexicalProvider:
    """Four features of a sentence: the share of the question's words in it, 1 over its place in the
    chunk, its length up to 30 words, and its share of distinct words."""

    detector: Detector = LEXICAL_DETECTOR

    def features(self, sentence: Column, place: Column, terms: Column) -> Column:
        def of(w):
            n = F.size(w).cast("double")
            return F.array(
                F.size(F.array_intersect(w, terms)) / F.greatest(F.size(terms), F.lit(1)).cast("double"),
                F.lit(1.0) / (place + 1).cast("double"),
                F.least(n / F.lit(30.0), F.lit(1.0)),
                F.size(F.array_distinct(w)) / F.greatest(n, F.lit(1.0)),
            )

        return let(words(sentence), of)

    def score(self, samples: DataFrame, chunks: Column) -> Column:
        terms = F.array_distinct(words(F.coalesce(F.col("question"), F.lit(""))))
        each = lambda q: F.flatten(F.transform(chunks, lambda c: F.transform(c, lambda s, i: self.detector.score(self.features(s, i, q)))))
        return let(terms, each)


@dataclass(frozen=True)
class FunctionProvider:
    """``function(sentences, question)`` gives an array of features by sentence and feature, or of
    scores if there is no detector. It may load a model on first use."""

    function: Callable[[list[str], str], np.ndarray]
    detector: Detector | None = None
    native = False

    def score(self, samples: DataFrame, chunks: Column) -> Column:
        import pandas as pd

        function, detector = self.function, self.detector

        def run(rows, question):
            out = []
            for row, q in zip(rows, question.fillna(""), strict=True):
                scores: list[float] = []
                for chunk in row if row is not None else ():
                    x = np.asarray(function(list(chunk), q), float)
                    scores += (x if detector is None else detector.probability(x)).tolist()
                out.append(scores)
            return pd.Series(out)

        return F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR)(chunks, F.col("question"))


@dataclass(frozen=True)
class TableProvider:
    """Features computed elsewhere: ``sample_id, features array<array<double>>``, one inner array per
    sentence in order. Samples without a row score 0; one with another number of sentences is an error."""

    table: DataFrame
    detector: Detector = field(default=LEXICAL_DETECTOR)

    def attach(self, samples: DataFrame) -> DataFrame:
        return samples.join(self.table.select("sample_id", F.col("features").alias("__features")), "sample_id", "left")

    def score(self, samples: DataFrame, chunks: Column) -> Column:
        n, found = F.size(F.flatten(chunks)), F.size("__features")
        wrong = F.raise_error(F.concat(F.lit("features of "), found.cast("string"), F.lit(" sentences for "), n.cast("string"))).cast("array<double>")
        known = F.when(found == n, F.transform(F.col("__features"), self.detector.score)).otherwise(wrong)
        return F.when(F.col("__features").isNotNull(), known).otherwise(F.transform(F.flatten(chunks), lambda s: F.lit(0.0)))


def attention_probe(q: np.ndarray, k: np.ndarray, spans: list[tuple[int, int] | None], context: tuple[int, int], scale: float) -> np.ndarray:
    """Features of sentences from one layer's query rows ``[heads, dim]`` and keys ``[kv_heads, tokens,
    dim]``: softmax over all tokens, divided by its sum over the context, averaged by sentence. A
    sentence without tokens has zeros. The dense form of ``quern.operators.probe``."""
    heads, (start, end) = len(q), context
    raw = np.einsum("kgd,ktd->kgt", q.reshape(len(k), heads // len(k), -1), k).reshape(heads, -1) * scale
    p = np.exp(raw - raw.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p = p[:, start : end + 1]
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-8)
    p[np.isnan(p)] = 0.0
    out = np.zeros((len(spans), heads))
    held = [i for i, span in enumerate(spans) if span is not None]
    if held:
        ranges = np.array([spans[i] for i in held]) - (start, start - 1)
        sums = np.add.reduceat(np.concatenate([p, np.zeros((heads, 1))], axis=1), ranges.ravel(), axis=1)[:, ::2]
        out[held] = (sums / (ranges[:, 1] - ranges[:, 0])).T
    return out


Layers = Callable[[list[str]], Iterable[tuple[np.ndarray, np.ndarray, float]]]


@dataclass(frozen=True)
class AttentionProvider:
    """Scores by a language model's attention from the last token of the scoring prompt.

    Of each chunk the prompt is built with its question and cut into tokens with their places, the first
    ``max_seq_len`` of them; sentences and the context are aligned with the tokens (``align_prompt``). ``layers``
    is the model: from a prompt's tokens it gives, layer by layer, the last token's queries ``[heads, dim]``,
    all keys ``[kv_heads, tokens, dim]`` and the scale. Attention is pooled by sentence (``attention_probe``),
    layers stand side by side, and the detector makes scores of them. It runs in Arrow batches; ``layers``
    may load a model on first use. A sentence behind the last token kept, or without a token, has features of 0."""

    layers: Layers
    detector: Detector
    counter: TokenCounter = field(default_factory=RegexTokenCounter)
    max_seq_len: int = 32_768
    native = False

    def features(self, context: str, sentences: list[str], question: str, encode) -> np.ndarray:
        return self.pooled(context, sentences, encode(PROMPT_HEAD + context + PROMPT_MIDDLE + question + PROMPT_TAIL, self.max_seq_len))

    def pooled(self, context: str, sentences: list[str], encoded: tuple) -> np.ndarray:
        """Features of one chunk, whose prompt's first tokens, their starts and their ends are ``encoded``."""
        tokens, starts, ends = encoded
        spans, window = align_prompt(starts, ends, context, sentences, len(PROMPT_HEAD))
        if window is None:
            return np.zeros((len(sentences), len(self.detector.coef)))
        return np.concatenate([attention_probe(q, k, spans, window, scale) for q, k, scale in self.layers(tokens)], axis=1)

    def score(self, samples: DataFrame, chunks: Column) -> Column:
        import pandas as pd

        def run(rows, contexts, questions, kinds):
            asked = []
            for at, (row, context, question, kind) in enumerate(zip(rows, contexts, questions.fillna(""), kinds, strict=True)):
                for chunk in row if row is not None else ():
                    sentences = list(chunk)
                    # one chunk is the context as it stands
                    text = context if len(row) == 1 else ("" if kind == "chinese" else " ").join(sentences)
                    if sentences:
                        asked.append((at, text, sentences, PROMPT_HEAD + text + PROMPT_MIDDLE + question + PROMPT_TAIL))
            out: list[list[float]] = [[] for _ in rows]
            encoded = encode_each([a[-1] for a in asked], self.counter, self.max_seq_len)
            for (at, text, sentences, _), e in zip(asked, encoded, strict=True):
                out[at] += self.detector.probability(self.pooled(text, sentences, e)).tolist()
            return pd.Series(out)

        return F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR)(chunks, F.col("context"), F.col("question"), F.col("context_type"))


def hashed_layers(tokens: list[str]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """A stand-in for a model: two layers of two query heads on one key head, three coordinates each, made
    of a token's length, its first character and the number of tokens. It has learnt nothing."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))[:, None]
    first = np.frombuffer("".join([t[0] for t in tokens]).encode("utf-32-le"), np.uint32).astype(np.int64)[:, None]
    d, h = np.arange(3), np.arange(2)[:, None]
    out = []
    for layer in range(2):
        k = ((size * (d + 1) + first * (layer + 1)) % 11 - 5) / 5.0
        q = ((size[-1] + first[-1] * (h + 2) + d * (layer + 3) + len(tokens)) % 9 - 4) / 4.0
        out.append((q, k[None], 0.7))
    return out
