"""Token counters. A counter turns a text column into a count, or into surface tokens."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class TokenCounter(Protocol):
    def count(self, text: Column) -> Column: ...

    def count_each(self, texts: Column) -> Column: ...

    def tokens(self, text: Column) -> Column: ...

    def encoder(self):
        """A function for Python workers: of a text, the first ``limit`` tokens (None: all), and where each starts and ends."""
        ...


class _Native:
    """Counters of built-in expressions only, which lambdas may use."""

    native = True

    def count_each(self, texts: Column) -> Column:
        return F.transform(texts, self.count)


@dataclass(frozen=True)
class RegexTokenCounter(_Native):
    """Runs of letters, single digits, single other characters. Built-in expressions only."""

    pattern: str = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]"

    def count(self, text: Column) -> Column:
        return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(self.pattern)).cast("int")

    def tokens(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({self.pattern})"), F.lit(1))


    def encoder(self):
        import regex

        # white space as in the JVM's patterns, inside a set and outside
        pattern = regex.compile(self.pattern.replace(r"\s", r"[\t\n\x0b\f\r\x20]"), regex.V1)

        def encode(text: str, limit: int | None = None):
            found = [m.span() for m in islice(pattern.finditer(text), limit)]
            return [text[a:b] for a, b in found], [a for a, _ in found], [b for _, b in found]

        return encode


@dataclass(frozen=True)
class CharTokenCounter(_Native):
    """One token for each ``chars`` characters, rounded down: not additive over joined texts."""

    chars: int = 4

    def count(self, text: Column) -> Column:
        return F.floor(F.length(F.coalesce(text, F.lit(""))) / self.chars).cast("int")

    def tokens(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)(.{{1,{self.chars}}})"), F.lit(1))


    def encoder(self):
        n = self.chars

        def encode(text: str, limit: int | None = None):
            starts = range(0, len(text), n)[:limit]
            return [text[a : a + n] for a in starts], [*starts], [min(a + n, len(text)) for a in starts]

        return encode


#: One token for each CJK character, runs of Latin, Greek and Cyrillic letters, single others.
CJK_TOKENS = RegexTokenCounter(r"[一-鿿]|[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}]+|\p{N}|[^\s\p{L}\p{N}]")


@dataclass(frozen=True)
class HFTokenCounter:
    """Counts by a tokenizer file of the public ``tokenizers`` library, in Arrow batches. The path must
    be readable on every executor; each Python worker loads it once."""

    path: str
    native = False

    def _udf(self, kind: str):
        import pandas as pd

        path = self.path

        def load():
            return loaded(path)

        def count(texts):
            return pd.Series([len(e.ids) for e in load().encode_batch(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int32")

        def surface(texts):
            t = load()
            return pd.Series([[s[a:b] for a, b in e.offsets] for s, e in zip(texts.fillna(""), t.encode_batch(texts.fillna("").tolist(), add_special_tokens=False), strict=True)])

        def each(rows):
            t = load()
            return pd.Series([[len(e.ids) for e in t.encode_batch(list(x), add_special_tokens=False)] if x is not None else None for x in rows])

        made = {"count": (count, "int"), "each": (each, "array<int>"), "tokens": (surface, "array<string>")}
        return F.pandas_udf(*made[kind], F.PandasUDFType.SCALAR)

    def encoder(self):
        path = self.path

        def encode(text: str, limit: int | None = None):
            e = loaded(path).encode(text, add_special_tokens=False)
            return e.tokens[:limit], [a for a, _ in e.offsets[:limit]], [b for _, b in e.offsets[:limit]]

        return encode

    def windows(self, sentences: Column, counts: Column, size: Column) -> Column:
        """For each sentence of more than ``size`` tokens its windows of that many, as they stand in the text; null for others."""
        import pandas as pd

        path = self.path

        def run(rows, tokens, sizes):
            out = []
            for sentences, n, size in zip(rows, tokens, sizes, strict=True):
                cut = []
                for s, k in zip(sentences, n, strict=True) if sentences is not None else ():
                    if k <= size:
                        cut.append(None)
                        continue
                    starts = [0, *(a for a, _ in loaded(path).encode(s, add_special_tokens=False).offsets[size::size]), len(s)]
                    cut.append([s[a:b] for a, b in zip(starts, starts[1:], strict=False)])
                out.append(cut)
            return pd.Series(out)

        return F.pandas_udf(run, "array<array<string>>", F.PandasUDFType.SCALAR)(sentences, counts, size)

    def count_each(self, texts: Column) -> Column:
        return self._udf("each")(texts)

    def count(self, text: Column) -> Column:
        return self._udf("count")(text)

    def tokens(self, text: Column) -> Column:
        return self._udf("tokens")(text)


_LOADED: dict[str, object] = {}


def loaded(path: str):
    """A tokenizer, read once by each Python worker."""
    from tokenizers import Tokenizer

    if path not in _LOADED:
        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]
