"""The compressor: samples in, compressed samples out, as one plan without a shuffle.

A sample is a row ``context, question, context_type``; all of its sentences, counts and scores stay
on that row as arrays. A batch is a DataFrame, a single sample a DataFrame of one row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.prompt import context_room
from quern.functions.text import boosted, has_words, output_separator, split_context, sync_sentences
from quern.functions.tokens import RegexTokenCounter, TokenCounter
from quern.operators.chunk import chunk_sentences
from quern.operators.select import bind, drop_order, join_kept, let, resolve_budget, select_budget, select_threshold, standing, total, trim
from quern.plans.options import CompressOptions, EngineConfig
from quern.plans.providers import LexicalProvider, ScoreProvider

RESULT_COLUMNS = ["compressed_text", "original_length", "compressed_length", "compression_ratio", "sentence_scores", "sentences", "preserved_indices", "status"]
_SAMPLE = "sample_id long, context string, question string, context_type string"


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed as they stand. They pass through a generator, across which the
    optimizer does not move expressions: Python functions inside array expressions would get lost there."""
    return df.select(F.inline(F.array(F.struct("*"))))


@dataclass
class Compressor:
    """Query-aware compression of texts.

    ``attention_counter`` measures what fits one forward pass, ``budget_counter`` what budgets are in.
    ``splitter`` replaces the built-in sentence splits: it turns the columns of text and context type into
    an array of sentences (a Python function goes through ``pandas_udf``), from whose starts the text is
    then cut, so that pieces keep the white space between them."""

    config: EngineConfig = field(default_factory=EngineConfig)
    provider: ScoreProvider = field(default_factory=LexicalProvider)
    attention_counter: TokenCounter = field(default_factory=RegexTokenCounter)
    budget_counter: TokenCounter = field(default_factory=RegexTokenCounter)
    splitter: Callable[[Column, Column], Column] | None = None

    @property
    def counter(self) -> TokenCounter:
        return self.budget_counter if self.config.budget_tokens == "budget" else self.attention_counter

    def scored(self, samples: DataFrame) -> DataFrame:
        """``samples`` with ``sentences``, ``n_tokens``, ``sentence_scores`` and ``separator``."""
        have = set(samples.columns)
        text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in have else F.lit(default)
        df = samples.withColumns({"context": text("context", ""), "question": text("question", ""), "context_type": text("context_type", "english")})
        if hasattr(self.provider, "attach"):
            df = self.provider.attach(df)
        kind, words = F.col("context_type"), self.config.min_word_length
        if {"__sentences", "__counts"} <= have:
            cut = F.col("__sentences")
        elif self.splitter is None:
            cut = split_context(F.col("context"), kind, words)
        else:
            df = settled(df.withColumn("__split", self.splitter(F.col("context"), kind)))
            df = settled(df.withColumn("__split", sync_sentences(F.col("__split"), F.col("context"))))
            cut = F.filter("__split", lambda s: has_words(s, words))
        room = context_room(F.col("question"), self.attention_counter, self.config.max_seq_len)
        if self.attention_counter.native:
            chunks = let(cut, lambda s: chunk_sentences(s, self.attention_counter.count_each(s), room, kind, self.attention_counter, words, self.config.disable_chunking))
            df = df.withColumn("__chunks", chunks)
        else:  # Python counters can't stand inside lambdas
            df = settled(df.withColumn("__cut", cut))
            df = settled(df.withColumn("__attn", self.attention_counter.count_each(F.col("__cut"))).withColumn("__room", room))
            df = settled(df.withColumn("__windows", self.attention_counter.windows(F.col("__cut"), F.col("__attn"), F.col("__room"))))
            df = df.withColumn("__chunks", chunk_sentences(F.col("__cut"), F.col("__attn"), F.col("__room"), kind, self.attention_counter, words, self.config.disable_chunking, F.col("__windows")))
        df = df.withColumn("sentences", F.flatten("__chunks"))
        raw = self.provider.score(df, F.col("__chunks"))
        df = df.withColumn("__raw", raw)
        if not getattr(self.provider, "native", True):
            df = settled(df)
        counted = self.counter.count_each(F.col("sentences"))
        if "__counts" in have and self.counter.native:  # chunks may have cut sentences anew
            counted = F.when(F.col("sentences") == F.col("__sentences"), F.col("__counts")).otherwise(counted)
        df = (df if self.counter.native else settled(df)).withColumn("n_tokens", counted)
        df = df.withColumn("sentence_scores", F.zip_with("__raw", "sentences", lambda x, s: boosted(x, s, kind)))
        return df.withColumn("separator", output_separator(kind, F.col("sentences"))).drop("__split", "__chunks", "__cut", "__attn", "__room", "__windows", "__raw", "__features", "__sentences", "__counts")

    def prepared(self, samples: DataFrame) -> DataFrame:
        """``samples`` with their sentences and token counts, made once for each context and type, however
        many questions are asked of it. ``scored`` and ``compress_df`` then take them as they are."""
        key = F.sha2(F.to_json(F.struct("context", "context_type")), 256)
        keyed = samples.withColumn("__doc", key)
        once = keyed.select("__doc", "context", "context_type").dropDuplicates(["__doc"])
        kind, words = F.col("context_type"), self.config.min_word_length
        if self.splitter is None:
            once = once.withColumn("__sentences", split_context(F.coalesce("context", F.lit("")), kind, words))
        else:
            once = settled(once.withColumn("__split", self.splitter(F.col("context"), kind)))
            once = settled(once.withColumn("__split", sync_sentences(F.col("__split"), F.col("context"))))
            once = once.withColumn("__sentences", F.filter("__split", lambda s: has_words(s, words)))
        once = (once if self.counter.native else settled(once)).withColumn("__counts", self.counter.count_each(F.col("__sentences")))
        return keyed.join(once.select("__doc", "__sentences", "__counts"), "__doc").drop("__doc")

    def compress_df(self, samples: DataFrame, options: CompressOptions | None = None) -> DataFrame:
        """``samples`` with the result columns. Columns ``target_token``, ``compression_rate`` and
        ``threshold`` in ``samples`` override the options row by row.

        A null context is empty; a context without sentences gives an empty text, lengths of 0, empty
        arrays and the status ``empty``. Each row is judged with its own question."""
        o = options or CompressOptions()
        have = set(samples.columns)
        value = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
        by_threshold = o.use_threshold_filtering or self.config.use_threshold_by_default
        limit = value("threshold", o.threshold) if o.use_threshold_filtering else F.lit(self.config.default_threshold)
        target, rate = value("target_token", o.target_token), value("compression_rate", float(o.compression_rate))
        step = (lambda x: x) if self.counter.native else settled
        df = step(self.scored(samples))
        sentences, n, scores, sep, kind = (F.col(c) for c in ("sentences", "n_tokens", "sentence_scores", "separator", "context_type"))
        df = step(df.withColumn("original_length", total(n)).withColumn("__sep", self.counter.count(sep)))
        if by_threshold:
            df = df.withColumn("preserved_indices", select_threshold(sentences, scores, limit.cast("double"), kind))
            kept_tokens = bind(lambda tokens: F.aggregate("preserved_indices", F.lit(0), lambda a, i: a + F.element_at(tokens, i + 1)), n)
            ratio = F.when(F.col("original_length") > 0, 1.0 - kept_tokens / F.col("original_length").cast("double")).otherwise(0.0)
        else:
            df = df.withColumn("__target", resolve_budget(F.col("original_length"), target, rate))
            df = step(df.withColumn("__kept", select_budget(sentences, n, scores, F.col("__target"), F.col("__sep"), kind)))
            df = step(df.withColumn("__order", drop_order(sentences, scores, F.col("__kept"), kind)))
            df = df.withColumn("preserved_indices", trim(sentences, n, scores, F.col("__kept"), F.col("__target"), sep, F.col("__sep"), kind, self.counter, F.col("__order")))
            by_target = F.when(F.col("original_length") > 0, 1.0 - F.col("__target") / F.col("original_length").cast("double")).otherwise(0.0)
            ratio = F.when(target > 0, by_target).otherwise(rate.cast("double"))
        df = step(df.withColumn("compression_ratio", ratio.cast("double")))
        df = step(df.withColumn("compressed_text", join_kept(sentences, F.col("preserved_indices"), sep)))
        df = df.withColumn("compressed_length", self.counter.count(F.col("compressed_text"))).withColumn("status", F.when(F.size(sentences) == 0, "empty").otherwise("ok"))
        keep = [c for c in samples.columns if c not in (*RESULT_COLUMNS, "n_tokens", "separator", "__sentences", "__counts")]
        return df.select(*keep, *RESULT_COLUMNS)

    def compress(self, spark: SparkSession, context: str, question: str = "", context_type: str = "english", **options) -> dict:
        """One sample; the result as a dict, with ``processing_time``."""
        return self.compress_batch(spark, [{"context": context, "question": question, "context_type": context_type}], **options)[0]

    def compress_batch(self, spark: SparkSession, samples: Iterable[Mapping], **options) -> list[dict]:
        """Samples as dicts with ``context`` and, if given, ``question`` and ``context_type``; results in
        the same order. ``processing_time`` is the batch's time shared out."""
        rows = [(i, s["context"], s.get("question", ""), s.get("context_type", "english")) for i, s in enumerate(samples)]
        if not rows:
            return []
        began = time.perf_counter()
        got = self.compress_df(spark.createDataFrame(rows, _SAMPLE), CompressOptions(**options)).orderBy("sample_id").collect()
        each = (time.perf_counter() - began) / len(rows)
        return [{c: r[c] for c in RESULT_COLUMNS} | {"processing_time": each} for r in got]

    def report(self, samples: DataFrame, options: CompressOptions | None = None, short: bool | None = None) -> DataFrame:
        """Kept sentences ranked by score: ``sample_id, rank, sent_idx, score, n_tokens, sentence``. In
        threshold mode sentences are shown up to 100 characters."""
        o = options or CompressOptions()
        short = o.use_threshold_filtering if short is None else short
        rows = bind(
            lambda kept, s, x: F.transform(kept, lambda i: F.struct(i.alias("sent_idx"), F.element_at(x, i + 1).alias("score"), F.element_at(s, i + 1).alias("text"))),
            *map(F.col, ("preserved_indices", "sentences", "sentence_scores")),
        )
        df = self.compress_df(samples, o).select("sample_id", F.explode(rows).alias("r")).select("sample_id", "r.*")
        shown = F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text")) if short else F.col("text")
        rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(standing(F.col("score")).desc(), "sent_idx"))
        return df.select("sample_id", rank.alias("rank"), "sent_idx", "score", self.counter.count(F.col("text")).alias("n_tokens"), shown.alias("sentence"))

    def print_report(self, samples: DataFrame, options: CompressOptions | None = None, write=print) -> None:
        """The report of each sample on the console, one sample after the other."""
        rows = self.report(samples, options).orderBy("sample_id", "rank")
        for sample, mine in groupby(rows.toLocalIterator(), key=lambda r: r["sample_id"]):
            kept = [*mine]
            write(f"Sample {sample}: {len(kept)} sentences kept, {sum(r['n_tokens'] for r in kept)} tokens")
            for r in kept:
                write(f"  {r['rank']:2d}. [Index: {r['sent_idx']:2d}] [Score: {r['score']:.3f}] [Tokens: {r['n_tokens']:3d}] {r['sentence']}")

    def info(self) -> dict:
        """Settings, provider and counters."""
        return asdict(self.config) | {"provider": type(self.provider).__name__, "attention_counter": repr(self.attention_counter), "budget_counter": repr(self.budget_counter)}

    def describe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in self.info().items()], "setting string, value string")

    def clear_cache(self, spark: SparkSession) -> None:
        """Drops cached tables of the session."""
        spark.catalog.clearCache()

    def check(self, spark: SparkSession) -> None:
        """Runs one tiny sample, so that a provider that can't load fails here."""
        self.compress(spark, "Hello world. Good morning.", "hello")


def length_buckets(samples: DataFrame, batch_size: int) -> DataFrame:
    """``samples`` with ``bucket``: consecutive batches in the order of their length, ties by id. Lengths and ids alone
    are put in order by ranges; a sample's place is its place in its range and the sizes of the ranges before."""
    length = (F.length(F.coalesce("context", F.lit(""))) + F.length(F.coalesce("question", F.lit("")))).alias("n_chars")
    laid = samples.select("sample_id", length).repartitionByRange("n_chars", "sample_id").sortWithinPartitions("n_chars", "sample_id")
    numbered = laid.select("sample_id", F.monotonically_increasing_id().alias("m"))  # the range above 33 bits of the place
    numbered = numbered.select("sample_id", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))  # one row for each range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = numbered.join(F.broadcast(before), "part").select("sample_id", F.floor((F.col("before") + F.col("at")) / batch_size).alias("bucket"))
    return samples.join(placed, "sample_id")


def compress_distinct(compressor: Compressor, samples: DataFrame, options: CompressOptions | None = None) -> DataFrame:
    """``compress_df`` that works once on samples alike in context, question and type, and splits and
    counts once for those alike in context and type."""
    key = F.sha2(F.to_json(F.struct("context", "question", "context_type")), 256)
    keyed = samples.withColumn("__key", key)
    once = keyed.dropDuplicates(["__key"]).select("__key", "context", "question", "context_type")
    done = compressor.compress_df(compressor.prepared(once), options).select("__key", *RESULT_COLUMNS)
    return keyed.join(done, "__key").drop("__key")
