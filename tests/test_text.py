"""Traps of the text functions, by hand-made rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.prompt import context_room, prompt_overhead
from quern.functions.tokens import CJK_TOKENS, CharTokenCounter, HFTokenCounter, RegexTokenCounter
from quern.plans import rowwise


def one(spark, expr, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())).select(expr.alias("x")).first()["x"]


def test_strip_takes_unicode_space(spark):
    assert one(spark, T.strip(F.col("t")), t="\t\u3000a b\u00a0\n") == "a b"


@pytest.mark.parametrize(("text", "n"), [("姚明 abc 12", 4), ("姚明,abc", 3), ("123. 45", 0), ("", 0), ("it's 3pm", 2)])
def test_word_count(spark, text, n):
    assert one(spark, T.word_count(F.col("t")), t=text) == n == rowwise.count_words(text)


def test_code_blocks(spark):
    code = "def f():\n  return 1;\nx = {\n  1,\n}\n\n\n123\n"
    assert one(spark, T.split_code(F.col("t")), t=code) == ["def f():\n  return 1;", "x = {\n  1,\n}"] == rowwise.split_code(code, 1)
    assert one(spark, T.split_code(F.col("t")), t="12\n34") == ["12\n34"]


def test_sync_takes_the_rest_when_a_start_is_missing(spark):
    got = one(spark, T.sync_sentences(F.col("s"), F.col("t")), s=["ab.", "missing", "ef."], t="ab. cd. ef.")
    assert got == ["ab. cd. ef."]
    assert one(spark, T.sync_sentences(F.col("s"), F.col("t")), s=["ab.", "cd.", "ef."], t="  ab. cd.\n ef. ") == ["  ab. ", "cd.\n ", "ef. "]


def test_code_blocks_and_sync_of_long_texts(spark):
    """Linear in the text; blank lines, endings and white space of all kinds as row by row."""
    import random
    import time

    r = random.Random(3)
    bits = ["a", "b1", ";", "{", ":", '"""', "'", "\n", "\n", "\n", " ", "\t", "\u00a0", "中", "12"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(50))) for _ in range(400)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(x.b == rowwise.split_code(x.t, 1) for x in d.select("t", T.split_code(F.col("t")).alias("b")).collect())
    long = spark.createDataFrame([("".join(f"x{i} = 1\ny = {i};\n" for i in range(40_000)), [f"Sentence {i} ends." for i in range(40_000)])], "c string, s array<string>")
    long = long.withColumn("t", F.array_join("s", "\n"))
    began = time.perf_counter()
    got = long.select(F.size(T.split_code(F.col("c"))).alias("blocks"), F.size(T.sync_sentences(F.col("s"), F.col("t"))).alias("pieces")).first()
    assert (got.blocks, got.pieces) == (40_000, 40_000) and time.perf_counter() - began < 10


@pytest.mark.parametrize(("kind", "out", "chunk"), [("code", "\n\n", "\n\n"), ("fewshot", "\n\n", "\n\n"), ("english", " ", " "), ("chinese", " ", "")])
def test_separators(spark, kind, out, chunk):
    s = F.array(F.lit("今天。"), F.lit("明天。"))
    assert one(spark, T.output_separator(F.col("k"), s), k=kind) == out
    assert one(spark, T.chunk_separator(F.col("k"), s), k=kind) == chunk
    news = F.array(F.lit("新闻内容：今天。"))
    assert one(spark, T.output_separator(F.col("k"), news), k="chinese") == one(spark, T.chunk_separator(F.col("k"), news), k="chinese") == "\n\n"


def test_markers_differ_by_colon(spark):
    assert one(spark, T.mandatory(F.col("t"), F.lit("chinese")), t="类别 a") is False
    assert one(spark, T.boosted(F.lit(0.1), F.col("t"), F.lit("chinese")), t="类别 a") == 0.95
    assert one(spark, T.boosted(F.lit(0.1), F.col("t"), F.lit("fewshot")), t="Answer: a") == 1.0
    assert one(spark, T.boosted(F.lit(0.1), F.col("t"), F.lit("english")), t="Answer: a") == 0.1


def test_token_counters(spark):
    t = "The 姚明 cat's 12 ok."
    assert one(spark, RegexTokenCounter().tokens(F.col("t")), t=t) == ["The", "姚明", "cat", "'", "s", "1", "2", "ok", "."]
    assert one(spark, CJK_TOKENS.count(F.col("t")), t=t) == 10
    assert one(spark, CharTokenCounter(4).count(F.col("t")), t="123456789") == 2


def test_hf_counter(spark):
    p = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    texts = ["Hello there", "", "naïve 姚明"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [len(Tokenizer.from_file(p).encode(t, add_special_tokens=False).ids) for t in texts]
    assert [r.n for r in df.select(HFTokenCounter(p).count(F.col("t")).alias("n")).collect()] == want
    each = df.agg(F.collect_list("t").alias("s")).select(HFTokenCounter(p).count_each(F.col("s")).alias("n")).first().n
    assert sorted(each) == sorted(want)


def test_room_is_at_least_one(spark):
    c = RegexTokenCounter()
    overhead = one(spark, prompt_overhead(F.col("q"), c), q="why")
    assert one(spark, context_room(F.col("q"), c, 100), q="why") == 100 - overhead - 10
    assert one(spark, context_room(F.col("q"), c, 5), q="why") == 1


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1.!?。；\n \u3000类{;", max_size=40), min_size=1, max_size=8))
def test_splits_as_row_by_row(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for kind in ("english", "chinese", "code", "fewshot"):
        got = {r.i: r.s for r in df.select("i", T.split_context(F.col("t"), F.lit(kind)).alias("s")).collect()}
        assert [got[i] for i in range(len(texts))] == [rowwise.split(t, kind) for t in texts], kind
    for r in df.select("t", T.split_english(F.col("t")).alias("s")).collect():
        assert "".join(r.s) == r.t or not r.t.strip()
