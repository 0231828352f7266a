"""The compressor: properties, edge cases, and agreement with the row-by-row form."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import align, chunk, probe, select
from quern.operators.detector import Detector, train
from quern.functions.text import split_english
from quern.functions.tokens import CharTokenCounter, HFTokenCounter, RegexTokenCounter
from quern.plans import rowwise
from quern.plans.engine import Compressor, compress_distinct, length_buckets
from quern.plans.options import CompressOptions, EngineConfig
from quern.plans.providers import AttentionProvider, FunctionProvider, TableProvider, attention_probe, hashed_layers
from quern.sources.samples import conform, from_dicts, in_order, read_samples, write_results
from quern.streaming.compress import for_each_batch, to_files

ARTICLE = "The river rose in March. Farmers moved their cattle uphill! Nobody had seen such water before. Was the dam safe? Engineers said it would hold. It held until May."
NEWS = "新闻内容：今天天气很好。明天下雨！后天呢？类别：天气。没有其他消息。"
SAMPLES = [
    {"context": ARTICLE, "question": "was the dam safe"},
    {"context": ARTICLE, "question": "where did farmers move"},
    {"context": NEWS, "question": "天气", "context_type": "chinese"},
    {"context": "Passage: a b c.\n\nQuestion: what is it?\n\nOther words here.", "context_type": "fewshot"},
    {"context": "def f(x):\n  return x;\n\nclass A:\n  b = {\n  }\n", "context_type": "code", "question": "return x"},
    {"context": ""},
    {"context": "123. 456."},
]


@pytest.mark.parametrize("options", [{"compression_rate": 0.5}, {"compression_rate": 0.8}, {"target_token": 12}, {"compression_rate": 1.0}])
def test_agrees_with_rows_one_by_one(spark, options):
    got = Compressor().compress_batch(spark, SAMPLES, **options)
    for s, g in zip(SAMPLES, got, strict=True):
        want = rowwise.compress(s["context"], s.get("question", ""), options.get("target_token", -1), options.get("compression_rate", 0.5), s.get("context_type", "english"))
        assert g["sentences"] == want["sentences"]
        assert g["preserved_indices"] == want["preserved_indices"]
        assert g["compressed_text"] == want["compressed_text"]
        assert g["compressed_length"] == want["compressed_length"]
        assert np.allclose(g["sentence_scores"], want["sentence_scores"])


def test_questions_of_one_text_are_kept_apart(spark):
    a, b = Compressor().compress_batch(spark, SAMPLES[:2], compression_rate=0.8)
    assert a["sentence_scores"] != b["sentence_scores"]


def test_single_is_a_batch_of_one(spark):
    c = Compressor()
    single = c.compress(spark, **SAMPLES[0], compression_rate=0.6)
    batch = c.compress_batch(spark, SAMPLES[:3], compression_rate=0.6)[0]
    assert {k: v for k, v in single.items() if k != "processing_time"} == {k: v for k, v in batch.items() if k != "processing_time"}
    assert c.compress_batch(spark, []) == []


def test_empty_contexts(spark):
    for options in ({}, {"target_token": 5}, {"use_threshold_filtering": True}):
        for r in Compressor().compress_batch(spark, SAMPLES[5:], **options):
            assert (r["status"], r["compressed_text"], r["original_length"], r["preserved_indices"]) == ("empty", "", 0, [])


def test_threshold_mode(spark):
    everything = Compressor().compress(spark, ARTICLE, "dam", use_threshold_filtering=True, threshold=0.0)
    assert everything["preserved_indices"] == list(range(6)) and everything["compression_ratio"] == 0.0
    best = Compressor().compress(spark, ARTICLE, "dam", use_threshold_filtering=True, threshold=1.1)
    assert best["preserved_indices"] == [int(np.argmax(best["sentence_scores"]))]
    by_default = Compressor(EngineConfig(use_threshold_by_default=True, default_threshold=0.0)).compress(spark, ARTICLE, "dam", threshold=1.1)
    assert by_default["preserved_indices"] == list(range(6))


def test_double_arithmetic_of_the_rate(spark):
    assert spark.range(1).select(select.resolve_budget(F.lit(100), F.lit(-1), F.lit(0.8)).alias("x")).first().x == 19


def test_mandatory_skips_but_ranking_stops(spark):
    s = F.array(*map(F.lit, ["类别：a", "b", "类别：c", "d"]))
    pick = lambda target: spark.range(1).select(select.select_budget(s, F.array(*map(F.lit, [9, 1, 2, 1])), F.array(*map(F.lit, [0.9, 0.2, 0.5, 0.8])), F.lit(target), F.lit(0), F.lit("chinese")).alias("x")).first().x
    assert pick(4) == [2]  # 0 is skipped as mandatory and stops the ranking
    assert pick(13) == [0, 1, 2, 3]
    assert pick(0) == [0]


def test_trim_with_a_tokenizer(spark):
    p = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    c = Compressor(budget_counter=HFTokenCounter(p))
    r = c.compress(spark, ARTICLE, "dam", target_token=20)
    assert 0 < r["compressed_length"] <= 20


def test_budget_holds(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("context"))
    for counter in (RegexTokenCounter(), CharTokenCounter(4)):
        got = Compressor(budget_counter=counter).compress_df(d, CompressOptions(target_token=40))
        assert got.where("compressed_length > 40 and size(preserved_indices) > 1").count() == 0
        assert got.where("preserved_indices <> array_sort(array_distinct(preserved_indices))").count() == 0


def test_chunks(spark):
    long = " ".join([ARTICLE] * 6)
    whole = Compressor().compress(spark, long, "dam")
    cut = Compressor(EngineConfig(max_seq_len=90)).compress(spark, long, "dam")
    assert cut["sentences"] == whole["sentences"] and cut["sentence_scores"] != whole["sentence_scores"]
    off = Compressor(EngineConfig(max_seq_len=90, disable_chunking=True)).compress(spark, long, "dam")
    assert off["sentence_scores"] == whole["sentence_scores"]
    pieces = Compressor(EngineConfig(max_seq_len=45)).compress(spark, "word " * 60 + ".", "dam")
    assert len(pieces["sentences"]) > 1
    d = spark.createDataFrame([(["a b c", "d", "e f g h i j", "k"],)], "s array<string>")
    got = d.select(chunk.pack(F.col("s"), RegexTokenCounter().count_each(F.col("s")), F.lit(5), F.lit("english")).alias("c")).first().c
    assert [(c.sentences, c.is_piece) for c in got] == [(["a b c", "d"], False), (["e f g h i j"], True), (["k"], False)]


def test_report_and_info(spark):
    c = Compressor()
    rows = c.report(from_dicts(spark, SAMPLES[:1]), CompressOptions(compression_rate=0.2)).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and all(a.score >= b.score for a, b in zip(rows, rows[1:], strict=False))
    assert c.describe(spark).count() == len(c.info())
    c.check(spark)


def test_duplicates_and_buckets(spark):
    d = from_dicts(spark, [SAMPLES[0], SAMPLES[1], SAMPLES[0]])
    got = {r.sample_id: r.compressed_text for r in compress_distinct(Compressor(), d).collect()}
    assert got[0] == got[2] and len(got) == 3
    b = length_buckets(from_dicts(spark, [{"context": "x" * n} for n in (5, 1, 3, 3)]), 2)
    assert {r.sample_id: r.bucket for r in b.collect()} == {1: 0, 2: 0, 3: 1, 0: 1}


def test_dense_probe_is_the_sql_probe(spark):
    draw = np.random.default_rng(0)
    q, k = draw.standard_normal((4, 8)), draw.standard_normal((2, 30, 8))
    spans = [(3, 7), (8, 8), (9, 20)]
    keys = spark.createDataFrame([(1, 0, h, t, k[h, t].tolist()) for h in range(2) for t in range(30)], "sample_id int, layer int, head int, tok_idx int, k array<double>")
    qs = spark.createDataFrame([(1, 0, h, q[h].tolist()) for h in range(4)], "sample_id int, layer int, head int, q array<double>")
    raw = probe.raw_scores(probe.expand_heads(keys, qs, 2), 0.5)
    s = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(spans)], "sample_id int, sent_idx int, tok_start int, tok_end int")
    want = attention_probe(q, k, spans, (3, 24), 0.5)
    for ratios in (probe.renormalise(probe.softmax(raw), F.col("tok_idx").between(3, 24)), probe.context_softmax(raw, F.col("tok_idx").between(3, 24))):
        got = {r.sent_idx: r.features for r in probe.features(probe.sentence_mean(ratios, s)).collect()}
        assert np.allclose([got[i] for i in range(3)], want, atol=1e-9)


def test_attention_provider_is_the_probe_tables(spark):
    """Prompt, alignment, two layers and pooling on the row against the joins of long tables."""
    question, d = "was the dam safe", Detector((1.0, -0.5, 2.0, 0.7), 0.1)
    c = Compressor(provider=AttentionProvider(hashed_layers, d))
    got = c.scored(from_dicts(spark, [{"context": ARTICLE, "question": question}])).first()
    prompt = f"Given the following information: {ARTICLE}\nAnswer the following question based on the given information with one or few words: {question}\nAnswer:"
    text = spark.createDataFrame([(0, prompt, got.sentences)], "sample_id long, t string, s array<string>")
    tokens = align.token_rows(text, F.col("t"))
    spans = align.token_spans(tokens, align.char_spans(align.sentence_rows(text, F.col("s")), 33))
    window = align.context_span(tokens, spark.createDataFrame([(0, 33, 33 + len(ARTICLE))], "sample_id long, c0 int, c1 int")).first()
    layers = hashed_layers([r.token for r in tokens.orderBy("tok_idx").collect()])
    keys = spark.createDataFrame([(0, i, 0, t, k[0, t].tolist()) for i, (_, k, _) in enumerate(layers) for t in range(k.shape[1])], "sample_id long, layer int, head int, tok_idx int, k array<double>")
    queries = spark.createDataFrame([(0, i, h, q[h].tolist()) for i, (q, _, _) in enumerate(layers) for h in range(2)], "sample_id long, layer int, head int, q array<double>")
    met = probe.raw_scores(probe.expand_heads(keys, queries, 2), layers[0][2])
    ratios = probe.renormalise(probe.softmax(met), F.col("tok_idx").between(window.context_start, window.context_end))
    want = [r.p for r in probe.features(probe.sentence_mean(ratios, spans)).withColumn("p", d.score(F.col("features"))).orderBy("sent_idx").collect()]
    assert len(want) == len(got.sentences) == 6 and np.allclose(got.sentence_scores, want, atol=1e-9)


def test_attention_of_truncated_and_empty_contexts(spark):
    d = Detector((1.0, -0.5, 2.0, 0.7), 0.1)
    cut = Compressor(provider=AttentionProvider(hashed_layers, d, max_seq_len=12)).scored(from_dicts(spark, [{"context": ARTICLE, "question": "x"}, {"context": ""}])).orderBy("sample_id").collect()
    nothing = 1 / (1 + np.exp(-0.1))
    assert not np.isclose(cut[0].sentence_scores[0], nothing) and np.allclose(cut[0].sentence_scores[2:], nothing) and cut[1].sentence_scores == []
    chunked = Compressor(EngineConfig(max_seq_len=45), provider=AttentionProvider(hashed_layers, d)).scored(from_dicts(spark, [{"context": ARTICLE, "question": "x"}])).first()
    assert len(chunked.sentence_scores) == len(chunked.sentences) >= 6
    short = AttentionProvider(hashed_layers, d, max_seq_len=2)
    assert short.features("abc. def.", ["abc. ", "def."], "x", RegexTokenCounter().encoder()).tolist() == [[0.0] * 4] * 2


def test_align_on_the_row_is_the_join(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("sample_id"), F.coalesce("text", F.lit("")).alias("t")).limit(60)
    sentences = split_english(F.col("t"))
    columns = ["sample_id", "sent_idx", "tok_start", "tok_end", "n_tokens"]
    want = align.token_spans(align.token_rows(d, F.col("t")), align.char_spans(align.sentence_rows(d, sentences))).select(columns)
    assert sorted(map(str, align.aligned(d, F.col("t"), sentences).collect())) == sorted(map(str, want.collect()))


ODD = [
    (0, "One two.  Three 4 five!", ["One two.  ", "Three 4 five!"]),
    (1, None, None),
    (2, "", []),
    (3, "ab", ["a", "b"]),  # a token of two sentences
    (4, "cd\u00a0中文𝒳𝒴 12—é", ["cd\u00a0", "", "中文", "𝒳", "𝒴 12—é and more than the text", "gone"]),
    (5, " \n ", [" \n "]),
    (6, "Endsinletters", ["Ends", "in", "letters"]),
    (7, "startsinletters x" * 300, ["startsinletters x"] * 300),
]


def _spans_by_hand(text, sentences, end_to_end, counter=RegexTokenCounter()):
    tokens, starts, ends = counter.encoder()(text)
    out, at = [], 0
    for s in sentences:
        a = at if end_to_end else text.find(s, at)
        here = a >= 0 and (s or end_to_end)
        met = [i for i in range(len(tokens)) if here and ends[i] > a and starts[i] < a + len(s)]
        at = a + len(s) if a >= 0 else at
        out.append((met[0], met[-1], len(met)) if met else (None, None, 0))
    return [*zip(tokens, starts, ends, strict=True)], out


@pytest.mark.parametrize("counter", [RegexTokenCounter(), CharTokenCounter(3)])
@pytest.mark.parametrize("size", [1, 1 << 22])
def test_tokens_and_sentences_on_the_row(spark, monkeypatch, counter, size):
    """Tokens, spans and tokens' sentences by arrays against a loop, in batches of one row and of several."""
    import pyarrow as pa

    from quern.operators import placed

    monkeypatch.setattr(placed, "SLICE_BYTES", size)
    batch = pa.RecordBatch.from_pydict({"i": [r[0] for r in ODD], "t": pa.array([r[1] for r in ODD], pa.string()), "s": pa.array([r[2] for r in ODD], pa.list_(pa.string()))})
    for end_to_end in (True, False):
        got_tokens, got_spans = {r[0]: [] for r in ODD}, {r[0]: [] for r in ODD}
        for part in placed.slices([batch.slice(1), batch.slice(0, 1)]):
            t, first, lo, hi = align._met(part, counter, end_to_end)
            ids = part.column(0).to_pylist()
            for row, at, token, a, b in zip(*placed.within(t.first), t.surface.to_pylist(), t.start, t.end, strict=True):
                got_tokens[ids[row]].append((token, a - t.at[row], b - t.at[row]))
            for row, a, b in zip(placed.within(first)[0], lo, hi, strict=True):
                got_spans[ids[row]].append((a - t.first[row], b - t.first[row], b - a + 1) if b >= a else (None, None, 0))
        for i, text, sentences in ODD:
            assert (got_tokens[i], got_spans[i]) == _spans_by_hand(text or "", sentences or [], end_to_end, counter)


def test_row_forms_are_the_long_joins(spark):
    d = spark.createDataFrame(ODD, "sample_id int, t string, s array<string>").repartition(2)
    t, s = F.col("t"), F.col("s")
    tokens = align.token_rows(d, t)
    assert sorted((r.sample_id, r.tok_idx, r.token, r.char_start, r.char_end) for r in tokens.collect()) == [(i, k, *x) for i, text, _ in ODD for k, x in enumerate(_spans_by_hand(text or "", [], True)[0])]
    assert max(r.tok_idx for r in align.token_rows(d, t, max_tokens=3).collect()) == 2
    spans = align.token_spans(tokens, align.char_spans(align.sentence_rows(d, s)))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(align.aligned(d, t, s, end_to_end=True), spans)
    assert same(align.aligned_tokens(d, t, s, end_to_end=True), align.token_sentence(tokens, spans))
    for a, b in ((0, 4), (2, 3), (5, 900), (7, 7)):
        windows = d.select("sample_id", F.lit(a).alias("c0"), F.lit(b).alias("c1"))
        assert same(align.context_tokens(d, t, F.lit(a), F.lit(b)), align.context_span(tokens, windows))


@pytest.mark.parametrize("name", ["token_rows", "token_spans", "token_to_sentence", "context_span"])
def test_tokens_are_not_shuffled(spark, data, name):
    from quern.plans.queries import QUERIES

    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "Join" not in plan


def test_true_spans_of_a_long_text(spark):
    """Linear in the text: each sentence was looked for from the text's first byte on."""
    import time

    text = "".join(f"Sentence {i} ends. " for i in range(30_000))
    d = spark.createDataFrame([(1, text)], "sample_id int, t string")
    began = time.perf_counter()
    got = align.true_spans(d, F.col("t"), split_english(F.col("t"))).agg(F.count("char_start").alias("n"), F.max("char_end").alias("e")).first()
    assert (got.n, got.e) == (30_000, len(text)) and time.perf_counter() - began < 10


def test_prompts_are_cut_while_they_are_read(spark):
    """Encoders stop at their limit, and pooling gives the means of overlapping, missing and single-token spans."""
    text = "Words 12, and more. " * 2_000
    for counter in (RegexTokenCounter(), CharTokenCounter(3)):
        encode = counter.encoder()
        assert encode(text, 7) == tuple(x[:7] for x in encode(text)) and len(encode(text)[0]) > 7
        from quern.operators.placed import encode_each

        texts = [text, "", "ab", "cd 𝒳é! x y z 1 2"]
        assert [tuple(map(list, e)) for e in encode_each(texts, counter, 7)] == [encode(t, 7) for t in texts]
    rng = np.random.default_rng(1)
    q, k, spans = rng.normal(size=(4, 8)), rng.normal(size=(2, 40, 8)), [(3, 9), None, (9, 9), (8, 20), (30, 36), None]
    raw = np.einsum("hd,htd->ht", q, np.repeat(k, 2, axis=0)) * 0.3
    p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
    ratio = p / p[:, 3:37].sum(1, keepdims=True)
    want = [ratio[:, s[0] : s[1] + 1].mean(1) if s else np.zeros(4) for s in spans]
    assert np.allclose(attention_probe(q, k, spans, (3, 36), 0.3), want, rtol=1e-12)


def test_windows_of_the_attention_tokenizer(spark):
    """Pieces of an oversized sentence are measured by the counter that the pass is measured by."""
    import public_tokenizers

    counter = HFTokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    c = Compressor(EngineConfig(max_seq_len=60), attention_counter=counter, budget_counter=counter)
    long = " ".join(f"unpronounceable{i}" for i in range(80)) + "."
    df = c.scored(from_dicts(spark, [{"context": f"Short one. {long} End.", "question": "x"}]))
    got = df.select("sentences", "n_tokens").first()
    room = 60 - 10 - len(counter.encoder()("Given the following information: \nAnswer the following question based on the given information with one or few words: x\nAnswer:")[0])
    assert len(got.sentences) > 4 and max(got.n_tokens) <= max(room, 1) + 1
    assert "".join("".join(got.sentences).split()) == "".join(f"Short one. {long} End.".split())


def test_prep_is_shared_by_questions(spark):
    rows = [{"context": ARTICLE, "question": q} for q in ("was the dam safe", "where did farmers move", "was the dam safe")] + [{"context": NEWS, "context_type": "chinese"}, {"context": ""}]
    samples = from_dicts(spark, rows)
    c, o = Compressor(EngineConfig(max_seq_len=60)), CompressOptions(compression_rate=0.6)
    show = lambda df: sorted(map(str, df.select("sample_id", "compressed_text", "original_length", "compressed_length", "preserved_indices", "status").collect()))
    assert show(c.compress_df(c.prepared(samples), o)) == show(c.compress_df(samples, o)) == show(compress_distinct(c, samples, o))
    assert c.compress_df(c.prepared(samples), o).columns == c.compress_df(samples, o).columns


def test_table_provider_counts_sentences(spark):
    samples = from_dicts(spark, [{"context": ARTICLE}])
    table = spark.createDataFrame([(0, [[0.1, 0.2, 0.3, 0.4]] * 2)], "sample_id long, features array<array<double>>")
    with pytest.raises(Exception, match="features of 2 sentences for 6"):
        Compressor(provider=TableProvider(table)).compress_df(samples).collect()


def test_console_report(spark):
    lines = []
    Compressor().print_report(from_dicts(spark, SAMPLES[:2]), CompressOptions(compression_rate=0.6), lines.append)
    assert sum(x.startswith("Sample ") for x in lines) == 2 and lines[1].startswith("   1. [Index: ")


def test_selection_of_many_sentences(spark):
    """A ranking of thousands is folded without copies."""
    draw = np.random.default_rng(2)
    n = 4_000
    tokens, scores = draw.integers(1, 9, n).tolist(), draw.random(n).round(3).tolist()
    df = spark.createDataFrame([(["x"] * n, tokens, scores, sum(tokens) // 2)], "s array<string>, n array<int>, x array<double>, t int")
    got = df.select(select.select_budget(F.col("s"), F.col("n"), F.col("x"), F.col("t"), F.lit(1), F.lit("english")).alias("k")).first().k
    used, want = 0, []
    for i in sorted(range(n), key=lambda i: -scores[i]):
        cost = tokens[i] + (1 if want else 0)
        if used + cost > sum(tokens) // 2:
            break
        used, want = used + cost, [*want, i]
    assert got == sorted(want)


def test_spans_with_lost_separators(spark):
    d = spark.createDataFrame([(1, "ab\n\ncd\n\nef", ["ab", "cd", "zz", "ef"])], "sample_id int, t string, s array<string>")
    got = [(r.char_start, r.char_end) for r in align.true_spans(d, F.col("t"), F.col("s")).orderBy("sent_idx").collect()]
    assert got == [(0, 2), (4, 6), (None, None), (8, 10)]
    compat = [(r.char_start, r.char_end) for r in align.char_spans(align.sentence_rows(d, F.col("s"))).orderBy("sent_idx").collect()]
    assert compat == [(0, 2), (2, 4), (4, 6), (6, 8)]


def test_detectors(spark, tmp_path):
    d = Detector((1.0, -1.0), 0.5, (0.1, 0.2), (2.0, 0.0))
    x = np.array([[0.3, 0.2], [1.0, 0.2]])
    got = [r.p for r in spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").select(d.score(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, d.probability(x))
    # one layer's features stand for each layer; another number is an error
    two = Detector((1.0, -1.0, 3.0, 0.5), -0.5)
    got = [r.p for r in spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").select(two.score(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, two.probability(np.tile(x, 2))) and np.allclose(got, two.probability(x))
    for n in (0, 3, 8):
        with pytest.raises(Exception, match="features, but the detector has 4"):
            spark.createDataFrame([([0.5] * n,)], "x array<double>").select(two.score(F.col("x"))).collect()
        with pytest.raises(ValueError):
            two.probability(np.zeros((1, n)))
    assert spark.createDataFrame([(None,)], "x array<double>").select(two.score(F.col("x"))).first()[0] is None
    with pytest.raises(ValueError):
        Detector((1.0,), mean=(1.0, 2.0))
    with pytest.raises(ValueError):
        Detector.read(spark, "x.pkl")
    (tmp_path / "d.json").write_text(json.dumps({"coef": [[1, -1]], "intercept": [0.5]}))
    assert Detector.read(spark, str(tmp_path / "d.json")).coef == (1.0, -1.0)
    rows = spark.createDataFrame([([float(i % 7), float(i % 2)], i % 2) for i in range(60)], "features array<double>, label int")
    p = [(r.label, r.p) for r in rows.select("label", train(rows).score(F.col("features")).alias("p")).collect()]
    assert all((v > 0.5) == bool(y) for y, v in p)


def test_estimators():
    class Scaler:
        mean_, scale_ = np.array([1.0, 2.0]), np.array([3.0, 4.0])

    class Linear:
        coef_, intercept_ = np.array([[5.0, 6.0]]), np.array([7.0])

    class Pipe:
        steps = [("s", Scaler()), ("l", Linear())]

    assert Detector.from_estimator(Pipe()) == Detector((5.0, 6.0), 7.0, (1.0, 2.0), (3.0, 4.0))
    with pytest.raises(ValueError):
        Detector.from_estimator(Scaler())


def test_providers(spark):
    by_length = FunctionProvider(lambda sentences, question: np.array([len(s) / 100 for s in sentences]))
    assert Compressor(provider=by_length).compress(spark, ARTICLE, "dam")["sentence_scores"][0] == pytest.approx(len("The river rose in March. ") / 100)
    table = spark.createDataFrame([(0, [[float(i)] for i in range(6)])], "sample_id long, features array<array<double>>")
    got = Compressor(provider=TableProvider(table, Detector((1.0,)))).compress_batch(spark, SAMPLES[:2])
    assert np.argmax(got[0]["sentence_scores"]) == 5 and set(got[1]["sentence_scores"]) == {0.0}


def test_own_splitter(spark):
    halves = F.pandas_udf(lambda t, k: t.map(lambda x: [x[: len(x) // 2], x[len(x) // 2 :]]), "array<string>", F.PandasUDFType.SCALAR)
    got = Compressor(splitter=halves).compress(spark, ARTICLE, "dam")
    assert "".join(got["sentences"]) == ARTICLE and len(got["sentences"]) == 2


def test_row_options_and_other_columns(spark):
    d = from_dicts(spark, SAMPLES[:2]).withColumn("compression_rate", F.when(F.col("sample_id") == 0, 0.2).otherwise(0.9)).withColumn("status", F.lit("mine"))
    got = {r.sample_id: r for r in Compressor().compress_df(d).collect()}
    assert len(got[0].preserved_indices) > len(got[1].preserved_indices) and got[0].status == "ok"


def test_sources_and_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_results(from_dicts(spark, SAMPLES), src, "json")
    samples = read_samples(spark, src, "json")
    assert samples.count() == len(SAMPLES)
    with pytest.raises(ValueError):
        conform(spark.range(1))
    with pytest.raises(ValueError):
        read_samples(spark, src, "xml")
    assert [r["sample_id"] for r in in_order(Compressor().compress_df(samples))] == list(range(len(SAMPLES)))
    stream = spark.readStream.schema("sample_id long, context string, question string, context_type string").json(src)
    to_files(Compressor(), stream, out, str(tmp_path / "c"), availableNow=True).awaitTermination(60)
    direct = {r.sample_id: r.compressed_text for r in Compressor().compress_df(samples).collect()}
    assert {r.sample_id: r.compressed_text for r in spark.read.parquet(out).collect()} == direct
    seen = []
    q = stream.writeStream.foreachBatch(for_each_batch(Compressor(), lambda df, i: seen.append(df.count()))).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(seen) == len(SAMPLES)


def test_mandatory_selection_of_whole_texts(spark, tmp_path):
    """The registered query against a fold in Python, on texts far longer than 3,000 characters too."""
    from quern.functions import text as T
    from quern.plans.queries import QUERIES, REGEX

    body = lambda k, n: " ".join(f"{'On the' if (i * k) % 5 == 0 else 'Word'} {'abc' * (1 + (i * 7 + k) % 9)} number {i} ends." for i in range(n))
    rows = [(0, "One the end. Two."), (1, body(1, 40)), (2, body(2, 400)), (3, body(3, 900)), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.createDataFrame([(i, "类别：" + (t or "").replace(" the ", " 类别：the ")) for i, t in rows], "sample_id long, context string")
    d = d.withColumn("s", T.split_english(F.col("context")))
    want = {}
    for r in d.withColumn("n", REGEX.count_each(F.col("s"))).collect():
        score = [(len(s) * 7 + i * 13) % 101 / 101 for i, s in enumerate(r.s)]
        order, target, used, kept = sorted(range(len(r.s)), key=lambda i: (-score[i], i)), sum(r.n) // 3, 0, []
        for i in (i for i, s in enumerate(r.s) if "类别：" in s):
            cost = used + r.n[i] + (2 if kept else 0)
            if cost <= target:
                used, kept = cost, [*kept, i]
        for i in order:
            if i not in kept:
                cost = used + r.n[i] + (2 if kept else 0)
                if cost > target:
                    break
                used, kept = cost, [*kept, i]
        want[r.sample_id] = ",".join(map(str, sorted(kept) or order[:1]))
    assert {r.sample_id: r.kept for r in QUERIES["select_budget_mandatory"](spark, str(tmp_path)).collect()} == want


def test_separators_join_every_sentence(spark, tmp_path):
    from quern.functions import text as T
    from quern.plans.queries import QUERIES

    rows = [(0, "One. Two! Three? Four. Five."), (1, ARTICLE), (2, None), (3, "One. Two. Three. 四。")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    heads = ("新闻内容：", "Question: ", "类别 ")
    d = spark.createDataFrame([(i, heads[i % 3] + (t or "")) for i, t in rows], "sample_id long, context string")
    sentences = {r.sample_id: r.s for r in d.select("sample_id", T.split_english(F.col("context")).alias("s")).collect()}
    got = QUERIES["join_separators"](spark, str(tmp_path)).collect()
    assert len(got) == 4 * len(rows) and max(map(len, sentences.values())) > 3
    for r in got:
        s, kind = sentences[r.sample_id], r.context_type
        block = kind in ("code", "fewshot") or kind == "chinese" and any(heads[0] in x for x in s)
        assert r.out_join == ("\n\n" if block else " ").join(s)
        assert r.chunk_join == ("\n\n" if block else "" if kind == "chinese" else " ").join(s)
        assert r.has_chinese == (kind == "chinese" or any("一" <= c <= "鿿" for c in "".join(s[:3])))
