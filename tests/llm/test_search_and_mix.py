"""Nearest neighbours, mixing, and the pipeline."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import ann, exact_dedup, mixing, ngram_join, quality
from quern.llm.queries import PRODUCTION_MIX, domain_of, op2_ann, op4_mixing
from quern.llm.runtime import release, shared_dir

from .conftest import ROWS


def brute(ids, v, q, k=20):
    s = v @ v[q]
    keep = np.flatnonzero(ids != ids[q])
    return [int(ids[i]) for i in keep[np.lexsort((ids[keep], -s[keep]))[:k]]]


def test_recall(spark, data):
    t = spark.read.parquet(f"{data}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, v = t["vec_id"].to_numpy(), np.array(t["embedding"].tolist(), float)
    got = op2_ann(spark, data).toPandas()
    hit = n = 0
    for q in np.flatnonzero(ids % 20 == 0):
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine["score"], [v[np.searchsorted(ids, i)] @ v[q] for i in mine["vec_id"]], atol=1e-12)
        hit, n = hit + len(set(mine["vec_id"]) & set(brute(ids, v, q))), n + 20
    assert hit / n >= 0.9


def test_odd_vectors(spark):
    draw = np.random.default_rng(4)
    v = draw.standard_normal((60, 6))
    v[10:40] = v[10]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(100, None), (120, [0.0] * 6), (140, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (160, [float("nan")] * 6), (180, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (200, [1.0, 2.0]), (220, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, id string")
    got = ann.search(df, segment=25, block=2).toPandas()
    assert set(got["query_id"]) == {0, 20, 40}
    for q in (0, 20, 40):
        mine = got[got["query_id"] == q].sort_values("rank")
        assert len(set(mine["id"]) & set(brute(np.arange(60), v, q))) >= 18
    assert got[got["query_id"] == 20].sort_values("rank")["id"].tolist()[:5] == brute(np.arange(60), v, 20)[:5]
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 20")).count() == 0
    assert ann.search(df.where("vec_id in (20, 7)")).count() == 1


def fill(amount, rooms, weights):
    """By rounds: what one can't take is shared by the others until all are full or all is taken."""
    given = [0.0] * len(rooms)
    for group in ([i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(weights) if w <= 0]):
        open_ = [i for i in group if rooms[i] > 0]
        left = amount - sum(given)
        while open_ and left > 1e-9:
            worth = {i: weights[i] if weights[i] > 0 else 1 for i in open_}
            offer = {i: left * worth[i] / sum(worth.values()) for i in open_}
            full = [i for i in open_ if offer[i] >= rooms[i]]
            for i in full or open_:
                given[i] = rooms[i] if full else offer[i]
                left -= given[i]
            open_ = [i for i in open_ if i not in full] if full else []
    return given


def weight(mix, path):
    names = (path, (*path[:-1], "*"), (*("*" for _ in path[:-1]), path[-1]))
    return next((mix.weights[n] for n in names if n in mix.weights), mix.default)


def brute_allot(supply, mix, budget):
    room = {}
    for leaf, n in supply.items():
        for k in range(len(leaf) + 1):
            room[leaf[:k]] = room.get(leaf[:k], 0) + n
    given = {(): min(budget, room.get((), 0))}
    for path in sorted(room, key=len):
        below = [p for p in room if p and p[:-1] == path]
        given |= dict(zip(below, fill(given[path], [room[p] for p in below], [weight(mix, p) for p in below]), strict=True))
    return {leaf: int(given[leaf] + 1e-6) for leaf in supply}


def allotted(spark, supply, mix, budget):
    df = spark.createDataFrame([(*k, float(n)) for k, n in supply.items()], "a string, b string, c string, room double")
    return {(r.a, r.b, r.c): r.given for r in mixing.allot(df, ["a", "b", "c"], mix, budget).collect()}


def test_fill():
    assert fill(10, [100, 100], [1, 3]) == [2.5, 7.5]
    assert fill(10, [1, 100, 100], [2, 1, 1]) == [1, 4.5, 4.5]
    assert fill(10, [2, 3], [1, 1]) == [2, 3]
    assert fill(4, [2, 100], [1, 0]) == [2, 2]


def test_shortage_goes_to_siblings_before_ancestors(spark):
    mix = mixing.Mix(weights={("a",): 1, ("b",): 1})
    supply = {("a", "en", "s1"): 10, ("a", "en", "s2"): 200, ("b", "en", "s3"): 500}
    assert allotted(spark, supply, mix, 200) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 90, ("b", "en", "s3"): 100}
    assert allotted(spark, supply | {("a", "en", "s2"): 20}, mix, 200) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 20, ("b", "en", "s3"): 170}
    assert sum(allotted(spark, supply, mix, 10**6).values()) == 710
    assert allotted(spark, {}, mix, 5) == {}


def test_shares_of_random_trees(spark):
    """The closed form against rounds: empty nodes, nodes of no weight, ties, and patterns of weights."""
    draw = np.random.default_rng(8)
    for seed in range(4):
        names = [(f"d{i}", f"l{j}", f"s{k}") for i in range(4) for j in range(3) for k in range(5) if draw.random() < 0.6]
        supply = {p: int(draw.choice([0, 7, 100, 100, 1000, draw.integers(1, 5000)])) for p in names}
        weights = {p[: draw.integers(1, 4)]: float(draw.choice([0, 0.5, 1, 3])) for p in names if draw.random() < 0.5} | {("*", "l1"): 2.0, ("*", "*", "s2"): 0.0, ("d1", "*"): 0.3}
        mix = mixing.Mix(weights=weights, default=float(seed % 2))
        for share in (0.0, 0.2, 0.7, 1.0, 2.0):
            budget = share * sum(supply.values())
            assert allotted(spark, supply, mix, budget) == brute_allot(supply, mix, budget)


def brute_mix(rows, mix):
    """``rows`` of (id, leaf, tokens): copies of each by sorting each leaf as a whole."""
    size = {}
    for _, leaf, n in rows:
        size[leaf] = size.get(leaf, 0) + n
    given = brute_allot({k: n * mix.max_epochs for k, n in size.items()}, mix, mix.share * sum(size.values()))
    out = {}
    for leaf, total in size.items():
        epochs, rest = divmod(given[leaf], total) if total else (mix.max_epochs, 0)
        mine = [(i, n) for i, x, n in rows if x == leaf]
        key, used, open_ = {i: hashlib.md5(f"{mix.seed}:{epochs}:{i}".encode()).hexdigest()[:13] for i, _ in mine}, 0, rest > 0
        for i, n in sorted(mine, key=lambda x: (key[x[0]], x[0])):
            open_ = open_ and used + n <= rest
            used += n
            out[i] = epochs + open_
    return out


@pytest.mark.parametrize(("bucket", "broadcast"), [(2, mixing.BROADCAST_LEAVES), (2000, mixing.BROADCAST_LEAVES), (50, 0)])
def test_mix_is_the_sorted_prefix(spark, data, bucket, broadcast, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", broadcast)
    d = spark.read.parquet(f"{data}/documents.parquet")
    columns = (domain_of(F.col("source")), F.col("lang"), F.col("source"), mixing.word_count(F.col("text")))
    got = mixing.select(d, PRODUCTION_MIX, *columns, bucket=bucket).collect()
    want = brute_mix([(r.id, (r.domain, r.lang, r.source), r.n_tokens) for r in got], PRODUCTION_MIX)
    assert {r.id: r.copies for r in got} == want and len(got) == d.count()
    assert {r.doc_id: r.copies for r in op4_mixing(spark, data).collect()} == want


def test_mix_edges(docs, no_docs):
    columns = (F.col("nothing"), F.col("lang"), F.col("source"), mixing.word_count(F.col("text")))
    add = lambda df: df.withColumn("nothing", F.lit(None).cast("string")).withColumns({k: F.lit("mine") for k in ("domain", "__domain", "__id", "__row", "__order", "__copies")})
    got = mixing.taken(add(docs), mixing.Mix(share=0.5), *columns)
    assert got.columns == [c for c in add(docs).columns if c not in ("__domain", "__copies")] + ["__domain", "__lang", "__source", "__tokens", "__copies"]
    assert got.count() == len(ROWS) and {r[0] for r in got.select("__domain").distinct().collect()} == {"(none)"}
    total, used = got.agg(F.sum("__tokens"), F.sum(F.col("__tokens") * F.col("__copies"))).first()
    assert 0 < used <= total / 2
    assert mixing.taken(add(docs), mixing.Mix(share=1.0), *columns).where("__copies <> 1").count() == 0
    assert mixing.taken(add(docs), mixing.Mix(budget=0), *columns).where("__copies > 0 and __tokens > 0").count() == 0
    assert mixing.taken(add(no_docs), mixing.Mix(share=0.5), *columns).count() == 0


def test_stages_on_odd_rows(spark, docs, no_docs, data):
    """Nulls, empty texts, repeated rows, an empty table and clashing names go through each stage."""
    odd = docs.withColumn("lang", F.when(F.col("id") % 3 == 0, F.col("lang"))).withColumn("source", F.when(F.col("id") % 4 > 0, F.col("source"))).withColumns({k: F.lit(1) for k in ("__row", "__id", "__score", "__text", "__copies", "raw", "h")})
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, odd, data), stage(spark, odd.limit(0), data)
        assert none.count() == 0
        assert 0 < got.count() <= len(ROWS), name
        if name != "bpe":
            assert got.columns == none.columns == odd.columns, name
            rows = Counter(map(str, got.collect()))
            assert not rows - Counter(map(str, odd.collect())), name


def test_pipeline_leaves_one_table(spark, data, monkeypatch):
    deleted = release(spark)
    got = corpus_pipeline.run(spark, data)
    assert got.count() > 0 and release(spark) == 1 and deleted >= 0


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}"
        stage(spark, docs, data).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert len(kept[name]) == docs.count() > 0
        if name != "bpe":
            assert docs.columns == columns
    d = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = quality.score(d, quality.fit(d, labels)).where(F.col("score") >= quality.CUT)
    assert kept["quality_classifier"] == {r.doc_id for r in good.collect()} and len(good.collect()) < before
    first = {r.id for r in exact_dedup.exact_dedup(good).where("kept").collect()}
    assert kept["exact_dedup"] == first
    one = ngram_join.join(good.join(spark.createDataFrame([(i,) for i in first], "doc_id long"), "doc_id")).where("class_id = id")
    assert kept["ngram_join"] == {r.id for r in one.collect()}
    assert kept["mixing"] < kept["ngram_join"] and kept["bpe"] == kept["mixing"]
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and docs.where("size(ids) <> n_tokens").count() == 0
    assert len({r.doc_id for r in corpus_pipeline.run(spark, data).collect()} ^ kept["bpe"]) == 0
