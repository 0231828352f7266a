"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup, ngram_join, runtime, suffix_dedup
from quern.llm.components import components
from quern.llm.shingles import MinHash, jaccard, shingles

from .conftest import ROWS, prose, swap


def test_exact(spark, docs):
    got = exact_dedup.exact_dedup(docs, hash_all=True).collect()
    assert len(got) == len(ROWS)
    norm = [re.sub("[ \t-\r]+", " ", t or "") for _, t in ROWS]
    groups = defaultdict(list)
    for (i, _), n in zip(ROWS, norm, strict=True):
        groups[hashlib.sha256(n.encode()).hexdigest()].append(i)
    by = defaultdict(list)
    for r in got:
        by[r.sha256].append(r)
    assert by.keys() == groups.keys()
    for k, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        assert sorted(map(str, (r.id for r in by[k]))) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in by[k]} == {(first, len(ids))}
        assert sum(r.kept for r in by[k]) == 1 and all(r.id == first for r in by[k] if r.kept)


@pytest.mark.parametrize("bits", [runtime.MOST_BITS, 1 << 15])
def test_exact_without_hashing_all(docs, bits, monkeypatch):
    monkeypatch.setattr(runtime, "MOST_BITS", bits)
    columns = ["id", "keep_id", "group_size", "kept"]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    assert rows(exact_dedup.exact_dedup(docs)) == rows(exact_dedup.exact_dedup(docs, hash_all=True))


def test_exact_with_hot_groups(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_dedup(docs, hash_all=True).collect()))
    monkeypatch.setattr(runtime, "LEAST_HOT", 1)
    monkeypatch.setattr(runtime, "MOST_HOT", 20)
    assert sorted(map(str, exact_dedup.exact_dedup(docs, hash_all=True).collect())) == want


def test_sieve_never_leaves_a_key_out(spark):
    keys = spark.range(0, 60_000, 3).withColumn("h", F.xxhash64("id"))
    got = runtime.sifted(spark.range(60_000), F.xxhash64("id"), runtime.sieve(keys, F.col("h")), "may").groupBy((F.col("id") % 3 == 0).alias("key"), "may").count().collect()
    n = {(r["key"], r["may"]): r["count"] for r in got}
    assert n[True, True] == 20_000 and (True, False) not in n and n[False, True] < 4_000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("least", [1_000, 3])
def test_join_counted(spark, monkeypatch, how, least):
    monkeypatch.setattr(runtime, "LEAST_HOT", least)
    rows = spark.range(3_000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 500 + 1_000))
    keys = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k < 1400")
    plain = rows.join(keys, ["k"], how)
    got = runtime.join_counted(rows, keys, ["k"], "n", how)
    assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_keep_first(docs, no_docs):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    norm = Counter(re.sub("[ \t-\r]+", " ", r.text or "") for r in kept.collect())
    assert set(norm.values()) == {1} and set(norm) == {re.sub("[ \t-\r]+", " ", t or "") for _, t in ROWS}
    assert exact_dedup.keep_first(no_docs).count() == 0


def test_keep_first_under_names_of_its_own(spark):
    """Ids and columns named like those that are used inside; rows alike in id and text, and in text only."""
    rows = [(1, "a  b", 0), (1, "a  b", 1), (1, "a b", 2), (2, "a b", 3), (3, "c", 4), (None, "c", 5), (None, "d", 6), (None, "d", 7)]
    df = spark.createDataFrame(rows, "id long, t string, __row long").repartition(3)
    got = [(r["id"], r.t) for r in exact_dedup.keep_first(df, "id", "t").collect()]
    assert sorted(map(str, got)) in (sorted(map(str, [(1, x), (3, "c"), (None, "d")])) for x in ("a  b", "a b"))
    assert exact_dedup.keep_first(df, "id", "t").columns == df.columns


def brute_links(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    links = [{j for j in range(len(rows)) if j != i and jaccard(sets[i], sets[j]) >= least} for i in range(len(rows))]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in links[i])]) for i in range(len(rows))]
    ids = defaultdict(list)
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            ids[c].append(rows[i][0])
    return [(rows[i][0], min(ids[comp[i]], default=None), len(links[i])) for i in range(len(rows))]


@pytest.mark.parametrize(("light", "tile"), [(32, 384), (1, 3)])
def test_ngram_join(spark, docs, light, tile):
    """With small buckets listed, and with all of them compared tile by tile."""
    got = [(r.id, r.class_id, r.n_links) for r in ngram_join.join(docs, light=light, tile=tile).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_links(ROWS)))


def test_ngram_join_of_a_large_group(spark):
    base = prose(1, 90)
    rows = [(i, swap(swap(base, i % 80), (7 * i) % 89)) for i in range(130)] + [(200 + i, prose(1000 + i, 60)) for i in range(20)]
    got = [(r.id, r.class_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), light=8, tile=40).collect()]
    assert sorted(got) == sorted(brute_links(rows))


def test_keep_one(docs, no_docs):
    kept = ngram_join.keep_one(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {3, 4, 7, 22} <= ids and not {20, 21, 23} & ids and {30, 31, 32, None} <= ids
    assert ngram_join.join(no_docs).count() == 0


def test_keep_one_drops_rows_and_not_ids(spark):
    """A row that only shares an id with a dropped one stays; of equal rows of one id one stays."""
    a, other = prose(1, 60), prose(2, 60)
    rows = [(1, a), (2, a), (2, other), (5, prose(3, 50)), (5, prose(3, 50)), (6, swap(other, 3)), (None, a), (7, None), (7, ""), (8, " ")]
    df = spark.createDataFrame(rows, "id long, key string").repartition(3)
    got = [(r.id, r.key) for r in ngram_join.keep_one(df, "id", "key").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, a), (2, other), (5, prose(3, 50)), (7, None), (7, ""), (8, " ")]))
    assert ngram_join.keep_one(df.limit(0), "id", "key").count() == 0


def test_banding_recall():
    draw, found, pairs = np.random.default_rng(0), 0, 400
    m = MinHash(ngram_join.BANDS, ngram_join.ROWS)
    for _ in range(pairs):
        x = draw.integers(0, 2**63, 220, dtype=np.uint64)
        found += bool((m(np.unique(x[:200])) == m(np.unique(np.r_[x[:178], x[200:]]))).any())  # similarity 0.80
    assert found / pairs > 0.99


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(texts, length=suffix_dedup.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts, length=suffix_dedup.PASSAGE):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    return [len({j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}) for w in words]


def passages():
    p, q = prose(900, 90), prose(901, 70)
    rows = list(ROWS) + [(50 + i, f"{prose(600 + i, 12)} {p[i:]} {prose(700 + i, 9)}") for i in range(9)] + [(70 + i, f"{q} {prose(800 + i, 5)} {q[:420]}") for i in range(3)]
    short = " ".join(f"w{i}" for i in range(60))  # 60 words in fewer than 400 bytes
    rows += [(90 + i, f"{prose(950 + i, 8)}\n{short}  {prose(960 + i, 8)}") for i in range(3)] + [(95, " ".join(short.split()[5:54])), (96, short.replace(" ", "\t"))]
    return rows + [(80, "ab" * 900), (81, "x" * 399), (82, "x" * 400), (83, "This " * 300), (84, p + p), (85, "é" * 350)]


def removed(spark):
    rows = passages()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, raw string, unit int").repartition(3)
    got = suffix_dedup.remove_repeats(df, with_text=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    texts = [t for _, t in rows]
    want = [(i, *x, n) for (i, _), x, n in zip(rows, brute_removed(texts), brute_passages(texts), strict=True)]
    assert sorted(map(str, ((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in got))) == sorted(map(str, want))


def test_suffix(spark):
    removed(spark)


def test_suffix_in_shares(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    removed(spark)


def test_suffix_in_pieces():
    """A text longer than a chunk falls into runs that together hold the same windows."""
    import pyarrow as pa

    text = prose(5, 3000)
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["t"])
    whole = list(suffix_dedup._chunks(batch, 0))
    old, suffix_dedup.CHUNK = suffix_dedup.CHUNK, 2000
    try:
        parts = list(suffix_dedup._chunks(batch, 0))
    finally:
        suffix_dedup.CHUNK = old
    windows = lambda chunks: sorted(s + at for _, starts, ends, data, at in chunks for _, first, last, *_ in [suffix_dedup.runs(data, starts, ends)] for a, b in zip(first, last, strict=True) for s in range(a, b + 1))
    assert len(parts) > 3 and windows(parts) == windows(whole) == list(range(len(text.encode()) - suffix_dedup.LENGTH + 1))


def test_log_index_levels_double():
    draw, index = np.random.default_rng(1), suffix_dedup.LogIndex()
    batches = [np.array([b"%08d" % x for x in draw.integers(0, 400, 30)], "S16") for _ in range(13)]
    for b in batches:
        index.add(b)
    every = np.concatenate(batches)
    counts = Counter(every.tolist())
    assert [size for size, *_ in index.levels] == [8, 4, 1]
    assert index.marks().tolist() == [counts[x] > 1 for x in every.tolist()]


def test_suffix_of_nothing(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
