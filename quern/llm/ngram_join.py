"""N-gram Jaccard self-join by MinHash banding, and the groups of near duplicates it gives.

1. One pass makes a document's set of word 5-grams, its 128-bit key and a hash for each band. With
   24 bands of 5 minima a pair at 0.8 shares a band with a chance of 1 - (1 - 0.8^5)^24 > 0.9999.
2. Equal sets are one class with one representative; only representatives go on, so a text that is
   copied to a third of the rows is one row here.
3. Representatives meet on (band, hash). Buckets of at most ``LIGHT`` give their pairs, each once.
   Larger buckets give a chain to their smallest member; representatives so connected form a heavy
   group, which is cut into blocks of about ``TILE`` and compared block against block. Work on a
   group is spread over its tiles, and a tile returns sums and a spanning set, never its pairs.
4. Every pair is verified on the full sets.
5. Links (and spanning sets) give connected components.

Sets are not stored: texts of documents that have a candidate are looked up and cut again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.runtime import in_arrow, join_counted, raw_digest, sieve, sifted, without, written
from quern.llm.shingles import WORDS, MinHash, jaccard, set_key, shingles

SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: The largest bucket whose pairs are listed, and the members of a block of a heavy group.
LIGHT, TILE = 32, 384
#: Grams of a member on average up to which blocks have ``TILE`` members; of longer texts they have fewer.
GRAMS = 2_000


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """``id, raw, n, key, bands`` of each row."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), text.alias("t"), raw_digest(text).alias("raw"))

    def run(batches):
        minhash = MinHash(bands, rows)
        for batch in batches:
            n, key, low = [], [], []
            for x in batch.column(1):
                s = shingles(x.as_py(), words)
                n.append(len(s))
                key.append(set_key(s))
                low.append(minhash(s) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int32()), pa.array(key, pa.binary()), pa.array(low, pa.list_(pa.int64()))], ["id", "raw", "n", "key", "bands"])

    return in_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, raw long, n int, key binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``rep, set`` of the wanted ``id, raw, rep, key``. Only texts that a sieve of these lets pass are shuffled."""
    on = ["__id", "__none", "__raw"]
    ids = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")).alias("__id"), F.col(c).isNull().alias("__none"))
    w = written(wanted.select(*ids("id"), F.col("raw").alias("__raw"), "rep", "key"))
    text = F.col(text_col).cast("string")
    rows = docs.select(*ids(id_col), raw_digest(text).alias("__raw"), text.alias("t"))
    hashed = F.xxhash64(*on)
    found = sifted(rows, hashed, sieve(w, hashed), "__may").where("__may").join(w, on).select("rep", "key", "t")

    def run(batches):
        for batch in batches:
            reps, sets = [], []
            for rep, key, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                s = shingles(text.as_py(), words)
                if set_key(s) == key.as_py():
                    reps.append(rep.as_py())
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.binary())], ["rep", "set"])

    return in_arrow(found, run, "rep long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def run(batches):
        for batch in batches:
            keep = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_arrow(both, run, "a long, b long").distinct()


def compare_tile(block: np.ndarray, sets: list[np.ndarray], least: float, across: bool) -> np.ndarray:
    """Boolean matrix of the pairs of a tile that are similar: within the one block, or, with
    ``across``, between members of different ``block`` numbers. Intersections are products of 0/1
    matrices over slices of the shingles that more than one member has."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(m), sizes.astype(int))
    _, place, times = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    column = np.cumsum(times > 1)[place[shared]] - 1
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((m, m), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, width), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        both += x @ x.T
    union = sizes[:, None] + sizes[None] - both
    similar = both / np.maximum(union, 1) >= least
    np.fill_diagonal(similar, False)
    if across:
        similar &= block[:, None] != block[None]
    return similar


def _tiles(heavy: DataFrame, sets: DataFrame, least: float, tile: int) -> DataFrame:
    """``rep, root, links``: for each member of a tile its weighted links there and the smallest
    member that its links lead to. ``heavy`` has ``rep, n, size, grp``."""
    blocks = written(heavy.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / (tile * GRAMS))).cast("int").alias("blocks"), F.count("*").alias("members")))
    placed = join_counted(heavy, blocks, ["grp"], "members").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("rep", "size", "grp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    full = dealt.join(sets, "rep")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("rep")  # an id given to equal rows brings its set more than once
        reps, weight = part["rep"].to_numpy(), part["size"].to_numpy()
        similar = compare_tile(part["block"].to_numpy(), [np.frombuffer(s, np.uint64) for s in part["set"]], least, part["i"].iloc[0] != part["j"].iloc[0])
        root = np.arange(len(reps))
        order = np.argsort(reps)
        reps, weight, similar = reps[order], weight[order], similar[order][:, order]
        while True:  # smallest place reachable: labels sink along links until they rest
            low = np.where(similar, root[None], len(reps)).min(1, initial=len(reps))
            new = np.minimum(root, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"rep": reps, "root": reps[root], "links": similar @ weight.astype(np.int64)})

    return full.groupBy("grp", "i", "j").applyInPandas(run, "rep long, root long, links long")


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, words: int, bands: int, rows: int, light: int, tile: int) -> DataFrame:
    """``id, raw, row`` of each row with ``first`` (``id, raw, row`` of the row that stands for its class),
    ``n_links`` and ``n_copies``, null for a row without words."""
    sig = written(signatures(docs, id_col, text_col, words, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    reps = sig.where("n > 0").groupBy("key").agg(F.min("row").alias("rep"), F.count("*").alias("size"))
    head = sig.select(F.col("row").alias("rep"), "id", "raw", "n", "bands")
    reps = written(reps.join(head, "rep"))

    banded = reps.select("rep", "n", F.posexplode("bands").alias("band", "h"))
    buckets = written(banded.groupBy("band", "h").agg(F.count("*").alias("m"), F.min("rep").alias("head")).where("m > 1"))
    members = written(join_counted(banded, buckets, ["band", "h"], "m"))
    heavy = written(components(members.where(F.col("m") > light).select(F.col("rep").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("grp")))
    gathered = members.where(F.col("m") <= light).join(heavy, "rep", "left").groupBy("band", "h").agg(F.array_sort(F.collect_list(F.struct("rep", "n", "grp"))).alias("g"))  # at most ``light`` each

    def candidates(g):
        later = lambda x, i: F.filter(F.slice(g, i + 2, F.size(g)), lambda y: ~F.coalesce(x["grp"] == y["grp"], F.lit(False)) & (F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"])))
        return F.flatten(F.transform(g, lambda x, i: F.transform(later(x, i), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))

    pairs = written(gathered.select(F.explode(candidates(F.col("g"))).alias("p")).select("p.a", "p.b").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(heavy.select("rep")).distinct().join(reps.select("rep", "id", "raw", "key"), "rep")
    sets = written(_sets(docs, wanted, id_col, text_col, words))

    links = written(_verified(pairs, sets, similarity))
    weight = reps.select(F.col("rep").alias("other"), F.col("size").alias("w"))
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    counted = ends.join(weight, "other").select("rep", F.col("w").alias("links"))
    edges = links
    if not heavy.isEmpty():
        tiles = written(_tiles(heavy.join(reps.select("rep", "n", "size"), "rep"), sets, similarity, tile))
        counted = counted.unionByName(tiles.select("rep", "links"))
        edges = edges.unionByName(tiles.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    n_links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = written(components(edges))
    classed = reps.select("rep", "key", "size").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classed = written(classed)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "raw", "row")
    firsts = sig.where("n > 0").groupBy("key").agg(F.min(order).alias("first"))
    names = written(classed.join(firsts, "key").groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("members")))
    n_copies = F.col("size") - 1
    named = join_counted(classed, names, ["component"], "members").join(n_links, "rep", "left")
    info = written(named.select("key", "first", "size", (F.coalesce("links", F.lit(0)) + n_copies).alias("n_links"), n_copies.alias("n_copies")))
    return join_counted(sig.select("id", "raw", "row", "key"), info, ["key"], "size", "left")


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    light: int = LIGHT,
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: ``id, class_id, n_links, n_copies``.

    ``n_links`` counts the other rows whose sets of ``words``-grams have a Jaccard similarity of
    ``similarity`` or more, rows with an equal set among them; ``n_copies`` counts those. ``class_id``
    is the smallest id of the rows that links connect, the row's own if it has none.

    Null and empty texts, and texts of white space, have no words and no links. A text of fewer than
    ``words`` words is one gram. Rows that repeat an id are rows of their own; a null id is larger
    than every other. An empty table gives no rows. Other columns are neither read nor returned.
    """
    out = _classes(docs, id_col, text_col, similarity, words, bands, rows, light, tile)
    zero = F.lit(0).cast("long")
    # without words there is no class; a class of null ids only has no smallest id
    return out.select("id", F.coalesce("first.id", "id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_copies", zero).alias("n_copies"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, light: int = LIGHT, tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id (null ids
    last), of several with that id the one with the smallest digest of its text, and one of rows alike in both, any if other columns
    differ. Rows that only share an id with a dropped one stay. Columns are unchanged; rows without
    words, and so null and empty texts, all stay; an empty table gives no rows."""
    found = _classes(docs, id_col, text_col, similarity, words, bands, rows, light, tile).where("first is not null and first.row <> row")
    again = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.raw") == F.col("raw"))
    return without(docs, id_col, text_col, found.select("id", "raw", again.alias("again")))
