"""Mixing sources to target weights over a tree domain > language > source.

A token budget is handed down the tree by weight. A node can take no more than its supply, the
tokens below it times the epochs allowed. What a node can't take goes first to its siblings with
room, by their weights, and only when they are all full to the siblings of its parent.

The shares of siblings have a closed form. Put in the order of room per weight, the level
``(amount - rooms before) / weights from here on`` rises as long as children are full and falls after; its
maximum *m* gives each child ``min(room, m * weight)``. So a generation of the tree is one window over its
nodes, whose number doesn't matter to the driver, which sees only the weights and the total.

Each leaf then takes a prefix of its tokens from seeded epochs: an epoch is the leaf's documents in
the order of a hash of (seed, epoch, id); full epochs are taken whole and the last one up to what is
left. To cut an epoch no leaf is sorted as a whole: documents fall into buckets by their hash, small
ones whose number follows the leaf's size; bucket totals are added up in order, buckets before the cut
are taken, and only the one that the cut runs through is put in order.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.runtime import join_counted, packed, written

#: Documents of a bucket, about.
BUCKET = 2_000
#: Leaves up to which the plan is broadcast; more of them meet the documents by ``join_counted``.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Mix:
    """``budget`` is tokens, or with ``share`` set a share of the tokens there are. Weights are looked
    up by path: ``("web",)``, ``("web", "en")``, ``("web", "en", "src3")``; ``*`` stands for any name.
    A path without a weight has ``default``."""

    weights: Mapping[tuple[str, ...], float] = field(default_factory=dict)
    budget: int = 0
    share: float | None = None
    max_epochs: int = 1
    seed: int = 17
    default: float = 1.0


#: What separates the names of a path.
_SEP = "\x1f"


def _weighed(nodes: DataFrame, path: list[str], mix: Mix) -> DataFrame:
    """``nodes`` with ``weight``: of the path itself, of its siblings (``*`` for the last name), or of its
    last name anywhere (``*`` for the others)."""
    weights = nodes.sparkSession.createDataFrame([(_SEP.join(k), float(w)) for k, w in mix.weights.items()], "p string, w double")
    stars = [F.lit("*")] * (len(path) - 1)
    names = [F.col(c) for c in path]
    out = nodes
    for k, key in enumerate((names, [*names[:-1], F.lit("*")], [*stars, names[-1]])):
        out = out.withColumn(f"p{k}", F.concat_ws(_SEP, *key)).join(weights.select(F.col("p").alias(f"p{k}"), F.col("w").alias(f"w{k}")), f"p{k}", "left")
    return out.withColumn("weight", F.coalesce("w0", "w1", "w2", F.lit(float(mix.default)))).drop(*(f"{x}{k}" for x in "pw" for k in range(3)))


def _handed(nodes: DataFrame, parent: list[str], path: list[str]) -> DataFrame:
    """``nodes`` (``amount`` of the parent, ``room``, ``weight``) with ``given``. Children of no weight
    take part only when the others are full, alike."""
    group = F.when(F.col("weight") > 0, 0).otherwise(1)
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    siblings = Window.partitionBy(*parent)
    part = Window.partitionBy(*parent, "__group")
    order = part.orderBy("__ratio", *path)
    df = nodes.withColumn("__group", group).withColumn("__weight", weight).withColumn("__ratio", F.col("room") / F.col("__weight"))
    first = F.sum(F.when(F.col("__group") == 0, F.col("room")).otherwise(0.0)).over(siblings)
    df = df.withColumn("__amount", F.when(F.col("__group") == 0, F.col("amount")).otherwise(F.greatest(F.col("amount") - first, F.lit(0.0))))
    before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("__level", (F.col("__amount") - before) / rest)
    return df.withColumn("given", F.least("room", F.greatest(F.max("__level").over(part), F.lit(0.0)) * F.col("__weight"))).drop("__group", "__weight", "__ratio", "__amount", "__level")


def allot(leaves: DataFrame, path: list[str], mix: Mix, budget: float) -> DataFrame:
    """``leaves`` (the columns ``path`` and ``room``, their tokens times epochs) with ``given``, the tokens of each, rounded down."""
    above = None
    for k in range(1, len(path) + 1):
        here = path[:k]
        nodes = leaves if k == len(path) else leaves.groupBy(*here).agg(F.sum("room").alias("room"))
        nodes = _weighed(nodes, here, mix)
        nodes = nodes.withColumn("amount", F.lit(float(budget))) if above is None else nodes.join(above, path[: k - 1])
        above = _handed(nodes, path[: k - 1], here).drop("amount", "weight")
        if k < len(path):
            above = above.select(*here, F.col("given").alias("amount"))
    return above.withColumn("given", F.floor(F.col("given") + 1e-6).cast("long"))


def word_count(text: Column) -> Column:
    """Tokens of a text for the budget: its runs of other than white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\S++")).cast("long")


_KEYS = ["__domain", "__lang", "__source"]
_OWN = [*_KEYS, "__tokens", "__copies"]


def _named(docs: DataFrame, domain: Column, lang: Column, source: Column, tokens: Column, id_col: str) -> DataFrame:
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    return packed(docs, __id=F.col(id_col), __domain=name(domain), __lang=name(lang), __source=name(source), __tokens=F.coalesce(tokens.cast("long"), F.lit(0).cast("long")))


def _met(rows: DataFrame, leaves: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with what a written table of leaves has for theirs."""
    return rows.join(F.broadcast(leaves), _KEYS, how) if leaves.count() <= BROADCAST_LEAVES else join_counted(rows, leaves, _KEYS, "__docs", how)


def _dealt(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with their leaf's plan, their place in the order of the leaf's last epoch, and the bucket
    of that place."""
    # the first 52 bits of a digest, so that buckets follow the order
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__epochs"), F.coalesce(F.col("__id").cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long")
    return _met(rows, plan).withColumn("__order", order).withColumn("__bucket", F.floor(F.col("__order") / F.lit(2.0**52) * F.col("__buckets")))


def _plan(light: DataFrame, mix: Mix, bucket: int) -> DataFrame:
    leaves = written(light.groupBy(*_KEYS).agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("__docs")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = allot(leaves.withColumn("room", (F.col("tokens") * mix.max_epochs).cast("double")), _KEYS, mix, mix.share * total if mix.share is not None else mix.budget)
    some = F.col("tokens") > 0
    return written(
        given.select(
            *_KEYS,
            "__docs",
            F.when(some, F.expr("given div tokens")).otherwise(mix.max_epochs).cast("long").alias("__epochs"),
            F.when(some, F.col("given") % F.col("tokens")).otherwise(0).cast("long").alias("__rest"),
            F.ceil(F.col("__docs") / bucket).alias("__buckets"),
        )
    )


def _cut(dealt: DataFrame) -> DataFrame:
    """Of each leaf whose last epoch is cut, the bucket that the cut runs through and the tokens before it."""
    sums = dealt.where("__rest > 0").groupBy(*_KEYS, "__docs", "__bucket", "__rest").agg(F.sum("__tokens").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*_KEYS).orderBy("__bucket")))
    over = sums.where(F.col("upto") > F.col("__rest")).withColumn("before", F.col("upto") - F.col("n"))
    return over.groupBy(*_KEYS, "__docs").agg(F.min_by(F.struct(F.col("__bucket").alias("__cut"), F.col("before").alias("__before")), "__bucket").alias("c")).select(*_KEYS, "__docs", "c.*")


def taken(docs: DataFrame, mix: Mix, domain: Column, lang: Column, source: Column, tokens: Column, id_col: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """``docs`` with ``__domain, __lang, __source, __tokens, __copies`` added, in place of columns so named; ``__copies``
    is how often the mix takes the row, 0 for one that it leaves out. Rows are not moved, but for those of the bucket
    of each leaf that the cut runs through, and all of them where there are more than ``BROADCAST_LEAVES`` leaves.

    A leaf never gets more than its allotment: the document over which the cut runs is left out with
    those after it, so up to one document's tokens of a leaf stay unused. Documents without tokens
    are taken as often as their neighbours. Null names make a node called ``(none)``; null tokens are
    0. Ties in the order are broken by id and by place in the table. An empty table gives no rows.
    """
    named = _named(docs, domain, lang, source, tokens, id_col)
    light = written(named.select("__id", *_KEYS, "__tokens"))
    plan = _plan(light, mix, bucket)
    cut = written(_cut(_dealt(light, plan, mix.seed)))
    marked = _met(_dealt(named, plan, mix.seed).drop("__docs"), cut, "left")
    last, here = F.col("__rest") > 0, F.col("__bucket") == F.col("__cut")
    at_cut = F.coalesce(last & here, F.lit(False))
    whole = F.coalesce(last & (F.col("__cut").isNull() | (F.col("__bucket") < F.col("__cut"))), F.lit(False))
    inside = Window.partitionBy(*_KEYS).orderBy("__order", "__id", "__place")
    edge = marked.where(at_cut).withColumn("__place", F.monotonically_increasing_id())
    edge = edge.withColumn("__upto", F.col("__before") + F.sum("__tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # once the cut has been passed nothing behind it is taken
    edge = edge.withColumn("__extra", F.min((F.col("__upto") <= F.col("__rest")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rest = marked.where(~at_cut).withColumn("__extra", whole.cast("int"))
    kept = [F.col("__row")[c].alias(c) for c in docs.columns if c not in _OWN]
    columns = [*kept, *_KEYS, "__tokens", (F.col("__epochs") + F.col("__extra")).cast("int").alias("__copies")]
    return rest.select(columns).unionByName(edge.select(columns))


def select(docs: DataFrame, mix: Mix, domain: Column, lang: Column, source: Column, tokens: Column, id_col: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """``id, domain, lang, source, n_tokens, copies`` of ``taken``, one row per input row."""
    narrow = _named(docs, domain, lang, source, tokens, id_col).select(F.col("__id").alias("id"), *[F.col(k).alias(k[2:]) for k in _KEYS], F.col("__tokens").alias("n_tokens"))
    rows = taken(narrow, mix, F.col("domain"), F.col("lang"), F.col("source"), F.col("n_tokens"), "id", bucket)
    return rows.select("id", "domain", "lang", "source", "n_tokens", F.col("__copies").alias("copies"))
