"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document of quality 1 is preferred to one of quality 0. The model gives each document a worth
``exp(w . x)`` of its text's features ``x``; the chance that *i* is preferred to *j* is
``1 / (1 + exp(-w . (x_i - x_j)))``, so ``w`` is learnt by logistic loss on feature differences.
Documents are then cut at a quantile of the ranking: the one, among the labelled, that puts the fewest
documents on the wrong side, in the middle of the widest such gap. The score is that ranking on a 0-to-1
scale on which the cut lies at ``CUT``.

Features are counts over the whole text (shares of kinds of bytes, repeated neighbours, repeated
words and lines, lengths). Labels, language, source and id are never among them.

Training reads a bounded sample of labelled rows (``SAMPLE``, by hash of the id, documented here):
its ids are broadcast to a scan, its features come to the driver. Scoring is one pass over all
rows without a shuffle; what it broadcasts are the few weights.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import in_arrow

#: Labelled rows that are learnt from, at most.
SAMPLE = 20_000
#: Preferred documents that each rejected one is paired with.
PAIRS = 12
#: The score at the cut.
CUT = 0.7
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|", b"#$%&*", b".,;:", b"\"'()-", b"/\\_=<>{}[]~^`@+", bytes(range(128, 256)), b" ", b"\n\r\t"]
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES):
    _TABLE[list(_members), _k] = 1.0
N_FEATURES = len(_CLASSES) + 10


def features(text: str) -> np.ndarray:
    """What a text looks like; an empty one is all zeros."""
    out = np.zeros(N_FEATURES)
    raw = text.encode("utf-8", "replace")
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[: len(_CLASSES)] = counts @ _TABLE / len(raw)
    words = text.split()
    n = len(words)
    k = len(_CLASSES)
    if n:
        distinct = len(set(words))
        lines = [x for x in text.split("\n") if x.strip()]
        long = sum(map(len, words))
        # the number of distinct words grows more slowly than a text
        out[k:] = [
            sum(map(eq, words, words[1:])) / n,
            np.log(distinct) / np.log(n) if n > 1 else 1.0,
            distinct / n,
            long / n / 10,
            np.log1p(n) / 10,
            1 - len(set(lines)) / max(len(lines), 1),
            n / max(len(lines), 1) / 100,
            sum(map(eq, words, words[2:])) / n,
            max(map(len, words)) / 100,
            sum(not w[-1].isalnum() for w in words) / n,
        ]
        out[k + 6] = min(out[k + 6], 5.0)
        out[k + 8] = min(out[k + 8], 5.0)
    return out


def _features(batch: pa.RecordBatch, column: int) -> np.ndarray:
    rows = [features(x.as_py() or "") for x in batch.column(column)]
    return np.array(rows).reshape(-1, N_FEATURES)


@dataclass(frozen=True)
class Model:
    """``score = sigmoid((w . (x - mean) / scale - cut) / spread + logit(CUT))``."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float
    spread: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.worth(x) - self.cut) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(x: np.ndarray, quality: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 40) -> Model:
    """Newton's method on the logistic loss of ``w . (x_preferred - x_rejected)``.

    Without labels of both kinds there is no pair; every score is then the same and above the cut.
    """
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
    w = np.zeros(N_FEATURES)
    if not len(good) or not len(bad):
        return Model(w, mean, scale, -1.0, 1.0)
    draw = np.random.default_rng(7)
    d = z[draw.choice(good, (len(bad), pairs))] - z[bad][:, None]
    d = d.reshape(-1, N_FEATURES)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance of the wrong order
        gradient = d.T @ p / len(d) - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(N_FEATURES)
        step = np.linalg.solve(curve, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    worth = z @ w
    order = np.argsort(worth, kind="stable")
    ranked, rejected = worth[order], quality[order] == 0
    # wrong if the lowest k are rejected: preferred ones among them and rejected ones above
    wrong = np.concatenate([[0], np.cumsum(~rejected)]) + rejected.sum() - np.concatenate([[0], np.cumsum(rejected)])
    near = np.flatnonzero(wrong[1:-1] <= wrong[1:-1].min()) + 1 if len(ranked) > 1 else np.array([1])
    k = near[np.argmax(ranked[near] - ranked[near - 1])] if len(ranked) > 1 else 0
    cut = float((ranked[k - 1] + ranked[k]) / 2)
    return Model(w, mean, scale, cut, float(max(np.abs(worth - cut).mean() / 4, 1e-6)))


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most ``sample`` labelled documents outside the held-out fold.

    Labels other than 0 and 1 and null ids are passed over. A document with several labels, or an id
    with several documents, counts once for each. Of more labels the first by a hash of the id are taken.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).where(F.col("id").isNotNull() & F.col("quality").isin(0, 1) & ~is_held_out(F.col("id")))
    n = usable.count()
    # rows above this share of the hash's range are not among the first ``sample`` (but by a chance of 1e-9), so they are not sorted
    share = min(1.0, (sample + 6 * sample**0.5 + 20) / max(n, 1))
    near = usable.where(F.xxhash64("id") <= F.lit(int(-(2**63) + share * (2**64 - 1024)))) if share < 1 else usable
    chosen = near.orderBy(F.xxhash64("id"), "id", "quality").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "id")  # at most ``sample`` rows

    def run(batches):
        for batch in batches:
            x = _features(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["id", "quality", "x"])

    got = in_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, quality int, x array<double>").toPandas()
    got = got.sort_values(["id", "quality"], kind="stable")
    return learn(np.array(got["x"].tolist(), dtype=float).reshape(-1, N_FEATURES), got["quality"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` (double, 0 to 1) added, rows and other columns as they are.

    Null texts score as empty ones. An existing column of that name is replaced; other columns may have any name.
    """
    own = "__text"
    while own in docs.columns or own == name:
        own += "_"

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(own)
            scores = pa.array(model.score(_features(batch, k)), pa.float64())
            keep = [i for i in range(batch.num_columns) if i != k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), scores], [*(batch.schema.names[i] for i in keep), name])

    rows = docs.drop(name).withColumn(own, F.col(text_col).cast("string"))
    schema = docs.drop(name).schema.add(name, "double")
    return in_arrow(rows, run, schema)
