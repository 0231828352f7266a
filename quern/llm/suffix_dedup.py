"""Removal of repeated passages: every byte inside a string of ``LENGTH`` bytes that also starts
anywhere else in the corpus. Runs of ``PASSAGE`` words that occur elsewhere are counted as well, whatever
their bytes: a passage of 50 words is often shorter than 400 bytes, and stays.

Looking at every suffix of the corpus is not needed to find them all. Each window (``LENGTH`` bytes, or
``PASSAGE`` words) is filed under the smallest hash of the grams in it, its *anchor*; equal windows have
equal anchors. Neighbouring windows share an anchor, so a text falls into *runs* of windows, about one
for every 185 bytes or 22 words:

1. Runs whose anchor occurs once, in one place, hold no repeated window. A sieve of the other anchors
   leaves them where they are.
2. Runs with equal content (by a 128-bit digest) and more than one occurrence are repeated throughout.
   The inside of copies is settled here.
3. What is left are the edges of repeated passages. Their windows are compared in an index that is a
   logarithmic family: each batch of runs gets a sorted array of its suffixes, is merge-scanned against
   the levels that exist, and equal-sized levels merge. Suffixes are ordered by their first 8 bytes (or
   first word) and then by a fingerprint of the window, since only equality over the window counts.

Step 3 is dealt by anchor. An anchor with many different runs is dealt by anchor and a share of the
window fingerprints, as many shares as it takes, so that a passage which a third of all documents quote
is spread over tasks. Runs that occur very often meet their digest without a shuffle (``join_counted``).
Texts are shuffled only where a sieve says that they have edges, and again where they have spans.
What is broadcast are sieves and hot keys, both of bounded size.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import in_arrow, join_counted, raw_digest, sieve, sifted, written
from quern.llm.shingles import mix


@dataclass(frozen=True)
class Unit:
    """What windows are made of: ``length`` symbols, in grams of ``gram`` of them (a power of 2)."""

    number: int
    length: int
    gram: int

    @property
    def span(self) -> int:
        """Grams of a window."""
        return self.length - self.gram + 1


LENGTH, PASSAGE = 400, 50
#: Windows of bytes are removed, windows of words counted.
BYTES, WORDS = Unit(0, LENGTH, 32), Unit(1, PASSAGE, 8)
#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
#: Runs of one anchor that one task compares, and the runs of a batch of the index.
HOT, BATCH = 2_000, 512
#: Runs that a task's index holds, about; one has 6 kB of keys.
RUNS_OF_A_TASK = 4_000
_TABLE = np.random.default_rng(3).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIXED = mix(_TABLE)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _symbols(data: np.ndarray) -> np.ndarray:
    """A number for each byte; words come as their hashes."""
    return _TABLE[data] if data.dtype == np.uint8 else data


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` symbols from each place."""
    h, width = _symbols(data), 1
    while width < gram:
        h = h[:-width] * _STEP + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return mix(h)


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` over each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """Runs of windows in documents that lie end to end in ``data``: the document's number, the first
    and last window's place in ``data``, the anchor, and whether the anchor occurs more than once in
    the run."""
    if len(data) < unit.length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    h = _grams(data, unit.gram)
    low = _sliding(h, unit.span, np.minimum)
    n = len(low)
    valid = np.zeros(n + 1, np.int8)
    keep = ends - starts >= unit.length
    np.add.at(valid, starts[keep], 1)
    np.add.at(valid, np.minimum(ends[keep] - unit.length + 1, n), -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    fresh = valid.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    fresh[starts[keep]] = True
    first = np.flatnonzero(fresh)
    if not len(first):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    doc = np.searchsorted(starts, first, "right") - 1
    # empty documents share a start; the last of them is the one with bytes
    last = np.minimum(np.append(first[1:], n), ends[doc] - unit.length + 1) - 1
    anchor = low[first]
    # places that are the smallest of some window
    pad = np.concatenate([np.zeros(unit.span - 1, np.uint64), low, np.zeros(len(h) - n, np.uint64)])
    place = np.flatnonzero(_sliding(pad, unit.span, np.maximum)[: len(h)] == h)
    names, which = np.unique(h[place], return_inverse=True)
    filed = np.sort((which.astype(np.int64) << 32) | place)
    name = np.searchsorted(names, anchor).astype(np.int64) << 32
    times = np.searchsorted(filed, name | (last + unit.span - 1), "right") - np.searchsorted(filed, name | first, "left")
    return doc, first, last, mix(anchor + np.uint64(unit.number)), times > 1


_POWERS: dict[str, np.ndarray] = {}


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the symbols before each place, each times a power that grows with the place, and the powers' inverses."""
    base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 2**64)
    n = len(data)
    if len(_POWERS.get("up", ())) <= n:
        size = max(4096, 2 * n)
        for name, b in (("up", base), ("down", inverse)):
            _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_MIXED[data] if data.dtype == np.uint8 else mix(data)) * _POWERS["up"][:n], out=sums[1:])
    return sums, _POWERS["down"]


def fingerprints(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` symbols from each place, by differences of prefix sums."""
    sums, down = _prefix_sums(data)
    return mix((sums[length:] - sums[:-length]) * down[: len(data) - length + 1])


class LogIndex:
    """Sorted arrays of suffix keys in levels whose sizes double.

    ``add`` sorts a batch, scans it against each level, and carries it up: while a level holds as
    many batches as what is carried, the two merge. Every key that occurs twice anywhere is marked.
    """

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # batches, keys, record numbers
        self.repeated: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, number = keys[order], order + self.n
        self.n += len(keys)
        self._mark(keys, number)
        for _, old, old_number in self.levels:
            at = np.searchsorted(old, keys)
            hit = (at < len(old)) & (old[np.minimum(at, len(old) - 1)] == keys)
            if hit.any():
                self.repeated += [number[hit], old_number[at[hit]]]
        carried = 1
        while self.levels and self.levels[-1][0] == carried:
            size, old, old_number = self.levels.pop()
            keys, number = np.concatenate([old, keys]), np.concatenate([old_number, number])
            order = np.argsort(keys, kind="stable")
            keys, number = keys[order], number[order]
            # of equal keys, one stands for all: each was marked when it met another
            once = np.ones(len(keys), bool)
            once[1:] = keys[1:] != keys[:-1]
            keys, number, carried = keys[once], number[once], carried + size
        self.levels.append((carried, keys, number))

    def _mark(self, keys, number):
        same = keys[1:] == keys[:-1]
        if same.any():
            twice = np.zeros(len(keys), bool)
            twice[1:] |= same
            twice[:-1] |= same
            self.repeated.append(number[twice])

    def marks(self) -> np.ndarray:
        out = np.zeros(self.n, bool)
        for number in self.repeated:
            out[number] = True
        return out


def window_keys(data: np.ndarray, anchor: int, unit: Unit = BYTES) -> np.ndarray:
    """16-byte keys of a run's windows: the first 8 bytes or the first word, and a fingerprint that holds the anchor."""
    fp = mix(fingerprints(data, unit.length) + np.uint64(anchor & (2**64 - 1)))
    head = np.lib.stride_tricks.sliding_window_view(data, 8)[: len(fp)] if unit == BYTES else data[: len(fp)].astype(">u8").view(np.uint8).reshape(-1, 8)
    both = np.concatenate([head, fp.astype(">u8").view(np.uint8).reshape(-1, 8)], 1)
    return np.ascontiguousarray(both).view("S16").ravel()


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text between runs of ASCII white space, by differences of prefix sums, ``CHUNK`` bytes or so at once."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        while end < n and not _IS_BLANK[data[end]]:
            end += 1
        part = data[at:end]
        edge = np.flatnonzero(np.diff(_IS_BLANK[part], prepend=True, append=True))
        start, stop = edge[::2], edge[1::2]
        sums, down = _prefix_sums(part)
        out.append(mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _data(text: pa.Scalar, unit: Unit) -> np.ndarray:
    buf = text.as_buffer()
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data if unit == BYTES else word_hashes(data)


def _chunks(batch: pa.RecordBatch, column: int, unit: Unit = BYTES):
    """Texts of a batch as symbols laid end to end, ``CHUNK`` or so at once: rows, starts, ends, data,
    and the first symbol's place in its document. A longer text comes in pieces that overlap by what a
    window needs."""
    held, rows, size = [], [], 0
    for r in range(batch.num_rows):
        data = _data(batch.column(column)[r], unit)
        n = len(data)
        if n > CHUNK:
            for at in range(0, n - unit.length + 1, CHUNK):
                part = data[at : at + CHUNK + unit.length - 1]
                yield np.array([r]), np.array([0]), np.array([len(part)]), part, at
            continue
        if n < unit.length:
            continue
        if size + n > CHUNK and held:
            yield _laid(held, rows)
            held, rows, size = [], [], 0
        held.append(data)
        rows.append(r)
        size += n
    if held:
        yield _laid(held, rows)


def _laid(held, rows):
    ends = np.cumsum([len(x) for x in held])
    return np.array(rows), ends - [len(x) for x in held], ends, np.concatenate(held), 0


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_RUN = ["unit", "first", "last", "anchor", "digest"]


def _same_text(keys: DataFrame) -> tuple[DataFrame, list[str]]:
    """``keys`` with ``id`` in a form that joins where it is null, and the names to join on."""
    return keys.withColumns({"__id": F.coalesce(F.col("id").cast("string"), F.lit("")), "__none": F.col("id").isNull()}), ["__id", "__none", "raw"]


def repeated_spans(texts: DataFrame, units: tuple[Unit, ...] = (BYTES, WORDS)) -> DataFrame:
    """``id, raw, unit, start, end``: spans of the texts (``id, raw, t``, none null but ids) that repeat, in symbols of
    their unit. Spans of a text may overlap. ``raw`` is a digest of the text, so that ids need not be unique."""
    id_type = texts.schema["id"].dataType.simpleString()
    by_number = {u.number: u for u in units}

    def cut(batches):
        for batch in batches:
            for unit in units:
                for rows, starts, ends, data, shift in _chunks(batch, 2, unit):
                    doc, first, last, anchor, twice = runs(data, starts, ends, unit)
                    row = pa.array(rows[doc])
                    digest = [hashlib.blake2b(data[a : b + unit.length].tobytes(), digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    at = [pa.array((x - starts[doc] + shift).astype(np.int64)) for x in (first, last)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.full(len(doc), unit.number, np.int32)), *at, pa.array(anchor.view(np.int64)), pa.array(digest, pa.binary()), pa.array(twice)],
                        ["id", "raw", *_RUN, "twice"],
                    )

    every = written(in_arrow(texts.select("id", "raw", "t"), cut, f"id {id_type}, raw long, unit int, first long, last long, anchor long, digest binary, twice boolean"))
    anchors = written(every.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("anchor"))
    # an anchor that the sieve lets pass in error occurs once, and then nothing below is true of it
    open_runs = sifted(every, F.xxhash64("anchor"), sieve(anchors, F.xxhash64("anchor")), "may").where("may").drop("may")
    kinds = written(open_runs.groupBy("unit", "anchor", "digest").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("id", "raw", "first", "last")).alias("at")))

    length = F.when(F.col("unit") == BYTES.number, BYTES.length).otherwise(WORDS.length)
    again = kinds.where("n > 1").select("anchor", "digest", "n")
    whole = join_counted(open_runs, again, ["anchor", "digest"], "n", "left_semi").select("id", "raw", "unit", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    groups = kinds.groupBy("anchor").agg(F.count("*").alias("d"), F.min("n").alias("least"), F.max("twice").alias("inner")).where("least = 1 and (d > 1 or inner)")
    groups = written(groups.select("anchor", "d", F.ceil(F.col("d") / HOT).cast("int").alias("shares")))
    edges = join_counted(kinds, groups, ["anchor"], "d").select("at.id", "at.raw", "unit", "at.first", "at.last", "anchor", "digest", "n", "shares")
    edges, on = _same_text(edges)
    per_text = written(edges.groupBy(*on).agg(F.collect_list(F.struct(*_RUN, "n", "shares")).alias("runs")))  # one text's runs
    n_edges = per_text.agg(F.sum(F.size("runs"))).first()[0] or 0
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_edges // RUNS_OF_A_TASK))
    keyed, _ = _same_text(texts)
    found = sifted(keyed, F.xxhash64(*on), sieve(per_text, F.xxhash64(*on)), "may").where("may").join(per_text, on).select("id", "raw", "t", "runs")

    names = ["id", "raw", "unit", "first", "anchor", "share", "digest", "n", "data", "places"]

    def contexts(batches):
        for batch in batches:
            out = {k: [] for k in ("row", *names[2:])}
            for r in range(batch.num_rows):
                whole_text = {}
                for run in batch.column(3)[r].as_py():
                    unit = by_number[run["unit"]]
                    if unit not in whole_text:
                        whole_text[unit] = _data(batch.column(2)[r], unit)
                    text = whole_text[unit][run["first"] : run["last"] + unit.length]
                    if run["shares"] == 1:
                        parts = [(0, text.tobytes(), None)]
                    else:
                        keys = window_keys(text, run["anchor"], unit)
                        share = (keys.view(">u8").reshape(-1, 2)[:, 1] % np.uint64(run["shares"])).astype(np.int64)
                        parts = [(int(s), keys[share == s].tobytes(), np.flatnonzero(share == s).astype(np.int32).tobytes()) for s in np.unique(share)]
                    for s, blob, places in parts:
                        for k, v in zip(out, (r, run["unit"], run["first"], run["anchor"], s, run["digest"], run["n"], blob, places), strict=True):
                            out[k].append(v)
                if len(out["row"]) >= 2000:
                    yield _context_batch(batch, out)
                    out = {k: [] for k in out}
            yield _context_batch(batch, out)

    def _context_batch(batch, out):
        row = pa.array(out["row"], pa.int64())
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(out[k], t) for k, t in zip(names[2:], types, strict=True))], names)

    laid = in_arrow(found, contexts, f"id {id_type}, raw long, unit int, first long, anchor long, share int, digest binary, n long, data binary, places binary").repartition(tasks, "anchor", "share")

    def compare(batches):
        index, seen, held, places_of, pending = LogIndex(), set(), [], [], []
        id_arrow = None

        def push():
            if pending:
                index.add(np.concatenate(pending))
                pending.clear()

        for batch in batches:
            id_arrow = batch.column(0).type
            for id_, raw, number, first, anchor, share, digest, n, blob, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (digest, share) in seen:  # an id given to equal rows brings its runs more than once
                    continue
                seen.add((digest, share))
                unit = by_number[number]
                keys = np.frombuffer(blob, "S16") if places is not None else window_keys(np.frombuffer(blob, np.uint8 if unit == BYTES else np.uint64), anchor, unit)
                pending.append(keys)
                held.append((len(keys), n == 1, unit, id_, raw, first))
                places_of.append(places)
                if len(pending) >= BATCH:
                    push()
        push()
        if not held:
            return
        marks, at = index.marks(), 0
        out = ([], [], [], [], [])
        for (n, alone, unit, id_, raw, first), places in zip(held, places_of, strict=True):
            hit = np.flatnonzero(marks[at : at + n])
            at += n
            if not len(hit) or not alone:
                continue
            if places is not None:
                hit = np.frombuffer(places, np.int32)[hit].astype(np.int64)
            far = np.flatnonzero(np.diff(hit) > unit.length)  # windows that touch make one span
            for a, b in zip(hit[np.r_[0, far + 1]].tolist(), hit[np.r_[far, len(hit) - 1]].tolist(), strict=True):
                for o, v in zip(out, (id_, raw, unit.number, first + a, first + b + unit.length), strict=True):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (id_arrow, pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["id", "raw", "unit", "start", "end"])

    return whole.unionByName(in_arrow(laid, compare, f"id {id_type}, raw long, unit int, start long, end long"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words`` and,
    ``with_text``, ``kept binary``, the bytes that stay.

    Null texts are empty; texts shorter than ``LENGTH`` bytes lose nothing. Strings are judged on the
    input, all occurrences go, the first one too, and no match crosses documents. Of texts that
    occur twice nothing stays if they are long enough. ``n_passage_words`` counts the words, between ASCII white
    space, in runs of ``PASSAGE`` words that also start anywhere else; nothing is removed for them. Null and repeated
    ids are passed through; an empty table gives no rows; other columns are neither read nor returned.
    What stays may end within a character.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), raw_digest(text).alias("raw"), text.alias("t"))
    id_type = texts.schema["id"].dataType.simpleString()
    spans, on = _same_text(repeated_spans(texts))
    per_text = written(spans.groupBy(*on).agg(F.collect_list(F.struct("unit", "start", "end")).alias("spans")))
    keyed, _ = _same_text(texts)
    marked = sifted(keyed, F.xxhash64(*on), sieve(per_text, F.xxhash64(*on)), "may")
    met = marked.where("may").join(per_text, on, "left").select("id", "t", "spans")
    full = marked.where("not may").select("id", "t", F.lit(None).cast(per_text.schema["spans"].dataType).alias("spans")).unionByName(met)

    def run(batches):
        for batch in batches:
            n, gone, count, sha, kept, words = [], [], [], [], [], []
            for t, s in zip(batch.column(1), batch.column(2), strict=True):
                raw = t.as_buffer().to_pybytes()
                found = s.as_py() or ()
                cut = merged([(x["start"], x["end"]) for x in found if x["unit"] == BYTES.number])
                rest = b"".join(raw[a:b] for a, b in zip([0, *(c[1] for c in cut)], [*(c[0] for c in cut), len(raw)], strict=True)) if cut else raw
                n.append(len(raw))
                gone.append(len(raw) - len(rest))
                count.append(len(cut))
                sha.append(hashlib.sha256(rest).hexdigest())
                words.append(sum(b - a for a, b in merged([(x["start"], x["end"]) for x in found if x["unit"] == WORDS.number])))
                if with_text:
                    kept.append(rest)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(words, pa.int64())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_text, names + ["kept"] * with_text)

    return in_arrow(full, run, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long" + ", kept binary" * with_text)
