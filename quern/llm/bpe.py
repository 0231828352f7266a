"""Byte-pair encoding with word ends, and decoding.

The tokenizer file is the JSON that the public ``tokenizers`` library reads: NFC, lower case, a
split into words, the byte alphabet, merges with a suffix at word ends. Words are merged on a
contiguous rank array: the part boundaries of a word and the rank of each pair of neighbours lie in
two lists; the smallest rank is found by a scan, its boundary is deleted and the two neighbouring
ranks are refreshed. For words above ``SHORT`` symbols, where repeated scans would be quadratic, a
heap holds the same ranks. Words repeat, so each Python worker keeps the words it has seen.

No shuffle: one pass over the table in Arrow batches, with the vocabulary loaded once a worker from
a path that each executor can open.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import in_arrow

SHORT = 200
#: Words of a generation that a worker remembers (there are two), and the longest word worth remembering.
REMEMBERED = 110_000
MEMO_CHARS = 64
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: visible Latin-1 characters are themselves,
    the others are numbered from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(0x100)]


class _Words(dict):
    """word -> what ``make`` gives for it. A full generation becomes the old one, from which words that
    are asked for again come back; the one before it is forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word):
        value = self.old.pop(word, None)
        if value is None:
            value = self.make(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


class WordBPE:
    """Encodes and decodes as the ``tokenizers`` library does with ``add_special_tokens=False`` and
    ``skip_special_tokens=False``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.tokens = {i: t for t, i in (self.vocab | special).items()}
        longest_first = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if special else None
        self.ids_of = _Words(self._ids_text)

    def merge(self, symbols: list[str]) -> list[str]:
        return self._merge_scan(symbols) if len(symbols) <= SHORT else self._merge_heap(symbols)

    def _merge_scan(self, parts: list[str]) -> list[str]:
        get, worst = self.ranks.get, len(self.ranks)
        ranks = [get(pair, worst) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == worst:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), worst)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), worst)
        return parts

    def _merge_heap(self, parts: list[str]) -> list[str]:
        """The same order of merges, lowest rank and then leftmost, in n log n."""
        get, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (r := get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p]

    def word_ids(self, word: str) -> list[int]:
        symbols = [self.alphabet[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        return [self.vocab[s] for s in self.merge(symbols)]

    def _ids_text(self, word: str) -> tuple[str, str, int]:
        ids = self.word_ids(word)
        return " ".join(map(str, ids)), " ".join(self.tokens[i] for i in ids), len(ids)

    def words(self, text: str) -> list[str]:
        # lower case goes character by character, so a sigma at a word's end stays an ordinary one
        return _WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[tuple[str, str, int]]:
        """For each word or special token: its ids and its tokens, each joined by spaces, and how many."""
        if self.cut is None or "<|" not in text and not self.cut.search(text):
            return list(map(self.ids_of.__getitem__, self.words(text)))
        out = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append((str(self.special[part]), part, 1))
            else:
                out += map(self.ids_of.__getitem__, self.words(part))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces as they stand."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=4)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def _texts(batch: pa.RecordBatch, k: int = 1):
    return (x.as_py() or "" for x in batch.column(k))


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, ids array<int>, decoded string``.

    Null and empty texts, and texts of white space only, have no ids and decode to an empty string.
    Ids, null or repeated, are passed through. Texts are encoded whole, whatever their length.
    """

    def run(batches):
        bpe = load(vocab_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, decoded = [], []
                for text in _texts(part):
                    pieces = bpe.pieces(text)
                    ids.append(np.array(" ".join([x[0] for x in pieces]).split(), np.int32))
                    decoded.append(" ".join([x[1] for x in pieces]))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return in_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` reduced where it runs to ``id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches):
        bpe, sha = load(vocab_path), lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for text in _texts(batch):
                pieces = bpe.pieces(text)
                n.append(sum([x[2] for x in pieces]))
                a.append(sha(" ".join([x[0] for x in pieces])))
                b.append(sha(" ".join([x[1] for x in pieces])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return in_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
