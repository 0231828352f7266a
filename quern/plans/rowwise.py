"""The default compression of one sample in plain Python: what the SQL table function runs, and what
tests hold the plan against. Regex counter and lexical provider only, no chunks."""

from __future__ import annotations

import math

import regex

from quern.functions.text import BLOCK_SEPARATOR, BOOST_MARKERS_CHINESE, BOOST_MARKERS_FEWSHOT, CODE_ENDINGS, MANDATORY_MARKERS
from quern.plans.providers import LEXICAL_DETECTOR

_TOKEN = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]")
_WORD = regex.compile(r"\p{L}+|\p{N}+")
_ENGLISH = regex.compile(r"""(?s)\s*\S.*?(?:[.!?]+["')\]]*\s+|\Z)""")
_CHINESE = regex.compile("(?:^[。？！；\\s]*)?[^。？！；\\s][^。？！；\n]*[。？！；\\s]*")


def count_words(text: str) -> int:
    return len(regex.findall("[一-鿿]", text)) + sum(bool(regex.search(r"\p{L}", w)) for w in text.split())


def split_code(text: str, least: int) -> list[str]:
    out, block = [], []

    def close():
        joined = "\n".join(block).strip()
        if joined and count_words(joined) >= least:
            out.append(joined)
        block.clear()

    for line in text.split("\n"):
        if not line.strip():
            close()
            continue
        block.append(line)
        if len(block) >= 2 and line.strip().endswith(CODE_ENDINGS):
            close()
    close()
    return out or [text]


def split(text: str, context_type: str, least: int = 1) -> list[str]:
    if context_type == "english":
        found = _ENGLISH.findall(text)
    elif context_type == "chinese":
        found = _CHINESE.findall(text)
    elif context_type == "code":
        found = split_code(text, least)
    else:
        found = [p.strip() for p in text.split("\n\n")]
    return [s for s in found if s.strip() and count_words(s) >= least]


def scores(sentences: list[str], question: str, context_type: str) -> list[float]:
    terms = set(_WORD.findall(question.lower()))
    out = []
    for i, s in enumerate(sentences):
        w = _WORD.findall(s.lower())
        x = (len(set(w) & terms) / max(len(terms), 1), 1 / (i + 1), min(len(w) / 30, 1.0), len(set(w)) / max(len(w), 1))
        p = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, LEXICAL_DETECTOR.coef, strict=True)) + LEXICAL_DETECTOR.intercept)))
        if context_type == "fewshot" and any(m in s for m in BOOST_MARKERS_FEWSHOT):
            p = 1.0
        if context_type == "chinese" and any(m in s for m in BOOST_MARKERS_CHINESE):
            p = max(p, 0.95)
        out.append(p)
    return out


def standing(score: float) -> float:
    """As ``select.standing``: units of 1e-12, halves away from zero."""
    x = abs(score) * 1e12
    return math.copysign(math.floor(x) + (x - math.floor(x) >= 0.5), score)


def compress(context: str, question: str = "", target: int = -1, rate: float = 0.5, context_type: str = "english") -> dict:
    sentences = split(context, context_type)
    points = scores(sentences, question, context_type)
    rank = [standing(p) for p in points]
    tokens = [len(_TOKEN.findall(s)) for s in sentences]
    news = context_type == "chinese" and any(MANDATORY_MARKERS[0] in s for s in sentences)
    sep = BLOCK_SEPARATOR if context_type in ("code", "fewshot") or news else " "
    budget = min(target, sum(tokens)) if target > 0 else int(sum(tokens) * (1 - rate))
    kept: list[int] = []
    used = 0
    if context_type == "chinese":
        for i, s in enumerate(sentences):
            if any(m in s for m in MANDATORY_MARKERS) and used + tokens[i] <= budget:
                kept.append(i)
                used += tokens[i]
    for i in sorted(range(len(sentences)), key=lambda i: -rank[i]):
        if i in kept:
            continue
        if used + tokens[i] > budget:
            break
        kept.append(i)
        used += tokens[i]
    if not kept and sentences:
        kept = [max(range(len(sentences)), key=lambda i: rank[i])]
    kept.sort()
    text = sep.join(sentences[i] for i in kept)
    return {"compressed_text": text, "original_length": sum(tokens), "compressed_length": len(_TOKEN.findall(text)), "sentence_scores": points, "sentences": sentences, "preserved_indices": kept}
