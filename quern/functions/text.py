"""Strings, words and sentence splits as Column expressions.

Everything works on one row at a time with built-in functions: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: marker strings and separators of the context types
MANDATORY_MARKERS = ("新闻内容：", "类别：")
BOOST_MARKERS_CHINESE = ("新闻内容", "类别")
BOOST_MARKERS_FEWSHOT = ("Passage:", "Question:", "Answer:")
BLOCK_SEPARATOR = "\n\n"
CJK = "[一-鿿]"
#: Unicode white space, which ``(?U)\s`` matches (``str.strip`` takes four control characters more).
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CODE_ENDINGS = ("{", "}", ";", ":", '"""', "'''")

#: A sentence with the white space around it: up to closing punctuation before a space, or the end.
ENGLISH_SENTENCE = r"(?sU)(\s*\S.*?(?:[.!?]+[\"')\]]*\s+|\z))"
#: A Chinese clause with the delimiters behind it. Pieces tile the text.
CHINESE_SENTENCE = "(?U)((?:^[。？！；\\s]*)?[^。？！；\\s][^。？！；\n]*[。？！；\\s]*)"

_LINE = r"[^\S\n]*+\S[^\n]*+"
_CLOSES = r"[^\n]*(?:" + "|".join(map(re.escape, CODE_ENDINGS)) + r")[^\S\n]*+(?:\n|\z)"
#: A block of code from its first letter or sign on: a line, more lines that don't close it, and one that does. All
#: repeats are possessive, so that long blocks take no stack.
CODE_BLOCK = rf"(?U)\S[^\n]*+(?:\n(?!{_CLOSES}){_LINE})*+(?:\n{_LINE})?+"

_STRINGS = "array<string>"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def strings(c: Column | None = None) -> Column:
    return F.array().cast(_STRINGS) if c is None else F.coalesce(c, F.array().cast(_STRINGS))


def word_count(text: Column) -> Column:
    """CJK characters plus white-space tokens that hold a letter."""
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda w: w.rlike(r"\p{L}"))
    return (F.regexp_count(text, F.lit(CJK)) + F.size(tokens)).cast("int")


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(markers[0]))
    for m in markers[1:]:
        out = out | F.contains(text, F.lit(m))
    return out


def any_sentence_contains(sentences: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(sentences, lambda s: contains_any(s, markers))


def has_words(sentence: Column, least: int) -> Column:
    """At least ``least`` words, and not blank. One word is one letter somewhere, CJK characters too."""
    if least <= 0:
        return strip(sentence) != ""
    return sentence.rlike(r"\p{L}") if least == 1 else word_count(sentence) >= least


def split_english(text: Column) -> Column:
    """Rule-based sentences that tile the text."""
    return F.regexp_extract_all(text, F.lit(ENGLISH_SENTENCE), F.lit(1))


def split_chinese(text: Column) -> Column:
    """Clauses that end at ``。？！；`` or a line's end and tile the text."""
    return F.regexp_extract_all(text, F.lit(CHINESE_SENTENCE), F.lit(1))


def split_chinese_fallback(text: Column) -> Column:
    """Plain cuts at ``。`` that get it back; white space between sentences is lost."""
    cut = F.filter(F.transform(F.split(text, "。", -1), strip), lambda s: s != "")
    return F.transform(cut, lambda s: F.concat(s, F.lit("。")))


def split_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda s: s != "")


def split_code(text: Column, min_words: int = 1) -> Column:
    """Blocks of code lines. A blank line closes a block; a line that ends in one of ``CODE_ENDINGS``
    closes it if the block has two lines or more. Blocks of fewer than ``min_words`` words go; if
    none is left the text is one block."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit(CODE_BLOCK), F.lit(0)), strip)
    kept = F.filter(blocks, lambda b: (b != "") & has_words(b, min_words))
    return F.transform(F.array(kept), lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(text)))[0]


def synced(sentences, text: str) -> list[str]:
    """``sync_sentences`` of one text, in time linear in it."""
    out, seen = [], 0
    for i, s in enumerate(sentences):
        following = sentences[i + 1][:10] if i + 1 < len(sentences) else None
        found = text.find(following, seen + len(s.strip(SPACES))) if following else -1
        piece = text[seen:found] if found > seen else text[seen:]
        if piece.strip(SPACES):
            out.append(piece)
        if found <= seen:
            break
        seen = found
    return out


def sync_sentences(sentences: Column, text: Column) -> Column:
    """Pieces of ``text`` that start where each sentence starts, so that they tile it.

    The next start is looked for by the next sentence's first ten characters, from the current start
    plus the current sentence's length on; if they aren't found the rest of the text is one piece.
    Blank pieces are dropped and the last piece takes what is left. A Python function over Arrow
    batches: folds of Column expressions count a text's characters from its start for each sentence."""
    import pandas as pd

    def run(rows, texts):
        return pd.Series([synced(s, t) if s is not None and t is not None else [] for s, t in zip(rows, texts, strict=True)])

    return F.pandas_udf(run, _STRINGS, F.PandasUDFType.SCALAR)(sentences, text)


def split_context(text: Column, context_type: Column, min_words: int = 1) -> Column:
    """Sentences by context type (english, chinese, code; any other type by paragraphs), without
    blank ones and those of fewer than ``min_words`` words."""
    text = F.coalesce(text, F.lit(""))
    cut = F.when(context_type == "english", split_english(text)).when(context_type == "chinese", split_chinese(text)).when(context_type == "code", split_code(text, min_words)).otherwise(split_paragraphs(text))
    return F.filter(cut, lambda s: has_words(s, min_words))


def has_chinese(context_type: Column, sentences: Column) -> Column:
    """Chinese by type, or by a CJK character in the first three sentences."""
    return (context_type == "chinese") | F.array_join(F.slice(sentences, 1, 3), "").rlike(CJK)


def output_separator(context_type: Column, sentences: Column) -> Column:
    """Between kept sentences: a blank line for code, fewshot and Chinese news, else one space."""
    news = (context_type == "chinese") & any_sentence_contains(sentences, MANDATORY_MARKERS[:1])
    return F.when(context_type.isin("code", "fewshot") | news, BLOCK_SEPARATOR).otherwise(" ")


def chunk_separator(context_type: Column, sentences: Column) -> Column:
    """Between a chunk's sentences: as for the output, but nothing for plain Chinese."""
    news = any_sentence_contains(sentences, MANDATORY_MARKERS[:1])
    return F.when(context_type.isin("code", "fewshot") | ((context_type == "chinese") & news), BLOCK_SEPARATOR).when(context_type == "chinese", "").otherwise(" ")


def mandatory(sentence: Column, context_type: Column) -> Column:
    return (context_type == "chinese") & contains_any(sentence, MANDATORY_MARKERS)


def boosted(score: Column, sentence: Column, context_type: Column) -> Column:
    """Scores after marker boosts: 1.0 for fewshot markers, at least 0.95 for Chinese news markers."""
    fewshot = (context_type == "fewshot") & contains_any(sentence, BOOST_MARKERS_FEWSHOT)
    chinese = (context_type == "chinese") & contains_any(sentence, BOOST_MARKERS_CHINESE)
    return F.when(fewshot, F.lit(1.0)).when(chinese, F.greatest(score, F.lit(0.95))).otherwise(score)
