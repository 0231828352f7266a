"""The scoring prompt and the room that it leaves for context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.tokens import TokenCounter

# fixed values: the prompt template and the margin of tokens kept free
PROMPT_HEAD = "Given the following information: "
PROMPT_MIDDLE = "\nAnswer the following question based on the given information with one or few words: "
PROMPT_TAIL = "\nAnswer:"
PROMPT_MARGIN = 10


def build_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), F.coalesce(context, F.lit("")), F.lit(PROMPT_MIDDLE), F.coalesce(question, F.lit("")), F.lit(PROMPT_TAIL))


def prompt_overhead(question: Column, counter: TokenCounter) -> Column:
    """Tokens of the prompt around an empty context."""
    return counter.count(build_prompt(F.lit(""), question))


def context_room(question: Column, counter: TokenCounter, max_seq_len: int) -> Column:
    """Context tokens that one forward pass has room for, 1 at least."""
    return F.greatest(F.lit(max_seq_len) - prompt_overhead(question, counter) - PROMPT_MARGIN, F.lit(1)).cast("int")
