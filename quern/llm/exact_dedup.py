"""Exact deduplication by progressive refinement.

Texts are equal when they are identical after each run of ASCII white space has become one space.
Rows are grouped by length, then by a hash of the first characters, then by SHA-256 of the whole
text; the whole text is read again and hashed only where (length, prefix hash) occurs twice. What is
shuffled is a narrow row per document (id, length, hashes), never the text.

Skew: every grouping is a partial aggregate, so a group that holds a third of all rows reaches its
reducer as one row per map task. Rows meet their group again by ``join_counted``: the large groups,
whose number is bounded, are broadcast, and their rows are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import join_counted, raw_digest, sieve, sifted, without, written

#: Length of the prefix that the second level hashes.
PREFIX_CHARS = 256


def normalised(text):
    """Null is empty; each run of space, tab, LF, VT, FF and CR is one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _decided(docs: DataFrame, id_col: str, text_col: str, hash_all: bool, prefix_chars: int) -> DataFrame:
    """``id, raw, row, sha256`` of each row, and ``first`` (``id, raw, row``) and ``n`` of its group, null if it is alone."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), raw_digest(text).alias("raw"), normalised(text).alias("t"))
    rows = rows.withColumn("len", F.length("t")).withColumn("pre", F.xxhash64(F.substring("t", 1, prefix_chars)))
    full = F.sha2(F.col("t").cast("binary"), 256)
    if not hash_all:
        # a length and prefix that occur twice have a length that does
        twice = written(rows.groupBy("len", "pre").agg(F.count("*").alias("n")).where("n > 1").select("len", "pre"))
        rows = sifted(rows, F.xxhash64("len", "pre"), sieve(twice, F.xxhash64("len", "pre")), "survives")
        full = F.when(F.col("survives"), full)
    light = written(rows.select("id", "raw", F.monotonically_increasing_id().alias("row"), "len", "pre", full.alias("sha256")))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "raw", "row")
    keys = ["len", "pre", "sha256"]
    groups = light.where("sha256 is not null").groupBy(*keys).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    return join_counted(light, written(groups), keys, "n", "left")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, sha256``.

    Of equal texts the row with the smallest id stays; a null id comes after every other. Rows that
    share the smallest id are told apart by a digest of the text as it is and a row number, so exactly
    one row of each group has ``kept``. Null and empty texts are equal to each other; a text of white space
    only equals ``' '``. An empty table gives no rows. Other columns of ``docs`` are neither read nor returned.

    With ``hash_all`` every row gets its ``sha256``, from the one scan that takes the lengths. Without
    it texts are scanned twice, and ``sha256`` is null for rows whose length and prefix occur once: a
    sieve of bounded size brings the surviving pairs to the second scan. The few rows that it lets pass
    in error are hashed for nothing.
    """
    alone = F.col("n").isNull()
    return _decided(docs, id_col, text_col, hash_all, prefix_chars).select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("first.row") == F.col("row")) & F.col("first.id").eqNullSafe(F.col("id")))).alias("kept"),
        "sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, columns unchanged, whatever their names.

    Texts are not shuffled but for those of dropped rows. Of rows alike in id and text one stays, any
    of them if other columns differ. Nulls, empty texts and empty tables as in ``exact_dedup``.
    """
    decided = _decided(docs, id_col, text_col, False, PREFIX_CHARS).where("n > 1 and not (first.row = row and first.id <=> id)")
    return without(docs, id_col, text_col, decided.select("id", "raw", (F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.raw") == F.col("raw"))).alias("again")))
