"""Where intermediate tables go, and the names that operators use inside."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint
    directory set on the context. Only a local master, where one machine holds everything, may do
    without: it gets a temporary folder that goes when Python ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


_PATHS: list[str] = []


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables that ``written`` made in this session, once nothing is read from them any
    more, and says how many there were. ``since`` spares as many of the first ones."""
    gone = _PATHS[since:]
    del _PATHS[since:]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def alone(df: DataFrame, since: int) -> DataFrame:
    """``written``, and the tables that were made for it released: those after the first ``since``."""
    out = written(df)
    path = _PATHS.pop()
    release(df.sparkSession, since)
    _PATHS.append(path)
    return out


def n_written() -> int:
    return len(_PATHS)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again. Later jobs start from the
    files, so a lost executor costs a read and not the plan above."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes that an Arrow batch on its way to Python holds at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with batches small enough for rows that hold whole texts. The session's limits
    are lowered to ``BATCH_ROWS`` and ``BATCH_BYTES``; lower ones stay."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (conf.get(key, None) or "").removesuffix("b").removesuffix("B")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(function, schema)


#: A key is hot from so many rows on, or from the share of all rows that leaves at most ``MOST_HOT`` such keys.
LEAST_HOT, MOST_HOT = 1_000, 50_000


def join_counted(rows: DataFrame, keys: DataFrame, on: Sequence[str], n: str, how: str = "inner") -> DataFrame:
    """``rows.join(keys, on, how)`` for ``inner``, ``left`` and ``left_semi``, with no partition that holds
    a hot key. ``keys`` has each key once, none null, and in ``n`` how many of ``rows`` have it; it is read
    several times, so it should be written. As the counts add up to the rows at most, no more than
    ``MOST_HOT`` keys are hot: those are broadcast, and only the other rows are shuffled."""
    total = keys.agg(F.sum(n)).first()[0] or 0
    hot = keys.where(F.col(n) > max(LEAST_HOT, -(-total // MOST_HOT)))
    if hot.isEmpty():
        return rows.join(keys, [*on], how)
    met = rows.join(F.broadcast(hot), [*on], "left_semi" if how == "left_semi" else "inner")
    rest = rows.join(F.broadcast(hot.select(*on)), [*on], "left_anti")
    return met.unionByName(rest.join(keys, [*on], how))


#: Bits of a sieve for each key, and at most: 16 MB, whatever the number of keys.
BITS_OF_A_KEY, MOST_BITS = 16, 1 << 27
_PAGE = 15  # bits of a row's number within a page of the bitmap


def sieve(keys: DataFrame, h: Column) -> tuple[DataFrame, int]:
    """A bitmap of the hashes ``h`` (long) of ``keys``, as rows of 4 kB, and its size in bits. ``keys`` is
    read twice. With many more keys than bits it lets everything pass, and never is a key left out."""
    n = keys.count()
    size = min(MOST_BITS, 1 << max(_PAGE, (n * BITS_OF_A_KEY).bit_length()))
    slots = keys.select(h.bitwiseAND(F.lit(size - 1)).alias("slot"))
    pages = slots.groupBy(F.shiftright("slot", _PAGE).alias("__page")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit((1 << _PAGE) - 1))).alias("__bits"))
    return written(pages), size


def sifted(rows: DataFrame, h: Column, made: tuple[DataFrame, int], name: str) -> DataFrame:
    """``rows`` with ``name``: false where ``h`` is certainly no key of the sieve. Nothing is shuffled."""
    pages, size = made
    slot = h.bitwiseAND(F.lit(size - 1))
    at = F.col("__slot").bitwiseAND(F.lit((1 << _PAGE) - 1))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    placed = rows.withColumn("__slot", slot).withColumn("__page", F.shiftright("__slot", _PAGE))
    return placed.join(F.broadcast(pages), "__page", "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop("__slot", "__page", "__bits")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``docs`` as one struct ``__row`` beside other ``columns``, whose names so can't clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *(c.alias(k) for k, c in columns.items()))


def raw_digest(text: Column) -> Column:
    """What tells the texts of one id apart where rows are looked up again; null is not empty."""
    return F.xxhash64(text.cast("string"))


def without(docs: DataFrame, id_col: str, text_col: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows ``dropped``, which has ``id``, ``raw`` (``raw_digest`` of the text) and
    ``again`` of each of them: whether the row that stays instead is alike in both, so that one of these rows has to stay.

    Rows are told apart by id and text, since no row number is the same in two scans. A sieve lets rows
    that are certainly not dropped pass where they are; only the others are shuffled."""
    keyed = dropped.groupBy(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("__id"), F.col("id").isNull().alias("__none"), F.col("raw").alias("__raw"))
    gone = written(keyed.agg(F.max("again").alias("__again"), F.count("*").alias("__n")))
    hashed = F.xxhash64("__id", "__none", "__raw")
    rows = packed(docs, __id=F.coalesce(F.col(id_col).cast("string"), F.lit("")), __none=F.col(id_col).isNull(), __raw=raw_digest(F.col(text_col)))
    marked = sifted(rows, hashed, sieve(gone, hashed), "__may")
    doubtful = join_counted(marked.where("__may"), gone, ["__id", "__none", "__raw"], "__n", "left")
    once = doubtful.where("__again").groupBy("__id", "__none", "__raw").agg(F.any_value("__row").alias("__row"))
    kept = marked.where("not __may").select("__row.*").unionByName(doubtful.where("__n is null").select("__row.*"))
    return kept.unionByName(once.select("__row.*"))
