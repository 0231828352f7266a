"""Reading samples and writing results. A sample has ``context`` and, if given, ``question`` and
``context_type``; ``sample_id`` is made up where it is missing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sample_id long, context string, question string, context_type string"
DEFAULTS = {"question": "", "context_type": "english"}


def conform(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with columns renamed by ``names`` (theirs to ours), defaults filled in and an id."""
    df = df.withColumnsRenamed(dict(names or {}))
    if "context" not in df.columns:
        raise ValueError("samples need a column 'context'")
    for name, default in DEFAULTS.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default))
    return df if "sample_id" in df.columns else df.withColumn("sample_id", F.monotonically_increasing_id())


#: Inputs up to this size, by the optimizer's estimate, are dealt out to all cores before they are worked on.
SMALL_BYTES = 64 << 20


def spread_small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """``df`` in as many partitions as there are cores if it is small. A small file is often one row group
    and so one task, however much work its rows are; large inputs have tasks enough and are not moved."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if estimate <= limit else df


def read_samples(spark: SparkSession, path: str, kind: str = "parquet", names: Mapping[str, str] | None = None) -> DataFrame:
    """Samples from Parquet, ORC, JSON lines, CSV with a header, or text (a file is a context)."""
    if kind == "text":
        df = spark.read.text(path, wholetext=True).withColumnRenamed("value", "context")
    elif kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    elif kind in ("parquet", "orc", "json"):
        df = spark.read.format(kind).load(path)
    else:
        raise ValueError(f"no source of kind {kind!r}")
    return conform(df, names)


def from_dicts(spark: SparkSession, samples: Iterable[Mapping]) -> DataFrame:
    rows = [(i, s["context"], s.get("question", ""), s.get("context_type", "english")) for i, s in enumerate(samples)]
    return spark.createDataFrame(rows, SCHEMA)


def write_results(results: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet, ORC or JSON lines, one file per task."""
    results.write.format(kind).mode(mode).save(path)


def in_order(results: DataFrame, by: str = "sample_id") -> Iterator[dict]:
    """Results as dicts in the order of the samples, a partition at a time."""
    return (r.asDict(recursive=True) for r in results.orderBy(by).toLocalIterator(prefetchPartitions=True))
