"""Helpers shared by the operators: stored tables, and Arrow batches cut into small slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.session import stored

__all__ = ["documents", "frequent", "rows_to_batch", "slices", "stored"]

#: Rows of an Arrow batch that become Python objects at once.
SLICE_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Columns of the batches as Python lists, SLICE_ROWS rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS).to_pydict()


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def frequent(counts: DataFrame, most: int, each: int = 100_000) -> DataFrame:
    """The words (word, n) that occur at least so often that there are at most `most` of them; about `each` in a partition."""
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.lit(1024) * F.pow(F.lit(2), F.floor(F.log2(F.col("n") / 1024)))).cast("long")
    total, least = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # under 1100 rows
        total += r["words"]
        if total > most:
            break
        least = r["level"]
    words = counts.where(F.lit(False) if least is None else F.col("n") >= least)
    return words.repartition(max(1, min(total, most) // each), "word")
