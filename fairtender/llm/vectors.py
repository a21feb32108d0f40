"""Rows whose vector can be computed with, and the integers that stand for its entries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entries are counted in steps of one part in 1024, rounded down
SCALE = 1024.0


def usable(df: DataFrame, vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """Rows whose vector has finite entries only, and the vectors' width.

    A vector that is missing or holds a missing or non-finite entry is left out. The width is
    that of most of the others (the larger one of two as frequent); vectors of another
    width cannot be measured against them and are left out too. Without any row the width is 0.
    """
    vector = F.col(f"`{vec_col}`").cast("array<double>")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    whole = df.withColumn(vec_col, vector).filter(F.col(f"`{vec_col}`").isNotNull() & F.forall(F.col(f"`{vec_col}`"), finite))
    whole = whole.filter(F.size(F.col(f"`{vec_col}`")) > 0)
    widths = whole.groupBy(F.size(F.col(f"`{vec_col}`")).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).head()
    width = widths.width if widths else 0
    return whole.filter(F.size(F.col(f"`{vec_col}`")) == width), width


def steps(column: pa.Array, width: int) -> np.ndarray:
    """``floor(1024 * entry)`` of a list column as whole numbers, one row per vector.

    What does not fit into 64 bits gets the nearest number that does.
    """
    flat = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    low, high = -(2.0**62), 2.0**62
    return np.clip(scaled, low, high).astype(np.int64).reshape(len(column), width)


def blocks(batches, rows: int):
    """Record batches in blocks of at most ``rows`` rows, so that memory does not follow theirs."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
