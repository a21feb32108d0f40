"""Repeatable uniform draws and bootstrap weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the 64-bit mixing function (SplitMix64)
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def key_hash(seed: int, key: Sequence[str]) -> Column:
    """60 bits of a digest of (seed, key): one per row, whatever the partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def exponential(hashes: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Exp(1) draws, rows by replicates, from the row hashes."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64)[:, None] + reps.astype(np.uint64)[None, :] * STEP
        z ^= z >> np.uint64(30)
        z *= MIX_1
        z ^= z >> np.uint64(27)
        z *= MIX_2
        z ^= z >> np.uint64(31)
    z >>= np.uint64(11)
    # in place, as making room costs more than the arithmetic
    out = z.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    np.log(out, out=out)
    return np.negative(out, out=out)


def replicate_weights(hashes: np.ndarray, first: int, last: int) -> np.ndarray:
    """Weights of replicates first..last; replicate 0 is the sample itself, weight 1."""
    weights = exponential(hashes, np.arange(first, last + 1))
    if first == 0:
        weights[:, 0] = 1.0
    return weights
