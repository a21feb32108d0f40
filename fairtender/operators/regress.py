"""Least squares with dummies, absorbed factors and Bayesian-bootstrap errors, many models at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtender.functions.draws import key_hash, replicate_weights
from fairtender.operators import tall
from fairtender.operators.moments import WORK, cross_products
from fairtender.operators.skew import HOT_ROWS
from fairtender.operators.solve import least_squares, normal_p, student_p
from fairtender.operators.twoway import cross_products_two
from fairtender.session import stage

MAX_DUMMIES = 400
# cross products times replicates that one task may put out
MAX_CELLS = 2_000_000
COEFS = "model string, rep int, pos int, coef double, stderr double, N double, r2 double, df_m double, df_r double"
Term = tuple[str, Column]


# ---- terms -------------------------------------------------------------------------------

def numeric(*columns: str) -> list[Term]:
    return [(c, F.col(c).cast("double")) for c in columns]


def factor_levels(df: DataFrame, column: str) -> list:
    """Sorted levels of a factor that is to become dummies: months, systems and the like.

    Cross products grow with the square of their number; absorb a factor of many levels.
    """
    return sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())


def dummies(column: str, levels: Sequence) -> list[Term]:
    """A 0/1 term per level, the lowest last: of terms that explain each other the last is left out."""
    return [(f"{v}.{column}", (F.col(column) == F.lit(v)).cast("double")) for v in sorted(levels, reverse=True)]


def crossed(first: Sequence[Term], second: Sequence[Term]) -> list[Term]:
    """Both sets of terms and their products."""
    products = [(f"{a}#{b}", x * y) for a, x in first for b, y in second]
    return [*first, *second, *products]


def flag(column: str) -> list[Term]:
    """The upper level of a 0/1 column."""
    return [(f"1.{column}", F.col(column).cast("double"))]


def did_terms(treat: str = "contratacion", post: str = "d_pandemia") -> list[Term]:
    """Two main effects and their product."""
    return crossed(flag(treat), flag(post))


# ---- fitting -----------------------------------------------------------------------------

def fit(
    df: DataFrame,
    y: str,
    terms: Sequence[Term],
    absorb: Sequence[str] = (),
    model: Column | str = "1",
    key: Sequence[str] = (),
    reps: int = 0,
    seed: int = 42,
    hot_rows: int = HOT_ROWS,
    method: str = "gram",
) -> DataFrame:
    """Tidy coefficients of one model per value of ``model`` (a label or a column).

    ``absorb`` holds up to two many-level factors; their coefficients are not reported,
    all else is as with dummies, the constant being that of the first levels. Rows with a
    missing value are left out. Terms that earlier ones explain are left out and have a
    missing coefficient. With ``reps`` the errors come from that many Bayesian-bootstrap
    replicates, whose weights depend only on ``seed`` and the row's ``key``, so a subset
    has the weights of the whole; else they are the classical ones (missing for the
    constant if a factor is absorbed).

    ``method`` is ``gram`` (cross products; a term of which earlier ones leave less than about
    3e-5 is left out) or ``qr`` (orthogonal factors of the rows, for nearly collinear terms: 1e-9;
    one absorbed factor at most; slower with replicates).
    """
    if method not in ("gram", "qr"):
        raise ValueError(method)
    if reps and not key:
        raise ValueError("replicate weights need a row key")
    if len(absorb) > 2:
        raise ValueError("at most two factors can be absorbed")
    listed, two = len(terms), len(absorb) == 2
    label = F.lit(model) if isinstance(model, str) else model.cast("string")
    columns = [F.lit(1.0), *[c for _, c in terms], F.col(y).cast("double")]
    levels = [F.col(a).cast("string").alias(f"level{i + 1 if i else ''}") for i, a in enumerate(absorb)]
    design = df.select(
        label.alias("model"),
        # spreads the rows of a hot level, so it must tell them apart even if the outcome does not
        (key_hash(seed, key) if key else F.xxhash64(*absorb, F.array(*columns))).alias("hash"),
        *levels,
        # one array, as the optimizer's work grows steeply with the number of derived columns
        F.array(*columns).alias("v"),
    )
    design = design.dropna(subset=[c for c in design.columns if c != "v"]).filter(~F.exists("v", lambda v: v.isNull()))
    if two:
        # read several times; dummies stand before the listed terms, as an absorbed factor would
        design, extra = _few_as_dummies(stage(design), list(absorb), listed + 2, reps)
        terms, absorb = [*extra, *terms], ["level", "level2"] if "level2" in design.columns else ["level"]
    width = len(terms) + 2
    names = F.array(*[F.lit(n) for n in ["_cons", *[t[0] for t in terms]]])
    if method == "qr":
        if len(absorb) == 2:
            raise ValueError("two large factors cannot be absorbed by orthogonal factors")
        coefs = tall.coefficients(design, width, reps, bool(absorb), hot_rows)
    elif len(absorb) == 2:
        coefs = _from_sums(cross_products_two(design, width, reps, hot_rows), width, True)
    else:
        coefs = _from_sums(cross_products(design, width, reps, bool(absorb), hot_rows), width, bool(absorb))
    hidden = len(terms) - listed
    tidy = summarise(coefs.withColumn("var", F.element_at(names, F.col("pos") + 1)), reps)
    if not hidden:
        return tidy
    return tidy.filter((F.col("pos") == 0) | (F.col("pos") > hidden)).withColumn(
        "pos", F.when(F.col("pos") > 0, F.col("pos") - hidden).otherwise(0)
    )


def _from_sums(sums: DataFrame, width: int, absorbed: bool) -> DataFrame:
    """Coefficients per model and replicate from cross products."""
    # a list of at most width * (width + parts) numbers per model and replicate
    cells = sums.groupBy("model", "rep").agg(F.collect_list(F.struct("part", "kind", "i", "j", "s", "x")).alias("cells"))
    return cells.mapInArrow(_solver(width, absorbed), COEFS)


def _few_as_dummies(design: DataFrame, absorb: list[str], width: int, reps: int) -> tuple[DataFrame, list[Term]]:
    """Of two factors the one with fewer levels, as dummies, if the cross products stay small; else both, the larger first."""
    both = ["level", "level2"]
    # either way gives the same, so an estimate does where there are far more levels than dummies
    about = design.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in both]).first()
    small = min(both, key=lambda c: about[c])
    large = both[1 - both.index(small)]
    levels = []
    if about[small] <= 2 * MAX_DUMMIES:
        levels = sorted((r[0] for r in design.select(small).distinct().collect()), reverse=True)
    wide = width + len(levels)
    if not levels or len(levels) > MAX_DUMMIES or wide * (wide + 1) // 2 * (reps + 1) > MAX_CELLS:
        return design.select("model", "hash", F.col(large).alias("level"), F.col(small).alias("level2"), "v"), []
    name = absorb[both.index(small)]
    terms = [(f"{v}.{name}", (F.col(small) == F.lit(v)).cast("double")) for v in levels]
    v = F.concat(F.slice("v", 1, 1), F.array(*[c for _, c in terms]), F.slice("v", 2, width - 1))
    return design.select("model", "hash", F.col(large).alias("level"), v.alias("v")), terms


def normal_equations(cells: pd.DataFrame, width: int, absorbed: bool):
    """Cross products, what the absorbed factors explain, sums of the first level, number of levels."""
    def square(column: str) -> np.ndarray:
        out = np.zeros((width, width))
        out[gram["i"], gram["j"]] = gram[column]
        return out + np.triu(out, 1).T

    kind = cells["kind"].to_numpy()
    gram = {c: cells[c].to_numpy()[kind == 0] for c in ("i", "j", "s", "x")}
    raw = square("s")
    if not absorbed:
        return raw, None, None, 0.0
    explained, levels, first = square("x"), cells["s"].to_numpy()[kind == 3].sum(), None
    for part, level in cells[(kind == 1) | (kind == 2)].groupby("part"):
        sums = np.zeros(width)
        np.add.at(sums, level["i"].to_numpy(), level["s"].to_numpy())
        explained += np.outer(sums, sums) / sums[0]
        levels += 1
        if level["kind"].iloc[0] == 2:
            first = sums
    if (kind == 4).any():
        first = np.zeros(width)
        first[cells["i"].to_numpy()[kind == 4]] = cells["s"].to_numpy()[kind == 4]
    return raw, explained, first, levels


def _solver(width: int, absorbed: bool):
    pos = np.arange(width - 1, dtype="int32")
    schema = pa.schema(
        [("model", pa.string()), ("rep", pa.int32()), ("pos", pa.int32())]
        + [(c, pa.float64()) for c in ("coef", "stderr", "N", "r2", "df_m", "df_r")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cells = cell_columns(batch.column("cells")[k])
                out = least_squares(*normal_equations(cells, width, absorbed))
                head = {"model": batch.column("model")[k].as_py(), "rep": np.int32(batch.column("rep")[k].as_py())}
                yield pa.RecordBatch.from_pandas(pd.DataFrame({**head, "pos": pos, **out}), schema, preserve_index=False)

    return run


def cell_columns(cells: pa.ListScalar) -> pd.DataFrame:
    """A list of structs as columns."""
    structs = cells.values
    return pd.DataFrame({f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(structs.type, structs.flatten())})


@F.pandas_udf(T.DoubleType())
def _p_value(ratio: pd.Series, df_r: pd.Series) -> pd.Series:
    """Normal where no degrees of freedom are given."""
    return pd.Series(
        [np.nan if pd.isna(z) else normal_p(z) if pd.isna(d) else student_p(z, d) for z, d in zip(ratio, df_r)]
    )


def summarise(coefs: DataFrame, reps: int) -> DataFrame:
    """Coefficients of the sample with errors, by the replicates if there are any."""
    sample = F.col("rep") == 0
    known = F.nanvl("coef", F.lit(None).cast("double"))
    spread = F.stddev_pop(F.when(~sample, known)) if reps else F.max(F.when(sample, F.nanvl("stderr", F.lit(None).cast("double"))))
    tidy = coefs.groupBy("model", "pos", "var").agg(
        F.max(F.when(sample, known)).alias("coef"),
        spread.alias("_spread"),
        *[F.max(F.when(sample, F.col(c))).alias(c) for c in ("N", "r2", "df_m", "df_r")],
    )
    tidy = tidy.withColumn("stderr", F.when(F.col("coef").isNotNull(), F.col("_spread")))
    ratio = F.try_divide(F.col("coef"), F.col("stderr"))
    p = F.nanvl(_p_value(ratio, F.lit(None).cast("double") if reps else F.col("df_r")), F.lit(None).cast("double"))
    return tidy.select("model", "pos", "var", "coef", "stderr", p.alias("pval"), "N", F.col("N").alias("N_pop"), "r2", "df_m")


# ---- simple forms ------------------------------------------------------------------------

def did_cells(df: DataFrame, y: str, treat: str = "contratacion", post: str = "d_pandemia") -> DataFrame:
    """Difference in differences from the four cell means: one row, no controls."""
    def mean(t: int, p: int) -> Column:
        return F.avg(F.when((F.col(treat) == t) & (F.col(post) == p), F.col(y)))

    means = df.agg(*[mean(t, p).alias(f"m{t}{p}") for t in (0, 1) for p in (0, 1)])
    return means.select(
        F.col("m00").alias("cons"),
        F.expr("m10 - m00").alias(treat),
        F.expr("m01 - m00").alias(post),
        F.expr("m11 - m10 - m01 + m00").alias("interaction"),
    )


def _lists(rows: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Rows of a matrix as lists."""
    count, width = rows.shape
    bounds = pa.array(np.arange(0, count * width + 1, width, dtype="int32") if width else np.zeros(count + 1, "int32"))
    return pa.ListArray.from_arrays(bounds, pa.array(rows.ravel()), mask=None if missing is None else pa.array(missing))


def boot_weights(df: DataFrame, key: Sequence[str], reps: int = 300, seed: int = 42, out: str = "rw") -> DataFrame:
    """Replicate weights of every row as an array, Exp(1) draws not yet scaled."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def draw(hashes: pa.Array) -> pa.Array:
        own = hashes.to_numpy(zero_copy_only=False)
        rows, step = np.empty((len(own), reps)), max(64, WORK // (reps + 1))
        for at in range(0, len(own), step):
            rows[at : at + step] = replicate_weights(own[at : at + step], 1, reps)
        return _lists(rows)

    return df.withColumn(out, draw(key_hash(seed, key)))


def weight_sums(df: DataFrame, weights: str = "rw", reps: int = 300) -> DataFrame:
    """Per replicate (``rep`` from 0) number, sum, sum of squares and largest of the rows' weights.

    Tasks add up whole batches, so rows do not multiply by the replicates.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares, largest = 0, np.zeros(reps), np.zeros(reps), np.full(reps, -np.inf)
        for batch in batches:
            rows = batch.column(0).drop_null()
            if len(rows):
                w = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), reps)
                n += len(rows)
                total += w.sum(axis=0)
                squares += np.einsum("ij,ij->j", w, w)
                largest = np.maximum(largest, w.max(axis=0))
        if n:
            told = {"rep": np.arange(reps, dtype="int32"), "n": np.full(reps, n), "total": total, "squares": squares, "largest": largest}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in told.items()})

    parts = df.select(weights).mapInArrow(run, "rep int, n bigint, total double, squares double, largest double")
    return parts.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("largest").alias("largest"))


def scaled_weights(df: DataFrame, weights: str = "rw", reps: int = 300) -> DataFrame:
    """The same divided by each replicate's mean, so that every replicate averages 1."""
    means = np.full(reps, np.nan)
    for r in weight_sums(df, weights, reps).collect():
        means[r["rep"]] = r["total"] / r["n"]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scale(rows: pa.Array) -> pa.Array:
        missing = rows.is_null().to_numpy(zero_copy_only=False)
        out = np.zeros((len(rows), reps))
        out[~missing] = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, reps) / means
        return _lists(out, missing)

    return df.withColumn(weights, scale(weights))


# ---- families of models ------------------------------------------------------------------

def falsification(df: DataFrame, month: str, cuts: Sequence[int], out: str = "d_test") -> DataFrame:
    """The rows once per cut-off month, labelled ``cut``, with 1 for months after it (a missing month is after)."""
    per_cut = df.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts])))
    return per_cut.withColumn(out, F.coalesce(F.col(month) > F.col("cut"), F.lit(True)).cast("int"))


def adj_r2(tidy: DataFrame) -> DataFrame:
    """Adjusted R2 by N and the model's degrees of freedom, without the usual further one."""
    return tidy.withColumn("r2_a", 1 - F.try_divide((1 - F.col("r2")) * (F.col("N_pop") - 1), F.col("N_pop") - F.col("df_m")))


def tidy_models(*models: DataFrame) -> DataFrame:
    out = models[0]
    for m in models[1:]:
        out = out.unionByName(m)
    return out


def coef_table(tidy: DataFrame, terms: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Terms by models, in the stated orders: coefficient, p-value, error; 0 where a term was left out."""
    stats = ("coef", "pval", "stderr")
    cells = [
        F.coalesce(F.max(F.when(F.col("model") == m, F.col(s))), F.lit(0.0)).alias(f"{s}_{m}") for m in models for s in stats
    ]
    order = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("var"))
    return tidy.filter(F.col("var").isin(*terms)).groupBy(order.alias("row"), "var").agg(*cells)
