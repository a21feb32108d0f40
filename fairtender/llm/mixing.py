"""Mixing sources to target weights by entropy balancing.

Rates r of documents minimise the sum of r log r - r (the divergence from one copy each)
under one constraint per source, that the rates times the sizes add up to the source's
target, with rates of at most ``CAP``. The dual is convex with one multiplier per source:
r = min(CAP, exp(multiplier * size / mean size)). Distributed Newton steps, kept inside a
bracket, solve it on counts of documents by source and size. Rates are then rounded to copies
so that along the sizes of a source the copies never stray from the sum of rates by one.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairtender.llm.staging import keep
from fairtender.operators.skew import number_rows

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
TOLERANCE = 1e-9
#: documents of one source and size that are ranked together
CELL = 100_000
PHASES = 32


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add ``target`` to a table of ``source``, ``source_size``, ``n``.

    Sources in order of code points, missing last, take the weights in turn and share
    ``share`` times all sizes by weight. A target stops at ``cap`` times its source's size, and
    what is over goes to the others by weight, until none is above.
    """
    numbered = number_rows(sources, [], ["source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = keep(numbered.withColumn("weight", weight), "sources")
    total, level, stopped = weighed.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    most = F.col("source_size") * cap
    while True:
        over = most <= F.col("weight") * level
        full, free, n = weighed.agg(F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == stopped or free is None:
            break
        level, stopped = (total * share - (full or 0.0)) / free, n
    return weighed.withColumn("target", F.least(most, F.col("weight") * level).cast("double")).drop("place", "weight")


def _rate(cap: float):
    return F.when(F.col("full"), cap).otherwise(F.least(F.lit(cap), F.exp(F.col("step") * F.col("size") / F.col("mean"))))


def multipliers(counts: DataFrame, sources: DataFrame, cap: float = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """Solve the dual: add ``step`` (the multiplier), ``mean`` and ``full`` to the sources.

    A source whose target is ``cap`` times its size is ``full``: all its rates are ``cap``. A
    source without words keeps multiplier 0. Steps go on until every sum of sizes is within
    ``tolerance`` of its target or its bracket cannot shrink.
    """
    bounds = counts.groupBy("source").agg(F.min("size").alias("least"))
    start = sources.join(bounds, sources["source"].eqNullSafe(bounds["source"]), "left").select(sources["*"], "least")
    state = keep(
        start.withColumn("mean", F.col("source_size") / F.col("n"))
        .withColumn("full", F.coalesce(F.col("target") >= F.col("source_size") * cap * (1 - tolerance), F.lit(True)))
        .withColumn("step", F.lit(0.0))
        .withColumn("low", -700 * F.col("mean") / F.col("least"))
        .withColumn("high", 2 * F.col("mean") / F.col("least"))
        .withColumn("open", ~F.col("full") & (F.col("source_size") > 0)),
        "duals",
    )
    while state.filter("open").limit(1).count():
        live = state.filter("open").select(F.col("source").alias("s"), "step", "mean", "full")
        rows = counts.join(live, counts["source"].eqNullSafe(live["s"]))
        rate = _rate(cap)
        mass = F.col("docs") * F.col("size") * rate
        slope = F.when(rate < cap, mass * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = rows.groupBy("s").agg(F.sum(mass).alias("mass"), F.sum(slope).alias("slope"))
        joined = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left").drop("s")
        short = F.col("target") - F.col("mass")
        low, high = F.when(short > 0, F.col("step")).otherwise(F.col("low")), F.when(short > 0, F.col("high")).otherwise(F.col("step"))
        newton = F.col("step") + short / F.nullif("slope", F.lit(0.0))
        inside = F.coalesce((newton > low) & (newton < high), F.lit(False))
        done = (F.abs(short) <= tolerance * F.col("target")) | (high - low <= 1e-14 * (F.abs(high) + F.abs(low)))
        moved = joined.select(
            *[c for c in state.columns if c not in ("step", "low", "high", "open")],
            F.when(~F.col("open") | done, F.col("step")).when(inside, newton).otherwise((low + high) / 2).alias("step"),
            F.when(F.col("open"), low).otherwise(F.col("low")).alias("low"),
            F.when(F.col("open"), high).otherwise(F.col("high")).alias("high"),
            (F.col("open") & ~done).alias("open"),
        )
        state = keep(moved, "duals")
    return state.drop("least", "low", "high", "open")


def _settle(groups: DataFrame, cap: float, rounds: int = 3) -> DataFrame:
    """Bring each source's words nearer to its sum of rates by one copy more or less, a few times.

    No document gets fewer than no or more than ``cap`` copies.
    """
    base = F.floor("rate")
    for _ in range(rounds):
        missing = groups.groupBy("source").agg(F.sum(F.col("size") * (F.col("k") * (F.col("rate") - base) - F.col("extra"))).alias("missing"))
        missing = missing.select(F.col("source").alias("s"), "missing")
        open_groups = groups.join(missing, groups["source"].eqNullSafe(missing["s"]))
        moves = [(1, F.col("extra") < F.col("k") * (cap - base)), (-1, F.col("extra") > -F.col("k") * base)]
        tries = [F.when(allowed, F.struct(F.round(F.abs(F.col("missing") - sign * F.col("size")), 6).alias("left"), "size", "part", F.lit(sign).alias("sign"))) for sign, allowed in moves]
        best = open_groups.groupBy("s").agg(F.min(F.array_min(F.filter(F.array(*tries), lambda t: t.isNotNull()))).alias("best"), F.first("missing").alias("missing"))
        better = best.filter(F.col("best.left") < F.abs("missing") - 1e-6).select("s", F.col("best.size").alias("z"), F.col("best.part").alias("q"), F.col("best.sign").alias("sign"))
        same = groups["source"].eqNullSafe(better["s"]) & (groups["size"] == better["z"]) & (groups["part"] == better["q"])
        moved = groups.join(better, same, "left")
        groups = keep(moved.select("source", "size", "part", "k", "rate", (F.col("extra") + F.coalesce("sign", F.lit(0))).alias("extra")), "extras")
    return groups


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cell: int = CELL) -> DataFrame:
    """Per row of ``docs``: doc_id, row_key, size, source_size, target, rate, copies, taken.

    The size is the number of words (a missing text: 0), and ``taken`` the copies times the
    size. A missing source is a source of its own. Documents without words have rate 1. Among
    documents of one source and size a hash of id and text decides, so reruns agree; repeated
    rows count one by one. An empty table gives no rows. Other columns are left out.
    """
    text = F.col(text_col)
    sizes = keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col(id_col), text).alias("row_key"),
        ),
        "sizes",
    )
    counts = keep(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "counts")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("n"))
    duals = multipliers(counts.filter("size > 0"), targets(sources, weights, share, cap), cap)
    duals = duals.withColumnRenamed("source", "s")
    cells = counts.join(duals, counts["source"].eqNullSafe(duals["s"])).drop("s")
    # rounded, so that the last bits of a sum cannot turn a copy
    rated = keep(cells.withColumn("rate", F.round(_rate(cap), 9)).withColumn("parts", F.ceil(F.col("docs") / cell).cast("long")), "rates")
    named = rated.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "rate", "parts")
    rows = sizes.join(named, sizes["source"].eqNullSafe(named["s"]) & (sizes["size"] == named["z"])).drop("s", "z")
    rows = keep(rows.withColumn("part", F.pmod("row_key", "parts")).drop("parts"), "rated")
    # at most one row per source and size, and one more per CELL documents
    groups = rows.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("k"), F.first("rate").alias("rate"))
    fraction = F.col("rate") - F.floor("rate")
    along = Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = groups.withColumn("over", F.round(F.sum(F.col("k") * fraction).over(along), 6)).withColumn("under", F.round(F.col("over") - F.col("k") * fraction, 6))
    summed = keep(summed, "groups")
    phase = lambda i: (2 * i + 1) / (2 * PHASES)
    extra = lambda p: F.floor(F.col("over") + p) - F.floor(F.col("under") + p)
    miss = [F.struct(F.abs(F.sum(F.col("size") * (extra(phase(i)) - F.col("k") * fraction))).alias("miss"), F.lit(phase(i)).alias("phase")) for i in range(PHASES)]
    best = summed.groupBy("source").agg(F.array_min(F.array(*miss)).alias("best")).select(F.col("source").alias("s"), "best.phase")
    begun = summed.join(best, summed["source"].eqNullSafe(best["s"])).select("source", "size", "part", "k", "rate", extra(F.col("phase")).cast("long").alias("extra"))
    chosen = _settle(keep(begun, "extras"), cap).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("q"), "k", "extra")
    same = rows["source"].eqNullSafe(chosen["s"]) & (rows["size"] == chosen["z"]) & (rows["part"] == chosen["q"])
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("row_key", "doc_id"))
    each, over = F.floor(F.col("extra") / F.col("k")), F.pmod("extra", "k")
    copies = (F.floor("rate") + each + F.when(rank <= over, 1).otherwise(0)).cast("long")
    return rows.join(chosen, same).select("doc_id", "row_key", "size", "source_size", "target", "rate", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    decided = mix(docs, id_col=id_col, text_col=text_col, **options).groupBy("row_key").agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"))
    joined = keyed.join(decided, "row_key")
    place = F.row_number().over(Window.partitionBy("row_key").orderBy("id"))
    each = F.floor(F.col("_all") / F.col("_rows")) + F.when(place <= F.col("_all") % F.col("_rows"), 1).otherwise(0)
    copied = joined.withColumn("times", each.cast("int"))
    return copied.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("doc.*")
