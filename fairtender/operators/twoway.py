"""Projecting out two many-level factors at once, for all replicates.

Rows are dealt into units: at most some thousand rows of one model, sorted by the first factor,
kept as one row of arrays. Their replicate weights are drawn anew from the row hashes wherever
they are needed, so neither rows nor level pairs are multiplied by the replicates. Within a
unit a level of the first factor is eliminated from the normal equations; what is left are
equations for the second factor's effects (and for the few levels whose rows lie in several units,
such as hot ones). Conjugate gradients solve them.

A model that fits into one unit is solved there, a task per chunk of replicates. Of a larger one
the connected parts of the graph of level pairs, which have nothing to do with each other, are
told apart: the rows of parts that fit move, packed, to units of whole parts, and such a unit is
solved alone too. A part of more rows stays in its units, and a step goes over all of these. The
vectors lie in blocks of levels; a block sends each unit the packed numbers of the levels the unit
holds and adds up what comes back. Which these are is settled once, so a step handles arrays and no
names. Units lie in buckets and do not move; each step's vectors are written to the shared folder,
so the plan does not grow and a lost executor costs one step at most.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairtender.functions.draws import replicate_weights
from fairtender.operators.components import components
from fairtender.operators.layout import BUCKETS, bucketed, forget
from fairtender.operators.moments import LONG, add_up, arrow_rows, matrix, texts
from fairtender.operators.skew import HOT_ROWS
from fairtender.session import stage

# steps without a new least residual after which the equations count as unsolvable
PATIENCE = 500
# size of the residual relative to that of the column
TOLERANCE = 1e-9
# numbers of the rows of a unit, and of the vectors of a unit's levels in one task
UNIT_VALUES, TASK_VALUES = 4_000_000, 16_000_000
# unknowns up to which a connected part in one unit is solved by elimination first, and those of small parts eliminated at once
DIRECT, AT_ONCE = 1500, 128
# least replicates solved one after the other by a task for a model of one unit
LOCAL_REPS = 8
# levels that are worth a block of vectors of their own
BLOCK_LEVELS = 1000
# kinds of rows besides those of LONG: effects of the lowest level of either factor met in a unit
LOWEST = (5, 6)
# and what residual is left where the solution got stuck
STUCK = 7

_UNIT = pa.schema(
    [("unit", pa.int64()), ("model", pa.string()), ("levels", pa.list_(pa.string())), ("nodes", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("level_at", "node_at", "hash", "v")]
)
UNIT_SQL = "unit bigint, model string, levels array<string>, nodes array<string>, level_at binary, node_at binary, hash binary, v binary"
_LONG = pa.schema(
    [("model", pa.string()), ("rep", pa.int32()), ("part", pa.string()), ("kind", pa.int32())]
    + [("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64()), ("x", pa.float64())]
)


def _connected(level: np.ndarray, node: np.ndarray, levels: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest level of the connected part of each level and node."""
    label = np.arange(levels)
    while True:
        of_node = np.full(nodes, levels)
        np.minimum.at(of_node, node, label[level])
        now = label.copy()
        np.minimum.at(now, level, of_node[node])
        now = now[now]
        if (now == label).all():
            return label, of_node
        label = now


def _sorted_names(names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct texts in their order, and where each text stands among them."""
    coded = names.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def _packed(number: int, model: str, levels: pa.Array, level: np.ndarray, nodes: pa.Array, node: np.ndarray, hashes: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """A unit of rows whose level and node are places in lists of sorted names."""
    if (np.diff(level) < 0).any():
        order = np.argsort(level, kind="stable")
        level, node, hashes, v = level[order], node[order], hashes[order], v[order]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), n) for n in (levels, nodes)]
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (level.astype(np.int32), node.astype(np.int32), hashes.astype(np.int64), v)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([model], pa.string()), *lists, *blobs], schema=_UNIT)


def _units(width: int, most: int):
    """Sorted rows to units; a task's rows of one model make one unit per ``most`` rows."""

    def packed(number: int, model: str, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        coded = [x for c in ("level", "level2") for x in _sorted_names(pa.concat_arrays(table[c].chunks))]
        return _packed(number, model, *coded, table["hash"].to_numpy(), np.concatenate([matrix(b, width) for b in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size, model = [], 0, None
        for batch in batches:
            models = texts(batch, "model")
            cuts = np.flatnonzero(np.r_[True, models[1:] != models[:-1]]) if len(models) else []
            for a, b in zip(cuts, [*cuts[1:], len(models)]):
                while a < b:
                    if held and (models[a] != model or size >= most):
                        yield packed(number, model, held)
                        number, held, size = number + 1, [], 0
                    model = models[a]
                    take = min(b - a, most - size)
                    held.append(batch.slice(a, take))
                    a, size = a + take, size + take
        if held:
            yield packed(number, model, held)

    return run


class Unit:
    """A unit's rows with the unknowns they touch: levels of the second factor, then the first's in ``shared`` places."""

    def __init__(self, row: dict, width: int, shared: list[int] | None = None):
        self.model, self.levels, self.nodes = row["model"], row["levels"], row["nodes"]
        self.level, self.node = (np.frombuffer(row[c], np.int32) for c in ("level_at", "node_at"))
        self.hash, self.v = np.frombuffer(row["hash"], np.int64), np.frombuffer(row["v"]).reshape(-1, width)
        self.y = self.v[:, 1:]
        self.starts = np.flatnonzero(np.r_[True, np.diff(self.level) > 0])
        # places count from 0 and rows are sorted by level; names may be left out
        self.node_count, self.shared = int(self.node.max()) + 1, np.zeros(int(self.level[-1]) + 1, bool)
        self.shared[shared or []] = True

    @cached_property
    def by_node(self) -> np.ndarray:
        return np.argsort(self.node, kind="stable")

    @cached_property
    def node_starts(self) -> np.ndarray:
        return np.flatnonzero(np.r_[True, np.diff(self.node[self.by_node]) > 0])

    def weights(self, first: int, last: int) -> np.ndarray:
        """Of the rows, by replicate."""
        return replicate_weights(self.hash, first, last - 1).T.copy()

    def _by_level(self, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(rows, self.starts)

    def _gathered(self, rows: np.ndarray) -> np.ndarray:
        """Sums by unknown of rows that are what is left of a level's sum."""
        if rows.ndim == 1 or rows.shape[1] <= 4:
            columns = [np.bincount(self.node, c, self.node_count) for c in (rows[None] if rows.ndim == 1 else rows.T)]
            own = columns[0] if rows.ndim == 1 else np.stack(columns, axis=1)
        else:
            own = np.add.reduceat(rows[self.by_node], self.node_starts)
        return np.concatenate([own, self._by_level(rows)[self.shared]])

    def sizes(self, w: np.ndarray) -> np.ndarray:
        return self._gathered(w)

    def plain(self, w: np.ndarray) -> np.ndarray:
        return self._gathered(w[:, None] * self.y)

    def right_side(self, w: np.ndarray) -> np.ndarray:
        rows = w[:, None] * self.y
        means = self._by_level(rows) / self._by_level(w)[:, None]
        means[self.shared] = 0.0
        return self._gathered(rows - w[:, None] * means[self.level])

    def apply(self, w: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The equations' left side for the unknowns ``p``."""
        rows = w[:, None] * p[self.node]
        means = self._by_level(rows) / self._by_level(w)[:, None]
        means[self.shared] = -p[self.node_count :]
        return self._gathered(rows - w[:, None] * means[self.level])

    def level_effects(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        rest = w[:, None] * (self.y - x[self.node])
        effects = self._by_level(rest) / self._by_level(w)[:, None]
        effects[self.shared] = x[self.node_count :]
        return effects

    def told(self, rep: int, w: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        """The cross products, what the effects explain of them, and the lowest levels' effects."""
        width = self.v.shape[1]
        effects = self.level_effects(w, x)
        fitted = np.concatenate([np.zeros((len(w), 1)), effects[self.level] + x[self.node]], axis=1)
        weighted = (w[:, None] * self.v).T
        product, raw = weighted @ fitted, weighted @ self.v
        i, j = np.triu_indices(width)
        parts = [pd.DataFrame({"part": None, "kind": 0, "i": i, "j": j, "s": raw[i, j], "x": product[i, j]})]
        for kind, name, effect in ((LOWEST[0], self.levels[0], effects[0]), (LOWEST[1], self.nodes[0], x[0])):
            parts.append(pd.DataFrame({"part": name, "kind": kind, "i": np.arange(width), "j": -1, "s": np.r_[0.5, effect], "x": 0.0}))
        return pd.concat(parts).assign(model=self.model, rep=rep).astype({c: "int32" for c in ("rep", "kind", "i", "j")})

    def parts(self) -> tuple[int, np.ndarray, list[np.ndarray]]:
        """If no connected part has rows elsewhere: levels of both factors less one per part of the
        graph of level pairs, one of the second factor's levels per part, and the nodes that are
        to be eliminated together."""
        _, of_node = _connected(self.level, self.node, len(self.levels), len(self.nodes))
        _, grounds, at, sizes = np.unique(of_node, return_index=True, return_inverse=True, return_counts=True)
        batches, held, size = [], [], 0
        by_part = np.split(np.argsort(at, kind="stable"), np.cumsum(sizes)[:-1])
        # a part's only node is held at 0
        for k in np.flatnonzero((sizes > 1) & (sizes <= DIRECT)):
            if held and size + sizes[k] > AT_ONCE:
                batches.append(np.concatenate(held))
                held, size = [], 0
            held.append(by_part[k])
            size += sizes[k]
        if held:
            batches.append(np.concatenate(held))
        return len(self.levels) + len(self.nodes) - len(grounds), grounds, [self._batch(b, grounds) for b in batches]

    def _batch(self, nodes: np.ndarray, grounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of whole parts: nodes, rows, their level and node counted from 0, and which nodes are held at 0."""
        at = np.full(len(self.nodes), -1)
        at[nodes] = np.arange(len(nodes))
        rows = np.flatnonzero(at[self.node] >= 0)
        _, level = np.unique(self.level[rows], return_inverse=True)
        return nodes, rows, level, at[self.node[rows]], np.flatnonzero(np.isin(nodes, grounds))

    def direct(self, w: np.ndarray, batches: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """The unknowns by elimination, one of each part held at 0; 0 in parts that are in no batch."""
        right, sizes = self.right_side(w), self.sizes(w)
        out = np.zeros_like(right)
        for nodes, rows, level, node, held in batches:
            size = len(nodes)
            left, own = np.diag(sizes[nodes]), w[rows]
            whole = np.bincount(level, own)
            for at in range(0, len(whole), size):
                some = slice(*np.searchsorted(level, (at, at + size)))
                block = np.bincount((level[some] - at) * size + node[some], own[some], size * size).reshape(size, size)
                left -= block.T @ (block / np.r_[whole[at : at + size], np.ones(max(0, at + size - len(whole)))][:, None])
            side = right[nodes]
            left[held], left[:, held], side[held] = 0.0, 0.0, 0.0
            left[held, held] = 1.0
            with contextlib.suppress(np.linalg.LinAlgError):
                out[nodes] = np.linalg.solve(left, side)
        return out


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """0 where nothing is left to divide by."""
    return np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)


def _stuck(squared: float) -> RuntimeError:
    return RuntimeError(f"two factors: no progress after a relative residual of {squared**0.5:.1e}")


def solve_unit(unit: Unit, w: np.ndarray, batches: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, float]:
    """Effects of the unknowns for one replicate, all columns at once, and 0 or, if there
    is no progress any more, the least residual reached (squared, relative).

    Elimination gives the start in parts of few unknowns; conjugate gradients go on from it as
    long as there is more than the tolerance left.
    """
    n = unit.sizes(w)[:, None]
    r = unit.right_side(w)
    scale = (unit.plain(w) ** 2 / n).sum(axis=0)
    x = unit.direct(w, batches)
    r = r - unit.apply(w, x)
    p = r / n
    rz = (r * p).sum(axis=0)
    least, idle = np.inf, 0
    while True:
        open_ = _ratio(rz, scale) >= TOLERANCE**2
        if not open_.any():
            return x, 0.0
        left = _ratio(rz, scale).max()
        least, idle = (left, 0) if left < least else (least, idle + 1)
        if idle > PATIENCE:
            return x, least
        q = unit.apply(w, p)
        step = _ratio(rz, (p * q).sum(axis=0)) * open_
        x += step * p
        r -= step * q
        z = r / n
        new = (r * z).sum(axis=0)
        p = z + _ratio(new, rz) * p
        rz = new


def _solved_alone(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, width)
                lost, _, batches = unit.parts()
                for rep, w in zip(range(row["first"], row["last"]), unit.weights(row["first"], row["last"])):
                    x, left = solve_unit(unit, w, batches)
                    yield arrow_rows(unit.told(rep, w, x), _LONG)
                    single = pd.DataFrame({"kind": [3, STUCK], "s": [float(lost), left]}).assign(model=unit.model, rep=rep, part=None, i=0, j=-1, x=0.0)
                    yield arrow_rows(single.astype({c: "int32" for c in ("rep", "kind", "i", "j")}), _LONG)

    return run


def cross_products_two(design: DataFrame, width: int, reps: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sums as of :func:`cross_products` with the factors ``level`` and ``level2`` projected out.

    A unit has at most ``hot_rows`` rows. ``design`` is read several times.
    """
    most = max(1, min(hot_rows, UNIT_VALUES // width))
    order = ["model", "level", "hash"]
    rows = design.select(*order, "level2", "v").repartitionByRange(*order).sortWithinPartitions(*order)
    units = stage(rows.mapInArrow(_units(width, most), UNIT_SQL))
    alone = units.groupBy("model").agg(F.count(F.lit(1)).alias("units"), F.sum(F.length("hash") / 8).alias("rows"))
    # a model whose rows lie in several ranges only because they are sorted
    small = alone.filter((F.col("units") > 1) & (F.col("rows") <= most))
    if small.head():
        again = design.join(small.select(F.col("model").alias("_m")), F.expr("model = _m")).select(*order, "level2", "v")
        one = again.repartition("model").sortWithinPartitions(*order).mapInArrow(_units(width, most), UNIT_SQL)
        renamed = one.withColumn("unit", F.col("unit") + (1 << 62))
        units = stage(units.join(small, "model", "left_anti").select(units.columns).unionByName(renamed))
        alone = units.groupBy("model").agg(F.count(F.lit(1)).alias("units"))
    large = stage(alone.filter("units > 1").select("model"))
    single, spread = units.join(large, "model", "left_anti"), None
    if large.head():
        single, spread, parts = _by_parts(single, units.join(large, "model", "left_semi").select(units.columns), width, most)
    tasks = int(design.sparkSession.conf.get(BUCKETS))
    # the more units, the more replicates of one go to a task
    at_once = max(LOCAL_REPS, -(-(reps + 1) * single.count() // (4 * tasks)))
    firsts = F.sequence(F.lit(0), F.lit(reps), F.lit(at_once))
    chunks = single.withColumn("first", F.explode(firsts)).withColumn("last", F.least(F.col("first") + at_once, F.lit(reps + 1)))
    # a chunk is far more work than moving a unit; many more parts than chunks keep these apart
    wide = max(4 * -(-(reps + 1) // at_once), 4 * tasks)
    long = stage(chunks.repartition(wide, "unit", "first").mapInArrow(_solved_alone(width), LONG))
    left = long.filter(F.col("kind") == STUCK).agg(F.max("s")).first()[0]
    if left:
        raise _stuck(left)
    long = long.filter(F.col("kind") != STUCK)
    if spread is not None:
        long = long.unionByName(_solved_together(spread, parts, width, reps))
    return add_up(_with_lowest(long))


def _with_lowest(long: DataFrame) -> DataFrame:
    """The lowest levels' effects, added for the constant, in place of those of each unit."""
    lowest = long.filter(F.col("kind").isin(*LOWEST)).groupBy("model", "rep", "kind", "i").agg(F.min(F.struct("part", "s")).alias("low"))
    both = lowest.groupBy("model", "rep", "i").agg(F.sum("low.s").alias("s"))
    told = both.select("model", "rep", F.lit(None).cast("string").alias("part"), F.lit(4).alias("kind"), "i", F.lit(-1).alias("j"), "s", F.lit(0.0).alias("x"))
    return long.filter(~F.col("kind").isin(*LOWEST)).unionByName(told)


# ---- models of many units ----------------------------------------------------------------

# a level's weights and vectors: n has a number per replicate, the others one per replicate and column
VECTORS = ("n", "x", "r", "p", "q")
_BLOBS = [(c, pa.binary()) for c in VECTORS]
# names of a unit's unknowns that lie in a block, and the block with the places they have there
ROUTE_SQL = "model string, block int, unit bigint, names array<string>"
_ROUTE = pa.schema([("model", pa.string()), ("block", pa.int32()), ("unit", pa.int64()), ("names", pa.list_(pa.string()))])
_BLOCK = pa.schema([("model", pa.string()), ("block", pa.int32()), ("size", pa.int32()), ("nodes", pa.int32()), ("units", pa.list_(pa.int64())), ("at", pa.list_(pa.binary()))])
BLOCK_SQL = "model string, block int, size int, nodes int, units array<bigint>, at array<binary>"
_STATE = pa.schema([*_BLOCK, *_BLOBS, ("dots", pa.binary())])
STATE_SQL = BLOCK_SQL + "".join(f", {c} binary" for c in (*VECTORS, "dots"))
# a unit's numbers for a block's levels
_PARTS = pa.schema([("model", pa.string()), ("block", pa.int32()), ("unit", pa.int64()), *_BLOBS])
PARTS_SQL = "model string, block int, unit bigint" + "".join(f", {c} binary" for c in VECTORS)
_SENT = pa.schema([("unit", pa.int64()), ("block", pa.int32()), ("vector", pa.binary())])
SENT_SQL = "unit bigint, block int, vector binary"
# a unit that knows which of its levels are shared, and its unknowns in the order of their blocks
_PLACED = pa.schema([*_UNIT, ("shared", pa.list_(pa.int32())), ("order", pa.binary()), ("blocks", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
PLACED_SQL = UNIT_SQL + ", shared array<int>, order binary, blocks array<int>, counts array<int>"


def _unknowns(row: dict, blocks: int) -> tuple[pa.Array, list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Names of a unit's unknowns, its shared levels, the order by block, and blocks with their counts."""
    places = {name: k for k, name in enumerate(row["levels"])} if row["shared"] else {}
    shared = sorted(places[name] for name in row["shared"] or [])
    names = pa.array(["b" + n for n in row["nodes"]] + ["a" + row["levels"][k] for k in shared], pa.string())
    block = (pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(blocks)).astype(np.int32)
    order = np.argsort(block, kind="stable").astype(np.int32)
    return names, shared, order, *np.unique(block, return_counts=True)


def _routes(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, _, order, found, counts = _unknowns(row, blocks)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), names.take(pa.array(order)))
                same = [pa.array([row[c]] * len(found), t) for c, t in (("model", pa.string()), ("unit", pa.int64()))]
                yield pa.RecordBatch.from_arrays([same[0], pa.array(found, pa.int32()), same[1], lists], schema=_ROUTE)

    return run


def _placed(blocks: int):
    """Units without the names that steps do not need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, shared, order, found, counts = _unknowns(row, blocks)
                row |= {"levels": row["levels"][:1], "nodes": row["nodes"][:1], "shared": shared}
                row |= {"order": order.tobytes(), "blocks": found.tolist(), "counts": counts.tolist()}
                yield pa.RecordBatch.from_pylist([row], schema=_PLACED)

    return run


def _block(routes: pa.Table) -> pa.Table:
    """The levels of a block, numbered, and which of them each unit holds."""
    lists = routes["names"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    at = [x.tobytes() for x in np.split(coded.indices.to_numpy().astype(np.int32), ends[:-1])]
    nodes = pc.sum(pc.starts_with(coded.dictionary, "b")).as_py()
    values = [routes["model"][0].as_py(), routes["block"][0].as_py(), len(coded.dictionary), nodes, routes["unit"].to_pylist(), at]
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)


def _on_units(width: int, work: Callable[[Unit, np.ndarray | None], dict | pa.Table], empty: pa.Schema):
    """A unit next to its unknowns' vectors; ``work`` gives a table or vectors, which go back by block."""

    def run(units: pa.Table, sent: pa.Table | None) -> pa.Table:
        if not units.num_rows:
            return empty.empty_table()
        row = units.to_pylist()[0]
        unit, order = Unit(row, width, row["shared"]), np.frombuffer(row["order"], np.int32)
        vectors = None
        if sent is not None:
            blobs = dict(zip(sent["block"].to_pylist(), sent["vector"].to_pylist()))
            came = np.concatenate([np.frombuffer(blobs.pop(b)).reshape(n, -1) for b, n in zip(row["blocks"], row["counts"])])
            vectors = np.empty_like(came)
            vectors[order] = came
        told = work(unit, vectors)
        if not isinstance(told, dict):
            return told
        cuts, count = np.cumsum(row["counts"])[:-1], len(row["blocks"])
        blobs = {c: [x.tobytes() for x in np.split(told[c][order], cuts)] if c in told else [None] * count for c in VECTORS}
        return pa.table({"model": [unit.model] * count, "block": row["blocks"], "unit": [row["unit"]] * count, **blobs}, schema=_PARTS)

    return run


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each unit the vector of those of a block's levels that it holds."""
    for batch in batches:
        for row in batch.to_pylist():
            vector = np.frombuffer(row["vector"]).reshape(row["size"], -1)
            for unit, at in zip(row["units"], row["at"]):
                values = [unit, row["block"], vector[np.frombuffer(at, np.int32)].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _SENT, strict=True)], schema=_SENT)


def _moved(scalars: dict[str, tuple[np.ndarray, np.ndarray]], reps: int):
    """The next effects, residuals and directions, from the steps and turns of each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                step, turn = scalars[row["model"]]
                n = np.frombuffer(row["n"]).reshape(row["size"], reps, 1)
                x, r, p, q = (np.frombuffer(row[c]).reshape(row["size"], reps, -1) for c in VECTORS[1:])
                r = r - step * q
                row |= {"x": (x + step * p).tobytes(), "r": r.tobytes(), "p": (r / n + turn * p).tobytes(), "q": None, "dots": None}
                yield pa.RecordBatch.from_pylist([row], schema=_STATE)

    return run


def _added(reps: int, begun: bool):
    """A block with the sums of what its units gave, and the scalar products of its vectors."""

    def run(blocks: pa.Table, parts: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _STATE.empty_table()
        row = blocks.to_pylist()[0]
        at = dict(zip(row["units"], (np.frombuffer(b, np.int32) for b in row["at"])))
        for c in VECTORS:
            if parts[c].null_count:
                continue
            total = None
            for unit, blob in zip(parts["unit"].to_pylist(), parts[c].to_pylist()):
                own = np.frombuffer(blob).reshape(len(at[unit]), -1)
                total = np.zeros((row["size"], own.shape[1])) if total is None else total
                # a unit holds a level once
                total[at[unit]] += own
            row[c] = total.tobytes()
        n = np.frombuffer(row["n"]).reshape(row["size"], reps, 1)
        x, r = (np.frombuffer(row[c]).reshape(row["size"], reps, -1) for c in ("x", "r"))
        if begun:
            # the columns' own size is the measure: nested factors leave only rounding errors to start with
            dots = [x**2 / n]
            row |= {c: np.zeros_like(r).tobytes() for c in ("x", "p", "q")}
        else:
            p, q = (np.frombuffer(row[c]).reshape(row["size"], reps, -1) for c in ("p", "q"))
            dots = [r * r / n, p * q, r * q / n, q * q / n]
        row["dots"] = np.stack([d.sum(axis=0) for d in dots]).tobytes()
        return pa.Table.from_pylist([row], schema=_STATE)

    return run


_DOTS = pa.schema([("model", pa.string()), ("dots", pa.binary())])


def _all_dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for model, dots in zip(batch.column("model").to_pylist(), batch.column("dots").to_pylist()):
            sums[model] = sums.get(model, 0.0) + np.frombuffer(dots)
    yield pa.RecordBatch.from_pydict({"model": list(sums), "dots": [d.tobytes() for d in sums.values()]}, schema=_DOTS)


def _dots(state: DataFrame, reps: int, size: int) -> dict[str, np.ndarray]:
    """On the driver: per model a few numbers per replicate and column, of one task at a time."""
    out: dict[str, np.ndarray] = {}
    for r in state.select("model", "dots").mapInArrow(_all_dots, "model string, dots binary").toLocalIterator():
        out[r["model"]] = out.get(r["model"], 0.0) + np.frombuffer(r["dots"]).reshape(-1, reps, size)
    return out


def _solved_together(units: DataFrame, parts: DataFrame, width: int, reps: int) -> DataFrame:
    """Long rows of models whose units have levels in common; ``parts`` are their connected parts."""
    ends = units.select("model", "unit", F.explode(F.array_distinct(F.array(F.element_at("levels", 1), F.element_at("levels", -1)))).alias("name"))
    # rows are sorted, so only a unit's first and last level can lie in others too
    several = stage(ends.groupBy("model", "name").agg(F.count(F.lit(1)).alias("units")).filter("units > 1"))
    shared = ends.join(several, ["model", "name"]).groupBy("unit").agg(F.collect_set("name").alias("shared"))
    marked = units.join(shared, "unit", "left")
    sizes = F.size("nodes") + 2
    most, total = units.agg(F.max(sizes), F.sum(sizes)).first()
    chunk = max(1, min(reps + 1, TASK_VALUES // (most * width)))
    buckets = int(units.sparkSession.conf.get(BUCKETS))
    blocks = max(1, -(-total * chunk * width // TASK_VALUES), min(buckets, total // BLOCK_LEVELS))
    routes = marked.select("unit", "model", "levels", "nodes", "shared").mapInArrow(_routes(blocks), ROUTE_SQL)
    met = stage(routes.groupBy("model", "block").applyInArrow(_block, BLOCK_SQL))
    placed = bucketed(marked.mapInArrow(_placed(blocks), PLACED_SQL), ["unit"])
    # levels of both factors less one per part: the dummies of a part's levels add up to the same column on either side
    counted = [
        units.select("model", F.size("levels").alias("s")), several.select("model", (1 - F.col("units")).alias("s")),
        met.select("model", F.col("nodes").alias("s")), parts.select("model", F.lit(-1).alias("s")),
    ]
    lost = stage(counted[0].unionAll(counted[1]).unionAll(counted[2]).unionAll(counted[3]).groupBy("model").agg(F.sum("s").cast("double").alias("s")))
    # weights are positive, so all replicates have the levels of the rows
    cases = lost.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    told = cases.select("model", "rep", F.lit(None).cast("string").alias("part"), F.lit(3).alias("kind"), F.lit(0).alias("i"), F.lit(-1).alias("j"), "s", F.lit(0.0).alias("x"))
    for first in range(0, reps + 1, chunk):
        told = told.unionByName(stage(_solved_chunk(placed, met, width, first, min(first + chunk, reps + 1))))
    forget(placed)
    return told


def _solved_chunk(units: DataFrame, blocks: DataFrame, width: int, first: int, last: int) -> DataFrame:
    reps, size = last - first, width - 1

    def on_units(work, state: DataFrame, vector: str, schema: pa.Schema, sql: str) -> DataFrame:
        sent = state.select("block", "size", "units", "at", F.col(vector).alias("vector")).mapInArrow(_sent, SENT_SQL)
        return units.groupBy("unit").cogroup(sent.groupBy("unit")).applyInArrow(_on_units(width, work, schema), sql)

    def with_parts(blocks: DataFrame, parts: DataFrame, begun: bool) -> DataFrame:
        key = ["model", "block"]
        return stage(blocks.groupBy(*key).cogroup(parts.groupBy(*key)).applyInArrow(_added(reps, begun), STATE_SQL))

    def started(unit: Unit, _) -> dict:
        w = unit.weights(first, last)
        side = np.concatenate([unit.right_side(x) for x in w], axis=1)
        plain = np.concatenate([unit.plain(x) for x in w], axis=1)
        return {"n": np.stack([unit.sizes(x) for x in w], axis=1), "x": plain, "r": side}

    def pushed(unit: Unit, p: np.ndarray) -> dict:
        p = p.reshape(len(p), reps, size)
        return {"q": np.concatenate([unit.apply(w, p[:, k]) for k, w in enumerate(unit.weights(first, last))], axis=1)}

    def finished(unit: Unit, x: np.ndarray) -> pa.Table:
        x = x.reshape(len(x), reps, size)
        rows = pd.concat([unit.told(first + k, w, x[:, k]) for k, w in enumerate(unit.weights(first, last))])
        return pa.Table.from_pandas(rows, _LONG, preserve_index=False)

    on_start = _on_units(width, started, _PARTS)
    begun = units.groupBy("unit").applyInArrow(lambda own: on_start(own, None), PARTS_SQL)
    blank = [F.lit(None).cast("binary").alias(c) for c in (*VECTORS, "dots")]
    state = with_parts(blocks.select("*", *blank), begun, True)
    scale = {m: d[0] for m, d in _dots(state, reps, size).items()}
    none = np.zeros((reps, size))
    scalars = {m: (none, none) for m in scale}
    least, idle = np.inf, 0
    while True:
        moved = state.mapInArrow(_moved(scalars, reps), STATE_SQL)
        state = with_parts(moved, on_units(pushed, moved, "p", _PARTS, PARTS_SQL), False)
        dots = _dots(state, reps, size)
        left = max(_ratio(d[0], scale[m]).max() for m, d in dots.items())
        if left < TOLERANCE**2:
            break
        least, idle = (left, 0) if left < least else (least, idle + 1)
        if idle > PATIENCE:
            raise _stuck(least)
        for m, (rz, pq, rq, qq) in dots.items():
            step = _ratio(rz, pq) * (_ratio(rz, scale[m]) >= TOLERANCE**2)
            after = np.maximum(rz - 2 * step * rq + step**2 * qq, 0.0)
            scalars[m] = (step, _ratio(after, rz))
    return on_units(finished, state, "x", _LONG, LONG)


# ---- connected parts over many units -----------------------------------------------------

_PIECES = pa.schema([("unit", pa.int64()), ("model", pa.string()), ("at", pa.int32()), ("rows", pa.int64()), ("names", pa.list_(pa.string()))])
PIECES_SQL = "unit bigint, model string, at int, rows bigint, names array<string>"
# rows of a unit that belong to a connected part of ``size`` rows; without a part, what stays in the unit
_DEALT = pa.schema([*_UNIT, ("part", pa.string()), ("size", pa.int64())])
DEALT_SQL = UNIT_SQL + ", part string, size bigint"


def _pieces(width: int):
    """Connected parts of each unit's own rows, by their lowest level, with the levels that other units may have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, width)
                of_level, of_node = _connected(unit.level, unit.node, len(unit.shared), unit.node_count)
                order = np.argsort(of_node, kind="stable")
                at, counts = np.unique(of_node, return_counts=True)
                rows = np.bincount(of_level[unit.level], minlength=len(of_level))[at]
                # rows are sorted by the first factor, so only its ends can lie elsewhere
                ends = sorted({0, len(of_level) - 1})
                names = ["b" + unit.nodes[k] for k in order] + ["a" + unit.levels[k] for k in ends]
                at, counts, rows = np.r_[at, of_level[ends]], np.r_[counts, [1] * len(ends)], np.r_[rows, [0] * len(ends)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(names, pa.string()))
                same = [pa.array([row[c]] * len(at), t) for c, t in (("unit", pa.int64()), ("model", pa.string()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at, pa.int32()), pa.array(rows, pa.int64()), lists], schema=_PIECES)

    return run


def _dealt(width: int, most: int):
    """A unit's rows by the connected part, packed, and what stays: rows of parts that have more than ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, width)
                of_level, _ = _connected(unit.level, unit.node, len(unit.shared), unit.node_count)
                names, number = np.unique([p["part"] for p in row["pieces"]], return_inverse=True)
                part, size = np.full(len(of_level), -1), np.zeros(len(names), np.int64)
                part[[p["at"] for p in row["pieces"]]] = number
                size[number] = [p["size"] for p in row["pieces"]]
                own = part[of_level][unit.level]
                stays = size[own] > most
                if stays.all():
                    yield pa.RecordBatch.from_pylist([row | {"part": None, "size": None}], schema=_DEALT)
                    continue
                own[stays] = -1
                order = np.argsort(own, kind="stable")
                found = []
                for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                    (levels, level), (nodes, node) = (np.unique(c[at], return_inverse=True) for c in (unit.level, unit.node))
                    k = own[at[0]]
                    found.append(
                        {"unit": row["unit"], "model": unit.model, "levels": [unit.levels[i] for i in levels], "nodes": [unit.nodes[i] for i in nodes]}
                        | {"level_at": level.astype(np.int32).tobytes(), "node_at": node.astype(np.int32).tobytes()}
                        | {"hash": unit.hash[at].tobytes(), "v": unit.v[at].tobytes()}
                        | {"part": names[k] if k >= 0 else None, "size": size[k] if k >= 0 else None}
                    )
                yield pa.RecordBatch.from_pylist(found, schema=_DEALT)

    return run


def _united(width: int, most: int):
    """Packed rows that come by connected part to units of whole parts."""

    def packed(number: int, rows: list[dict]) -> pa.RecordBatch:
        coded = []
        for names, at in (("levels", "level_at"), ("nodes", "node_at")):
            texts, place = _sorted_names(pa.array([n for r in rows for n in r[names]], pa.string()))
            starts = np.cumsum([0, *[len(r[names]) for r in rows[:-1]]])
            coded += [texts, np.concatenate([place[np.frombuffer(r[at], np.int32) + s] for r, s in zip(rows, starts)])]
        hashes = np.concatenate([np.frombuffer(r["hash"], np.int64) for r in rows])
        return _packed(number, rows[0]["model"], *coded, hashes, np.concatenate([np.frombuffer(r["v"]) for r in rows]).reshape(-1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size, last = [], 0, (None, None)
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["model"], row["part"])
                if now != last:
                    if held and (now[0] != last[0] or size + row["size"] > most):
                        yield packed(number, held)
                        number, held, size = number + 1, [], 0
                    last, size = now, size + row["size"]
                held.append(row)
        if held:
            yield packed(number, held)

    return run


def _by_parts(single: DataFrame, units: DataFrame, width: int, most: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of models of many units dealt out by connected part.

    Returns units that are solved alone (``single`` and those of whole parts), units of the rows of parts
    that have more than ``most``, and these parts.
    """
    pieces = stage(units.mapInArrow(_pieces(width), PIECES_SQL)).withColumn("piece", F.concat_ws("-", "unit", "at"))
    # a level comes once per unit, so none has many rows
    met = pieces.select("model", "piece", F.explode("names").alias("name")).withColumn("least", F.min("piece").over(Window.partitionBy("model", "name")))
    links = components(met.filter("piece <> least").select(F.col("piece").alias("a"), F.col("least").alias("b")).distinct())
    joined = pieces.drop("names").join(links.select(F.col("node").alias("piece"), "label"), "piece", "left")
    labelled = joined.withColumn("part", F.coalesce("label", "piece")).drop("label")
    sizes = labelled.groupBy("part").agg(F.sum("rows").alias("size"))
    known = stage(labelled.join(sizes, "part").select("unit", "model", "at", "rows", "part", "size"))
    inside, beyond = known.agg(F.sum(F.when(F.col("size") <= most, F.col("rows"))), F.max("size")).first()
    if not inside:
        return single, units, known.select("model", "part").distinct()
    told = known.groupBy("unit").agg(F.collect_list(F.struct("at", "part", "size")).alias("pieces"))
    dealt = stage(units.join(told, "unit").mapInArrow(_dealt(width, most), DEALT_SQL))
    bins = max(-(-inside // most), int(units.sparkSession.conf.get(BUCKETS)))
    moved = dealt.filter(F.col("part").isNotNull()).repartition(bins, "model", "part").sortWithinPartitions("model", "part")
    whole = moved.mapInArrow(_united(width, most), UNIT_SQL)
    single = single.unionByName(stage(whole.withColumn("unit", F.col("unit") + (1 << 61))))
    if beyond <= most:
        return single, None, None
    return single, dealt.filter(F.col("part").isNull()).select(units.columns), known.filter(F.col("size") > most).select("model", "part").distinct()
