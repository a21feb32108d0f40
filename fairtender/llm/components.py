"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtender.llm.staging import keep, release
from fairtender.llm.words import lean

#: edges that a task contracts at once
AT_ONCE = 1 << 18
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges but the least of its part of them, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[x], least[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while ((up := least[least]) != least).any():
            least = up
    some = least != np.arange(len(nodes))
    return nodes[some], nodes[least[some]]


def _contract(batches: Iterator[pa.RecordBatch], at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """As few edges (a > b) that connect the same nodes, of each ``at_once`` edges of a task.

    Where they are sorted by ``a``, a node's edges count as one however they fall: what is known of
    the last node goes on to the next edges.
    """
    held, size = [], 0

    def sent(ends: bool) -> tuple[pa.RecordBatch, list]:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, least = _forest(a, b)
        stays = nodes == a[-1] if not ends else np.zeros(len(nodes), bool)
        return pa.RecordBatch.from_arrays([pa.array(nodes[~stays]), pa.array(least[~stays])], schema=_EDGES), [(nodes[stays], least[stays])]

    for batch in batches:
        for at in range(0, len(batch), at_once):
            held.append(tuple(batch.column(c).to_numpy()[at : at + at_once] for c in ("a", "b")))
            size += len(held[-1][0])
            if size >= at_once:
                out, held = sent(False)
                size = 0
                yield out
    if held:
        yield sent(True)[0]


def _contracted(edges: DataFrame) -> DataFrame:
    at_once = AT_ONCE
    return edges.select("a", "b").mapInArrow(lean(lambda batches: _contract(batches, at_once)), "a long, b long")


def _open(links: DataFrame) -> tuple[int, int]:
    """How many nodes keep ``links`` (a > b) from being stars around least nodes, and how many links are there twice."""
    down = links.select(F.col("a").alias("node"), "b", F.lit(0).alias("centre"))
    up = links.select(F.col("b").alias("node"), F.lit(None).cast(dict(links.dtypes)["b"]).alias("b"), F.lit(1).alias("centre"))
    nodes = down.unionByName(up).groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("b").alias("c"), F.max("centre").alias("centre"))
    some = nodes.agg(F.count(F.when((F.col("low") != F.col("high")) | ((F.col("c") > 0) & (F.col("centre") == 1)), 1)), F.count(F.when(F.col("c") > 1, 1)))
    return tuple(some.first())


def least_nodes(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: each node of ``edges`` (``a``, ``b``) with the least one of its component, without those least nodes.

    Tasks first leave out what their own edges connect already (whole numbers only). Then large-star and
    small-star steps are repeated until all edges point at least nodes: each step links the
    neighbours of a node to its least neighbour, first the larger ones, then the smaller ones
    and the node itself. The number of rounds grows with the logarithm of the nodes; minima are
    combined before each shuffle, and joins on a hot node can be split by adaptive execution.
    After the tasks' own step a node has at most one smaller neighbour of each task.
    """
    links = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    whole = {t for _, t in links.dtypes} == {"bigint"}
    links = keep(_contracted(links) if whole else links.distinct(), "edges")
    while not links.isEmpty():
        wrong, twice = _open(links)
        if not wrong:
            links = keep(links.distinct(), "edges") if twice else links
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large if whole else large.distinct(), "edges")
        release(links)
        if whole:  # what a node's smaller neighbours and others in the task connect
            links = keep(_contracted(large.repartition("a").sortWithinPartitions("a")), "edges")
        else:
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            links = keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(large)
    return links.select(F.col("a").alias("node"), F.col("b").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (``a``, ``b``) with the least node of its component: ``node``, ``label``."""
    nodes = least_nodes(edges)
    return nodes.unionByName(nodes.select(F.col("label").alias("node"), "label").distinct())


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` as of :func:`least_nodes`, written, when ``edges`` come to those they were made from.

    Only edges between components are looked at, and none of those within them again.
    """
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    held = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = least_nodes(held.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    if between.isEmpty():
        return labels
    moved = between.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return keep(old.unionByName(between), "labels")
