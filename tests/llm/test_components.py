"""Components of links that come little by little, in few tables."""

import random

import pytest

from fairtender.llm import components as graph


def _written(monkeypatch) -> list[str]:
    written, keep = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df, label="step": (written.append(label), keep(df, label))[1])
    return written


def _least(edges: list[tuple[int, int]]) -> dict[int, int]:
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return {x: y for x, y in label.items() if x != y}


def _edges(spark, edges, parts=4):
    return spark.createDataFrame(edges, "a long, b long").repartition(parts)


def _got(df) -> dict[int, int]:
    rows = df.collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.label for r in rows}


def test_stars_are_written_once(spark, monkeypatch):
    """Two rounds and seven tables before, most of them to see that nothing changes."""
    written = _written(monkeypatch)
    edges = [(x, x % 7) for x in range(7, 200)]
    assert _got(graph.least_nodes(_edges(spark, edges))) == _least(edges)
    assert len(written) == 1


@pytest.mark.parametrize("at_once", [3, 1 << 18])
def test_links_come_to_labels(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    written = _written(monkeypatch)
    rng = random.Random(7)
    chain = [(x, x + 1) for x in range(1000, 1024)]
    rng.shuffle(chain)
    first = chain[:16] + [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(5, 5), (-9, 3), (3, -9)]
    more = chain[16:] + [(rng.randrange(400), rng.randrange(400)) for _ in range(60)]
    none = spark.createDataFrame([], "node long, label long")
    labels = graph.merged(none, _edges(spark, first))
    assert _got(labels) == _least(first)
    after = graph.merged(labels, _edges(spark, more))
    assert _got(after) == _least(first + more)
    # links within components leave the labels as they are, at one (empty) table
    written.clear()
    assert graph.merged(after, _edges(spark, first)) is after and len(written) == 1


def test_missing_and_repeated_links(spark):
    edges = [(2, 1), (1, 2), (2, 1), (4, 3), (3, 2), (9, 9)]
    rows = spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long").repartition(6)
    assert _got(graph.least_nodes(rows)) == _least(edges)
    names = rows.selectExpr("concat('n', a) a", "concat('n', b) b")
    assert _got(graph.components(names)) == {f"n{x}": "n1" for x in (1, 2, 3, 4)}
    assert _got(graph.components(rows.filter("a > 100"))) == {}
