"""Whitening and vector codes against plain numpy."""

import hashlib
import math

import numpy as np
import pytest

from fairtender.llm import codes, queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(values):
    return [math.floor(1024 * float(np.float32(c))) for c in values]


def kept(rows, width):
    return [r for r in rows if r[1] is not None and len(r[1]) == width and all(c is not None and math.isfinite(c) for c in r[1])]


def sample(n, width, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)) * np.linspace(0.05, 0.6, width) + rng.normal(size=width)
    base[n // 3 :: 7] = base[0]  # repeated vectors
    return [(int(i), [float(np.float32(c)) for c in v], [None, 1, 2, 2, 2][i % 5]) for i, v in enumerate(base)]


AWKWARD = [(None, [0.5] * 8, None), (5000, None, 1), (5001, [0.1] * 7 + [None], 1), (5002, [0.1] * 7 + [float("nan")], 1), (5003, [float("inf")] + [0.0] * 7, 2), (5004, [], 2), (5005, [0.1] * 5, 2), (3, [-3.0] * 8, 2)]


def test_cross_products():
    rng = np.random.default_rng(1)
    for shape, high in (((1, 1), 5), ((64, 3), 2**20), ((777, 70), 3000), ((130, 130), 2**11), ((100, 4), 2**40), ((65, 5), 1)):
        x = rng.integers(-high, high, shape)
        want = x.astype(object).T @ x.astype(object)
        assert (whitening.cross_products(x).astype(object) == want).all()


def check_whitened(got, rows, width, top):
    x = np.array([whole(r[1]) for r in rows], object) + 100_000
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    v = (off.T @ off).astype(float) / float(n) ** 3
    values, basis = np.linalg.eigh(v)
    order = np.argsort(-values)[:top]
    want = (off / n).astype(float) @ basis[:, order] / np.sqrt(values[order])
    mine = {}
    for r in got:
        mine.setdefault(r.vec_id, {}).setdefault(r.component, []).append((abs(r.whitened), int(r.deviation)))
        assert r.n == n and r.identity_error < 1e-9
        assert math.isclose(r.explained, values[order][r.component - 1] / values.sum(), rel_tol=1e-6)
    theirs = {}
    for i, r in enumerate(rows):
        for c in range(len(order)):
            theirs.setdefault(r[0], {}).setdefault(c + 1, []).append((abs(want[i, c]), int((off[i] ** 2).sum())))
    assert {k: set(v) for k, v in mine.items()} == {k: set(v) for k, v in theirs.items()}
    for k in theirs:
        for c in theirs[k]:
            a, b = sorted(mine[k][c], key=lambda p: p[::-1]), sorted(theirs[k][c], key=lambda p: p[::-1])
            assert [p[1] for p in a] == [p[1] for p in b]
            assert np.allclose([p[0] for p in a], [p[0] for p in b], atol=1e-8)
    # one sign for all rows
    if None not in theirs:
        for c in range(len(order)):
            dot = sum(r.whitened * want[[q[0] for q in rows].index(r.vec_id), c] for r in got if r.component == c + 1)
            assert abs(abs(dot) / n - 1) < 1e-6


def test_whitened(spark):
    rows = sample(400, 12)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n string").repartition(5)
    check_whitened(whitening.whiten(frame).collect(), rows, 12, 8)


def test_whitened_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitened(queries.op11_whitened(spark, sf).collect(), kept(rows, 64), 64, 8)


def test_whitened_awkward(spark):
    rows = sample(200, 8) + AWKWARD
    check_whitened(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), kept(rows, 8), 8, 8)
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).count() == 0 and whitening.whiten(none).columns == whitening.whiten(spark.createDataFrame(rows, SCHEMA)).columns
    # equal rows do not vary; three rows vary along two components at most
    same = whitening.whiten(spark.createDataFrame(rows[:1] * 3, SCHEMA)).collect()
    assert len(same) == 24 and all(r.whitened is None and r.deviation == 0 and r.explained is None for r in same)
    few = whitening.whiten(spark.createDataFrame(rows[:3], SCHEMA)).collect()
    assert sorted({r.component for r in few if r.whitened is not None}) == [1, 2] and few[0].identity_error < 1e-9
    one = whitening.whiten(spark.createDataFrame([(1, [0.5]), (2, [0.25]), (2, [0.75])], "vec_id long, embedding array<double>")).collect()
    assert sorted(round(r.whitened, 6) for r in one) in ([-1.224745, 0.0, 1.224745],)


def test_whitened_large_numbers(spark):
    rows = [(i, [1e30 * (i % 3), 1e9 + i, 0.1 * i], None) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 90
    rows = [(i, [1e6 * (i % 3), 1e5 + i, 0.1 * i * i], None) for i in range(30)]
    x = np.array([[math.floor(1024 * c) for c in r[1]] for r in rows], object) + 100_000
    off = 30 * x - x.sum(axis=0)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {r[0]: int((o * o).sum()) for r, o in zip(rows, off, strict=True)}


def plain_codes(rows, width, entries=256, parts=4, rounds=4):
    rows = sorted(kept(rows, width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    each = -(-width // parts)
    x = [whole(r[1]) + [0] * (each * parts - width) for r in rows]
    books = [[v[p * each : (p + 1) * each] for v in x[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in x:
            own = []
            for p, b in enumerate(books):
                near = [sum((a - c) ** 2 for a, c in zip(v[p * each : (p + 1) * each], e, strict=True)) for e in b]
                own.append((near.index(min(near)), min(near)))
            out.append(own)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * each : (p + 1) * each] for v, f in zip(x, found, strict=True) if f[p][0] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    errors = [sum(d for _, d in f) for f in found]
    by = {}
    for r, e in zip(rows, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{k:02x}" for k, _ in f), e, by[r[2]], digest) for r, f, e in zip(rows, found, errors, strict=True))


def told(df):
    return sorted((str(r.vec_id), r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("n,width", [(330, 8), (100, 8), (300, 10)])
def test_codes(spark, n, width):
    rows = sample(n, width, seed=n)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", code string").repartition(4)
    assert told(codes.compress(frame)) == plain_codes(rows, width)


def test_codes_awkward(spark):
    rows = sample(60, 8) + AWKWARD + [(2, [0.25] * 8, 7), (2, [0.0] * 8, 7)]
    assert told(codes.compress(spark.createDataFrame(rows, SCHEMA))) == plain_codes(rows, 8)
    none = spark.createDataFrame([], SCHEMA)
    assert codes.compress(none).count() == 0 and codes.compress(none).dtypes == codes.compress(spark.createDataFrame(rows, SCHEMA)).dtypes
    large = [(i, [1e15 * (i % 5), 3.0 * i, 1e9 * i, -1e12 * i], i % 2) for i in range(40)]
    assert len(told(codes.compress(spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")))) == 40


def test_codes_query(spark, sf):
    x = {r.vec_id: r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(x)
    v = np.array([whole(x[i].embedding) for i in ids])
    books = [v[:256, p * 16 : (p + 1) * 16].copy() for p in range(4)]
    for r in range(5):
        near = [((v[:, None, p * 16 : (p + 1) * 16] - books[p][None]) ** 2).sum(axis=2) for p in range(4)]
        if r < 4:
            for p in range(4):
                own = near[p].argmin(axis=1)
                for k in np.unique(own):
                    books[p][k] = v[own == k, p * 16 : (p + 1) * 16].sum(axis=0) // (own == k).sum()
    got = {r.vec_id: r for r in queries.op13_vector_codes(spark, sf).collect()}
    assert [got[i].code for i in ids] == ["".join(f"{near[p][at].argmin():02x}" for p in range(4)) for at in range(len(ids))]
    assert [got[i].error for i in ids] == [int(sum(near[p][at].min() for p in range(4))) for at in range(len(ids))]


def test_candidates_hold_the_nearest():
    rng = np.random.default_rng(4)
    for n, width in ((1, 1), (64, 3), (65, 5), (256, 16)):
        book = codes.Codebook(rng.integers(-9, 9, (n, width)))
        parts = rng.integers(-12, 12, (500, width))
        far = ((parts[:, None] - book.entries[None]) ** 2).sum(axis=2)
        index, distance = book.nearest(parts)
        assert (index == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
        masks = book.candidates(parts, book.radius(parts))
        assert np.bitwise_count(masks).sum() <= 500 * n


def test_widths(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, [2.0]), (4, [3.0, 1.0]), (5, [])]
    frame, width = vectors.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert width == 2 and sorted(r.vec_id for r in frame.collect()) == [1, 4]
