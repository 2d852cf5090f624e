"""Whitening and top-k against dense linear algebra and brute force."""

import math

import numpy as np
import pytest

from conftest import SF_DIR
from posture.llm import topk, whitening

SCHEMA = "vec_id bigint, embedding array<float>, row int, x string, block int, n string"


def write(spark, tmp_path, vectors, schema=SCHEMA, parts=3):
    rows = [(i, v, 1, "x", 2, "n") for i, v in vectors]
    frame = spark.createDataFrame(rows, schema).repartition(parts)
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def given(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return [(r[0], r[1]) for r in rows.collect()]


def whole(vectors, scale):
    """(id, whole numbers) of the vectors that take part, of equal length."""
    sound = [
        (i, [math.floor(scale * c) for c in v])
        for i, v in vectors
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    size = max([len(v) for _, v in sound], default=0)
    return [(i, v + [0] * (size - len(v))) for i, v in sound]


def awkward(seed, n=300, size=7, scale=1.0):
    rng = np.random.default_rng(seed)
    found = [
        (i, (scale * rng.standard_normal(size)).astype(np.float32).tolist()) for i in range(n)
    ]
    copies = [(n + i, found[3][1]) for i in range(n // 2)]
    odd = [
        (None, found[5][1]), (50, found[7][1]), (50, found[7][1]), (9001, None), (9050, None),
        (9002, [None] * size), (9100, [float("nan")] * size), (9003, [float("inf")] * size),
        (9150, [0.5, -0.25]), (9200, []), (9004, [0.0] * size), (-50, found[9][1]),
    ]
    return found + copies + odd


# --- top-k ---------------------------------------------------------------------------------


def expected_top(vectors, top=topk.TOP):
    rows = whole(vectors, topk.SCALE)
    out = []
    for at, (i, q) in enumerate(rows):
        if i is None or i % topk.QUERY_EVERY:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v, strict=True)), (j is None, j or 0))
            for other, (j, v) in enumerate(rows)
            if other != at
        )
        for rank, (score, (none, j)) in enumerate(scored[:top], 1):
            out.append((i, rank, None if none else j, -score))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("entries", [1 << 19, 700])
@pytest.mark.parametrize("scale", [1.0, 8_000.0])
def test_top_k_of_awkward_vectors(spark, tmp_path, entries, scale):
    vectors = awkward(1, scale=scale)
    sf_dir = write(spark, tmp_path, vectors)
    found = topk.top_k(
        topk.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        topk.F.col("vec_id") % topk.QUERY_EVERY == 0,
        block_entries=entries,
    )
    assert rows_of(found.select("query_id", "rank", "vec_id", "score")) == expected_top(vectors)


def test_top_k_of_few_and_no_vectors(spark, tmp_path):
    few = write(spark, tmp_path / "few", [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (100, [2.0, 0.0])])
    assert rows_of(topk.op12_exact_top_k(spark, few)) == expected_top(given(spark, few))
    none = write(spark, tmp_path / "none", [])
    assert rows_of(topk.op12_exact_top_k(spark, none)) == []


def test_top_k_of_given_vectors(spark):
    assert rows_of(topk.op12_exact_top_k(spark, SF_DIR)) == expected_top(given(spark, SF_DIR))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_bounds_hold_at_every_depth(n):
    rng = np.random.default_rng(n)
    values = rng.integers(-9, 9, (n, 4))
    lists = topk.Lists(values, np.float64)
    for depth in topk.DEPTHS:
        low, high = lists.at(depth)
        assert (low <= values).all() and (values <= high).all()
        read = int(n * depth) if depth < 0.5 else n
        assert (low == high).sum() >= 4 * min(n, 2 * read)
    assert (low == high).all()


def test_products_beyond_doubles():
    rng = np.random.default_rng(4)
    values = rng.integers(-(1 << 24), 1 << 24, (200, 64))
    found = topk.Block(list(range(200)), np.arange(200), values).best(values[:3], np.arange(3), 2)
    for query in range(3):
        exact = sorted((-sum(map(int.__mul__, values[query].tolist(), v)), i)
                       for i, v in enumerate(values.tolist()) if i != query)[:2]
        assert [(i, -s) for s, i in exact] == [(i, s) for q, i, s in found if q == query]


def test_reading_stops_early():
    """Candidates far from all others are found without reading the lists to their middle."""
    rng = np.random.default_rng(3)
    values = rng.integers(-10, 10, (4000, 16))
    values[:20] = 400
    block = topk.Block(list(range(4000)), np.arange(4000), values)
    found = block.best(np.full((3, 16), 5), np.array([-1, -1, -1]), 5)
    assert [i for _, i, _ in found] == [0, 1, 2, 3, 4] * 3
    (lists,) = block.lists.values()
    assert max(lists.bounds) < 0.5


# --- whitening -----------------------------------------------------------------------------


def dense(vectors):
    """Rows, centre and eigenpairs by a dense solver."""
    rows = [(i, [c + whitening.SHIFT for c in v]) for i, v in whole(vectors, whitening.SCALE)]
    fit = sorted({tuple(v) for _, v in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    near = np.array([[c * n - s for c, s in zip(v, sums, strict=True)] for v in fit], dtype=float) / n
    covariance = near.T @ near / n
    values, turn = np.linalg.eigh(covariance)
    return rows, n, sums, values[::-1], turn[:, ::-1], covariance


def check_whitened(vectors, frame, close=1e-8):
    rows, n, sums, values, turn, covariance = dense(vectors)
    k = min(whitening.COMPONENTS, int((values > 1e-10 * values[0]).sum()))
    found = frame.collect()
    assert len(found) == k * len(rows)
    assert {r["n"] for r in found} == {n}
    deviation = sorted(
        (i is None, i or 0, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)))
        for i, v in rows
    )
    got = [(r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in found]
    assert sorted(got) == sorted(d for d in deviation for _ in range(k))
    explained = {r["component"]: r["explained"] for r in found}
    assert sorted(explained) == list(range(1, k + 1))
    for j, share in explained.items():
        assert share == pytest.approx(values[j - 1] / np.trace(covariance), rel=1e-9)
    assert found[0]["identity_error"] < 1e-9
    for j in range(1, k + 1):
        gap = min([abs(values[j - 1] - values[m]) for m in range(len(values)) if m != j - 1], default=1)
        if gap < 1e-3 * values[0]:
            continue
        near = np.array([[float(c * n - s) / n for c, s in zip(v, sums, strict=True)] for _, v in rows])
        own = near @ turn[:, j - 1] / np.sqrt(values[j - 1])

        def by_row(ids, numbers):
            return np.array(sorted((i is None, i or 0, x) for i, x in zip(ids, numbers, strict=True)))

        got = by_row(*zip(*((r["vec_id"], r["whitened"]) for r in found if r["component"] == j), strict=True))
        ids = [i for i, _ in rows]
        assert min(np.abs(got - by_row(ids, sign * own)).max() for sign in (1, -1)) < close


def test_whitening_of_given_vectors(spark):
    check_whitened(given(spark, SF_DIR), whitening.op11_embedding_whitening(spark, SF_DIR))


@pytest.mark.parametrize("size", [2, 7, 20])
def test_whitening_of_awkward_vectors(spark, tmp_path, size):
    vectors = awkward(2, n=120, size=size)
    sf_dir = write(spark, tmp_path, vectors)
    check_whitened(vectors, whitening.op11_embedding_whitening(spark, sf_dir))


@pytest.mark.parametrize("vectors", [[], [(1, [0.1, 0.2])], [(1, [])], [(1, [0.1]), (2, [0.1])], [(5, None)]])
def test_whitening_without_components(spark, tmp_path, vectors):
    sf_dir = write(spark, tmp_path, vectors)
    assert whitening.op11_embedding_whitening(spark, sf_dir).collect() == []


def test_deviations_beyond_a_long():
    centre = whitening.Centre(3, [10, 20])
    x = np.array([[5, 7], [1 << 40, 3]], dtype=np.int64)
    assert centre.deviations(x) == [(15 - 10) ** 2 + (21 - 20) ** 2, None]


@pytest.mark.parametrize("size, wanted", [(5, 5), (40, 3), (120, 4), (300, 16)])
def test_jacobi_davidson_against_a_dense_solver(size, wanted):
    rng = np.random.default_rng(size)
    rows = rng.standard_normal((4 * size, size)) * np.linspace(1, 3, size)
    matrix = rows.T @ rows / len(rows)
    calls = []

    def product(w):
        calls.append(w.shape[1])
        return matrix @ w

    values, vectors = whitening.jacobi_davidson(product, size, wanted)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:wanted], rtol=1e-13)
    residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
    assert residual.max() < 1e-13 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-13
    print(size, wanted, len(calls))
