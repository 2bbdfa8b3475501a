"""Whitening against plain numpy on whole lists, and eigenvectors against their definition."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from corpus_tables import rows_of

from planloom.llm.queries import QUERIES
from planloom.llm.whitening import eigenvectors, whitened_vectors

QUERY = "op12_embedding_whitening"


def rotation(size, seed):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]


@pytest.mark.parametrize(
    "values",
    [
        [5, 4, 3, 2, 1, 0.5],
        [1, 1 + 1e-9, 1 + 2e-9, 0.3, 0.3 + 1e-12, 1e-6],
        [2, 2, 2, 1, 1, 0],
        [1, 1 + 1e-7, 1 - 1e-7, 1 + 3e-8, 0.5, 0.25],
        [1e30, 1e29, 3e28, 1e20, 5.0, 1.0],
        [1, 0, 0, 0, 0, 0],
    ],
)
@pytest.mark.parametrize("seed", [1, 2])
def test_eigenvectors_by_definition(values, seed):
    q = rotation(len(values), seed)
    matrix = q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, x = eigenvectors(matrix)
    top, tiny = max(values), 1e-14
    assert np.all(np.diff(found) <= 0)
    assert np.abs(found - np.sort(values)[::-1]).max() <= tiny * top
    assert np.abs(x.T @ x - np.eye(len(values))).max() <= tiny
    assert np.abs(matrix @ x - x * found).max() <= tiny * top
    wide, vectors = matrix.astype(np.longdouble), x.astype(np.longdouble)
    # Far from other eigenvalues the vectors themselves are right to double precision.
    exact = np.linalg.eigh(matrix)[1][:, ::-1]
    for k in range(len(values)):
        if np.abs(np.delete(found, k) - found[k]).min() > 0.05 * top:
            assert min(np.abs(x[:, k] - exact[:, k]).max(), np.abs(x[:, k] + exact[:, k]).max()) < 1e-14
            assert np.abs(wide @ vectors[:, k] - found[k] * vectors[:, k]).max() < 4e-16 * top


def test_odd_matrices():
    assert eigenvectors(np.zeros((0, 0)))[0].shape == (0,)
    values, x = eigenvectors(np.zeros((3, 3)))
    assert values.tolist() == [0, 0, 0] and np.array_equal(x, np.eye(3))
    assert eigenvectors(np.array([[7.0]]))[1].tolist() == [[1.0]]
    values, x = eigenvectors(np.eye(40))
    assert np.abs(values - 1).max() < 1e-15 and np.abs(x.T @ x - np.eye(40)).max() < 1e-15


def test_large_matrix_with_clusters():
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(30, 3.0), 3 + rng.normal(size=20) * 1e-8, rng.uniform(0, 1, 60)])
    q = rotation(len(values), 3)
    matrix = q @ np.diag(values) @ q.T
    found, x = eigenvectors((matrix + matrix.T) / 2)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-13
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14
    assert np.abs(matrix @ x - x * found).max() < 1e-13


def plain(rows, components=4, scale=256):
    """The contract over lists, with Python's integers and a double-precision solver."""
    kept = [
        (key, [math.floor(scale * c) for c in vector])
        for key, vector in rows
        if vector is not None and all(c is not None and math.isfinite(c) for c in vector)
    ]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(key, tuple(v) + (0,) * (width - len(v))) for key, v in kept]
    fit = sorted({v for _, v in kept})
    if not fit or not width:
        return []
    n, sums = len(fit), [sum(column) for column in zip(*fit, strict=True)]
    centred = np.array([[(n * x - s) / n for x, s in zip(v, sums, strict=True)] for v in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, int((values > values[0] * 1e-12).sum())) if values[0] > 0 else 0
    result = []
    for key, v in kept:
        deviation = [n * x - s for x, s in zip(v, sums, strict=True)]
        z = np.array([d / n for d in deviation]) @ vectors[:, :count] / np.sqrt(values[:count])
        for k in range(count):
            result.append((key, k + 1, n, sum(d * d for d in deviation), z[k], values[k] / covariance.trace()))
    return result


def check(found, wanted, near=1e-7):
    """Same rows, up to one sign for each component."""
    order = lambda row: (repr(row[0]), row[1], row[3], abs(row[4]))
    rows = sorted((tuple(row.values()) for row in found), key=order)
    wanted = sorted(wanted, key=order)
    assert [row[:3] for row in rows] == [row[:3] for row in wanted]
    signs = {}
    for row, other in zip(rows, wanted, strict=True):
        assert int(row[7]) == other[3] and row[3] == (other[3] if other[3] < 2**63 else None)
        assert abs(abs(row[4]) - abs(other[4])) < near and abs(row[5] - other[5]) < near
        assert row[6] <= 1e-4
        if abs(other[4]) > 1e-6:
            signs.setdefault(row[1], set()).add(np.sign(row[4]) == np.sign(other[4]))
    assert all(len(found) == 1 for found in signs.values())


def vectors(seed, count, width, spread):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(count, width)) * spread
    return [(n, row.astype(np.float32).tolist()) for n, row in enumerate(base)]


def frame_of(spark, rows, kind="float"):
    full = [(key, vector, 3, "own", 7) for key, vector in rows]
    return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, n int, packed string, component int").repartition(6)


def test_equals_plain_numpy(spark):
    rows = vectors(1, 400, 7, [3, 2, 1.5, 1, 0.5, 0.2, 0.1])
    nan, inf = float("nan"), float("inf")
    rows += [(900 + n, rows[n % 3][1]) for n in range(200)] + [rows[5], rows[5], (None, rows[7][1]), (None, rows[7][1])]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 5), (2002, [nan] * 7), (2003, [inf] + [0.0] * 6), (2004, [-inf] * 7)]
    rows += [(2005, []), (2006, [1.0, 2.0]), (2007, [1.0, 2.0] + [0.0] * 5), (2008, [-0.0] * 7)]
    found = rows_of(whitened_vectors(frame_of(spark, rows)))
    check(found, plain(rows))
    assert {row["component"] for row in found} == {1, 2, 3, 4} and {row["vec_id"] for row in found} >= {None, 2005, 2006}


def test_fewer_components(spark):
    line = [(n, [float(n), 2.0 * n, 0.0]) for n in range(20)]
    found = rows_of(whitened_vectors(frame_of(spark, line)))
    assert {row["component"] for row in found} == {1}
    check(found, plain(line))
    check(rows_of(whitened_vectors(frame_of(spark, vectors(2, 50, 3, 1.0)), components=2)), plain(vectors(2, 50, 3, 1.0), 2))
    for rows in ([(1, [1.0, 2.0])] * 5, [(1, None)], [(1, []), (2, [0.0])]):
        assert rows_of(whitened_vectors(frame_of(spark, rows))) == []


def test_deviations_beyond_64_bits(spark):
    rows = [(n, [float(2**40 * n + n * n), float(n % 7) * 2.0**38]) for n in range(60)]
    found = rows_of(whitened_vectors(frame_of(spark, rows, "double")))
    check(found, plain(rows))
    assert any(row["deviation"] is None for row in found)
    huge = [(n, [1e300 * (n - 2), float(n)]) for n in range(5)]
    found = rows_of(whitened_vectors(frame_of(spark, huge, "double")))
    # Beside entries of 2**63 the second dimension is beyond double precision.
    assert len(found) == 5 and all(math.isfinite(row["whitened"]) for row in found)


def test_query(spark):
    place = "/root/testdata/sf0.001"
    rows = [(row["vec_id"], row["embedding"]) for row in pq.read_table(f"{place}/embeddings.parquet").to_pylist()]
    check(rows_of(QUERIES[QUERY](spark, place)), plain(rows))


def test_empty_table(spark, tmp_path):
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    pq.write_table(schema.empty_table(), tmp_path / "embeddings.parquet")
    assert rows_of(QUERIES[QUERY](spark, str(tmp_path))) == []
