"""Near-duplicate vectors against brute force: recall, counts, components and odd vectors."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from corpus_tables import rows_of

from planloom.llm import embeddings
from planloom.llm.embeddings import Forest, linked_vectors
from planloom.llm.queries import QUERIES

VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])


def expected(rows, cosine=0.98):
    sound = [
        (i, np.array(e, dtype=np.float64), l) for i, e, l in rows
        if i is not None and l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
    ]
    links, root = [0] * len(sound), {i: i for i, _, _ in sound}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a, label) in enumerate(sound):
        for m, (j, b, other) in enumerate(sound[:n]):
            if label == other and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[n] += 1
                links[m] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    out = [(i, n, find(i), find(i) == i) for (i, _, _), n in zip(sound, links, strict=True)]
    left = len(rows) - len(sound)
    return out, left


def write(path, rows):
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), VECTORS, strict=True)], VECTORS)
    pq.write_table(table.append_column("rep", pa.array(["own"] * len(rows))), path / "embeddings.parquet")
    return str(path)


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(24)
    rows = [(n, (base + 0.11 * rng.standard_normal(24)).tolist(), n % 2) for n in range(40)]
    rows += [(100 + n, rng.standard_normal(24).tolist(), 0) for n in range(40)]
    rows += [(200 + n, base.tolist(), 0) for n in range(5)] + [(300, (3 * base).tolist(), 0), (301, (-base).tolist(), 0)]
    rows += [(302, (1e-30 * base).tolist(), 0), (303, (1e30 * base).tolist(), 0)]
    rows += [(400, base[:8].tolist(), 0), (401, base[:8].tolist(), 0), (402, [2.0], 0), (403, [5.0], 0), (404, [-1.0], 0)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    rows += [(500 + n, v, 0) for n, v in enumerate(odd * 2)] + [(600, base.tolist(), None), (601, base.tolist(), None)]
    rows += [(None, base.tolist(), 0), (200, base.tolist(), 0)]
    found = rows_of(QUERIES["op9_embedding_near_dedup"](spark, write(tmp_path, rows)))
    wanted, left = expected(rows)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found), key=repr)
    single = [(i, 0, i, True) for i, e, l in rows if l is None or i is None or not e or not np.isfinite([x or np.nan if x != 0 else 0 for x in e]).all() or not any(e)]
    assert len(single) == left and got == sorted(wanted + single, key=repr)


@pytest.mark.parametrize("block", [512, 16])
def test_dense_groups_and_block_pairs(spark, monkeypatch, block):
    """A group denser than the spill, so that leaves stay large and are compared in blocks."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    rows = [(n, (base + 0.12 * rng.standard_normal(64)).tolist(), 1) for n in range(160)]
    rows += [(1000 + n, rng.standard_normal(64).tolist(), 1) for n in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows_of(linked_vectors(frame)))
    assert found == sorted(expected(rows)[0])


def test_recall_of_pairs_at_the_limit():
    """Pairs at a cosine of just 0.98 share a leaf, also in trees deeper than their sample."""
    rng = np.random.default_rng(5)
    first = rng.standard_normal((1500, 64))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    other = rng.standard_normal((1500, 64))
    other -= (other * first).sum(axis=1, keepdims=True) * first
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    second = 0.9801 * first + np.sqrt(1 - 0.9801**2) * other
    forest = Forest(first, 64, 11, 0.98)

    def leaves(vectors):
        out = [set() for _ in vectors]
        for row, tree, path in zip(*forest.leaves(vectors), strict=True):
            out[row].add((tree, path))
        return out

    one, two = leaves(first), leaves(second)
    assert np.mean([bool(a & b) for a, b in zip(one, two, strict=True)]) > 0.999
    assert np.mean([len(a) for a in one]) < 8 * embeddings.TREES


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert rows_of(linked_vectors(empty)) == []
