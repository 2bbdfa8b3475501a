"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors again and again: a random direction, a threshold at the median of the projections, and a spill:
vectors within SPILL of the threshold go to both sides. Vectors that share a leaf in some tree are compared exactly.
Two vectors at the required cosine are separated in all TREES trees about once in a million times.

What travels to the leaves is a vector's id and a sketch of a few bytes: its projection on SKETCH directions in 8 bits each. Projections of two vectors
are no further apart than the vectors, so a leaf can tell for certain which of its vectors are too far from all others there. Only the rest,
those that may have a link, are brought to their leaves as they are.

Thresholds are fitted on a bounded sample; every vector is put into leaves. The trees are as deep as the number of vectors asks for:
where a node's part of the sample is too small for another median, deeper thresholds come from the sample of the last node above that
was large enough. Leaves that stay large are compared block against block, so no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from planloom.llm.components import components
from planloom.llm.storage import saved

TREES = 7
# Vectors of a leaf, roughly; the depth follows from it.
LEAF = 96
# Half the width of the band around a threshold that goes to both sides, in units of the largest distance of linked unit vectors
# divided by the root of the dimension, the scale of their projections' differences.
SPILL = 0.6
# Rows of the sample that thresholds are fitted on, and the fewest that give a median.
SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
NODE_SAMPLE = 48
# Dimensions of a sketch.
SKETCH = 16
# Vectors of a block; a task compares two at a time.
BLOCK = 512
# Rows of a record batch that a task sends.
ROWS = 1 << 15


class Forest:
    """The trees for vectors of one dimension: directions and thresholds."""

    def __init__(self, sample: np.ndarray, dimension: int, depth: int, cosine: float, seed: int = 11):
        self.depth = depth
        self.margin = SPILL * np.sqrt(max(0.0, 2 - 2 * cosine) / dimension)
        random = np.random.default_rng(seed + dimension)
        directions = random.standard_normal((TREES, max(depth, 1), dimension))
        self.directions = directions / np.linalg.norm(directions, axis=2, keepdims=True)
        self.sketched = np.linalg.qr(random.standard_normal((dimension, min(SKETCH, dimension))))[0]
        # thresholds[tree][level] is by path; deeper paths than it has entries for use their beginning.
        self.thresholds = [self._fitted(sample @ self.directions[tree].T) for tree in range(TREES)]

    def _fitted(self, projections: np.ndarray) -> list[np.ndarray]:
        paths = np.zeros(len(projections), dtype=np.int64)
        bits, levels = 0, []
        for level in range(self.depth):
            values = projections[:, level]
            medians = pd.Series(values).groupby(paths).median().reindex(range(1 << bits), fill_value=0.0)
            thresholds = medians.to_numpy()
            levels.append(thresholds)
            if len(projections) >> (bits + 1) >= NODE_SAMPLE:
                paths = paths * 2 + (values > thresholds[paths])
                bits += 1
        return levels

    def sketches(self, vectors: np.ndarray) -> np.ndarray:
        """Projections of unit vectors on fixed directions, as SKETCH bytes each; missing dimensions are 0."""
        result = np.zeros((len(vectors), SKETCH), dtype=np.int8)
        result[:, : self.sketched.shape[1]] = np.rint(vectors @ self.sketched * 127)
        return result

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, path) of each leaf of each of the unit vectors."""
        rows, trees, paths = [], [], []
        for tree in range(TREES):
            projections = vectors @ self.directions[tree].T
            row, path = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
            for level, thresholds in enumerate(self.thresholds[tree]):
                known = path >> max(0, level - (len(thresholds).bit_length() - 1))
                distance = projections[row, level] - thresholds[known]
                low, high = distance <= self.margin, distance > -self.margin
                row = np.concatenate([row[low], row[high]])
                path = np.concatenate([path[low] * 2, path[high] * 2 + 1])
            rows.append(row)
            trees.append(np.full(len(row), tree))
            paths.append(path)
        return np.concatenate(rows), np.concatenate(trees), np.concatenate(paths)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, by their largest component first so that nothing overflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _indexed(batches: Iterator[pa.RecordBatch], forests: dict[int, Forest]) -> Iterator[pa.RecordBatch]:
    """(rep, label, sketch, leaf) once for each leaf of each vector."""
    for batch in batches:
        lists = batch.column("embedding")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        for dimension in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dimension))
            vectors = _matrix(part.column("embedding"), int(dimension))
            unit, forest = _unit(vectors), forests[int(dimension)]
            row, tree, path = forest.leaves(unit)
            # Dimension, tree and path in one number; a leaf belongs to one label as well.
            leaf = (int(dimension) * TREES + tree) * (1 << 40) + path
            data = np.ascontiguousarray(forest.sketches(unit))
            bounds = pa.py_buffer(np.arange(0, data.size + 1, SKETCH, dtype=np.int32))
            sketches = pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, bounds, pa.py_buffer(data)])
            for start in range(0, len(row), ROWS):
                taken = pa.array(row[start : start + ROWS])
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep").take(taken), part.column("label").take(taken), sketches.take(taken), pa.array(leaf[start : start + ROWS])],
                    ["rep", "label", "sketch", "leaf"],
                )


def _matrix(lists: pa.Array, dimension: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _hopeful(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """The vectors of a pair of blocks of a leaf whose sketch is near another one's: none that has a link there is missing."""
    first, second = int(group["x"].iloc[0]), int(group["y"].iloc[0])
    sketches = np.frombuffer(b"".join(group["sketch"]), dtype=np.int8).reshape(-1, SKETCH).astype(np.float32)
    # Rounding moves each coordinate by half a unit at most.
    reach = 127 * np.sqrt(max(0.0, 2 - 2 * cosine)) + np.sqrt(SKETCH) + 0.01
    block = group["block"].to_numpy()
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    squares = (sketches * sketches).sum(axis=1)
    near = squares[left][:, None] + squares[right] - 2 * sketches[left] @ sketches[right].T <= reach * reach
    if first == second:
        np.fill_diagonal(near, False)
    found = np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])
    return group.iloc[found][["rep", "label", "leaf"]]


LINKED = "rep long, n_links long, linked long"


def _compared(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """For one pair of blocks of a leaf: each vector's links that no earlier shared leaf has, and a spanning set of them.

    Links to the same smallest vector connect what the links here connect: each row names the smallest vector that its
    links reach within these blocks.
    """
    first, second = int(group["x"].iloc[0]), int(group["y"].iloc[0])
    group = group.sort_values("rep", kind="stable")
    leaf = int(group["leaf"].iloc[0])
    unit = _unit(np.array(group["embedding"].tolist(), dtype=np.float64))
    rep, copies, block = (group[name].to_numpy() for name in ("rep", "copies", "block"))
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    similar = unit[left] @ unit[right].T >= cosine
    a, b = np.nonzero(similar)
    a, b = left[a], right[b]
    distinct = a < b if first == second else a != b
    a, b = a[distinct], b[distinct]
    # Leaves are sorted, so the first shared one is the same wherever the pair meets.
    leaves = [set(x.tolist()) for x in group["leaves"]]
    here = np.fromiter((min(leaves[i] & leaves[j]) == leaf for i, j in zip(a, b, strict=True)), bool, len(a))
    a, b = a[here], b[here]
    links = np.zeros(len(rep), dtype=np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    root = np.arange(len(rep))
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    used = links > 0
    return pd.DataFrame({"rep": rep[used], "n_links": links[used], "linked": rep[root[used]]})


def linked_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `vectors` (vec_id, embedding, label).

    Only vectors with equal labels that are not null and of equal length are compared, by cosine in double precision;
    links have at least `cosine`. n_links counts the other rows linked directly, component_id is the smallest
    vec_id that links reach, kept marks the row it belongs to. Vectors that are null, empty, all zeros, or hold null or non-finite
    components link with nothing, as do those without label. Equal vectors of a label are one class and are compared once; each
    counts the others of its class. Repeated rows are such copies, and rows that share a vec_id are one vector with
    several forms, each with its own row. Rows with a null vec_id link with nothing, component_id null, kept true.
    Other columns are ignored.

    n_links and components come from links counted within leaves; no list of pairs is ever made.
    """
    sound = F.expr(
        "vec_id is not null and label is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )
    kind = "array<float>" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), F.col("label").cast("long"))
    # Two hashes of 64 bits tell a class.
    keys = [F.xxhash64("label", "embedding").alias("one"), F.xxhash64("embedding", "label", F.lit(1)).alias("other")]
    classes = saved(
        vectors.where(sound).select("*", *keys).groupBy("one", "other")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")),
        "embedding-classes",
    )
    forests = _forests(classes, cosine)
    indexed = classes.select("rep", "label", "embedding").mapInArrow(
        lambda batches: _indexed(batches, forests), "rep long, label long, sketch binary, leaf long"
    )
    hopeful = _in_blocks(indexed, ["rep", "label", "sketch", "leaf"], lambda group: _hopeful(group, cosine), "rep long, label long, leaf long")
    hopeful = saved(hopeful.distinct(), "embedding-leaves")
    leaves = hopeful.groupBy("rep", "label").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    # A vec_id may have several vectors, even of one label: their leaves are taken together.
    rows = classes.join(leaves, ["rep", "label"]).select("rep", "copies", "label", "embedding", "leaves", F.explode("leaves").alias("leaf"))
    found = _in_blocks(
        rows, ["rep", "copies", "label", "leaf", "embedding", "leaves"], lambda group: _compared(group, cosine), LINKED, hopeful
    )
    found = saved(found, "embedding-links")
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("links"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("linked").alias("b")))
    named = (
        classes.select("one", "other", "rep", "copies").join(counts, "rep", "left")
        .join(reached.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "one",
            "other",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    # Rows that link with nothing have no class.
    own = [F.when(sound, key).alias(name) for key, name in zip(keys, ("one", "other"), strict=True)]
    return vectors.select("vec_id", *own).join(named, ["one", "other"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _forests(classes: DataFrame, cosine: float) -> dict[int, Forest]:
    """A forest for each dimension, fitted on the SAMPLE vectors whose ids hash lowest, fewer if they take more than SAMPLE_BYTES."""
    sizes = classes.groupBy(F.size("embedding").alias("dimension"), "label").count()
    largest = sizes.groupBy("dimension").agg(F.max("count").alias("n")).collect()
    # Bounded in bytes as well: longer vectors are fewer.
    widest = max((dimension for dimension, _ in largest), default=1)
    count = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * widest)))
    order = F.xxhash64("rep")
    sample = classes.select("embedding", order.alias("o")).orderBy("o").limit(count).toArrow()["embedding"].combine_chunks()
    sizes = pc.list_value_length(sample).to_numpy(zero_copy_only=False)
    forests = {}
    for dimension, n in largest:
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        vectors = _matrix(sample.filter(pa.array(sizes == dimension)), dimension)
        forests[dimension] = Forest(_unit(vectors) if len(vectors) else vectors, dimension, depth, cosine)
    return forests


def _in_blocks(
    rows: DataFrame, columns: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], kinds: str, counted: DataFrame | None = None
) -> DataFrame:
    """`work` on each leaf; leaves of more than BLOCK vectors are dealt in pairs of blocks x <= y. `counted` has the leaves' rows, if cheaper."""
    large = (rows if counted is None else counted).groupBy("label", "leaf")
    large = large.agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many")).where("many > 1")
    large = saved(large, "embedding-large-leaves")
    dealt = rows.join(large, ["label", "leaf"], "left").withColumn("blocks", F.coalesce("many", F.lit(1)))
    dealt = dealt.withColumn("block", F.expr("pmod(xxhash64(rep), blocks)").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select(*columns, "block", other).select(
        *columns, "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")
    )
    # Dealt out anew, since the join may have left all blocks of a leaf in one partition.
    pairs = pairs.repartition("label", "leaf", "x", "y")
    return pairs.groupBy("label", "leaf", "x", "y").applyInPandas(work, kinds)
