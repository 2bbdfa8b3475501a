"""Near-duplicate documents by SuperMinHash signatures, banding, verification and components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.components import components
from planloom.llm.storage import saved
from planloom.llm.words import LOWER, byte_rows, mixed, parts, shingles, word_hashes

# Signature positions: a prime, so that the multiples of any step visit every position once.
POSITIONS = 241
# Rows of a band. 40 bands of 6 miss a pair of similarity 0.8 once in 190,000 times.
BAND_ROWS = 6
BANDS = POSITIONS // BAND_ROWS
# Bands take positions from a fixed shuffle: one element's best positions lie at equal distances.
BAND_POSITIONS = np.random.default_rng(7).permutation(POSITIONS)[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
# Rounds in which a bucket's members outside the component of a member picked at random are compared with that one.
HUB_ROUNDS = 2
# Groups of more members are compared in blocks of about BLOCK members and at most about BLOCK_ELEMENTS elements in all.
SMALL = 16
BLOCK = 256
BLOCK_ELEMENTS = 500_000
# Values hold the rank in the top byte, so a lower rank always wins.
RANK_SHIFT = np.uint64(56)
UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def signature(elements: np.ndarray) -> np.ndarray:
    """SuperMinHash of a set of distinct 64-bit hashes: POSITIONS values.

    Each element ranks the positions by a permutation of its own and offers each the value
    rank + fraction; a position keeps its least offer. The ranks of one element all differ, so
    one element can't win two positions with rank 0, which lowers the variance against
    independent hashes. The permutations are x -> start + step * rank modulo a prime: any two
    positions get any two ranks equally often, as in a random permutation, and the variance
    depends on pairs only. Ranks are offered in order and end as soon as every position
    holds a value below the next rank; large sets need rank 0 alone.
    """
    best = np.full(POSITIONS, UNSET)
    if len(elements) == 0:
        return best
    prime = np.uint64(POSITIONS)
    start, step = elements % prime, mixed(elements) % (prime - np.uint64(1)) + np.uint64(1)
    rank = 0
    while rank < POSITIONS:
        upto = min(POSITIONS, rank + 1 + (2 * POSITIONS if rank or len(elements) < POSITIONS else 0) // len(elements))
        ranks = np.arange(rank, upto, dtype=np.uint64)[:, None]
        places = (start + step * ranks) % prime
        offers = (ranks << RANK_SHIFT) | (mixed(elements + ranks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8))
        np.minimum.at(best, places.ravel().astype(np.intp), offers.ravel())
        rank = upto
        if (best >> RANK_SHIFT).max() < rank:
            break
    return best


def band_keys(elements: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; sets that agree in a band share its key."""
    rows = signature(elements)[BAND_POSITIONS]
    keys = np.arange(BANDS, dtype=np.uint64)
    for place in range(BAND_ROWS):
        keys = mixed(keys * np.uint64(BANDS + 1) + rows[:, place])
    return keys.view(np.int64)


def _elements(data: np.ndarray, width: int) -> np.ndarray:
    return shingles(word_hashes(LOWER[data]), width)


def _features(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        sizes, digests, keys = [], [], []
        for data in byte_rows(batch.column("text")):
            elements = _elements(data, width)
            sizes.append(len(elements))
            digests.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest())
            keys.append(band_keys(elements) if len(elements) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "digest", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        sets = [_elements(data, width).view(np.int64) for data in byte_rows(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "elements"]
        )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (columns doc_id, text).

    A document's set holds its distinct runs of `width` words, letters A-Z lower-cased. Two documents
    are linked if 100 * intersection >= percent * union; component_id is the smallest doc_id that
    links reach. Documents with equal sets form one class and are handled as one. Classes that
    agree in a band are candidates: each bucket's members are compared with its smallest member. While members of a bucket are
    in several components, those outside the component of a member picked at random are compared with that member. In the
    end all that are still outside are compared with all members of other components, in blocks where
    there are many. So each pair of a bucket is compared or already connected, and no more pairs are listed than a
    few for each member.

    Null and empty texts and texts without words have no set, n_shingles 0, and link with nothing. Rows with
    a null doc_id link with nothing and have component_id null, kept true. Repeated rows each get their row. Rows
    that share a doc_id count as one document holding either text. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    features = saved(
        docs.mapInArrow(
            lambda batches: _features(batches, width),
            "doc_id long, n_shingles long, digest binary, bands array<long>",
        ),
        "minhash-features",
    )
    classes = features.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands")
    )
    classes = saved(classes, "minhash-classes")
    reached = _reached(docs, classes, width, percent)
    named = classes.select("digest", "rep").join(reached.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component")
    )
    return (
        features.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component")))
            .otherwise(F.col("doc_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _reached(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have links, by their smallest doc_ids."""
    banded = classes.select("rep", "size", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last")
    members = saved(banded.join(hubs.select("bucket", "hub"), "bucket"), "minhash-members")
    candidates = members.select("rep").distinct()
    texts = docs.join(candidates.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = texts.mapInArrow(lambda batches: _sets(batches, width), "doc_id long, elements array<long>")
    sets = saved(sets, "minhash-sets")

    pairs = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    reached = components(_verified(pairs, sets, percent))
    for number in range(HUB_ROUNDS + 1):
        parted = _parted(members, reached, number)
        known = reached.select(F.col("node").alias("a"), F.col("component").alias("b"))
        if number < HUB_ROUNDS:
            pairs = parted.where("component <> hub.component").where(
                f"100 * least(size, hub.size) >= {percent} * greatest(size, hub.size)"
            )
            pairs = pairs.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
            found = _verified(pairs, sets, percent)
        else:
            found = _rest(parted, sets, percent)
        reached = components(known.union(found))
    return reached


def _parted(members: DataFrame, reached: DataFrame, number: int) -> DataFrame:
    """The members of the buckets that hold several components, with each bucket's hub: a member picked by hash."""
    placed = members.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", "size", F.coalesce("component", "rep").alias("component")
    )
    # Most likely one of the bucket's largest component.
    picked = F.min(F.struct(F.xxhash64("rep", "bucket", F.lit(number)).alias("o"), "rep", "size", "component"))
    hubs = placed.groupBy("bucket").agg(picked.alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
    return saved(placed.join(hubs.where("low <> high").drop("low", "high"), "bucket"), "minhash-parted")


def _rest(parted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of everything that is still apart.

    Around the component of each bucket's hub, all its members and all others of its buckets make up a group: whoever is
    outside the component is compared with the whole group, which holds every pair of a bucket. Groups of
    up to SMALL members are compared by pairs. Larger ones are compared block against block, and only links come out.
    """
    rows = parted.select(F.col("hub.component").alias("main"), "rep", "size", "component").distinct()
    rows = rows.withColumn("outside", F.expr("component <> main"))
    groups = rows.groupBy("main").agg(
        F.count("*").alias("n"),
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).cast("int").alias("blocks"),
        F.count_if("outside").alias("outsiders"),
    )
    rows = saved(rows.join(groups, "main"), "minhash-rest")

    small = rows.where(f"n <= {SMALL}")
    asked = small.where("outside").select("main", F.struct("rep", "size", "component").alias("o"))
    pairs = (
        small.join(asked, "main")
        .where("component <> o.component and (not outside or rep < o.rep)")
        .where(f"100 * least(size, o.size) >= {percent} * greatest(size, o.size)")
        .select(F.least("rep", "o.rep").alias("a"), F.greatest("rep", "o.rep").alias("b"))
        .distinct()
    )

    large = rows.where(f"n > {SMALL}").withColumn("asking", F.ceil(F.col("outsiders") * F.col("blocks") / F.col("n")).cast("int"))
    place = F.xxhash64("rep")
    asking = large.where("outside").select(
        "main", "rep", "component", F.pmod(place, "asking").cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), F.lit(True).alias("asks"),
    )
    answering = large.select(
        "main", "rep", "component", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("x"),
        F.pmod(place, "blocks").cast("int").alias("y"), F.lit(False).alias("asks"),
    )
    dealt = asking.union(answering).join(sets.withColumnRenamed("doc_id", "rep"), "rep").repartition("main", "x", "y")
    links = dealt.groupBy("main", "x", "y").applyInPandas(lambda group: _block_links(group, percent), "a long, b long")
    return _verified(pairs, sets, percent).union(links.distinct())


def _block_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """For each asking row a link with one row of each other component that it is similar enough to."""
    asks = group["asks"].to_numpy()
    rep, component = group["rep"].to_numpy(), group["component"].to_numpy()
    elements = [np.asarray(x, dtype=np.int64) for x in group["elements"]]
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    sizes = np.array([len(x) for x in elements])
    common = _common([elements[n] for n in left], [elements[n] for n in right])
    linked = 100 * common >= percent * (sizes[left][:, None] + sizes[right] - common)
    linked &= component[left][:, None] != component[right]
    a, b = np.nonzero(linked)
    found = pd.DataFrame({"a": rep[left[a]], "b": rep[right[b]], "c": component[right[b]]})
    return found.groupby(["a", "c"], as_index=False)["b"].min()[["a", "b"]]


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not left or not right:
        return out.astype(np.int64)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for side in (left, right):
        values, rows = np.concatenate(side), np.repeat(np.arange(len(side)), [len(x) for x in side])
        columns = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        known = shared[columns] == values if len(shared) else np.zeros(len(values), dtype=bool)
        order = np.argsort(columns[known], kind="stable")
        sides.append((rows[known][order], columns[known][order], len(side)))
    # As products of 0/1 matrices, some columns at a time; counts stay exact in single precision below 2**24.
    width = 2048
    for start in range(0, len(shared), width):
        parts = []
        for rows, columns, count in sides:
            low, high = np.searchsorted(columns, (start, start + width))
            part = np.zeros((count, width), dtype=np.float32)
            part[rows[low:high], columns[low:high] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("a_set"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("b_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * common >= percent * (F.size("a_set") + F.size("b_set") - common))
        .select("a", "b")
        .distinct()
    )


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, with all their columns: one document of each group.

    Of repeated rows one stays; rows that share a doc_id but not a text all stay where their doc_id does. Rows
    with a null doc_id stay, but once for each text.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    kept = near_duplicates(docs, width, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("key")).distinct()
    # Rows without id are spread by their texts.
    rows = docs.select(
        F.struct("*").alias("doc"),
        doc_id.isNull().alias("unnamed"),
        F.coalesce(doc_id, F.xxhash64(text)).alias("key"),
        F.xxhash64(text).alias("text_hash"),
    )
    same = Window.partitionBy("key", "unnamed", "text_hash").orderBy(F.lit(0))
    return (
        rows.join(kept.withColumn("chosen", F.lit(True)), "key", "left")
        .where("unnamed or chosen")
        .withColumn("copy", F.row_number().over(same))
        .where("copy = 1")
        .select("doc.*")
    )
