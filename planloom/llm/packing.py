"""Packing documents into padded batches from optimal length buckets.

Documents of like length share a bucket and are padded to its upper bound. Dynamic programming over the histogram of all lengths finds the bounds
with the least padding. Inside each bucket, batches take as many documents as fit the token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.running import running_sums, sums_over_pieces
from planloom.llm.storage import saved


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds, a subset of the ascending `lengths`, of at most `buckets` buckets with the least padding in all.

    Padding of a bucket is the sum of its bound less the length over its documents, of which there are counts[i] with
    lengths[i]. Of equally good choices the one with fewer buckets is taken. All numbers are whole, so the result is exact.
    """
    size = len(lengths)
    if size == 0:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    count = np.append(0, np.cumsum(counts))
    total = np.append(0, np.cumsum(lengths * counts))
    # best[j]: least padding of the first j lengths; starts[k][j]: where the last of k + 1 buckets begins.
    best = lengths[np.maximum(np.arange(size + 1) - 1, 0)] * count - total
    starts, reached = [np.zeros(size + 1, dtype=np.int64)], [best[size]]
    for _ in range(min(buckets, size) - 1):
        best, start = _one_bucket_more(best, lengths, count, total)
        starts.append(start)
        reached.append(best[size])
    end, bounds = size, []
    for start in reversed(starts[: int(np.argmin(reached)) + 1]):
        if end:
            bounds.append(int(lengths[end - 1]))
            end = start[end]
    return bounds[::-1]


def _one_bucket_more(best: np.ndarray, lengths: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least padding of the first j lengths when one more bucket ends there, and where it begins.

    The best beginning never moves back as j grows, so once it is known for the middle one of some j, those on either side only need to look on
    their side of it. All middles of a round are worked out at once: a round looks at each beginning about once, and there are log(j) rounds.
    """
    size = len(lengths)
    padding, begin = best.copy(), np.zeros(size + 1, dtype=np.int64)
    # Ranges of j, first and last, and of beginnings.
    first, last, low, high = (np.array([x]) for x in (1, size, 0, size - 1))
    while len(first):
        middle = (first + last) // 2
        width = np.minimum(high, middle - 1) - low + 1
        offset = np.append(0, np.cumsum(width))[:-1]
        end = np.repeat(middle, width)
        i = np.arange(width.sum()) + np.repeat(low - offset, width)
        cost = best[i] + lengths[end - 1] * (count[end] - count[i]) - (total[end] - total[i])
        least = np.minimum.reduceat(cost, offset)
        hits = np.flatnonzero(cost == np.repeat(least, width))
        chosen = i[hits[np.searchsorted(hits, offset)]]
        padding[middle], begin[middle] = least, chosen
        first, last, low, high = (
            np.concatenate(pair) for pair in ((first, middle + 1), (middle - 1, last), (low, chosen), (chosen, high))
        )
        there = first <= last
        first, last, low, high = first[there], last[there], low[there], high[there]
    return padding, begin


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0))


def packed(
    docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 65536, order: Column | None = None
) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch, place, batch_rows, padding, over_budget for each row of `docs`.

    `docs` has doc_id and text; other columns are ignored unless `length`, a column of `docs` with the tokens of each document, uses them; by
    default tokens are words. A batch is told by (bucket, batch); its rows take places 0 and up, and its padded size, batch_rows *
    bucket_length at most, is within `budget` unless a single document is longer: such documents have a batch each
    and over_budget set. Null lengths and texts count as 0 tokens; they share the bucket of bound 0 or that of the shortest texts.
    Repeated rows are packed one by one; null doc_ids are as any other. Nothing is cut or left out.

    Batches of a bucket are filled in the order of `order`, a column of `docs`, and of a hash of doc_id and text where that
    is equal or not given.

    The histogram of all lengths is all that the driver sees: a corpus of t tokens has at most sqrt(2 * t) different lengths.
    """
    text = F.col("text").cast("string")
    tokens = word_count(text) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    columns = [
        F.col("doc_id").cast("long"),
        tokens.alias("n_tokens"),
        F.xxhash64(F.col("doc_id").cast("long"), text).alias("row_hash"),
    ]
    rows = saved(docs.select(*columns, *([] if order is None else [order.alias("order")])), "packing-rows")
    if order is not None:
        # Dealt in order and written, so that the number of a partition is that of a piece of the order.
        rows = saved(rows.repartitionByRange("order", "row_hash").withColumn("piece", F.spark_partition_id()), "packing-order")
    found = rows.groupBy("n_tokens").count().toPandas().sort_values("n_tokens")
    bounds = optimal_bounds(found["n_tokens"].to_numpy(), found["count"].to_numpy(), buckets) or [0]
    number, bound = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for place in reversed(range(len(bounds) - 1)):
        inside = F.col("n_tokens") <= bounds[place]
        number, bound = F.when(inside, place).otherwise(number), F.when(inside, bounds[place]).otherwise(bound)
    bucketed = rows.withColumns({"bucket": number, "one": F.lit(1)})
    if order is None:
        summed = running_sums(bucketed, "bucket", "row_hash", "one")
    else:
        summed = sums_over_pieces(bucketed, ["bucket"], "piece", ["order", "row_hash", "doc_id", "n_tokens"], "one")
    capacity = F.greatest(F.floor(F.lit(budget) / F.greatest(bound.cast("long"), F.lit(1))), F.lit(1))
    return summed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        bound.cast("long").alias("bucket_length"),
        F.floor(F.col("before") / capacity).alias("batch"),
        (F.col("before") % capacity).alias("place"),
        capacity.alias("batch_rows"),
        (bound.cast("long") - F.col("n_tokens")).alias("padding"),
        (F.col("n_tokens") > budget).alias("over_budget"),
    )
