"""Length buckets against exhaustive search, and batches within their budget."""

import itertools
import random

import numpy as np
import pytest
from corpus_tables import folder, library_counts, rows_of
from pyspark.sql import functions as F

from planloom.llm.packing import optimal_bounds, packed
from planloom.llm.queries import QUERIES
from planloom.llm.running import running_sums


def padding(bins, counts, bounds):
    return sum(c * (next(x for x in bounds if x >= b) - b) for b, c in zip(bins, counts, strict=True))


@pytest.mark.parametrize("seed", range(12))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    bins = sorted(rng.sample(range(40), rng.randrange(1, 9)))
    counts = [rng.randrange(1, 20) for _ in bins]
    for buckets in (1, 2, 3, 5):
        bounds = optimal_bounds(np.array(bins), np.array(counts), buckets)
        choices = itertools.chain.from_iterable(itertools.combinations(bins[:-1], n) for n in range(buckets))
        assert bounds == sorted(set(bounds)) and len(bounds) <= buckets and bounds[-1] == bins[-1]
        assert padding(bins, counts, bounds) == min(padding(bins, counts, [*c, bins[-1]]) for c in choices)


def test_bounds_of_many_lengths_equal_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for size, buckets in ((1, 3), (2, 2), (60, 5), (300, 16), (301, 1), (40, 60)):
        lengths = np.sort(rng.choice(100_000, size, replace=False))
        counts = rng.integers(1, 1000, size) ** rng.integers(1, 3, size)
        count, total = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(lengths * counts))
        best = np.append(0, np.full(size, 1 << 60))
        for _ in range(min(buckets, size)):
            costs = [best[:j] + lengths[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j]) for j in range(1, size + 1)]
            best = np.minimum(best, np.append(0, [cost.min() for cost in costs]))
        bounds = optimal_bounds(lengths, counts, buckets)
        assert padding(lengths.tolist(), counts.tolist(), bounds) == best[size] and len(bounds) <= buckets


def check(rows, budget):
    batches = {}
    for row in rows:
        assert row["padding"] == row["bucket_length"] - row["n_tokens"] >= 0
        assert row["over_budget"] == (row["n_tokens"] > budget)
        batches.setdefault((row["bucket"], row["batch"]), []).append(row)
    short = {}
    for (bucket, _), batch in batches.items():
        assert sorted(r["place"] for r in batch) == list(range(len(batch)))
        assert len(batch) * batch[0]["bucket_length"] <= budget or len(batch) == 1
        short[bucket] = short.get(bucket, 0) + (len(batch) < batch[0]["batch_rows"])
    assert all(n <= 1 for n in short.values())


def test_query_on_odd_rows(spark, odd_folder, odd_rows):
    rows = rows_of(QUERIES["op7_length_bucket_packing"](spark, odd_folder))
    counts = library_counts(row[1] for row in odd_rows)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in rows), key=repr) == sorted(
        ((row[0], count) for row, count in zip(odd_rows, counts, strict=True)), key=repr
    )
    assert len({r["bucket"] for r in rows}) == 16
    check(rows, 65536)


def test_texts_without_spaces_are_packed_by_tokens(spark, tmp_path):
    rows = [(n, "漢字仮名" * 2000 + str(n), "en", "s", 8000) for n in range(3)] + [(9, "漢字" * 50_000, "en", "s", 100_000)]
    place = folder(tmp_path, [*rows, (10, "two words", "en", "s", 9)])
    found = rows_of(QUERIES["op7_length_bucket_packing"](spark, place))
    counts = {r["doc_id"]: r["n_tokens"] for r in rows_of(QUERIES["op3_token_counts"](spark, place))}
    assert {r["doc_id"]: r["n_tokens"] for r in found} == counts and counts[0] > 8000 and counts[9] > 65536
    assert [r["doc_id"] for r in found if r["over_budget"]] == [9]
    check(found, 65536)


def test_bounds_are_lengths_of_documents(spark):
    docs = spark.range(60).selectExpr("id as doc_id", "'' as text", "if(id % 3 = 0, 9001, 5000) as size")
    found = rows_of(packed(docs, F.col("size"), buckets=2))
    assert {(r["n_tokens"], r["bucket_length"], r["padding"]) for r in found} == {(5000, 5000, 0), (9001, 9001, 0)}
    check(found, 65536)


def test_small_budgets(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    check(rows_of(packed(docs, buckets=4, budget=300)), 300)
    check(rows_of(packed(docs, F.col("n_chars"), buckets=1, budget=10)), 10)


def test_empty_table(spark, empty_folder):
    assert rows_of(QUERIES["op7_length_bucket_packing"](spark, empty_folder)) == []


def test_running_sums_of_a_heavy_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.getrandbits(64) - 2**63, rng.choice([None, 0, 1, 5])) for _ in range(9000)]
    rows += [(2, 5, 3)] * 4 + [(2, -5, 3)]
    frame = spark.createDataFrame(rows, "g long, o long, w long").repartition(7)
    found = {}
    for row in running_sums(frame, "g", "o", "w").collect():
        found.setdefault(row.g, []).append((row.o, row.w, row.before))
    for group in (None, 1, 2):
        # In the order of the hash each row's sum follows from the one before.
        own, total = sorted(found[group], key=lambda r: (r[0], r[2])), 0
        assert len(own) == sum(r[0] == group for r in rows)
        for _, weight, before in own:
            assert before == total
            total += weight or 0
