"""Pfair mixing against a slot-by-slot simulation of earliest deadline first."""

import math
import random
from fractions import Fraction

import pytest
from corpus_tables import rows_of

from planloom.llm import mixing
from planloom.llm.mixing import _blocks, mix, mixed_documents
from planloom.llm.queries import QUERIES


def blocks_by_slot(rows):
    slots = {}
    for row in rows:
        slots.setdefault(row["slot"], set()).add((row["stream"], row["block"]))
    assert all(len(found) == 1 for found in slots.values())
    return {slot: found.pop() for slot, found in slots.items()}


def frame_of(spark, sizes, width=100):
    """Documents of `width` bytes, so that one makes a block."""
    rows = [(n, source, "x" * (width - 8) + f"{source}{n:06d}"[-8:]) for source, count in sizes.items() for n in range(count)]
    rows = [(number, source, text) for number, (_, source, text) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def check_balance(rows, weights):
    """Deviations over all balanced slots against the targets as they are, in exact fractions; returns the number of slots."""
    total = sum(map(Fraction, weights.values()))
    share = {source: Fraction(weight) / total for source, weight in weights.items()}
    by_slot = blocks_by_slot(rows)
    horizon = len({r["slot"] for r in rows if r["balanced"]})
    assert all(slot in by_slot for slot in range(horizon))
    assert all(r["balanced"] == (r["slot"] < horizon) for r in rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows if r["balanced"])
    # Deviations change by a share a slot, so a source's extremes are right before and behind its own slots.
    had = dict.fromkeys(weights, 0)
    for slot in range(horizon):
        source, block = by_slot[slot]
        assert block == had[source]
        assert abs(had[source] - share[source] * slot) < 1
        had[source] += 1
        assert abs(had[source] - share[source] * (slot + 1)) < 1
    assert all(abs(n - share[source] * horizon) < 1 for source, n in had.items())
    return horizon


@pytest.mark.parametrize(
    "weights",
    [
        {"aa": 0.5, "bb": 0.3, "cc": 0.2},
        {"aa": 7, "bb": 1, "cc": 1},
        {"aa": 1, "bb": 1, "cc": 1},
        {"aa": 0.9, "bb": 0.0999, "cc": 0.0001},
        {"aa": math.pi, "bb": math.e, "cc": math.sqrt(2), "dd": 0.01, "ee": 0.02, "ff": 0.4},
        {"aa": 50, **{f"t{n}": 1 for n in range(50)}},
    ],
)
def test_deviation_is_below_one_block(spark, weights):
    sizes = {source: int(1500 * weight / sum(weights.values())) + 2 for source, weight in weights.items()}
    rows = rows_of(mix(frame_of(spark, sizes), weights, block_bytes=100))
    assert len(rows) == sum(sizes.values()) and len({r["doc_id"] for r in rows}) == len(rows)
    assert check_balance(rows, weights) >= 1490


def streams_of(spark, weights, blocks):
    total = sum(weights.values())
    rows = [(source, 100 * (int(blocks * weight / total) + 2), float(weight)) for source, weight in weights.items()]
    return spark.createDataFrame(rows, "stream string, total long, weight double")


@pytest.mark.parametrize("count", [20, 200])
@pytest.mark.parametrize("equal", [True, False])
def test_many_sources_over_many_slots(spark, count, equal):
    weights = {f"s{n:03d}": 1.0 if equal else 1 / (n + 1.7) for n in range(count)}
    rows = rows_of(_blocks(streams_of(spark, weights, 50_000), 100))
    assert check_balance(rows, weights) >= 50_000


def test_earliest_deadline_first(spark):
    weights = {"aa": 512, "bb": 341, "cc": 171}
    rows = rows_of(_blocks(streams_of(spark, weights, 600), 100))
    found, done, total = blocks_by_slot(rows), dict.fromkeys(weights, 0), 1024
    for slot in range(600):
        ready = [s for s in weights if math.floor(Fraction(done[s] * total, weights[s])) <= slot]
        chosen = min(ready, key=lambda s: (math.ceil(Fraction((done[s] + 1) * total, weights[s])), -weights[s]))
        assert found[slot] == (chosen, done[chosen])
        done[chosen] += 1


def test_sources_that_are_left_follow_by_deadline(spark):
    rows = rows_of(mix(frame_of(spark, {"aa": 10, "bb": 300, "cc": 40}), {"aa": 1, "bb": 1, "cc": 2}, block_bytes=100))
    late = sorted((r for r in rows if not r["balanced"]), key=lambda r: r["slot"])
    assert len({r["block"] for r in late if r["source"] == "bb"}) > 250
    assert [r["deadline"] for r in late] == sorted(r["deadline"] for r in late)
    check_balance(rows, {"aa": 1, "bb": 1, "cc": 2})


def test_blocks_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 50)
    rows = rows_of(mix(frame_of(spark, {"aa": 300, "bb": 300}), {"aa": 2, "bb": 1}, block_bytes=100))
    assert len(rows) == 600 and len({(r["stream"], r["block"]) for r in rows}) <= 52
    assert check_balance(rows, {"aa": 2, "bb": 1}) >= 30


def test_blocks_stay_as_they_are_in_large_corpora(spark):
    """200,000 blocks, more than what was once the most of any corpus."""
    rows = rows_of(mix(frame_of(spark, {"aa": 1000, "bb": 1000}), {"aa": 2, "bb": 1}, block_bytes=1))
    assert {r["offset"] for r in rows} == {0}
    assert sorted(r["block"] for r in rows if r["source"] == "aa") == list(range(0, 100_000, 100))
    assert len(blocks_by_slot(rows)) == 2000 and max(r["slot"] for r in rows) > 190_000


def simulated(weights, counts):
    """Blocks in the order of the slots, each slot after the other."""
    total, order = sum(weights.values()), sorted(weights, key=lambda s: (-weights[s], s))
    done, picked = dict.fromkeys(order, 0), []
    for slot in range(min(counts[s] * total // weights[s] for s in order)):
        ready = [s for s in order if done[s] * total // weights[s] <= slot]
        chosen = min(ready, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), order.index(s)))
        picked.append((chosen, done[chosen]))
        done[chosen] += 1
    return picked


@pytest.mark.parametrize("period", [1, 8, 512])
@pytest.mark.parametrize("kind", ["even", "steep", "random"])
def test_periods_are_folded_apart(spark, monkeypatch, period, kind):
    """Each begins with the blocks that wait then, those of light streams for many periods."""
    monkeypatch.setattr(mixing, "PERIOD", period)
    rng = random.Random(f"{period} {kind}")
    weight = {"even": lambda n: 1, "steep": lambda n: 3**n, "random": lambda n: rng.randrange(1, 1000)}[kind]
    weights = {f"s{n:02d}": weight(n) for n in range(9)}
    counts = {s: 600 * w // sum(weights.values()) + rng.randrange(1, 4) for s, w in weights.items()}
    frame = spark.createDataFrame([(s, 100 * counts[s], float(w)) for s, w in weights.items()], "stream string, total long, weight double")
    rows = rows_of(_blocks(frame, 100))
    want, found = simulated(weights, counts), blocks_by_slot(rows)
    assert [found[slot] for slot in range(len(want))] == want
    assert sorted(found) == list(range(len(rows))) and len(rows) == sum(counts.values()) + 9
    assert {r["slot"] for r in rows if r["balanced"]} == set(range(len(want)))


@pytest.mark.parametrize("factor", [1e-300, 1.0, 1e300])
def test_weights_of_any_size(spark, factor):
    weights = {"aa": 0.5 * factor, "bb": 0.3 * factor, "cc": 0.2 * factor, "dd": 1e-22 * factor}
    frame = spark.createDataFrame([(s, 100_000, w) for s, w in weights.items()], "stream string, total long, weight double")
    rows = rows_of(_blocks(frame, 100))
    found = blocks_by_slot(rows)
    assert sorted(found) == list(range(4004))
    assert [found[slot][0] for slot in range(4)] == ["aa", "bb", "aa", "cc"]
    assert check_shares(rows, {"aa": 5, "bb": 3, "cc": 2}) == 2000


def check_shares(rows, weights):
    """The number of balanced slots, of which a source has had its share at any time, but for a block."""
    by_slot, had, total = blocks_by_slot(rows), dict.fromkeys(weights, 0), sum(weights.values())
    balanced = sorted(r["slot"] for r in rows if r["balanced"])
    for slot in balanced:
        source = by_slot[slot][0]
        had[source] = had.get(source, 0) + 1
        assert all(abs(had[s] - Fraction(w * (slot + 1), total)) <= 1 for s, w in weights.items())
    return len(balanced)


def test_sources_without_weight_follow_at_the_end(spark):
    frame = frame_of(spark, {"aa": 20, "bb": 20, "zz": 20})
    rows = rows_of(mix(frame, {"aa": 1, "bb": 1, "absent": 5}, block_bytes=100))
    last = max(r["slot"] for r in rows if r["source"] != "zz")
    assert all(r["slot"] > last and r["stream"] is None for r in rows if r["source"] == "zz")
    shared = rows_of(mix(frame, {"aa": 1, None: 1}, block_bytes=100))
    assert {r["stream"] for r in shared if r["source"] != "aa"} == {None}
    assert len(blocks_by_slot(shared)) == 60


def test_odd_rows_all_come_once(spark, odd_folder, odd_rows):
    rows = rows_of(QUERIES["op5_pfair_mixing"](spark, odd_folder))
    got = sorted(((r["doc_id"], r["source"], r["n_bytes"]) for r in rows), key=repr)
    assert got == sorted(((row[0], row[3], len((row[1] or "").encode())) for row in odd_rows), key=repr)
    blocks_by_slot(rows)


def test_every_source_is_a_stream(spark):
    frame = frame_of(spark, {f"s{n:03d}": 3 for n in range(60)})
    rows = rows_of(mix(frame, block_bytes=100))
    assert len(rows) == 180 and len({r["stream"] for r in rows}) == 60
    assert check_balance(rows, {f"s{n:03d}": 1 for n in range(60)}) == 180
    given = rows_of(mix(frame, {f"s{n:03d}": 1 + n % 3 for n in range(40)}, block_bytes=100))
    assert len({r["stream"] for r in given}) == 41 and len(given) == 180
    with pytest.raises(ValueError, match="negative"):
        mix(frame, {"s001": -1})


def test_empty_table(spark, empty_folder):
    assert rows_of(QUERIES["op5_pfair_mixing"](spark, empty_folder)) == []


def test_stage_sorts_whole_rows(spark, odd_folder, odd_rows):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    frame = mixed_documents(docs)
    assert frame.columns == docs.columns
    assert sorted(map(repr, rows_of(frame))) == sorted(map(repr, rows_of(docs)))


def test_no_python(spark):
    plan = QUERIES["op5_pfair_mixing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_rows_are_not_shuffled_by_source(spark, monkeypatch):
    """Only sums are: rows go by source and piece of its order."""
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    try:
        frame = mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
        text = frame._jdf.queryExecution().optimizedPlan().toString()
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
    lines = [line for line in plan.splitlines() if "hashpartitioning(_group" in line]
    assert lines and "_piece" in text
    alone = [line for line in lines if "_piece" not in line.split("hashpartitioning(")[1].split(")")[0]]
    # The one exchange by source alone is that of the sums of pieces.
    assert len(alone) <= 1
