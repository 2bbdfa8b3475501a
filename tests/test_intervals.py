"""Overlap joins against comparing every pair."""

import random
from datetime import datetime, timedelta

import pytest
from oracle import TEST_DATA
from test_physical import explain

from planloom.operators import CATALOGUE
from planloom.operators.intervals import overlaps
from planloom.runner import open_plan


def run(spark, left, right, key=None, piece_rows=100_000):
    session = spark.newSession()
    for name, rows in (("one", left), ("other", right)):
        session.createDataFrame(rows, "id long, starts long, ends long, k int").createOrReplaceTempView(name)
    for view, sql in overlaps("one", "other", key, piece_rows):
        session.sql(sql).createOrReplaceTempView(view)
    return session


def expected(left, right, key=False):
    return sorted(
        (a[0], b[0])
        for a in left
        for b in right
        if None not in (a[1], a[2], b[1], b[2]) and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2]
        and (not key or a[3] is not None and a[3] == b[3])
    )


def some_intervals(seed, count):
    rng = random.Random(seed)
    rows = []
    for n in range(count):
        start = rng.randrange(-(1 << 40), 1 << 40)
        length = rng.choice([0, 1, 2, 1 << 20, (1 << 20) + 1, 1 << 22, rng.randrange(1 << 30), rng.randrange(1 << 38), -5])
        rows.append((n, start, start + length, rng.choice([1, 2, 3, None])))
    rows += [(count, None, 5, 1), (count + 1, 5, None, 1), (count + 2, -(1 << 62), 1 << 61, 1), (count + 3, 7, 7 + (1 << 20), 2), (count + 4, 7, 8, 2)]
    return rows


@pytest.mark.parametrize("key", [None, "k"])
@pytest.mark.parametrize("piece_rows", [100_000, 7])
def test_equals_every_pair(spark, key, piece_rows):
    left, right = some_intervals(1, 300), some_intervals(2, 250)
    found = run(spark, left, right, key, piece_rows).table("overlaps").collect()
    assert sorted(map(tuple, found)) == expected(left, right, key is not None)


def test_one_very_long_interval_does_not_gather_all_points(spark):
    """All points ask the bin of the long interval; no piece of it has many more than its share."""
    left = [(0, 0, 1 << 50, 1)] + [(n, n << 26, (n << 26) + 1000, 1) for n in range(1, 50)]
    right = [(n, n << 22, (n << 22) + 500, 1) for n in range(20_000)]
    session = run(spark, left, right, piece_rows=500)
    counts = session.table("right_asking").groupBy("size", "bin", "piece").count()
    assert counts.agg({"count": "max"}).first()[0] < 900
    assert session.table("overlaps").count() == len(expected(left, right))


def test_empty_sides(spark):
    assert run(spark, [], some_intervals(3, 20)).table("overlaps").count() == 0
    assert run(spark, some_intervals(3, 20), []).table("overlaps").count() == 0


def intervals_of_few_sizes():
    """Many of one length on the left; from very short to a few long ones on the right."""
    rng = random.Random(4)
    lengths = [1 << rng.randrange(32) for _ in range(400)] + [(1 << 32) - n for n in range(100)] + 3 * [1 << 38]
    sides = [(1 << 32) - 5] * 2000, lengths
    return ([(n, start := rng.randrange(1 << 36), start + length, 1) for n, length in enumerate(side)] for side in sides)


def test_rows_lie_in_few_sizes(spark):
    """No size that only one side is as small as, and none for a few long intervals."""
    left, right = intervals_of_few_sizes()
    session = run(spark, left, right)
    assert session.table("left_asking").count() + session.table("right_asking").count() < 3 * (len(left) + len(right))
    assert sorted(map(tuple, session.table("overlaps").collect())) == expected(left, right)


def test_rows_come_by_their_left_interval(spark):
    """Written columns of the left are runs then."""
    left, right = intervals_of_few_sizes()
    session = run(spark, left, right)
    found = [row.left_id for row in session.table("overlaps").collect()]
    runs = 1 + sum(one != other for one, other in zip(found, found[1:], strict=False))
    assert runs <= session.table("left_asking").count()


def test_both_sides_empty(spark):
    assert run(spark, [], []).table("overlaps").count() == 0


@pytest.mark.parametrize("name", ["j17_overlap_join", "j18_keyed_overlap_join"])
def test_no_pair_is_found_by_trying(spark, name):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    text = explain(CATALOGUE[name](session, str(TEST_DATA / "sf0.001")))
    assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" in text


def sessions_of(spark, folder, times):
    rows = [(n, ts, user, "view", 1.0, "{}") for n, (user, ts) in enumerate(times)]
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/events.parquet")
    return open_plan(spark, CATALOGUE["j17_overlap_join"].plan(str(folder)))


def test_sessions_go_on_past_midnight(spark, tmp_path):
    rng, half, micro = random.Random(5), timedelta(minutes=30), timedelta(microseconds=1)
    midnight = datetime(2024, 3, 10)
    times = [(1, midnight + n * half) for n in range(-3, 150)] + [(2, midnight - half + n * (half + micro)) for n in range(9)]
    times += [(3, midnight - micro), (3, midnight + half - micro), (4, midnight - micro), (4, midnight + half), (None, midnight), (5, None)]
    times += [(user, midnight + timedelta(minutes=rng.randrange(-3000, 3000), microseconds=rng.randrange(3))) for user in range(6, 30) for _ in range(200)]
    expected = []
    for user, ts in sorted(x for x in times if None not in x):
        if expected and expected[-1][0] == user and ts <= expected[-1][2]:
            expected[-1][2] = ts + half
        else:
            expected.append([user, ts, ts + half])
    assert sorted(map(list, sessions_of(spark, tmp_path, times).view("sessions").collect())) == expected


def test_events_are_shuffled_once_for_sessions(spark, tmp_path):
    """Rows of user and time, once for all that reads them; only sessions near midnight travel again."""
    rng = random.Random(6)
    opened = sessions_of(spark, tmp_path, [(user, datetime(2024, 3, 1) + timedelta(minutes=rng.randrange(20_000))) for user in range(200) for _ in range(20)])
    plan = explain(opened.view("day_sessions"))
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and "Aggregate" not in plan
    sessions = opened.view("sessions")
    count = len(sessions.collect())
    assert count > 3000 and 0 < opened.view("edge_sessions").count() < count / 10
    assert "ReusedExchange" in sessions._jdf.queryExecution().executedPlan().toString()


def many_and_few(seed):
    """Many intervals on the left that often touch two bins, few on the right; some on both sides are much longer, some lie at ends of bins."""
    rng, bin_ = random.Random(seed), 1 << 26
    left = [(start := rng.randrange(-40 * bin_, 40 * bin_), start + rng.randrange(bin_ // 3, bin_)) for _ in range(1500)]
    left += [(n * bin_ + place, n * bin_ + place + length) for n in (-3, 0, 4) for place in (-1, 0, 1) for length in (1, bin_ - 1, bin_)]
    left += [(n * 7 * bin_ - 5, n * 7 * bin_ + 5 * bin_ + n) for n in range(-4, 4)]
    right = [(start := rng.randrange(-40 * bin_, 40 * bin_), start + rng.randrange(1, 2 * bin_)) for _ in range(150)]
    right += [(n * bin_ + place, n * bin_ + place + length) for n in (-3, 0, 4, 5) for place in (-1, 0, 1) for length in (1, bin_, bin_ + 1)]
    right += [(-9 * bin_ + 3, 11 * bin_ - 1), (2 * bin_, 9 * bin_)]
    return ([(n, *ends, rng.choice([1, 2, None])) for n, ends in enumerate(side)] for side in (left, right))


@pytest.mark.parametrize("piece_rows", [100_000, 7])
@pytest.mark.parametrize("key", [None, "k"])
@pytest.mark.parametrize("swapped", [False, True])
def test_the_larger_side_lies_in_one_bin_of_each_size(spark, swapped, key, piece_rows):
    many, few = many_and_few(8)
    left, right = (few, many) if swapped else (many, few)
    session = run(spark, left, right, key, piece_rows)
    used = session.table("used_sizes").first().used
    assert used.once == ("right" if swapped else "left")
    bins = session.table(f"{used.once}_bins").where("length <= shiftleft(1L, size) and size = 26")
    assert bins.count() == bins.select("id").distinct().count() > 1400
    assert sorted(map(tuple, session.table("overlaps").collect())) == expected(left, right, key is not None)


def test_bins_travel_as_starts_and_steps(spark):
    """What a row's bin is follows from columns that are shuffled anyway."""
    many, few = many_and_few(9)
    session = run(spark, many, few)
    join = session.table("overlaps")._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().head()
    for side in (join.children().head(), join.children().last()):
        columns = side.output().mkString(" ")
        assert "starts#" in columns and "step#" in columns and "bin#" not in columns


@pytest.mark.parametrize("key", [None, "k"])
def test_rows_leave_for_the_join_by_their_start(spark, key):
    """Sorted below what deals them to pieces, where the optimizer leaves it."""
    many, few = many_and_few(10)
    session = run(spark, many, few, key)
    for name in ("left", "right"):
        tasks = session.table(f"{name}_asking").rdd.map(lambda row: row.starts).glom().collect()
        assert sum(map(len, tasks)) > 150 and all(starts == sorted(starts) for starts in tasks)
    join = explain(session.table("overlaps"))
    assert join.count("Sort [starts#") == 2 and join.index("SortMergeJoin") < join.index("Sort [starts#")
