"""Mixing sources to target weights by Pfair scheduling. Native DataFrame operations only.

Each source's documents are cut into blocks of equal bytes. Time runs in slots of one block. A source of weight w releases its
block k at slot floor(k / w), and the block must be out by slot ceil((k + 1) / w). In every slot the released block
with the earliest deadline comes next. As the weights sum to one, each deadline is met, and at any
time each source has had its share of the blocks to within less than one block.

Weights are taken as they are, for any number of sources. The schedule is over blocks, not documents, and blocks are as large in a
large corpus as in a small one. It is worked out slot by slot, by folds over periods of slots, until the first source runs out; blocks
after that follow by their deadlines. Which blocks wait as a period begins follows from releases and deadlines alone, so
periods are folded by many tasks at once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planloom.llm.running import running_sums
from planloom.llm.storage import saved

# Most blocks of the whole corpus, besides one for each source, for whoever wants larger ones then. None: blocks stay as they are.
SLOTS: int | None = None
# Slots that are folded at a time, by one task.
PERIOD = 512
# Periods that a task folds, on average.
TASK_PERIODS = 8
# No slot comes as late as this; later releases and deadlines say this.
LAST = 1 << 62


def _given_weights(spark: SparkSession, weights: Mapping[str, float]) -> DataFrame:
    if any(weight < 0 for weight in weights.values()):
        raise ValueError("weights must not be negative")
    rows = [
        F.struct(F.lit(source).alias("source"), F.lit(float(weight)).alias("weight"))
        for source, weight in weights.items()
        if source is not None
    ]
    empty = F.expr("cast(array() as array<struct<source: string, weight: double>>)")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, block_bytes: int = 65536
) -> DataFrame:
    """doc_id, source, n_bytes, stream, block, release, deadline, slot, offset, balanced, row_hash for each row of `docs`.

    `docs` has doc_id, source and text; other columns are ignored. The mix is the order of (slot, offset, row_hash): no
    document is left out or repeated. `weights` gives sources' weights; sources without one share a stream (null) with the
    weight that `weights` has for None, or none: such documents then follow at the end, in slots after all others. Without
    `weights` each source is a stream that weighs its bytes to `power`. Weights count for sources that are there and needn't sum to one.

    balanced marks the slots in which no source has run out yet: there each source's share of the blocks is its weight to
    within less than one block. After that, blocks that are left come in the order of their deadlines. A block has `block_bytes`, however large
    the corpus is. The schedule takes a task as many steps as a period has slots, times the streams.

    Null sources are a stream of their own, or belong to the shared one if `weights` are given. Null and empty texts have 0 bytes and go
    where their place in the source's order is. Repeated rows are scheduled one by one. A document longer than a block takes the place of its
    first byte. The order within a source is that of a hash of doc_id and text.
    """
    text = F.col("text").cast("string")
    rows = saved(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            F.coalesce(F.octet_length(text).cast("long"), F.lit(0)).alias("n_bytes"),
            F.xxhash64(F.col("doc_id").cast("long"), text).alias("row_hash"),
        ),
        "mixing-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("n_bytes").alias("total"))
    if weights is None:
        streams = sizes.select(
            F.col("source").alias("stream"), "total", F.pow(F.col("total").cast("double"), F.lit(power)).alias("weight")
        )
        rows = rows.withColumn("stream", F.col("source"))
    else:
        given = saved(_given_weights(docs.sparkSession, weights).join(sizes, "source", "left_semi"), "mixing-weights")
        named = given.select("source", F.col("source").alias("stream"))
        rows = saved(rows.join(named, "source", "left"), "mixing-streams")
        streams = (
            rows.groupBy("stream").agg(F.sum("n_bytes").alias("total"))
            .join(given.withColumnRenamed("source", "stream"), "stream", "left")
            .select("stream", "total", F.coalesce("weight", F.lit(float(weights.get(None, 0.0)))).alias("weight"))
        )
    if SLOTS is not None:
        block_bytes = max(block_bytes, -(-(sizes.agg(F.sum("total")).first()[0] or 0) // SLOTS))
    blocks = saved(_blocks(streams, block_bytes), "mixing-blocks")
    placed = running_sums(rows, "stream", "row_hash", "n_bytes").withColumn("block", F.floor(F.col("before") / block_bytes))
    # A block stands for many documents' bytes or for one document: the join is left to the optimizer.
    own = blocks.withColumnsRenamed({"stream": "s", "block": "b"})
    return placed.join(own, F.expr("stream <=> s and block = b")).select(
        "doc_id",
        "source",
        "n_bytes",
        "stream",
        "block",
        "release",
        "deadline",
        "slot",
        (F.col("before") - F.col("block") * block_bytes).alias("offset"),
        "balanced",
        "row_hash",
    )


def _blocks(streams: DataFrame, block_bytes: int) -> DataFrame:
    """(stream, block, release, deadline, slot, balanced) of the blocks of (stream, total, weight).

    A stream that ends with its block has one block more, for empty documents behind its last byte.
    """
    state = saved(_shares(streams, block_bytes), "mixing-shares")
    ends = state.first()["ends"]
    due = saved(_due(state), "mixing-due")
    picks = saved(_picks(due, ends), "mixing-picks")
    slotted = due.join(picks, ["i", "block"], "left")
    # What is left is numbered by pieces of its order. They are written, so that a row's piece stays the same.
    order = [F.asc_nulls_last("deadline"), F.col("i"), F.col("block")]
    late = saved(
        slotted.where("at is null").repartitionByRange(*order).withColumn("piece", F.spark_partition_id()), "mixing-late"
    )
    pieces = late.groupBy("piece").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("piece").orderBy(*order)) - 1
    late = late.join(pieces.select("piece", base.alias("base")), "piece").withColumn("slot", F.lit(ends) + F.col("base") + nth)
    columns = ("stream", "block", "release", "deadline")
    return slotted.where("at is not null").select(*columns, F.col("at").alias("slot"), F.lit(True).alias("balanced")).unionByName(
        late.select(*columns, "slot", F.lit(False).alias("balanced"))
    )


def _quotient(number: str, by: str) -> str:
    """A quotient of whole numbers, rounded down; beyond any slot, LAST."""
    return f"if({number} < {by} * {LAST}BD, ({number}) div ({by}), {LAST}L)"


def _shares(streams: DataFrame, block_bytes: int) -> DataFrame:
    """One row: the streams from the heaviest on as `own`, the sum of their weights as `whole`, and the number of balanced slots.

    Weights are whole numbers from here on, the largest of 16 digits or so: all times are exact, and some block is released in each slot.
    """
    # Streams without bytes take no part in the schedule; they follow at the end as those without weight do.
    share = F.when(F.col("total") > 0, F.col("weight")).otherwise(0.0)
    weighed = streams.select("stream", F.coalesce("total", F.lit(0)).alias("total"), share.alias("weight"))
    everyone = weighed.groupBy().agg(
        F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("minus"), "stream", "total", "weight"))).alias("all")
    )
    # Two factors, as one may be beyond a double.
    scale = "pow(10D, greatest(digits - 300, 0)) * pow(10D, least(digits, 300))"
    return everyone.withColumn(
        "digits", F.expr("16 - ceil(log10(array_max(transform(all, x -> x.weight))))")
    ).withColumn(
        "own",
        F.expr(f"""
            transform(all, (x, i) -> named_struct('i', i, 'stream', x.stream, 'count', (x.total + {block_bytes - 1}L) div {block_bytes}L,
                'weight', if(x.weight > 0, greatest(1L, cast(round(x.weight * {scale}) as bigint)), 0L)))
        """),
    ).withColumn(
        "whole", F.expr("aggregate(own, cast(0 as decimal(38, 0)), (t, x) -> cast(t + x.weight as decimal(38, 0)))")
    ).select(
        "own",
        "whole",
        # The first source to run out ends the balanced slots: every source has had less than a block more than its share.
        F.expr(f"""
            coalesce(array_min(transform(own, x -> if(x.weight > 0, {_quotient("x.count * whole", "x.weight")}, null))), 0L)
        """).alias("ends"),
    )


def _due(state: DataFrame) -> DataFrame:
    """(i, stream, block, release, deadline) of all blocks; `i` numbers the streams from the heaviest on."""
    parts = state.select("whole", F.explode("own").alias("own")).select(
        "whole", "own.*", F.expr(f"explode(sequence(0L, own.count div {PERIOD}))").alias("part")
    )
    blocks = parts.repartition("i", "part").withColumn(
        "block", F.expr(f"explode(sequence(part * {PERIOD}, least(count, part * {PERIOD} + {PERIOD - 1})))")
    )
    release = _quotient("block * whole", "weight")
    deadline = _quotient("(block + 1) * whole + weight - 1", "weight")
    return blocks.select(
        "i",
        "stream",
        "block",
        F.expr(f"if(weight > 0, {release}, null)").alias("release"),
        F.expr(f"if(weight > 0, {deadline}, null)").alias("deadline"),
    )


def _picks(due: DataFrame, ends: int) -> DataFrame:
    """(i, block, at): the blocks of the slots before `ends`.

    Periods of slots are folded apart from each other. Each begins with the blocks that wait then, which needs no earlier fold.
    """
    known = due.where(F.col("release") < ends).select("i", "block", "release", "deadline")
    begun = known.withColumn("period", F.expr(f"release div {PERIOD}")).unionByName(_waiting(known, ends))
    # A given number of tasks: by their few bytes adaptive execution would put all periods into one.
    lists = (
        begun.repartition(ends // (TASK_PERIODS * PERIOD) + 1, "period")
        .groupBy("period", "i").agg(F.array_sort(F.collect_list(F.struct("block", "release", "deadline"))).alias("blocks"))
        .groupBy("period").agg(F.array_sort(F.collect_list(F.struct("i", "blocks"))).alias("own"))
    )
    return lists.select(F.explode(F.expr(_FOLD.format(width=f"{PERIOD}L", ends=f"{ends}L"))).alias("pick")).select("pick.*")


def _waiting(known: DataFrame, ends: int) -> DataFrame:
    """(i, block, release, deadline, period): the blocks that are released but not out as a period begins.

    Every slot takes one block, so b(s), the blocks released before slot s less s, counts those that wait. Blocks whose priority is lower than some
    block's get what slots the others leave: of any number e of lowest priority, f(e) wait in slot t, the minimum over all s up to t of b(s) and those of
    the e that are released in s or later. So the e-th waits if f(e) is more than f(e - 1). Only blocks released before t with a deadline
    behind it can wait. For these the minimum is e, or is right behind one of their releases: b's minimum from there to t, `low`, and
    those of the e that are released later.
    """
    session, last = known.sparkSession, max(ends - 1, 0) // PERIOD
    # What each slot adds to b, as the running sum within its period, and the minimum from each slot on.
    steps = session.range(ends).select("id", F.lit(-1).alias("step")).union(known.select("release", F.lit(1)))
    within = Window.partitionBy("period").orderBy("id")
    slots = (
        steps.groupBy("id").agg(F.sum("step").alias("step")).withColumn("period", F.expr(f"id div {PERIOD}"))
        .withColumn("run", F.sum("step").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("tail", F.min("run").over(within.rowsBetween(0, Window.unboundedFollowing)))
    )
    slots = saved(slots, "mixing-slots")
    # A row for each period.
    before = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    periods = slots.groupBy("period").agg(F.sum("step").alias("step"), F.min("run").alias("run"))
    periods = periods.select("period", "run", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("base"))
    first, final = f"release div {PERIOD} + 1", f"least((deadline - 1) div {PERIOD}, {last}L)"
    open_ = (
        known.where(f"{first} <= {final}")
        .join(slots.select(F.col("id").alias("release"), "tail"), "release")
        .withColumn("period", F.explode(F.expr(f"sequence({first}, {final})")))
        .join(periods.select((F.col("period") + 1).alias("period"), "run", "base"), "period")
        .withColumn("low", F.col("base") + F.expr(f"if(period = {first}, tail, run)"))
    )
    so_far = Window.partitionBy("i", "block").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    open_ = open_.withColumn("low", F.min("low").over(so_far))
    # The lowest priority first.
    ranked = open_.groupBy("period").agg(
        F.sort_array(F.collect_list(F.struct("deadline", "i", "block", "release", "low")), asc=False).alias("open")
    )
    return ranked.select("period", F.explode(F.expr(_WAIT)).alias("b")).select(
        "b.i", "b.block", "b.release", "b.deadline", "period"
    )


# The fold's state is f, the blocks so far with what each would make of f, and those that wait.
_WAIT = """
    aggregate(open,
        named_struct('f', 0L, 'seen', cast(array() as array<struct<release: bigint, value: bigint>>), 'waits', filter(open, x -> false)),
        (state, x) -> transform(array(concat(
                transform(state.seen, y -> named_struct('release', y.release, 'value', y.value + if(y.release < x.release, 1L, 0L))),
                array(named_struct('release', x.release, 'value', x.low + cast(size(filter(state.seen, y -> y.release > x.release)) as bigint)))
            )),
            seen -> transform(array(least(cast(size(seen) as bigint), array_min(transform(seen, y -> y.value)))),
                f -> named_struct('f', f, 'seen', seen, 'waits', if(f > state.f, concat(state.waits, array(x)), state.waits)))[0])[0],
        state -> state.waits)
"""
# The fold's state is how many of each stream's blocks are out; a slot goes to the released
# block with the earliest deadline, of equal ones to the heavier stream.
_STEP = """
    transform(array(array_min(transform(own, (x, n) -> if(get(x.blocks, state.out[n]).release <= t,
            named_struct('deadline', get(x.blocks, state.out[n]).deadline, 'n', n), null)))),
        next -> named_struct(
            'out', transform(state.out, (k, n) -> if(n = next.n, k + 1, k)),
            'picks', concat(state.picks, array(named_struct('i', own[next.n].i, 'block', own[next.n].blocks[state.out[next.n]].block, 'at', t)))
        ))[0]
"""
_FOLD = f"""
    aggregate(sequence(period * {{width}}, least((period + 1) * {{width}}, {{ends}}) - 1),
        named_struct('out', transform(own, x -> 0), 'picks', cast(array() as array<struct<i: int, block: bigint, at: bigint>>)),
        (state, t) -> {_STEP},
        state -> state.picks)
"""


def placed_documents(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """(row_hash, doc, place) for each row of `docs`: the whole row and (slot, offset), its place in the mix."""
    order = mix(docs, weights, power).groupBy("row_hash").agg(F.min(F.struct("slot", "offset")).alias("place"))
    row: Column = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # The rows travel as one struct, so that no column of theirs clashes with the mix's.
    return docs.select(F.struct("*").alias("doc"), row.alias("row_hash")).join(order, "row_hash")


def mixed_documents(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """The rows and columns of `docs`, sorted over all partitions by their place in the mix."""
    return (
        placed_documents(docs, weights, power)
        .repartitionByRange("place", "row_hash")
        .sortWithinPartitions("place", "row_hash")
        .select("doc.*")
    )
