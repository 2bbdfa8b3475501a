"""Running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of a piece, on average.
PIECE_ROWS = 20_000


def running_sums(rows: DataFrame, group: str, order: str, weight: str) -> DataFrame:
    """`rows` with the column `before`: the sum of `weight` over the rows of the same group that come earlier.

    Within a group rows are in the order of the 64-bit hash in column `order`, so in one that looks random; ties in the order
    of their other columns' values, and rows alike in all of them in any order. All groups are cut at the same hashes, into as many pieces as
    all rows need at PIECE_ROWS each, so that a row's own values tell its piece: rows are only shuffled by group and piece,
    and sums of pieces carry over to later ones. `rows` is read three times, so it
    should be a written table. Null groups are a group. `group`, `order` and `weight` name columns.
    """
    rest = [name for name in rows.columns if name not in (group, order)]
    pieces = rows.count() // PIECE_ROWS + 1
    # The hash as a share of its range, from the lowest negative number on.
    share = F.shiftrightunsigned(F.col(order).bitwiseXOR(F.lit(-(1 << 63))), 11) / F.lit(float(1 << 53))
    # Nulls are joined as values.
    cut = rows.withColumns({
        "_group": F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")),
        "_piece": F.floor(share * pieces),
    })
    return sums_over_pieces(cut, ["_group"], "_piece", [order, *rest], weight).drop("_group", "_piece")


def sums_over_pieces(rows: DataFrame, groups: list[str], piece: str, order: list[str], weight: str) -> DataFrame:
    """`rows` with the column `before`, as running_sums has it: groups are cut along their order into numbered pieces.

    Within a piece rows are in the order of the columns `order`. `rows` is read twice. Groups and pieces aren't null.
    """
    earlier = Window.partitionBy(*groups).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*groups, piece).agg(F.sum(weight).alias("_sum"))
    sums = sums.select(*groups, piece, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*groups, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(sums, [*groups, piece])
        .withColumn("before", F.col("_base") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .drop("_base")
    )
