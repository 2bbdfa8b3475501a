"""Keeping one heavy key from becoming one long task.

A window, or a join against a per-key aggregate, sends all rows of a key to one task. These views cut
every key into pieces = ceil(rows / PIECE_ROWS), at most MOST_PIECES, so a key of up to PIECE_ROWS rows is
one piece and follows the ordinary plan. They can stand at the beginning of any plan:

    transformations = [*hot_keys("events", "user_id"), ("mine", "select ... from events left join hot_keys ...")]

Looking for keys with several pieces must not cost a shuffle of all keys. Rows are first counted per hash bucket of the
key; a bucket of PIECE_ROWS rows or fewer can't hold such a key, and only keys in other buckets are
counted one by one. Without heavy keys the views that deal with them are empty and dropped at run time.

Counts are exact and samples are taken by hash, so that every use of these views in a plan cuts the rows in
the same way, also when a lost task runs again.
"""

# Fixed values of this library, not of the data.
PIECE_ROWS = 1000
MOST_PIECES = 1024
BUCKETS = 10000
# Sampled rows for each piece, from which the cuts are taken.
SAMPLED = 16
# Cuts are searched in steps of this many, then one by one.
STRIDE = 32

Step = tuple[str, str]


def hot_keys(table: str, key: str) -> tuple[Step, ...]:
    """View `hot_keys(hot_key, hot_rows, pieces)`: one row for each key of more than one piece."""
    bucket = f"pmod(xxhash64(t.{key}), {BUCKETS})"
    return (
        ("heavy_buckets", f"select {bucket} as bucket from {table} t group by {bucket} having count(*) > {PIECE_ROWS}"),
        (
            "hot_keys",
            # At most BUCKETS rows are broadcast.
            f"""
            select /*+ broadcast(b) */ t.{key} as hot_key, count(*) as hot_rows,
                   cast(least({MOST_PIECES}, ceil(count(*) / {PIECE_ROWS})) as bigint) as pieces
            from {table} t left semi join heavy_buckets b on {bucket} = b.bucket
            group by t.{key} having count(*) > {PIECE_ROWS}
            """,
        ),
    )


def banded(table: str, key: str, order: str, row: str) -> tuple[Step, ...]:
    """Views `hot_keys` and `banded`: the table plus `hot_rows`, `band` and `piece`.

    Neither ever decreases along `order`; `piece` doesn't along (`order`, `row`) either, where `row` is a whole number
    that tells the rows of equal `order` apart. The cuts between bands are values at equal counts of a sample. Each cut
    value is a band of its own: bands with odd numbers hold one value only, -1 the nulls. So equal values share a band, and
    rows of an even band the same piece. A value that takes up several cuts, and nulls, are cut into
    pieces by `row`. No piece holds much more than its share of the key, whatever the distribution.
    `hot_rows` is null for keys of one piece, whose band and piece are 0.
    """
    cuts = "transform(sequence(1, cast(pieces as int) - 1), i -> get({0}, cast(size({0}) * i div pieces as int)))"
    marks = f"filter({{0}}, (c, i) -> i % {STRIDE} = {STRIDE - 1})"
    return (
        *hot_keys(table, key),
        (
            "hot_samples",
            f"""
            select h.hot_key, h.hot_rows, h.pieces,
                   sort_array(collect_list(t.{order})) as orders, sort_array(collect_list(t.{row})) as ids
            from {table} t join hot_keys h on t.{key} <=> h.hot_key
            where pmod(xxhash64(t.{row}), greatest(1, h.hot_rows div ({SAMPLED} * h.pieces))) = 0
            group by h.hot_key, h.hot_rows, h.pieces
            """,
        ),
        (
            "hot_cuts",
            f"""
            select hot_key, hot_rows, cuts, {marks.format("cuts")} as marks,
                   row_cuts, {marks.format("row_cuts")} as row_marks
            from (select hot_key, hot_rows, {cuts.format("orders")} as cuts, {cuts.format("ids")} as row_cuts
                  from hot_samples)
            """,
        ),
        (
            "banded",
            f"""
            select * except (cuts, row_cuts, row_marks, below),
                   band * {2 * MOST_PIECES}
                   + if(hot_rows is not null and ({order} is null or {order} <=> get(cuts, below + 1) and pmod(band, 2) = 1),
                        {_below("row_cuts", "row_marks", row)}, 0) as piece
            from (select *, case when hot_rows is null then 0 when {order} is null then -1
                                 else 2 * below + if(get(cuts, below) <=> {order}, 1, 0) end as band
                  from (select t.*, h.hot_rows, h.cuts, h.row_cuts, h.row_marks,
                               coalesce({_below("h.cuts", "h.marks", f"t.{order}")}, 0) as below
                        from {table} t left join hot_cuts h on t.{key} <=> h.hot_key))
            """,
        ),
    )


def _below(cuts: str, marks: str, value: str) -> str:
    """How many of the ascending `cuts` lie below `value`; `marks` are every STRIDE-th of them."""
    skipped = f"{STRIDE} * size(filter({marks}, c -> c < {value}))"
    return f"({skipped} + size(filter(slice({cuts}, {skipped} + 1, {STRIDE}), c -> c < {value})))"
