"""Window queries (W).

The oracles are the plain window functions. The plans use the same functions within the
pieces of `hot_keys.banded` and correct the rows of hot keys by what small aggregates say about
the other pieces. Rows meet their window and their correction by the same key and piece.
"""

from planloom.operators.hot_keys import banded, hot_keys
from planloom.operators.query import Query, one_step

QUERIES = [
    Query(
        "w1_ranking",
        ("orders",),
        (
            *banded("orders", "o_custkey", "o_totalprice", "o_orderkey"),
            (
                "pieces",
                """
                select o_custkey, band, piece, count(*) as n, count(distinct o_totalprice) as prices
                from banded where hot_rows is not null group by o_custkey, band, piece
                """,
            ),
            # Prices of a band cut into pieces are one price.
            (
                "dearer",
                """
                select o_custkey, piece, orders_before,
                       orders_before - coalesce(sum(n) over before_in_band, 0) as orders_above,
                       (sum(if(first_piece = piece, prices, 0)) over by_price)
                       - if(first_piece = piece, prices, 0)
                       - coalesce(sum(if(first_piece = piece, prices, 0)) over before_in_band, 0) as prices_above
                from (select *, (sum(n) over by_price) - n as orders_before,
                             min(piece) over (partition by o_custkey, band) as first_piece
                      from pieces p
                      window by_price as (partition by o_custkey order by band desc, piece
                                          rows between unbounded preceding and current row)) p
                window by_price as (partition by o_custkey order by band desc, piece
                                    rows between unbounded preceding and current row),
                       before_in_band as (partition by o_custkey, band order by piece
                                          rows between unbounded preceding and 1 preceding)
                """,
            ),
            (
                "result",
                """
                select b.o_orderkey, b.o_custkey,
                       row_number() over price_then_key + coalesce(d.orders_before, 0) as rn,
                       rank() over price + coalesce(d.orders_above, 0) as rnk,
                       dense_rank() over price + coalesce(d.prices_above, 0) as dense
                from banded b left join dearer d on b.o_custkey <=> d.o_custkey and b.piece = d.piece
                window price as (partition by b.o_custkey, b.piece order by b.o_totalprice desc),
                       price_then_key as (partition by b.o_custkey, b.piece
                                          order by b.o_totalprice desc, b.o_orderkey)
                """,
            ),
        ),
        """
        select o_orderkey, o_custkey, row_number() over price_then_key as rn,
               rank() over price as rnk, dense_rank() over price as dense
        from orders
        window price as (partition by o_custkey order by o_totalprice desc),
               price_then_key as (partition by o_custkey order by o_totalprice desc, o_orderkey)
        """,
    ),
    Query(
        "w2_distribution",
        ("orders",),
        (
            *banded("orders", "o_custkey", "o_totalprice", "o_orderkey"),
            (
                "cheaper",
                """
                select o_custkey, piece, rows_before, band_rows, orders_before - coalesce(within_band, 0) as orders_below
                from (select o_custkey, piece, band,
                             sum(n) over (partition by o_custkey order by piece) - n as rows_before,
                             sum(n) over (partition by o_custkey order by piece) - n as orders_before,
                             sum(n) over (partition by o_custkey, band) as band_rows,
                             sum(n) over (partition by o_custkey, band order by piece) - n as within_band
                      from (select o_custkey, band, piece, count(*) as n
                            from banded where hot_rows is not null group by o_custkey, band, piece))
                """,
            ),
            (
                "placed",
                """
                select b.o_orderkey, b.o_custkey, b.hot_rows,
                       row_number() over price_then_key - 1 + c.rows_before as hot_position,
                       rank() over price - 1 + c.orders_below as hot_below,
                       -- the rows of a band with an odd number are all peers
                       if(pmod(b.band, 2) = 1, c.band_rows, count(*) over price) + c.orders_below as hot_not_above,
                       ntile(4) over price_then_key as tile,
                       percent_rank() over price as pct,
                       cume_dist() over price as cume
                from banded b left join cheaper c on b.o_custkey <=> c.o_custkey and b.piece = c.piece
                window price as (partition by b.o_custkey, b.piece order by b.o_totalprice),
                       price_then_key as (partition by b.o_custkey, b.piece order by b.o_totalprice, b.o_orderkey)
                """,
            ),
            # For hot keys the definitions of the three functions, from position and total:
            # the first (rows mod 4) of the four tiles hold one row more than the others.
            (
                "result",
                """
                select o_orderkey, o_custkey,
                       case when hot_rows is null then cast(tile as bigint)
                            when hot_position < (hot_rows % 4) * (hot_rows div 4 + 1)
                            then hot_position div (hot_rows div 4 + 1) + 1
                            else (hot_position - hot_rows % 4) div greatest(hot_rows div 4, 1) + 1
                       end as tile,
                       round(case when hot_rows is null then pct
                                  when hot_rows = 1 then 0.0D
                                  else hot_below / (hot_rows - 1) end, 12) as pct,
                       round(case when hot_rows is null then cume
                                  else hot_not_above / hot_rows end, 12) as cume
                from placed
                """,
            ),
        ),
        """
        select o_orderkey, o_custkey,
               ntile(4) over (partition by o_custkey order by o_totalprice, o_orderkey) as tile,
               round(percent_rank() over (partition by o_custkey order by o_totalprice), 12) as pct,
               round(cume_dist() over (partition by o_custkey order by o_totalprice), 12) as cume
        from orders
        """,
    ),
    Query(
        "w3_neighbours",
        ("events",),
        (
            *banded("events", "user_id", "ts", "event_id"),
            (
                "band_ends",
                """
                select user_id, piece,
                       min_by(struct(value, event_type), struct(ts, event_id)) as head,
                       max_by(struct(value, event_type), struct(ts, event_id)) as tail
                from banded where hot_rows is not null group by user_id, piece
                """,
            ),
            (
                "second_event",
                """
                select user_id, event_id as second_id
                from (select user_id, event_id,
                             row_number() over (partition by user_id order by ts, event_id) as rn
                      from banded where hot_rows is not null)
                where rn = 2
                """,
            ),
            (
                "surroundings",
                """
                select e.user_id, e.piece, s.second_id,
                       lag(e.tail) over in_time as before, lead(e.head) over in_time as after,
                       first_value(e.head) over whole as opening, last_value(e.tail) over whole as closing
                from band_ends e left join second_event s on e.user_id <=> s.user_id
                window in_time as (partition by e.user_id order by e.piece),
                       whole as (partition by e.user_id order by e.piece
                                 rows between unbounded preceding and unbounded following)
                """,
            ),
            (
                "result",
                """
                select b.event_id, b.user_id,
                       case when s.before is not null and lag(b.event_id) over in_time is null
                            then s.before.value else lag(b.value, 1, 0.0D) over in_time end as prev_value,
                       case when s.after is not null and lead(b.event_id) over in_time is null
                            then s.after.event_type else lead(b.event_type, 1, 'none') over in_time
                       end as next_type,
                       case when s.piece is null then first_value(b.value) over whole
                            else s.opening.value end as first_value,
                       case when s.piece is null then last_value(b.value) over whole
                            else s.closing.value end as last_value,
                       case when s.piece is null then nth_value(b.event_id, 2) over whole
                            else s.second_id end as second_event
                from banded b left join surroundings s on b.user_id <=> s.user_id and b.piece = s.piece
                window in_time as (partition by b.user_id, b.piece order by b.ts, b.event_id),
                       whole as (partition by b.user_id, b.piece order by b.ts, b.event_id
                                 rows between unbounded preceding and unbounded following)
                """,
            ),
        ),
        """
        select event_id, user_id,
               lag(value, 1, 0.0) over in_time as prev_value,
               lead(event_type, 1, 'none') over in_time as next_type,
               first_value(value) over whole as first_value,
               last_value(value) over whole as last_value,
               nth_value(event_id, 2) over whole as second_event
        from events
        window in_time as (partition by user_id order by ts, event_id),
               whole as (partition by user_id order by ts, event_id
                         rows between unbounded preceding and unbounded following)
        """,
    ),
    # The running sum of a hot key's piece starts from the sums of the earlier ones. The moving
    # average needs two earlier rows: the last two of each piece are repeated in the pieces whose
    # frames reach back to them, and dropped again at the end.
    Query(
        "w4_running",
        ("events",),
        (
            *banded("events", "user_id", "ts", "event_id"),
            (
                "earlier",
                """
                select user_id, piece, n,
                       coalesce(sum(n) over before, 0) as rows_before,
                       sum(total) over before as total_before
                from (select user_id, piece, count(*) as n, sum(value) as total
                      from banded where hot_rows is not null group by user_id, piece)
                window before as (partition by user_id order by piece
                                  rows between unbounded preceding and 1 preceding)
                """,
            ),
            (
                "tails",
                """
                select * from (
                    select user_id, piece, event_id, ts, value,
                           row_number() over (partition by user_id, piece
                                              order by ts desc, event_id desc) as from_end
                    from banded where hot_rows is not null)
                where from_end <= 2
                """,
            ),
            (
                "repeated",
                """
                select t.user_id, e.piece, t.event_id, t.ts, t.value
                from (select t.user_id, t.event_id, t.ts, t.value,
                             explode(array(e.rows_before + e.n - t.from_end + 1,
                                           e.rows_before + e.n - t.from_end + 2)) as reaches
                      from tails t join earlier e on t.user_id <=> e.user_id and t.piece = e.piece) t
                     join earlier e on t.user_id <=> e.user_id and t.reaches = e.rows_before
                """,
            ),
            (
                "extended",
                """
                select user_id, piece, event_id, ts, value, true as own from banded
                union all
                select user_id, piece, event_id, ts, value, false as own from repeated
                """,
            ),
            (
                "framed",
                """
                select x.event_id, x.user_id, x.own,
                       sum(case when x.own then x.value end) over (
                           partition by x.user_id, x.piece order by x.ts, x.event_id
                           rows between unbounded preceding and current row) as within_piece,
                       e.total_before,
                       avg(x.value) over (partition by x.user_id, x.piece order by x.ts, x.event_id
                                          rows between 2 preceding and current row) as moving
                from extended x left join earlier e on x.user_id <=> e.user_id and x.piece = e.piece
                """,
            ),
            (
                "result",
                """
                select event_id, user_id, round(moving, 6) as moving_mean,
                       -- null only where neither this piece nor an earlier one has had a value
                       round(case when total_before is null then within_piece
                                  else total_before + coalesce(within_piece, 0.0D) end, 2) as running_total
                from framed where own
                """,
            ),
        ),
        """
        select event_id, user_id,
               round(sum(value) over (partition by user_id order by ts, event_id
                                      rows between unbounded preceding and current row), 2) as running_total,
               round(avg(value) over (partition by user_id order by ts, event_id
                                      rows between 2 preceding and current row), 6) as moving_mean
        from events
        """,
    ),
    # The frame reaches back one hour, so the events of a hot user are cut by the hour and
    # repeated in the hour that follows.
    Query(
        "w5_trailing_hour",
        ("events",),
        (
            *hot_keys("events", "user_id"),
            # Events without a time have an hour of their own, null.
            (
                "hourly",
                """
                select event_id, user_id, ts,
                       ts - make_dt_interval(0, 0, minute(ts), extract(second from ts)) as hour
                from events
                """,
            ),
            (
                "spread",
                """
                select event_id, user_id, ts, own_hour, explode(hours) as frame_hour
                from (select e.event_id, e.user_id, e.ts,
                             case when k.hot_rows is not null then e.hour end as own_hour,
                             case when k.hot_rows is not null and e.hour is not null
                                  then array(e.hour, e.hour + interval 1 hour)
                                  else array(cast(null as timestamp_ntz)) end as hours
                      from hourly e left join hot_keys k on e.user_id <=> k.hot_key)
                """,
            ),
            (
                "counted",
                """
                select event_id, user_id, own_hour <=> frame_hour as own,
                       count(*) over (partition by user_id, frame_hour order by ts
                                      range between interval 1 hour preceding and current row) as n
                from spread
                """,
            ),
            ("result", "select event_id, user_id, n as events_in_hour from counted where own"),
        ),
        """
        select event_id, user_id,
               count(*) over (partition by user_id order by ts
                              range between interval 1 hour preceding and current row) as events_in_hour
        from events
        """,
    ),
    # Spark keeps at most three rows per key and task before the shuffle.
    one_step(
        "w6_top3",
        "orders",
        """
        select o_custkey, o_orderkey, o_totalprice
        from (select o_custkey, o_orderkey, o_totalprice,
                     row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn
              from orders)
        where rn <= 3
        """,
    ),
    Query(
        "w7_share",
        ("orders",),
        (
            *hot_keys("orders", "o_custkey"),
            (
                "hot_totals",
                """
                select h.hot_key, h.pieces, sum(o.o_totalprice) as total
                from orders o join hot_keys h on o.o_custkey <=> h.hot_key group by h.hot_key, h.pieces
                """,
            ),
            (
                "salted",
                """
                select o.o_orderkey, o.o_custkey, o.o_totalprice, t.total,
                       coalesce(pmod(xxhash64(o.o_orderkey), t.pieces), 0) as salt
                from orders o left join hot_totals t on o.o_custkey <=> t.hot_key
                """,
            ),
            (
                "result",
                """
                select o_orderkey, o_custkey,
                       round(o_totalprice / coalesce(
                           total, sum(o_totalprice) over (partition by o_custkey, salt)), 12) as share
                from salted
                """,
            ),
        ),
        """
        select o_orderkey, o_custkey,
               round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 12) as share
        from orders
        """,
    ),
]
