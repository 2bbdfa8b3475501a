"""Aggregation queries (A). All of them reduce map-side before the shuffle."""

from planloom.operators.query import Query, one_step

QUERIES = [
    one_step(
        "a1_global",
        "orders",
        """
        select count(*) as orders, count(distinct o_custkey) as customers,
               min(o_totalprice) as lowest, max(o_totalprice) as highest,
               round(avg(o_totalprice), 6) as mean, round(sum(o_totalprice), 2) as total
        from orders
        """,
    ),
    one_step(
        "a2_pricing_summary",
        "lineitem",
        """
        select l_returnflag, l_linestatus,
               round(sum(l_quantity), 2) as sum_qty,
               round(sum(l_extendedprice), 2) as sum_base_price,
               round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc_price,
               round(avg(l_quantity), 6) as avg_qty,
               round(avg(l_discount), 6) as avg_disc,
               count(*) as count_order
        from lineitem
        where l_shipdate <= timestamp_ntz'2001-06-01 00:00:00'
        group by all
        """,
        """
        select l_returnflag, l_linestatus,
               round(sum(l_quantity), 2) as sum_qty,
               round(sum(l_extendedprice), 2) as sum_base_price,
               round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc_price,
               round(avg(l_quantity), 6) as avg_qty,
               round(avg(l_discount), 6) as avg_disc,
               count(*) as count_order
        from lineitem
        where l_shipdate <= timestamp '2001-06-01 00:00:00'
        group by all
        """,
    ),
    one_step(
        "a3_having",
        "orders",
        """
        select o_custkey, count(*) as orders, round(sum(o_totalprice), 2) as total
        from orders group by o_custkey having count(*) >= 15
        """,
    ),
    one_step(
        "a4_filtered_distinct",
        "events",
        """
        select event_type, count(*) as n, count(*) filter (where value > 50) as large,
               count(distinct user_id) as users
        from events group by event_type
        """,
    ),
    one_step(
        "a5_rollup",
        "orders",
        """
        select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total
        from orders group by rollup (o_orderstatus, o_orderpriority)
        """,
    ),
    one_step(
        "a6_cube",
        "orders",
        """
        select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total
        from orders group by cube (o_orderstatus, o_orderpriority)
        """,
    ),
    one_step(
        "a7_grouping_sets",
        "orders",
        """
        select o_orderstatus, o_orderpriority, count(*) as n,
               cast(grouping_id(o_orderstatus, o_orderpriority) as bigint) as level
        from orders
        group by grouping sets ((o_orderstatus), (o_orderpriority), ())
        """,
    ),
    one_step(
        "a8_moments",
        "events",
        """
        select event_type, round(stddev_samp(value), 6) as sd, round(var_pop(value), 6) as variance,
               round(corr(value, user_id), 6) as correlation
        from events group by event_type
        """,
    ),
    # Percentiles keep one counter per distinct value; l_quantity is a small integer range,
    # so the state stays small however many rows a group has.
    one_step(
        "a9_percentiles",
        "lineitem",
        """
        select l_returnflag, round(percentile(l_quantity, 0.25), 6) as q1,
               round(percentile_cont(0.9) within group (order by l_quantity), 6) as p90,
               round(median(l_quantity), 6) as middle
        from lineitem group by l_returnflag
        """,
        """
        select l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) as q1,
               round(quantile_cont(l_quantity, 0.9), 6) as p90,
               round(median(l_quantity), 6) as middle
        from lineitem group by l_returnflag
        """,
    ),
    # Estimates are not portable between engines, so the result says whether they are close to the exact count. In one aggregation
    # with the exact count Spark would keep a sketch (13 KB) for each user of a type; in one of its own there is one for each type.
    Query(
        "a10_approximate_distinct",
        ("events",),
        (
            (
                "estimates",
                "select event_type, approx_count_distinct(user_id, 0.01) as estimate from events group by event_type",
            ),
            ("counts", "select event_type, count(distinct user_id) as exact from events group by event_type"),
            (
                "result",
                """
                select c.event_type, abs(e.estimate - c.exact) <= 0.05 * c.exact as close
                from counts c join estimates e on c.event_type <=> e.event_type
                """,
            ),
        ),
        "select distinct event_type, true as close from events",
    ),
    # The collected list holds distinct nation names: at most one per nation and segment.
    one_step(
        "a11_ordered_strings",
        "customer nation",
        """
        select s.c_mktsegment,
               array_join(sort_array(collect_list(s.n_name)), ',') as nations,
               listagg(s.n_name, '|') within group (order by s.n_name desc) as nations_desc
        from (select /*+ broadcast(n) */ distinct c.c_mktsegment, n.n_name
              from customer c join nation n on c.c_nationkey = n.n_nationkey) s
        group by s.c_mktsegment
        """,
        """
        select s.c_mktsegment,
               string_agg(s.n_name, ',' order by s.n_name) as nations,
               string_agg(s.n_name, '|' order by s.n_name desc) as nations_desc
        from (select distinct c.c_mktsegment, n.n_name
              from customer c join nation n on c.c_nationkey = n.n_nationkey) s
        group by s.c_mktsegment
        """,
    ),
    one_step(
        "a12_arg_extremes",
        "orders",
        """
        select o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) as dearest,
               min_by(o_orderkey, struct(o_totalprice, o_orderkey)) as cheapest,
               bool_or(o_totalprice > 400000) as any_large, bool_and(o_totalprice > 10000) as all_over
        from orders group by o_custkey
        """,
        """
        select o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as dearest,
               arg_min(o_orderkey, (o_totalprice, o_orderkey)) as cheapest,
               bool_or(o_totalprice > 400000) as any_large, bool_and(o_totalprice > 10000) as all_over
        from orders group by o_custkey
        """,
    ),
    one_step(
        "a13_pivot",
        "orders",
        """
        select * from (select o_orderpriority, o_orderstatus from orders)
        pivot (count(*) for o_orderstatus in ('F' as finished, 'O' as open, 'P' as pending))
        """,
        """
        select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as finished,
               count(*) filter (where o_orderstatus = 'O') as open,
               count(*) filter (where o_orderstatus = 'P') as pending
        from orders group by o_orderpriority
        """,
    ),
    one_step(
        "a14_unpivot",
        "supplier",
        """
        select s_suppkey, measure, amount
        from (select s_suppkey, s_acctbal as balance, cast(s_nationkey as double) as nation from supplier)
        unpivot (amount for measure in (balance, nation))
        """,
        """
        select s_suppkey, 'balance' as measure, s_acctbal as amount from supplier
        union all select s_suppkey, 'nation', cast(s_nationkey as double) from supplier
        """,
    ),
    one_step(
        "a15_calendar_bucket",
        "orders",
        """
        select cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n,
               round(sum(o_totalprice), 2) as total
        from orders group by date_trunc('month', o_orderdate)
        """,
    ),
    one_step(
        "a16_tumbling_window",
        "events",
        """
        select window.start as window_start, count(*) as n, round(sum(value), 2) as total
        from events group by window(ts, '1 hour')
        """,
        """
        select time_bucket(interval 1 hour, ts) as window_start, count(*) as n, round(sum(value), 2) as total
        from events group by all
        """,
    ),
    one_step(
        "a17_sliding_window",
        "events",
        """
        select window.start as window_start, window.end as window_end, count(*) as n
        from events group by window(ts, '1 hour', '30 minutes')
        """,
        """
        select window_start, window_start + interval 1 hour as window_end, count(*) as n
        from (select unnest([time_bucket(interval 30 minute, ts),
                             time_bucket(interval 30 minute, ts) - interval 30 minute]) as window_start
              from events)
        group by all
        """,
    ),
    # Events of one user within the same half hour always share a session, so they are first
    # reduced to one row per user and half hour. What is left to put in sequence per user is
    # bounded by the time span covered, not by the number of events.
    Query(
        "a18_session_window",
        ("events",),
        (
            (
                "half_hours",
                """
                select user_id, min(ts) as first_ts, max(ts) - min(ts) as covered, count(*) as n, sum(value) as total
                from events group by user_id, window(ts, '30 minutes')
                """,
            ),
            (
                "result",
                """
                select user_id, session_window.start as session_start, session_window.end as session_end,
                       sum(n) as events, round(sum(total), 2) as total
                from half_hours
                group by user_id, session_window(first_ts, make_interval(
                    0, 0, 0, 0, 0, 30 + extract(minute from covered), extract(second from covered)))
                """,
            ),
        ),
        """
        with flagged as (
            select *, case when ts > lag(ts) over (partition by user_id order by ts) + interval 30 minute
                           then 1 else 0 end as fresh
            from events),
        numbered as (
            select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session
            from flagged)
        select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end,
               count(*) as events, round(sum(value), 2) as total
        from numbered group by user_id, session
        """,
    ),
]
