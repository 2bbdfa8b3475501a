"""Join queries (J)."""

from planloom.operators.query import Query, one_step
from planloom.operators.hot_keys import banded

QUERIES = [
    one_step(
        "j1_inner",
        "orders customer",
        """
        select o.o_orderkey, c.c_name, c.c_mktsegment
        from orders o join customer c on o.o_custkey = c.c_custkey
        """,
    ),
    # In the outer, semi and anti joins the many-rows side is the preserved side: that is
    # the side adaptive execution can split when one key is skewed.
    one_step(
        "j2_left_outer",
        "orders customer",
        """
        select o.o_orderkey, o.o_custkey, c.c_name
        from orders o left join customer c on o.o_custkey = c.c_custkey and c.c_mktsegment = 'BUILDING'
        """,
    ),
    one_step(
        "j3_right_outer",
        "part lineitem",
        """
        select l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_quantity, p.p_name
        from part p right join lineitem l on p.p_partkey = l.l_partkey and p.p_size > 40
        """,
    ),
    # Neither side of a full join can be split, so both are one row per key beforehand; the
    # join then needs no shuffle beyond those of the two aggregations.
    one_step(
        "j4_full_outer",
        "orders",
        """
        select coalesce(u.o_custkey, f.o_custkey) as custkey, u.urgent_orders, f.large_orders
        from (select o_custkey, count(*) as urgent_orders from orders
              where o_orderpriority = '1-URGENT' group by o_custkey) u
             full join
             (select o_custkey, count(*) as large_orders from orders
              where o_totalprice > 450000 group by o_custkey) f
             on u.o_custkey = f.o_custkey
        """,
    ),
    one_step(
        "j5_left_semi",
        "orders customer",
        """
        select o_orderkey, o_custkey from orders
        left semi join customer on o_custkey = c_custkey and c_acctbal > 5000
        """,
        """
        select o_orderkey, o_custkey from orders
        semi join customer on o_custkey = c_custkey and c_acctbal > 5000
        """,
    ),
    Query(
        "j6_left_anti",
        ("customer", "orders"),
        (
            ("large_buyers", "select distinct o_custkey from orders where o_totalprice > 450000"),
            (
                "result",
                "select c_custkey, c_name from customer left anti join large_buyers on c_custkey = o_custkey",
            ),
        ),
        """
        select c_custkey, c_name from customer
        anti join (select * from orders where o_totalprice > 450000) on c_custkey = o_custkey
        """,
    ),
    # The right side is a global aggregate: one row by construction.
    one_step(
        "j7_cross",
        "customer",
        """
        select /*+ broadcast(g) */ c.c_custkey, c.c_acctbal < g.mean as below_mean, round(c.c_acctbal - g.lowest, 2) as above_lowest
        from customer c cross join (select avg(c_acctbal) as mean, min(c_acctbal) as lowest from customer) g
        """,
    ),
    # Orders paired with the one placed right after them: equal on the key, unequal on the date.
    one_step(
        "j8_self_join",
        "orders",
        """
        select a.o_orderkey, b.o_orderkey as next_orderkey, a.o_custkey, b.o_custkey as next_custkey
        from orders a join orders b on b.o_orderkey = a.o_orderkey + 1 and b.o_orderdate > a.o_orderdate
        """,
    ),
    # Both sides are keyed by (user, hour): a click goes to its own hour and the next one, a
    # purchase to its own, so each pair meets once and a busy user is spread over the hours.
    Query(
        "j9_interval_join",
        ("events",),
        (
            (
                "clicks",
                """
                select event_id, user_id, ts,
                       explode(array(window(ts, '1 hour').start,
                                     window(ts, '1 hour').start + interval 1 hour)) as hour
                from events where event_type = 'click'
                """,
            ),
            (
                "purchases",
                """
                select event_id, user_id, ts, window(ts, '1 hour').start as hour
                from events where event_type = 'purchase'
                """,
            ),
            (
                "result",
                """
                select c.event_id as click_id, p.event_id as purchase_id, c.user_id
                from clicks c join purchases p
                  on c.user_id = p.user_id and c.hour = p.hour
                 and p.ts between c.ts and c.ts + interval 1 hour
                """,
            ),
        ),
        """
        select c.event_id as click_id, p.event_id as purchase_id, c.user_id
        from events c join events p
          on c.user_id = p.user_id and p.ts between c.ts and c.ts + interval 1 hour
        where c.event_type = 'click' and p.event_type = 'purchase'
        """,
    ),
    # The bands are the three literal rows of the query text.
    one_step(
        "j10_range_join",
        "part",
        """
        select /*+ broadcast(b) */ p.p_partkey, p.p_retailprice, b.band
        from part p join (values ('low', 0, 1000), ('middle', 1000, 1500), ('high', 1500, 1000000))
                         as b(band, lowest, below)
          on p.p_retailprice >= b.lowest and p.p_retailprice < b.below
        """,
    ),
    # Revenue is reduced to one row per order, then per customer, before the wider joins.
    # nation and region have a fixed number of rows; supplier-sized tables are not hinted.
    Query(
        "j11_star_join",
        ("lineitem", "orders", "customer", "nation", "region"),
        (
            (
                "order_revenue",
                """
                select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as revenue, count(*) as lines
                from lineitem group by l_orderkey
                """,
            ),
            (
                "customer_revenue",
                """
                select o.o_custkey, sum(r.revenue) as revenue, sum(r.lines) as lines
                from order_revenue r join orders o on r.l_orderkey = o.o_orderkey
                group by o.o_custkey
                """,
            ),
            (
                "result",
                """
                select /*+ broadcast(n), broadcast(g) */ g.r_name, n.n_name,
                       round(sum(v.revenue), 4) as revenue, sum(v.lines) as lines
                from customer_revenue v
                     join customer c on v.o_custkey = c.c_custkey
                     join nation n on c.c_nationkey = n.n_nationkey
                     join region g on n.n_regionkey = g.r_regionkey
                group by g.r_name, n.n_name
                """,
            ),
        ),
        """
        select g.r_name, n.n_name,
               round(sum(l.l_extendedprice * (1 - l.l_discount)), 4) as revenue, count(*) as lines
        from lineitem l
             join orders o on l.l_orderkey = o.o_orderkey
             join customer c on o.o_custkey = c.c_custkey
             join nation n on c.c_nationkey = n.n_nationkey
             join region g on n.n_regionkey = g.r_regionkey
        group by g.r_name, n.n_name
        """,
    ),
    # The limit becomes a per-customer row limit that is applied before the shuffle as well.
    one_step(
        "j12_lateral_top2",
        "customer orders",
        """
        select c.c_custkey, t.o_orderkey, t.o_totalprice
        from customer c, lateral (
            select o_orderkey, o_totalprice from orders o where o.o_custkey = c.c_custkey
            order by o_totalprice desc, o_orderkey limit 2) t
        """,
    ),
    # As-of join: the latest view at or before each purchase of the same user, from one pass
    # over one relation. Views come before purchases of the same time, those without a time never. Pieces of hot users start from what earlier ones carry over.
    Query(
        "j13_as_of",
        ("events",),
        (
            (
                "activity",
                """
                select event_id, user_id, ts, event_type = 'purchase' as is_purchase,
                       -- views first among events of one time
                       event_id + if(event_type = 'purchase', 1L << 62, 0) as place,
                       case when event_type = 'view' then event_id end as view_id
                from events
                where event_type = 'purchase' or (event_type = 'view' and user_id is not null and ts is not null)
                """,
            ),
            *banded("activity", "user_id", "ts", "place"),
            (
                "carried",
                """
                select user_id, piece,
                       last_value(last_view, true) over (
                           partition by user_id order by piece
                           rows between unbounded preceding and 1 preceding) as carried_view
                from (select user_id, piece, max_by(view_id, struct(ts, event_id))
                                 filter (where view_id is not null) as last_view
                      from banded where hot_rows is not null group by user_id, piece)
                """,
            ),
            (
                "latest",
                """
                select b.event_id, b.user_id, b.is_purchase,
                       coalesce(last_value(b.view_id, true) over (
                                    partition by b.user_id, b.piece order by b.ts, b.place
                                    rows between unbounded preceding and current row),
                                k.carried_view) as view_id
                from banded b left join carried k on b.user_id <=> k.user_id and b.piece = k.piece
                """,
            ),
            ("result", "select event_id as purchase_id, user_id, view_id from latest where is_purchase"),
        ),
        """
        select p.event_id as purchase_id, p.user_id, v.event_id as view_id
        from (select * from events where event_type = 'purchase') p
             asof left join (select * from events where event_type = 'view') v
             on p.user_id = v.user_id and v.ts <= p.ts
        """,
    ),
    one_step(
        "j14_using",
        "documents labels",
        "select doc_id, lang, quality, toxic from documents join labels using (doc_id)",
    ),
    one_step(
        "j14_natural_left",
        "documents labels",
        "select doc_id, lang, quality, toxic from documents natural left join labels",
    ),
]
