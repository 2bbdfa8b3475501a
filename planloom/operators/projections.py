"""Projection, filter and predicate queries (P, F)."""

from planloom.operators.hot_keys import hot_keys
from planloom.operators.query import Query, one_step

QUERIES = [
    one_step(
        "p1_computed_column",
        "lineitem",
        """
        select l_orderkey, l_partkey, l_linenumber,
               round(l_extendedprice * (1 - l_discount), 4) as net_price
        from lineitem
        """,
    ),
    one_step(
        "p2_drop_column",
        "customer",
        "select * except (c_acctbal) from customer",
        "select * exclude (c_acctbal) from customer",
    ),
    one_step("p3_distinct", "events", "select distinct user_id, event_type from events"),
    one_step(
        "f1_between_in_like",
        "orders",
        """
        select o_orderkey, o_custkey, o_totalprice, o_orderpriority
        from orders
        where o_totalprice between 100000 and 250000
          and o_orderstatus in ('F', 'P')
          and o_orderpriority like '%H%'
        """,
    ),
    one_step(
        "f2_regex",
        "part",
        "select p_partkey, p_name from part where p_name rlike '^[a-m].*e' and not p_name rlike 'ing$'",
        """
        select p_partkey, p_name from part
        where regexp_matches(p_name, '^[a-m].*e') and not regexp_matches(p_name, 'ing$')
        """,
    ),
    one_step(
        "f3_null_safe_equality",
        "documents labels",
        """
        select d.doc_id, d.lang, l.quality <=> l.toxic as same_label, l.quality <=> null as unlabelled
        from documents d left join labels l on d.doc_id = l.doc_id
        where l.quality <=> null or l.quality <=> 1
        """,
        """
        select d.doc_id, d.lang, l.quality is not distinct from l.toxic as same_label,
               l.quality is not distinct from null as unlabelled
        from documents d left join labels l on d.doc_id = l.doc_id
        where l.quality is not distinct from null or l.quality is not distinct from 1
        """,
    ),
    # The subquery side is reduced to one row per key before it is shuffled, so a customer
    # with very many orders costs one row per map task.
    Query(
        "f4_in_subquery",
        ("customer", "orders"),
        (
            (
                "urgent_buyers",
                "select distinct o_custkey from orders where o_orderpriority = '1-URGENT'",
            ),
            (
                "result",
                """
                select c_custkey, c_name from customer
                where c_custkey in (select o_custkey from urgent_buyers)
                """,
            ),
        ),
        """
        select c_custkey, c_name from customer
        where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')
        """,
    ),
    Query(
        "f5_not_exists",
        ("customer", "orders"),
        (
            ("large_buyers", "select distinct o_custkey from orders where o_totalprice > 450000"),
            (
                "result",
                """
                select c_custkey, c_name, c_mktsegment from customer c
                where not exists (select 1 from large_buyers b where b.o_custkey = c.c_custkey)
                """,
            ),
        ),
        """
        select c_custkey, c_name, c_mktsegment from customer c
        where not exists (
            select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 450000)
        """,
    ),
    # Each order is compared with its customer's average. The averages come from partial
    # aggregates; those of hot customers are repeated per salt, so that their orders are
    # compared in as many tasks as they have salts.
    Query(
        "f6_correlated_scalar_subquery",
        ("orders",),
        (
            *hot_keys("orders", "o_custkey"),
            (
                "salted_orders",
                """
                select o.*,
                       coalesce(pmod(xxhash64(o.o_orderkey), h.pieces), 0) as salt
                from orders o left join hot_keys h on o.o_custkey = h.hot_key
                """,
            ),
            (
                "typical_order",
                """
                select a.o_custkey, a.typical,
                       explode(sequence(cast(0 as bigint), coalesce(h.pieces, 1) - 1)) as salt
                from (select o_custkey, avg(o_totalprice) as typical from orders group by o_custkey) a
                     left join hot_keys h on a.o_custkey = h.hot_key
                """,
            ),
            (
                "result",
                """
                select o_orderkey, o_custkey, o_totalprice from salted_orders o
                where o_totalprice > (select 1.9 * max(t.typical) from typical_order t
                                      where t.o_custkey = o.o_custkey and t.salt = o.salt)
                """,
            ),
        ),
        """
        select o_orderkey, o_custkey, o_totalprice from orders o
        where o_totalprice > (select 1.9 * avg(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)
        """,
    ),
    one_step(
        "f7_conditional",
        "events",
        """
        select event_id,
               case when value < 10 then 'low' when value < 100 then 'middle' else 'high' end as band,
               coalesce(nullif(event_type, 'view'), 'other') as kind,
               nullif(user_id, 0) as nonzero_user
        from events
        """,
    ),
]
