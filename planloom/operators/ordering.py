"""Sort, limit and set queries (S, U)."""

from planloom.operators.query import one_step

QUERIES = [
    one_step(
        "s1_top_k",
        "orders",
        """
        select o_orderkey, o_custkey, o_totalprice from orders
        order by o_totalprice desc nulls last, o_orderkey limit 10
        """,
    ),
    one_step(
        "s2_limit_offset",
        "orders",
        "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 10 offset 25",
    ),
    one_step(
        "u1_union_all",
        "customer supplier",
        """
        select c_nationkey as nationkey, c_acctbal as balance from customer
        union all select s_nationkey, s_acctbal from supplier
        """,
    ),
    one_step(
        "u2_union",
        "customer supplier",
        "select c_nationkey as nationkey from customer union select s_nationkey from supplier",
    ),
    # Spark compares with the right side as it comes; made distinct, it is reduced map-side first.
    one_step(
        "u3_intersect",
        "orders lineitem",
        """
        select o_orderkey as orderkey from orders where o_orderstatus = 'F'
        intersect select distinct l_orderkey from lineitem where l_returnflag = 'R'
        """,
    ),
    # The ALL forms shuffle one row and a count per distinct value, then repeat each value. The
    # values are pairs, so that the copies of one heavy part or customer come from many tasks.
    one_step(
        "u4_intersect_all",
        "lineitem",
        """
        select l_partkey, l_suppkey from lineitem where l_returnflag = 'R'
        intersect all select l_partkey, l_suppkey from lineitem where l_returnflag = 'N'
        """,
    ),
    one_step(
        "u5_except",
        "customer orders",
        """
        select c_custkey as custkey from customer
        except select distinct o_custkey from orders where o_totalprice > 450000
        """,
    ),
    one_step(
        "u6_except_all",
        "orders",
        """
        select o_custkey, o_orderdate from orders
        except all select o_custkey, o_orderdate from orders where o_orderstatus = 'F'
        """,
    ),
]
