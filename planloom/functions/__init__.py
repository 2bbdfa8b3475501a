"""SQL-defined functions used by catalogue plans.

Each text is a plan transformation of its own; the function lives in the session of
the plan that creates it and is inlined by the optimizer.
"""

NET_PRICE = """
create temporary function net_price(price double, discount double) returns double
return round(price * (1 - discount), 4)
"""

ORDERS_OVER = """
create temporary function orders_over(lowest double)
returns table (orderkey bigint, custkey bigint, totalprice double)
return select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > lowest
"""
