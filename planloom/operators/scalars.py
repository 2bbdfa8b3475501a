"""Scalar functions, nested data, query structure and SQL-defined functions (X, Q, Y)."""

from planloom.functions import NET_PRICE, ORDERS_OVER
from planloom.operators.query import Query, one_step

QUERIES = [
    one_step(
        "x1_strings",
        "customer",
        """
        select c_custkey, upper(c_name) as up, substr(c_name, 3, 6) as part, concat(c_name, '-', c_mktsegment) as both,
               cast(length(c_name) as bigint) as len, lpad(cast(c_custkey as string), 8, '0') as padded,
               trim(concat('  ', c_mktsegment, ' ')) as trimmed, replace(c_name, 'Customer', 'C') as shorter,
               cast(instr(c_name, '#') as bigint) as hash_at, split_part(c_name, '#', 2) as digits,
               regexp_replace(c_name, '[0-9]+', 'N') as masked, regexp_extract(c_name, '([0-9]+)', 1) as found,
               reverse(c_mktsegment) as backwards, translate(c_mktsegment, 'AEI', 'aei') as translated,
               initcap(c_mktsegment) as capital
        from customer
        """,
        """
        select c_custkey, upper(c_name) as up, substr(c_name, 3, 6) as part, concat(c_name, '-', c_mktsegment) as both,
               length(c_name) as len, lpad(cast(c_custkey as varchar), 8, '0') as padded,
               trim(concat('  ', c_mktsegment, ' ')) as trimmed, replace(c_name, 'Customer', 'C') as shorter,
               instr(c_name, '#') as hash_at, split_part(c_name, '#', 2) as digits,
               regexp_replace(c_name, '[0-9]+', 'N') as masked, regexp_extract(c_name, '([0-9]+)', 1) as found,
               reverse(c_mktsegment) as backwards, translate(c_mktsegment, 'AEI', 'aei') as translated,
               upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as capital
        from customer
        """,
    ),
    one_step(
        "x2_dates",
        "orders",
        """
        select o_orderkey, cast(year(d) as bigint) as y, cast(quarter(d) as bigint) as q, cast(month(d) as bigint) as m,
               cast(date_trunc('quarter', d) as date) as quarter_start, date_add(d, 7) as next_week,
               cast(datediff(date'2002-01-01', d) as bigint) as days_left, add_months(d, 1) as next_month,
               last_day(d) as month_end, date_format(d, 'yyyy/MM/dd') as shown,
               cast(dayofyear(d) as bigint) as doy, cast(weekofyear(d) as bigint) as woy
        from (select o_orderkey, cast(o_orderdate as date) as d from orders)
        """,
        """
        select o_orderkey, year(d) as y, quarter(d) as q, month(d) as m,
               cast(date_trunc('quarter', d) as date) as quarter_start, d + 7 as next_week,
               date_diff('day', d, date '2002-01-01') as days_left, cast(d + interval 1 month as date) as next_month,
               last_day(d) as month_end, strftime(d, '%Y/%m/%d') as shown,
               dayofyear(d) as doy, weekofyear(d) as woy
        from (select o_orderkey, cast(o_orderdate as date) as d from orders)
        """,
    ),
    one_step(
        "x3_math",
        "part",
        """
        select p_partkey, abs(p_retailprice - 1000) as distance, ceil(p_retailprice) as up, floor(p_retailprice) as down,
               round(sqrt(p_retailprice), 6) as root, round(power(p_size, 1.5), 6) as powered,
               round(ln(p_retailprice), 6) as logged, p_partkey % 7 as remainder, p_partkey div 7 as quotient,
               greatest(p_size, 25) as at_least, least(p_size, 25) as at_most,
               cast(sign(p_size - 25) as bigint) as side, cast(p_retailprice as decimal(12, 2)) as exact
        from part
        """,
        """
        select p_partkey, abs(p_retailprice - 1000) as distance, cast(ceil(p_retailprice) as bigint) as up,
               cast(floor(p_retailprice) as bigint) as down,
               round(sqrt(p_retailprice), 6) as root, round(power(p_size, 1.5), 6) as powered,
               round(ln(p_retailprice), 6) as logged, p_partkey % 7 as remainder, p_partkey // 7 as quotient,
               greatest(p_size, 25) as at_least, least(p_size, 25) as at_most,
               cast(sign(p_size - 25) as bigint) as side, cast(p_retailprice as decimal(12, 2)) as exact
        from part
        """,
    ),
    one_step(
        "x4_array_lambdas",
        "embeddings",
        """
        select vec_id, cast(size(embedding) as bigint) as dims,
               round(aggregate(embedding, 0.0D, (sum, x) -> sum + x * x), 6) as squared,
               cast(size(filter(embedding, x -> x > 0)) as bigint) as positives,
               cast(array_max(embedding) as double) as largest, cast(element_at(embedding, -1) as double) as final,
               exists(embedding, x -> x > 0.3) as any_large,
               cast(array_min(slice(embedding, 2, 3)) as double) as early_low
        from embeddings
        """,
        """
        select vec_id, len(embedding) as dims,
               round(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))), 6) as squared,
               len(list_filter(embedding, lambda x: x > 0)) as positives,
               cast(list_max(embedding) as double) as largest, cast(embedding[-1] as double) as final,
               len(list_filter(embedding, lambda x: cast(x as double) > 0.3)) > 0 as any_large,
               cast(list_min(embedding[2:4]) as double) as early_low
        from embeddings
        """,
    ),
    one_step(
        "x5_posexplode",
        "embeddings",
        """
        select vec_id, cast(pos as bigint) as pos, cast(x as double) as x
        from embeddings lateral view posexplode(embedding) v as pos, x
        """,
        """
        select vec_id, i as pos, cast(embedding[i + 1] as double) as x
        from (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings)
        """,
    ),
    one_step(
        "x6_json",
        "events",
        """
        select event_id, get_json_object(props, '$.k') as k_text,
               from_json(props, 'k bigint').k as k, get_json_object(props, '$.missing') as missing
        from events
        """,
        """
        select event_id, json_extract_string(props, '$.k') as k_text,
               cast(json_extract_string(props, '$.k') as bigint) as k,
               json_extract_string(props, '$.missing') as missing
        from events
        """,
    ),
    one_step(
        "x7_word_count",
        "documents",
        r"""
        select word, count(*) as n
        from (select explode(split(text, '[ \n]+')) as word from documents)
        group by word
        """,
        r"""
        select word, count(*) as n
        from (select unnest(regexp_split_to_array(text, '[ \n]+')) as word from documents)
        group by word
        """,
    ),
    one_step(
        "x8_map_struct",
        "events",
        """
        select event_id, m[event_type] as amount, element_at(map_keys(m), 1) as only_key,
               cast(size(m) as bigint) as entries, s.kind, s.who
        from (select event_id, event_type, map(event_type, value) as m,
                     named_struct('kind', event_type, 'who', user_id) as s
              from events)
        """,
        """
        select event_id, value as amount, event_type as only_key, cast(1 as bigint) as entries,
               event_type as kind, user_id as who
        from events
        """,
    ),
    one_step(
        "x9_cast_hash",
        "customer",
        """
        select c_custkey, cast(c_custkey as string) as as_text, try_cast(c_name as int) as never,
               try_cast(substr(c_name, 10) as bigint) as parsed, md5(c_name) as m, sha2(c_name, 256) as s
        from customer
        """,
        """
        select c_custkey, cast(c_custkey as varchar) as as_text, try_cast(c_name as int) as never,
               try_cast(substr(c_name, 10) as bigint) as parsed, md5(c_name) as m, sha256(c_name) as s
        from customer
        """,
    ),
    one_step(
        "x10_sequence",
        "orders",
        """
        select o_custkey, explode(sequence(first_year, last_year)) as active_year
        from (select o_custkey, cast(min(year(o_orderdate)) as bigint) as first_year,
                     cast(max(year(o_orderdate)) as bigint) as last_year
              from orders group by o_custkey)
        """,
        """
        select o_custkey, unnest(generate_series(first_year, last_year)) as active_year
        from (select o_custkey, min(year(o_orderdate)) as first_year, max(year(o_orderdate)) as last_year
              from orders group by o_custkey)
        """,
    ),
    one_step(
        "x11_bits",
        "part",
        """
        select p_partkey, cast(bit_count(p_partkey) as bigint) as bits, p_size & 12 as masked, p_size | 3 as combined,
               p_size ^ 5 as toggled, shiftleft(p_size, 2) as shifted, hex(p_partkey) as hexed
        from part
        """,
        """
        select p_partkey, cast(bit_count(p_partkey) as bigint) as bits, p_size & 12 as masked, p_size | 3 as combined,
               xor(p_size, 5) as toggled, p_size << 2 as shifted, hex(p_partkey) as hexed
        from part
        """,
    ),
    # Exact decimals: the same total must come out each time the expression is evaluated. With
    # the null filter spelled out, both uses of the common table have the same plan and the
    # aggregation over lineitem runs once.
    one_step(
        "q1_cte_scalar_subquery",
        "lineitem supplier",
        """
        with revenue as (
            select l_suppkey, sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as total
            from lineitem where l_suppkey is not null group by l_suppkey)
        select s.s_suppkey, s.s_name, cast(r.total as double) as total
        from supplier s join revenue r on s.s_suppkey = r.l_suppkey
        where r.total = (select max(total) from revenue)
        """,
    ),
    # The recursion halves the span of years until every span is one year, so its depth grows with
    # the logarithm of the span.
    one_step(
        "q2_recursive_cte",
        "orders",
        """
        with recursive spans(low, high) as (
            select cast(min(year(o_orderdate)) as bigint), cast(max(year(o_orderdate)) as bigint) from orders
            union all
            select if(half = 0, low, (low + high) div 2 + 1), if(half = 0, (low + high) div 2, high)
            from spans cross join (values (0), (1)) as halves(half) where low < high)
        select s.low as y, coalesce(o.n, 0) as orders
        from (select low from spans where low = high) s
             left join (select year(o_orderdate) as y, count(*) as n from orders group by year(o_orderdate)) o
             on s.low = o.y
        """,
        """
        select r.y, coalesce(o.n, 0) as orders
        from (select unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) as y from orders) r
             left join (select year(o_orderdate) as y, count(*) as n from orders group by year(o_orderdate)) o using (y)
        """,
    ),
    one_step(
        "q3_pipe_syntax",
        "orders",
        """
        from orders
        |> where o_totalprice > 250000
        |> extend o_totalprice / 1000 as thousands
        |> aggregate count(*) as n, round(max(thousands), 6) as highest group by o_orderstatus
        """,
        """
        select o_orderstatus, count(*) as n, round(max(o_totalprice / 1000), 6) as highest
        from orders where o_totalprice > 250000 group by o_orderstatus
        """,
    ),
    # Hours are counted before they meet the range, so the join sees at most 24 rows a side.
    one_step(
        "q4_range",
        "events",
        """
        select r.id as hour, coalesce(e.n, 0) as events
        from range(0, 24) r
             left join (select hour(ts) as h, count(*) as n from events group by hour(ts)) e on r.id = e.h
        """,
        """
        select r.range as hour, coalesce(e.n, 0) as events
        from range(0, 24) r
             left join (select hour(ts) as h, count(*) as n from events group by hour(ts)) e on r.range = e.h
        """,
    ),
    Query(
        "q5_fragment_target",
        ("orders", "customer"),
        (("pending", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'P'"),),
        """
        select o_orderkey, o_custkey, o_totalprice from orders
        where o_orderstatus = 'P' and o_totalprice > 300000
          and o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')
        """,
        result="""pending where o_totalprice > 300000
                  and o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')""",
    ),
    Query(
        "y1_sql_scalar_function",
        ("lineitem",),
        (
            ("define", NET_PRICE),
            (
                "result",
                """
                select l_orderkey, l_partkey, l_linenumber, net_price(l_extendedprice, l_discount) as net_price
                from lineitem
                """,
            ),
        ),
        """
        select l_orderkey, l_partkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net_price
        from lineitem
        """,
    ),
    Query(
        "y2_sql_table_function",
        ("orders",),
        (("define", ORDERS_OVER), ("result", "select * from orders_over(400000)")),
        """
        select o_orderkey as orderkey, o_custkey as custkey, o_totalprice as totalprice
        from orders where o_totalprice > 400000
        """,
    ),
]
