"""Further Spark SQL that plans use as it is: one query per family of constructs."""

from planloom.operators.query import Query, one_step

QUERIES = [
    # --- projection, predicates ---
    one_step(
        "p4_lateral_alias",
        "lineitem",
        """
        select l_orderkey, l_partkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net,
               round(net * (1 + l_tax), 6) as gross, gross > 50000 as is_large
        from lineitem
        """,
        """
        select * exclude (tax), gross > 50000 as is_large
        from (select *, round(net * (1 + tax), 6) as gross
              from (select l_orderkey, l_partkey, l_linenumber, l_tax as tax,
                           round(l_extendedprice * (1 - l_discount), 4) as net
                    from lineitem))
        """,
    ),
    one_step(
        "f8_like_any_ilike",
        "part",
        """
        select p_partkey, p_name, p_type from part
        where p_name like any ('red%', '%ring') and p_type ilike 'eco%' and not p_name like all ('%a%', '%e%')
        """,
        """
        select p_partkey, p_name, p_type from part
        where (p_name like 'red%' or p_name like '%ring') and p_type ilike 'eco%'
          and not (p_name like '%a%' and p_name like '%e%')
        """,
    ),
    one_step(
        "f9_null_handling",
        "documents labels",
        """
        select d.doc_id, ifnull(l.quality, -1) as quality, nvl2(l.toxic, 'seen', 'unseen') as state,
               isnull(l.quality) as missing, decode(l.quality, 0, 'bad', 1, 'good', 'unknown') as verdict,
               cast(greatest(l.quality, l.toxic, 0) as bigint) as worst
        from documents d left join labels l on d.doc_id = l.doc_id
        """,
        """
        select d.doc_id, ifnull(l.quality, -1) as quality,
               case when l.toxic is not null then 'seen' else 'unseen' end as state,
               l.quality is null as missing,
               case l.quality when 0 then 'bad' when 1 then 'good' else 'unknown' end as verdict,
               cast(greatest(coalesce(l.quality, 0), coalesce(l.toxic, 0), 0) as bigint) as worst
        from documents d left join labels l on d.doc_id = l.doc_id
        """,
    ),
    one_step(
        "f10_try_functions",
        "lineitem",
        """
        select l_orderkey, l_partkey, l_linenumber, l_discount,
               try_divide(1, cast(round(l_discount * 100) as int)) is null as no_discount,
               try_to_number(l_returnflag, '9') is null as not_numeric,
               round(try_divide(l_extendedprice, l_quantity), 9) as unit_price
        from lineitem
        """,
        """
        select l_orderkey, l_partkey, l_linenumber, l_discount, l_discount = 0 as no_discount, true as not_numeric,
               round(l_extendedprice / l_quantity, 9) as unit_price
        from lineitem
        """,
    ),
    # --- joins ---
    one_step(
        "j15_lateral_explode",
        "embeddings",
        """
        select e.vec_id, v.pos, v.weight
        from embeddings e, lateral (
            select cast(pos as bigint) as pos, cast(x as double) as weight
            from posexplode(e.embedding) as t(pos, x)) v
        where v.weight > 0
        """,
        """
        select vec_id, pos, weight
        from (select vec_id, pos, cast(embedding[pos + 1] as double) as weight
              from (select vec_id, embedding, unnest(range(len(embedding))) as pos from embeddings))
        where weight > 0
        """,
    ),
    one_step(
        "j16_multi_key",
        "conversations",
        """
        select a.conv_id, a.turn, a.role, b.role as reply_role,
               cast(length(b.text) - length(a.text) as bigint) as grows_by
        from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1
        """,
        """
        select a.conv_id, a.turn, a.role, b.role as reply_role, length(b.text) - length(a.text) as grows_by
        from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1
        """,
    ),
    # --- aggregates ---
    one_step(
        "a19_counting",
        "events",
        """
        select user_id, count_if(event_type = 'error') as errors, sum(if(value > 50, 1, 0)) as large,
               bit_or(try_cast(value as bigint)) as any_bits, bit_and(try_cast(value as bigint)) as all_bits,
               every(value >= 0) as none_negative, some(event_type = 'signup') as signed_up
        from events group by user_id
        """,
        """
        select user_id, count(*) filter (where event_type = 'error') as errors,
               count(*) filter (where value > 50) as large,
               bit_or(try_cast(trunc(value) as bigint)) as any_bits,
               bit_and(try_cast(trunc(value) as bigint)) as all_bits,
               bool_and(value >= 0) as none_negative, bool_or(event_type = 'signup') as signed_up
        from events group by user_id
        """,
    ),
    one_step(
        "a20_regression",
        "lineitem",
        """
        select l_returnflag, regr_count(l_extendedprice, l_quantity) as n,
               round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
               round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
               round(regr_r2(l_extendedprice, l_quantity), 6) as r2,
               round(covar_pop(l_extendedprice, l_quantity), 3) as covariance
        from lineitem group by l_returnflag
        """,
        """
        select l_returnflag, cast(regr_count(l_extendedprice, l_quantity) as bigint) as n,
               round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
               round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
               round(regr_r2(l_extendedprice, l_quantity), 6) as r2,
               round(covar_pop(l_extendedprice, l_quantity), 3) as covariance
        from lineitem group by l_returnflag
        """,
    ),
    # A set of event types per user has at most as many members as there are types.
    one_step(
        "a21_sets",
        "events",
        """
        select user_id, cast(size(collect_set(event_type)) as bigint) as kinds,
               array_join(array_sort(collect_set(event_type)), '+') as profile
        from events group by user_id
        """,
        """
        select user_id, count(distinct event_type) as kinds,
               string_agg(distinct event_type, '+' order by event_type) as profile
        from events group by user_id
        """,
    ),
    one_step(
        "a22_pivot_two_measures",
        "events",
        """
        select * from (select user_id, event_type, value from events)
        pivot (count(*) as n, round(max(value), 2) as top for event_type in ('view' as views, 'purchase' as buys))
        """,
        """
        select user_id, nullif(count(*) filter (where event_type = 'view'), 0) as views_n,
               round(max(value) filter (where event_type = 'view'), 2) as views_top,
               nullif(count(*) filter (where event_type = 'purchase'), 0) as buys_n,
               round(max(value) filter (where event_type = 'purchase'), 2) as buys_top
        from events group by user_id
        """,
    ),
    # Each estimate must lie between two exact order statistics; see the tests.
    Query(
        "a23_approximate_percentiles",
        ("events",),
        (
            # Three rows per event type.
            (
                "estimates",
                """
                select event_type, s.share, s.estimate
                from (select event_type, percentile_approx(value, array(0.1, 0.5, 0.9), 10000) as p
                      from events group by event_type)
                     lateral view inline(transform(array(0.1D, 0.5D, 0.9D),
                         (share, i) -> named_struct('share', share, 'estimate', p[i]))) s
                """,
            ),
            (
                "result",
                """
                select event_type, share,
                       count_if(value < estimate) <= share * count(value) + greatest(1, count(value) / 10000)
                       and count_if(value <= estimate) >= share * count(value) - greatest(1, count(value) / 10000) as close
                from events join estimates using (event_type) group by event_type, share
                """,
            ),
        ),
        """
        select event_type, share, true as close
        from (select distinct event_type from events), (values (0.1::double), (0.5::double), (0.9::double)) as shares(share)
        """,
    ),
    # --- scalar functions ---
    one_step(
        "x12_more_strings",
        "part",
        """
        select p_partkey, concat_ws('/', p_brand, p_type) as path, cast(levenshtein(p_name, p_type) as bigint) as distance,
               repeat(left(p_type, 1), 3) as tripled, right(p_brand, 2) as tail, rpad(p_brand, 10, '.') as dotted,
               startswith(p_name, 'red') as is_red, contains(p_name, 'ing') as has_ing,
               substring_index(p_name, ' ', 1) as first_word, cast(ascii(p_type) as bigint) as code,
               base64(encode(p_type, 'utf-8')) as encoded
        from part
        """,
        """
        select p_partkey, concat_ws('/', p_brand, p_type) as path, levenshtein(p_name, p_type) as distance,
               repeat(left(p_type, 1), 3) as tripled, right(p_brand, 2) as tail, rpad(p_brand, 10, '.') as dotted,
               starts_with(p_name, 'red') as is_red, contains(p_name, 'ing') as has_ing,
               split_part(p_name, ' ', 1) as first_word, cast(ascii(p_type) as bigint) as code,
               base64(encode(p_type)) as encoded
        from part
        """,
    ),
    one_step(
        "x13_urls",
        "pages",
        """
        select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, try_parse_url(url, 'HOST') as host,
               cast(size(split(url, '/')) as bigint) as parts, cast(regexp_count(url, '[0-9]') as bigint) as digits,
               cast(length(html) as bigint) as html_chars
        from pages
        """,
        """
        select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme,
               nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') as host,
               len(string_split(url, '/')) as parts, len(regexp_extract_all(url, '[0-9]')) as digits,
               length(html) as html_chars
        from pages
        """,
    ),
    one_step(
        "x14_timestamps",
        "events",
        """
        select event_id, cast(hour(ts) as bigint) as h, cast(minute(ts) as bigint) as m,
               cast(dayofweek(ts) as bigint) as dow, date_format(ts, 'yyyy-MM-dd HH:mm') as shown,
               ts + interval 1 day 2 hours as later, cast(ts as date) as day,
               cast(timestampdiff(minute, timestamp_ntz'2024-01-01 00:00:00', ts) as bigint) as minutes,
               to_timestamp_ntz(date_format(ts, 'yyyyMMdd'), 'yyyyMMdd') as midnight
        from events
        """,
        """
        select event_id, hour(ts) as h, minute(ts) as m, dayofweek(ts) + 1 as dow,
               strftime(ts, '%Y-%m-%d %H:%M') as shown, ts + interval 26 hour as later, cast(ts as date) as day,
               cast(floor(epoch(ts - timestamp '2024-01-01 00:00:00') / 60) as bigint) as minutes,
               cast(cast(ts as date) as timestamp) as midnight
        from events
        """,
    ),
    one_step(
        "x15_array_functions",
        "embeddings",
        """
        select vec_id, cast(size(array_distinct(signs)) as bigint) as kinds, array_contains(signs, 1) as any_positive,
               cast(array_position(signs, -1) as bigint) as first_negative,
               round(reduce(zip_with(embedding, reverse(embedding), (a, b) -> cast(a as double) * b),
                            0.0D, (s, x) -> s + x), 6) as folded,
               array_join(transform(signs, s -> cast(s as string)), '') as all_signs,
               forall(embedding, x -> abs(x) <= 1) as bounded
        from (select vec_id, embedding, transform(embedding, x -> if(x > 0, 1, -1)) as signs from embeddings)
        """,
        """
        select vec_id, len(list_distinct(signs)) as kinds, list_contains(signs, 1) as any_positive,
               cast(list_position(signs, -1) as bigint) as first_negative,
               round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i:
                     cast(embedding[i] as double) * cast(embedding[len(embedding) + 1 - i] as double))), 6) as folded,
               array_to_string(signs, '') as all_signs,
               len(list_filter(embedding, lambda x: abs(x) > 1)) = 0 as bounded
        from (select vec_id, embedding, list_transform(embedding, lambda x: if(x > 0, 1, -1)) as signs
              from embeddings)
        """,
    ),
    one_step(
        "x16_map_functions",
        "orders",
        """
        select o_orderkey, map_contains_key(m, 'status') as has_status, m['priority'] as priority,
               element_at(map_filter(m, (k, v) -> length(v) > 1), 'status') as long_status,
               element_at(transform_values(m, (k, v) -> lower(v)), 'status') as lowered,
               array_join(array_sort(map_keys(map_concat(m, map('extra', 'x')))), ',') as all_keys,
               cast(size(map_entries(m)) as bigint) as entries
        from (select o_orderkey, map('status', o_orderstatus, 'priority', o_orderpriority) as m from orders)
        """,
        """
        select o_orderkey, true as has_status, o_orderpriority as priority,
               case when length(o_orderstatus) > 1 then o_orderstatus end as long_status,
               lower(o_orderstatus) as lowered, 'extra,priority,status' as all_keys, cast(2 as bigint) as entries
        from orders
        """,
    ),
    one_step(
        "x17_json_documents",
        "orders",
        """
        select o_orderkey, get_json_object(j, '$.who.key') as who, cast(json_array_length(get_json_object(j, '$.tags')) as bigint) as tags,
               variant_get(parse_json(j), '$.total', 'double') as total, get_json_object(j, '$.tags[1]') as second_tag
        from (select o_orderkey,
                     to_json(named_struct('who', named_struct('key', o_custkey), 'total', o_totalprice,
                                          'tags', array(o_orderstatus, o_orderpriority))) as j
              from orders)
        """,
        """
        select o_orderkey, cast(o_custkey as varchar) as who, cast(2 as bigint) as tags, o_totalprice as total,
               o_orderpriority as second_tag
        from orders
        """,
    ),
    one_step(
        "x18_generators",
        "orders",
        """
        select o_orderkey, kind, amount
        from orders
             lateral view stack(2, 'total', o_totalprice, 'thousands', round(o_totalprice / 1000, 6)) s as kind, amount
        """,
        """
        select o_orderkey, 'total' as kind, o_totalprice as amount from orders
        union all
        select o_orderkey, 'thousands', round(o_totalprice / 1000, 6) from orders
        """,
    ),
    one_step(
        "x19_inline_structs",
        "customer",
        """
        select c_custkey, label, amount
        from customer
             lateral view outer inline(if(c_acctbal > 0, array(named_struct('k', 'balance', 'v', c_acctbal),
                                                          named_struct('k', 'double', 'v', c_acctbal * 2)),
                                          null)) s as label, amount
        """,
        """
        select c_custkey, 'balance' as label, c_acctbal as amount from customer where c_acctbal > 0
        union all select c_custkey, 'double', c_acctbal * 2 from customer where c_acctbal > 0
        union all select c_custkey, null, null from customer where not c_acctbal > 0
        """,
    ),
    one_step(
        "x20_number_formats",
        "part",
        """
        select p_partkey, conv(cast(p_partkey as string), 10, 16) as sixteen, bin(p_size) as two,
               format_string('%05d|%s', p_size, p_type) as padded, cast(pmod(p_size - 25, 7) as bigint) as weekday,
               cast(bround(p_size / 2.0, 0) as double) as half_even, width_bucket(p_size, 0, 50, 5) as bucket,
               round(log10(p_retailprice), 6) as magnitude, round(degrees(atan2(p_size, 10)), 6) as angle
        from part
        """,
        """
        select p_partkey, printf('%X', p_partkey) as sixteen, printf('%b', p_size) as two,
               printf('%05d|%s', p_size, p_type) as padded, cast(((p_size - 25) % 7 + 7) % 7 as bigint) as weekday,
               cast(round_even(p_size / 2.0, 0) as double) as half_even,
               cast(least(floor(p_size / 10.0) + 1, 6) as bigint) as bucket,
               round(log10(p_retailprice), 6) as magnitude, round(degrees(atan2(p_size, 10)), 6) as angle
        from part
        """,
    ),
    # --- structure ---
    one_step(
        "q6_nested_ctes",
        "orders customer",
        """
        with per_customer as (select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by o_custkey),
             busy as (with frequent as (select * from per_customer where n >= 10)
                      select * from frequent where top > 450000)
        select c.c_custkey, c.c_name, b.n, b.top from busy b join customer c on b.o_custkey = c.c_custkey
        """,
    ),
    Query(
        "q7_session_variable",
        ("orders",),
        (
            ("declared", "declare variable lowest double default 400000"),
            ("changed", "set variable lowest = lowest + 50000"),
            ("result", "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > lowest"),
        ),
        "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 450000",
    ),
    Query(
        "q8_parameterised_statement",
        ("orders",),
        (
            (
                "result",
                """
                execute immediate 'select o_orderkey, o_totalprice from orders where o_totalprice > :low and o_orderstatus = :s'
                using 300000 as low, 'F' as s
                """,
            ),
        ),
        "select o_orderkey, o_totalprice from orders where o_totalprice > 300000 and o_orderstatus = 'F'",
    ),
]
