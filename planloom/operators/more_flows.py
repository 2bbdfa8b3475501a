"""Flows over stored states, open-ended columns, scripts, and tables laid out for later reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from planloom.operators.flows import Flow, _csv, _parquet, _run, _table, _view
from planloom.operators.shared_folder import new_folder


def _stored(spark: SparkSession, table_dir: str, name: str, state: str, halves: tuple[str, str], table: str = "events") -> dict:
    """The state of either half of a table, appended to one folder: an input of that name, to be merged by its readers."""
    folder = new_folder(spark, name)
    steps = {f"part{n}": state.format(rows=f"(select * from {table} where {half})") for n, half in enumerate(halves)}
    _run(spark, [_table(table_dir, table)], steps, [(view, _parquet(folder)) for view in steps])
    return _parquet(folder, name)


HALVES = ("event_id % 2 = 0", "event_id % 2 <> 0 or event_id is null")


def bitmap_distinct(spark: SparkSession, table_dir: str) -> DataFrame:
    """Exact distinct users by day, week, type and altogether, from one stored state.

    The state holds a bitmap of users for each day, type and range of 32,768 ids: bitmaps merge, so coarser levels never look at events again
    and no row is copied for each of them.
    """
    state = _stored(
        spark,
        table_dir,
        "user_bits",
        """
        select cast(ts as date) as day, event_type, bitmap_bucket_number(user_id) as bucket,
               bitmap_construct_agg(bitmap_bit_position(user_id)) as bits
        from {rows} group by all
        """,
        HALVES,
    )
    return _view(
        spark,
        [state],
        {
            "daily": "select day, bucket, bitmap_or_agg(bits) as bits from user_bits group by day, bucket",
            "weekly": "select cast(date_trunc('week', day) as date) as week, bucket, bitmap_or_agg(bits) as bits from daily group by all",
            "typed": "select event_type, bucket, bitmap_or_agg(bits) as bits from user_bits group by event_type, bucket",
            "whole": "select bucket, bitmap_or_agg(bits) as bits from weekly group by bucket",
            "result": """
                select 'day' as level, cast(day as string) as name, sum(bitmap_count(bits)) as users from daily group by day
                union all
                select 'week', cast(week as string), sum(bitmap_count(bits)) from weekly group by week
                union all
                select 'type', event_type, sum(bitmap_count(bits)) from typed group by event_type
                union all
                select 'all', 'all', sum(bitmap_count(bits)) from whole
            """,
        },
    )


def merged_sketches(spark: SparkSession, table_dir: str) -> DataFrame:
    """Stored sketches, merged and intersected later: whether each estimate is within its bound of the exact value.

    Distinct users by HyperLogLog and theta sketches (5 %), the median by KLL (its rank within 3 % of the rows), users of purchases who also had errors
    by a theta intersection (5 % of both), and the most frequent user's count by a heavy-hitters state (exact, since all users fit).
    """
    state = _stored(
        spark,
        table_dir,
        "sketches",
        """
        select event_type, hll_sketch_agg(user_id, 14) as hll, theta_sketch_agg(user_id, 14) as theta,
               kll_sketch_agg_double(value) as kll, approx_top_k_accumulate(user_id, 100000) as top
        from {rows} where user_id is not null and value is not null group by event_type
        """,
        HALVES,
    )
    return _view(
        spark,
        [state, _table(table_dir, "events")],
        {
            "sound": "select * from events where user_id is not null and value is not null",
            "merged": """
                select event_type, hll_sketch_estimate(hll_union_agg(hll)) as hll, theta_union_agg(theta, 14) as theta,
                       kll_sketch_get_quantile_double(kll_merge_agg_double(kll), 0.5D) as median,
                       approx_top_k_estimate(approx_top_k_combine(top), 1)[0].count as most
                from sketches group by event_type
            """,
            "exact": """
                select s.event_type, count(distinct s.user_id) as users, max(m.most) as most, count(*) as n,
                       count_if(s.value < m.median) as below, count_if(s.value <= m.median) as upto,
                       max(m.hll) as hll, max(theta_sketch_estimate(m.theta)) as theta
                from sound s join merged m on s.event_type <=> m.event_type group by s.event_type
            """,
            "heaviest": """
                select event_type, max(n) as most
                from (select event_type, user_id, count(*) as n from sound group by all) group by event_type
            """,
            "both": """
                select theta_sketch_estimate(theta_intersection(max(theta) filter (where event_type = 'purchase'),
                                                                max(theta) filter (where event_type = 'error'))) as estimate
                from merged
            """,
            "result": """
                select e.event_type, abs(hll - users) <= 0.05 * users + 1 as hll_ok, abs(theta - users) <= 0.05 * users + 1 as theta_ok,
                       below <= 0.53 * n and upto >= 0.47 * n as median_ok, e.most = h.most as top_ok,
                       abs((select estimate from both)
                           - (select count(distinct p.user_id) from sound p left semi join (select user_id from sound where event_type = 'error') f
                              on p.user_id = f.user_id where p.event_type = 'purchase')) <= 0.1 * users + 1 as both_ok
                from exact e join heaviest h on e.event_type <=> h.event_type
            """,
        },
    )


def variant_column(spark: SparkSession, table_dir: str) -> DataFrame:
    """JSON kept as a VARIANT column in Parquet; keys come from the data, none is named."""
    folder = new_folder(spark, "variants")
    parsed = "select event_id, event_type, try_parse_json(props) as props from events"
    _run(spark, [_table(table_dir, "events")], {"parsed": parsed}, [("parsed", _parquet(folder))])
    return _view(
        spark,
        [_parquet(folder, "stored")],
        {
            "result": """
                select e.event_type, v.key, count(*) as n, sum(try_variant_get(v.value, '$', 'double')) as total
                from stored e, lateral variant_explode(e.props) v group by e.event_type, v.key
            """
        },
    )


def sql_script(spark: SparkSession, table_dir: str) -> DataFrame:
    """A loop to a fixed point: bisects the whole price from which on orders make up half of all revenue."""
    return _view(
        spark,
        [_table(table_dir, "orders")],
        {
            "priced": "select o_orderpriority, cast(o_totalprice as decimal(18, 2)) as price from orders",
            "threshold": """
                begin
                  declare low bigint default 0;
                  declare high bigint default 0;
                  declare middle bigint;
                  declare above decimal(38, 2);
                  declare half decimal(38, 2);
                  set (high, half) = (select coalesce(cast(ceil(max(price)) as bigint), 0) + 1, coalesce(sum(price), 0) / 2 from priced);
                  while high - low > 1 do
                    set middle = (low + high) div 2;
                    set above = (select coalesce(sum(price), 0) from priced where price >= middle);
                    if above >= half then
                      set low = middle;
                    else
                      set high = middle;
                    end if;
                  end while;
                  select low as price;
                end
            """,
            "result": """
                select /*+ broadcast(t) */ p.o_orderpriority, t.price, count(*) as orders, sum(p.price) as revenue
                from priced p join threshold t on p.price >= t.price group by p.o_orderpriority, t.price
            """,
        },
    )


def dynamic_overwrite(spark: SparkSession, table_dir: str) -> DataFrame:
    """A reload replaces only the partitions that it has rows for, however often it runs."""
    folder = new_folder(spark, "reloaded")
    events = [_table(table_dir, "events")]
    whole = "select /*+ rebalance(event_type) */ event_id, user_id, value, event_type from events"
    _run(spark, events, {"whole": whole}, [("whole", _parquet(folder, partitionBy="event_type"))])
    corrected = """
        select /*+ rebalance(event_type) */ event_id, user_id, value * 2 as value, event_type
        from events where event_type in ('error', 'view')
    """
    target = _parquet(folder, partitionBy="event_type", partitionOverwriteMode="dynamic") | {"mode": "overwrite"}
    for _ in range(2):
        _run(spark, events, {"corrected": corrected}, [("corrected", target)])
    return _view(spark, [_parquet(folder, "stored")], {"result": "select event_id, user_id, value, event_type from stored"})


def runtime_pruning(spark: SparkSession, table_dir: str) -> DataFrame:
    """Which partitions are read is found out while the query runs, from the filtered side of the join."""
    folder, kinds = new_folder(spark, "by_type"), new_folder(spark, "kinds")
    steps = {
        "whole": "select /*+ rebalance(event_type) */ event_id, user_id, value, event_type from events",
        "kinds": "select event_type as kind, length(event_type) as letters, count(*) as n from events group by event_type",
    }
    targets = [("whole", _parquet(folder, partitionBy="event_type")), ("kinds", _parquet(kinds))]
    _run(spark, [_table(table_dir, "events")], steps, targets)
    return _view(
        spark,
        [_parquet(folder, "stored"), _parquet(kinds, "kinds")],
        {"result": "select event_id, value, event_type, n from stored join kinds on event_type = kind where letters = 5"},
    )


def bucketed_join(spark: SparkSession, table_dir: str) -> DataFrame:
    """Two tables in buckets of the join key, made by statements of a plan: their join moves no rows."""
    names = {table: f"{table}_{uuid.uuid4().hex[:12]}" for table in ("orders", "customer")}
    keys = {"orders": "o_custkey", "customer": "c_custkey"}
    _view(
        spark,
        [_table(table_dir, table) for table in names],
        {
            f"made_{table}": f"""
                create table {name} using parquet clustered by ({keys[table]}) sorted by ({keys[table]}) into 8 buckets
                location '{new_folder(spark, name)}' as select * from {table}
            """
            for table, name in names.items()
        },
    )
    return _view(
        spark,
        [],
        {
            "result": f"""
                select /*+ merge(c) */ o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment
                from {names["orders"]} o join {names["customer"]} c on o.o_custkey = c.c_custkey
            """
        },
    )


def quarantine(spark: SparkSession, table_dir: str) -> DataFrame:
    """Rows of a delimited file that don't fit their schema go to a target of their own, with their file and the reason."""
    folder, rejects = new_folder(spark, "delivered"), new_folder(spark, "rejects")
    delivered = """
        select event_id, if(event_type = 'signup', 'unknown', cast(user_id as string)) as user_id, event_type,
               if(event_type = 'error', 'n/a', cast(value as string)) as value from events
    """
    _run(spark, [_table(table_dir, "events")], {"delivered": delivered}, [("delivered", _csv(folder))])
    options = {"header": "true", "delimiter": ";", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "line"}
    # Whether a row fits must not depend on the columns that a query asks for.
    options["columnPruning"] = "false"
    source = _csv(folder, "delivered", options, schema="event_id bigint, user_id bigint, event_type string, value double, line string")
    steps = {
        "read_once": "select *, input_file_name() as file from delivered",
        "rejected": """
            select line, file, case when user_id is null and get(fields, 1) <> '' then 'user_id'
                                    when value is null and get(fields, 3) <> '' then 'value' else 'line' end as reason
            from (select *, split(line, ';') as fields from read_once where line is not null)
        """,
    }
    _run(spark, [source], steps, [("rejected", _parquet(rejects))])
    return _view(
        spark,
        [source, _parquet(rejects, "rejects")],
        {
            "result": """
                select 'kept' as kind, event_id, user_id, value, cast(null as string) as reason, false as named
                from delivered where line is null
                union all
                select 'rejected', cast(split(line, ';')[0] as bigint), null, null, reason, file like '%.csv' from rejects
            """
        },
    )


def collations(spark: SparkSession, table_dir: str) -> DataFrame:
    """Joining, grouping and sorting without regard to case, by collation key instead of by changed copies of the strings."""
    return _view(
        spark,
        [_table(table_dir, "customer"), _table(table_dir, "part")],
        {
            # The same segments in three spellings.
            "spelled": """
                select c_custkey, c_acctbal, case pmod(c_custkey, 3) when 0 then c_mktsegment when 1 then lower(c_mktsegment)
                                             else initcap(c_mktsegment) end collate UTF8_LCASE as segment from customer
            """,
            "named": "select distinct c_mktsegment as name from customer",
            "result": """
                select lower(n.name) as segment, count(*) as customers, round(sum(s.c_acctbal), 2) as balance,
                       cast(row_number() over (order by min(s.segment) collate UNICODE_CI desc) as bigint) as place
                from spelled s join named n on s.segment = n.name collate UTF8_LCASE
                group by lower(n.name), s.segment
            """,
        },
    )


FLOWS = [
    Flow(
        "a24_bitmap_distinct",
        bitmap_distinct,
        """
        select 'day' as level, cast(ts::date as varchar) as name, count(distinct user_id) as users from events group by ts::date
        union all
        select 'week', cast(date_trunc('week', ts)::date as varchar), count(distinct user_id) from events group by date_trunc('week', ts)
        union all
        select 'type', event_type, count(distinct user_id) from events group by event_type
        union all
        select 'all', 'all', count(distinct user_id) from events
        """,
    ),
    Flow(
        "a25_merged_sketches",
        merged_sketches,
        """
        select event_type, true as hll_ok, true as theta_ok, true as median_ok, true as top_ok, true as both_ok
        from events where user_id is not null and value is not null group by event_type
        """,
    ),
    Flow(
        "x21_variant_column",
        variant_column,
        """
        select event_type, key, count(*) as n, sum(cast(json_extract_string(props, '$."' || key || '"') as double)) as total
        from (select event_type, props, unnest(json_keys(props)) as key from events) group by event_type, key
        """,
    ),
    Flow(
        "q9_sql_script",
        sql_script,
        """
        with priced as (select o_orderpriority, cast(o_totalprice as decimal(18, 2)) as price from orders),
        summed as (select price, sum(price) over (order by price desc) as above, sum(price) over () as total from priced),
        threshold as (select cast(floor(max(price)) as bigint) as price from summed where above >= total / 2)
        select p.o_orderpriority, t.price, count(*) as orders, sum(p.price)::decimal(28, 2) as revenue
        from priced p join threshold t on p.price >= t.price group by p.o_orderpriority, t.price
        """,
    ),
    Flow(
        "e8_dynamic_overwrite",
        dynamic_overwrite,
        "select event_id, user_id, if(event_type in ('error', 'view'), value * 2, value) as value, event_type from events",
    ),
    Flow(
        "e9_runtime_pruning",
        runtime_pruning,
        """
        select event_id, value, event_type, n
        from events join (select event_type as kind, count(*) as n from events group by event_type) on event_type = kind
        where length(event_type) = 5
        """,
    ),
    Flow(
        "e10_bucketed_join",
        bucketed_join,
        "select o_orderkey, o_totalprice, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey",
    ),
    Flow(
        "src7_quarantine",
        quarantine,
        """
        select 'kept' as kind, event_id, user_id, value, cast(null as varchar) as reason, false as named
        from events where event_type not in ('error', 'signup')
        union all
        select 'rejected', event_id, null, null, if(event_type = 'signup', 'user_id', 'value'), true
        from events where event_type in ('error', 'signup')
        """,
    ),
    Flow(
        "x22_collations",
        collations,
        """
        select lower(c_mktsegment) as segment, count(*) as customers, round(sum(c_acctbal), 2) as balance,
               row_number() over (order by lower(c_mktsegment) desc) as place
        from customer group by lower(c_mktsegment)
        """,
    ),
]
