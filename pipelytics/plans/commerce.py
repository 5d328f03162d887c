"""Customer analytics, reading and writing, data quality."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import commerce as c
from ..operators import quality as q
from ..session import scratch_path
from ..sources import readers as r
from ..sources import writers as w
from ..views import TABLES
from .registry import plan

AS_OF = datetime(2001, 8, 1)
DAYS = 365
MARK = "2024-01-15 00:00:00"

_RECENT = "order_date >= timestamp '2000-08-01 00:00:00' and status = 'completed'"
_REVENUE = f"""
    select customer_id, cast(order_date as date) as order_day,
           cast(sum(cast(total_amount as decimal(18,2))) as double) as daily_revenue,
           count(*) as order_count,
           cast(sum(cast(total_amount as decimal(18,2))) as double) / count(*) as avg_order_value
    from orders_v where {_RECENT} group by 1, 2"""


def _revenue(t) -> DataFrame:
    return c.daily_revenue(t.orders_v, AS_OF, DAYS)


@plan("daily_revenue", _REVENUE)
def daily_revenue(t):
    return _revenue(t)


@plan("filter_lookback", "select * from orders_v where order_date >= timestamp '2000-08-01 00:00:00'")
def filter_lookback(t):
    return c.filter_lookback(t.orders_v, "order_date", AS_OF, DAYS)


@plan("filter_status", "select * from orders_v where status = 'completed'")
def filter_status(t):
    return c.filter_status(t.orders_v)


@plan("extract_orders", f"""
    select c.customer_id, c.name, c.segment, o.order_id, o.order_date, o.total_amount,
           i.product_id, i.quantity, i.unit_price
    from customers_v c join orders_v o on c.customer_id = o.customer_id
    join items_v i on i.order_id = o.order_id where {_RECENT}""")
def extract_orders(t):
    return c.extract_orders(t.customers_v, t.orders_v, t.items_v, AS_OF, DAYS)


@plan("orphan_orders", """
    select * from dirty_orders_v o
    where not exists (select 1 from customers_v c where c.customer_id = o.customer_id)""")
def orphan_orders(t):
    return c.orphan_orders(t.dirty_orders_v, t.customers_v)


@plan("valid_orders", """
    select * from dirty_orders_v
    where total_amount > 0 and customer_id in (select customer_id from customers_v)""")
def valid_orders(t):
    return c.valid_orders(t.dirty_orders_v, t.customers_v)


@plan("customer_lifetime_value", """
    select customer_id, cast(sum(cast(total_amount as decimal(18,2))) as double) as lifetime_value,
           count(*) as order_count,
           cast(sum(cast(total_amount as decimal(18,2))) as double) / count(*) as avg_order_value,
           min(order_date) as first_order, max(order_date) as last_order,
           date_diff('day', cast(min(order_date) as date), cast(max(order_date) as date)) as tenure_days
    from orders_v group by customer_id""")
def customer_lifetime_value(t):
    return c.customer_lifetime_value(t.orders_v)


@plan("top_customers", """
    with revenue as (
        select o.customer_id, segment,
               cast(sum(cast(total_amount as decimal(18,2))) as double) as revenue
        from orders_v o join customers_v c on c.customer_id = o.customer_id group by 1, 2)
    select customer_id, revenue, segment, cast(position as int) as position from (
        select *, row_number() over (partition by segment order by revenue desc, customer_id) as position
        from revenue) where position <= 10""")
def top_customers(t):
    return c.top_customers(t.orders_v, t.customers_v, 10)


@plan("top_revenue_days", f"""
    select * from ({_REVENUE}) order by daily_revenue desc, customer_id, order_day limit 20""")
def top_revenue_days(t):
    return c.top_revenue_days(_revenue(t), 20)


@plan("sales_report", """
    select r_name as region, segment,
           cast(sum(cast(total_amount as decimal(18,2))) as double) as revenue,
           count(*) as orders, cast(grouping(r_name, segment) as bigint) as level
    from orders_v o join customers_v c on c.customer_id = o.customer_id
    join nation on n_nationkey = nation_key join region on r_regionkey = n_regionkey
    group by rollup (r_name, segment)""")
def sales_report(t):
    return c.sales_report(t.orders_v, t.customers_v, t.nation, t.region)


# ---- reading and writing -------------------------------------------------


@plan("scan_formats", """
    select f.format, count(*) as row_count,
           cast(sum(cast(total_amount as decimal(18,2))) as double) as total
    from orders_v, (values ('csv'), ('json'), ('orc'), ('parquet')) as f(format) group by 1""")
def scan_formats(t):
    src = t.orders_v.select("order_id", "total_amount", "status")
    parts = []
    for fmt in ("csv", "json", "orc", "parquet"):
        path = scratch_path(t.spark, f"scan-{fmt}")
        src.write.format(fmt).save(path)
        back = r.read_table(t.spark, path, fmt, src.schema)
        parts.append(
            back.agg(
                F.count(F.lit(1)).alias("row_count"),
                F.sum(F.col("total_amount").cast("decimal(18,2)")).cast("double").alias("total"),
            ).withColumn("format", F.lit(fmt))
        )
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@plan("union_sources", """
    select c_custkey as party_id, c_name as name, c_acctbal as balance, c_mktsegment as segment,
           'customers' as source from customer
    union all
    select s_suppkey, s_name, s_acctbal, null, 'suppliers' from supplier""")
def union_sources(t):
    return r.union_sources([
        (t.customer.drop("c_nationkey"),
         {"c_custkey": "party_id", "c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"},
         {"party_id": "bigint", "balance": "double"}, "customers"),
        (t.supplier.drop("s_nationkey"),
         {"s_suppkey": "party_id", "s_name": "name", "s_acctbal": "balance"},
         {"party_id": "bigint", "balance": "double"}, "suppliers"),
    ])


@plan("incremental_load", f"""
    select *, (select max(ts) from events) as next_mark from events
    where ts > timestamp '{MARK}'""")
def incremental_load(t):
    mark = r.next_mark(t.events, "ts", MARK).select("next_mark").scalar()
    return r.incremental_load(t.events, "ts", MARK).withColumn("next_mark", mark)


@plan("schema_evolution_read", """
    select o_orderkey, o_totalprice,
           case when o_orderdate < timestamp '1998-01-01' then null else o_orderpriority end
               as o_orderpriority from orders""")
def schema_evolution_read(t):
    path = scratch_path(t.spark, "evolved")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    old = t.orders.where(F.col("o_orderdate") < cut).select("o_orderkey", "o_totalprice")
    new = t.orders.where(F.col("o_orderdate") >= cut).select(
        "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    old.write.parquet(f"{path}/version=1")
    new.write.parquet(f"{path}/version=2")
    return r.schema_evolution_read(t.spark, path).drop("version")


@plan("file_manifest")
def file_manifest(t):
    return r.file_manifest(t.spark, t.folder, "*.parquet")


@plan("append_customer_analytics", _REVENUE)
def append_customer_analytics(t):
    path = scratch_path(t.spark, "analytics")
    revenue = _revenue(t)
    cut = F.lit("2001-01-01").cast("date")
    w.append_customer_analytics(revenue.where(F.col("order_day") < cut), path)
    return w.append_customer_analytics(revenue.where(F.col("order_day") >= cut), path)


def _metrics(orders: DataFrame) -> DataFrame:
    return c.customer_lifetime_value(orders).select(
        "customer_id", "lifetime_value", "order_count", "last_order"
    )


@plan("upsert_customer_metrics", """
    with m as (
        select customer_id, status = 'pending' as newer,
               cast(sum(cast(total_amount as decimal(18,2))) as double) as lifetime_value,
               count(*) as order_count, max(order_date) as last_order
        from orders_v where status in ('pending', 'completed') group by 1, 2),
    old as (select * from m where not newer), upd as (select * from m where newer)
    select coalesce(u.customer_id, o.customer_id) as customer_id,
           coalesce(u.lifetime_value, o.lifetime_value) as lifetime_value,
           coalesce(u.order_count, o.order_count) as order_count,
           coalesce(u.last_order, o.last_order) as last_order
    from old o full join upd u on o.customer_id = u.customer_id""")
def upsert_customer_metrics(t):
    path = scratch_path(t.spark, "metrics")
    w.upsert_customer_metrics(path, _metrics(c.filter_status(t.orders_v)), ["customer_id"])
    return w.upsert_customer_metrics(
        path, _metrics(c.filter_status(t.orders_v, "pending")), ["customer_id"]
    )


@plan("daily_summary", f"""
    select order_day, count(*) as inserted_rows,
           cast(sum(cast(daily_revenue as decimal(18,2))) as double) as total_revenue,
           count(distinct customer_id) as customers
    from ({_REVENUE}) group by 1""")
def daily_summary(t):
    return w.daily_summary(_revenue(t))


@plan("write_partitioned", """
    select order_id, case when year(order_date) = 2000 then total_amount * 2 else total_amount end
               as total_amount, cast(year(order_date) as int) as order_year
    from orders_v""")
def write_partitioned(t):
    path = scratch_path(t.spark, "by-year")
    orders = t.orders_v.select(
        "order_id", "total_amount", F.year("order_date").alias("order_year")
    )
    w.write_partitioned(orders, path, "order_year")
    redo = orders.where("order_year = 2000").withColumn("total_amount", F.col("total_amount") * 2)
    for _ in range(2):  # a repeat of the same partition changes nothing
        w.write_partitioned(redo, path, "order_year")
    return t.spark.read.schema(orders.schema).parquet(path)


# ---- data quality --------------------------------------------------------

_RULES = [
    ("amount_positive", "total_amount > 0", 0.02),
    ("date_present", "order_date is not null", 0.005),
    ("customer_in_range", "customer_id < 10000000", 0.05),
]


@plan("negative_amounts", "select * from dirty_orders_v where total_amount <= 0")
def negative_amounts(t):
    return q.negative_amounts(t.dirty_orders_v)


@plan("duplicate_rows", """
    select order_id, count(*) as copies from dirty_orders_v group by 1 having count(*) > 1""")
def duplicate_rows(t):
    return q.duplicate_rows(t.dirty_orders_v, ["order_id"])


@plan("validation_report", """
    with n as (
        select (select count(*) from dirty_orders_v) as total_rows,
               (select count(*) from dirty_orders_v where total_amount <= 0) as negative_orders,
               (select count(*) from dirty_orders_v
                where customer_id not in (select customer_id from customers_v)) as invalid_customers,
               (select count(*) from (select order_id from dirty_orders_v
                group by 1 having count(*) > 1)) as duplicates)
    select *, case when invalid_customers > 0 then 'failed'
                   when negative_orders + duplicates > 0 then 'warning' else 'success' end as status
    from n""")
def validation_report(t):
    return q.validation_report(t.dirty_orders_v, t.customers_v)


@plan("rule_engine", """
    with n as (select count(*) as total,
        count(*) filter (where not coalesce(total_amount > 0, false)) as a,
        count(*) filter (where order_date is null) as b,
        count(*) filter (where not customer_id < 10000000) as c from dirty_orders_v)
    select 'amount_positive' as rule, a as failed_rows, a / total as failed_ratio,
           a / total <= 0.02 as passed from n
    union all select 'date_present', b, b / total, b / total <= 0.005 from n
    union all select 'customer_in_range', c, c / total, c / total <= 0.05 from n""")
def rule_engine(t):
    return q.rule_engine(t.dirty_orders_v, _RULES)


@plan("quarantine", """
    select order_id, customer_id, total_amount,
           concat_ws(',', case when not total_amount > 0 then 'amount_positive' end,
                     case when order_date is null then 'date_present' end,
                     case when not customer_id < 10000000 then 'customer_in_range' end) as violations
    from dirty_orders_v""")
def quarantine(t):
    out = q.quarantine(t.dirty_orders_v, [(n, p) for n, p, _ in _RULES])
    return out.select(
        "order_id", "customer_id", "total_amount",
        F.array_join("violations", ",").alias("violations"),
    )


@plan("freshness", """
    select event_type, max(ts) as newest,
           cast(floor(epoch(timestamp '2024-01-31 00:00:00' - max(ts))) as bigint) as age_seconds,
           cast(floor(epoch(timestamp '2024-01-31 00:00:00' - max(ts))) as bigint) > 900 as stale
    from events group by 1""")
def freshness(t):
    return q.freshness(t.events, "event_type", "ts", datetime(2024, 1, 31), 900)


@plan("readiness_check", " union all ".join(
    f"select '{n}' as table_name, count(*) > 0 as ready from {n}" for n in TABLES))
def readiness_check(t):
    return q.readiness_check({n: getattr(t, n) for n in TABLES})


_FEATURES = ["income", "age", "credit_score", "account_balance", "transaction_count", "constant"]


@plan("null_counts", " union all ".join(
    f"select '{n}' as column_name, count(*) - count({n}) as nulls from features_v"
    for n in ["customer_id", *_FEATURES[:-1], "last_order", "constant"]))
def null_counts(t):
    return q.null_counts(t.features_v)


@plan("value_ranges", " union all ".join(
    f"select '{n}' as column_name, cast(min({n}) as double) as min_value, "
    f"cast(max({n}) as double) as max_value from features_v" for n in _FEATURES))
def value_ranges(t):
    return q.value_ranges(t.features_v, _FEATURES)


@plan("category_counts", 'select event_type as category, count(*) as "rows" from events group by 1')
def category_counts(t):
    return q.category_counts(t.events, "event_type")


@plan("feature_stats", """
    select count(*) as total_samples, cast(8 as bigint) as feature_count,
           count(*) * 8 - count(customer_id) - count(income) - count(age) - count(credit_score)
             - count(account_balance) - count(transaction_count) - count(last_order)
             - count(constant) as missing_values
    from features_v""")
def feature_stats(t):
    return q.feature_stats(t.features_v)


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


@plan("summary_stats", " union all ".join(
    f"select '{n}' as column_name, round(avg({n}), 6) as mean, round(stddev_pop({n}), 6) as std, "
    f"max({n}) as max, min({n}) as min from lineitem" for n in _MEASURES))
def summary_stats(t):
    found = q.summary_stats(t.lineitem, _MEASURES)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_PROFILED = ["l_orderkey", "l_partkey", "l_returnflag", "l_quantity"]


@plan("distinct_profile", " union all ".join(
    f"select '{n}' as column_name, count(distinct {n}) as distinct_values, "
    f"count({n}) - count(distinct {n}) as duplicates from lineitem" for n in _PROFILED))
def distinct_profile(t):
    return q.distinct_profile(t.lineitem, _PROFILED).drop("approx_distinct")


_LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


@plan("type_profile", " union all ".join(
    f"select cast({i} as int) as position, '{n}' as column_name, '{k}' as logical_type, "
    f"count({n}) as filled_rows from lineitem" for i, (n, k) in enumerate(_LINE_TYPES.items())))
def type_profile(t):
    return q.type_profile(t.lineitem)


@plan("schema_diff", """
    select 'o_custkey' as column_name, 'int' as expected_type, 'bigint' as found_type, 'retyped' as change,
           count(o_custkey) as filled_rows from orders
    union all select 'o_totalprice', 'decimal(18,2)', 'double', 'retyped', count(o_totalprice) from orders
    union all select 'o_clerk', 'string', null, 'missing', null
    union all select 'o_orderpriority', null, 'string', 'extra', count(o_orderpriority) from orders""")
def schema_diff(t):
    expected = [
        ("o_orderkey", "bigint"), ("o_custkey", "int"), ("o_orderstatus", "string"),
        ("o_totalprice", "decimal(18,2)"), ("o_orderdate", "timestamp_ntz"), ("o_clerk", "string"),
    ]
    filled = q.type_profile(t.orders).select("column_name", "filled_rows")
    return q.schema_diff(t.orders, expected).join(filled, "column_name", "left")


@plan("convert_types", """
    with raw as (
        select event_id, cast(value as varchar) as value,
               case when event_type = 'error' then props
                    else regexp_extract(props, '([0-9]+)', 1) end as k from events)
    select event_id, try_cast(value as double) as value, try_cast(k as bigint) as k,
           case when try_cast(k as bigint) is null then 'k' else '' end as rejects from raw""")
def convert_types(t):
    raw = t.events.select(
        "event_id",
        F.col("value").cast("string").alias("value"),
        F.when(F.col("event_type") == "error", F.col("props"))
        .otherwise(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"),
    )
    typed = q.convert_types(raw, {"value": "double", "k": "bigint"})
    return typed.select("event_id", "value", "k", F.array_join("_rejects", ",").alias("rejects"))


@plan("dedupe_latest", """
    select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity from (
        select *, row_number() over (partition by l_orderkey, l_linenumber
            order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc,
                     l_extendedprice desc) as rn from lineitem) where rn = 1""")
def dedupe_latest(t):
    return q.dedupe_latest(
        t.lineitem, ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
    ).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
