"""Whole queries over the star schema and the events, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import operators as op
from tidemill import streaming
from tidemill.functions import clock, exact, in_units, json_number, revenue
from tidemill.operators import partials
from tidemill.operators.funnels import funnel
from tidemill.sources import read_table, stream_table, with_event_time

_SQL_REVENUE = "sum(l_extendedprice::DECIMAL(18,4) * (1::DECIMAL(5,0) - l_discount::DECIMAL(6,4)))::DOUBLE"
_STAR = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

_SQL_SESSIONS = """WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked)"""


def star(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the number and the revenue of their lines, customer, nation and region.

    Lines are summed by order first, so that the joins see a row per order.
    Spark broadcasts the sides that are small.
    """
    line, orders, customer, nation, region = (read_table(spark, folder, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    sums = line.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(revenue()).alias("revenue"))
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    buyers = customer.join(places, customer.c_nationkey == places.n_nationkey)
    return sums.join(orders, sums.l_orderkey == orders.o_orderkey).join(buyers, orders.o_custkey == buyers.c_custkey)


def lines_and_revenue() -> list[Column]:
    """Totals over rows of star(); decimals add up in any order."""
    return [F.sum("lines").alias("lines"), in_units(F.sum("revenue")).alias("revenue")]


def region_year_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return star(spark, folder).groupBy("r_name", F.year("o_orderdate").cast("bigint").alias("year")).agg(*lines_and_revenue())


def customers_without_orders(spark: SparkSession, folder: str) -> DataFrame:
    customer, orders = read_table(spark, folder, "customer"), read_table(spark, folder, "orders")
    return op.without(customer, orders, customer.c_custkey == orders.o_custkey).select("c_custkey", "c_name", "c_mktsegment")


def orders_without_lines(spark: SparkSession, folder: str) -> DataFrame:
    orders, line = read_table(spark, folder, "orders"), read_table(spark, folder, "lineitem")
    return op.without(orders, line, orders.o_orderkey == line.l_orderkey).select("o_orderkey", "o_orderstatus", "o_totalprice")


def customers_with_urgent_orders(spark: SparkSession, folder: str) -> DataFrame:
    customer, orders = read_table(spark, folder, "customer"), read_table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return op.having(customer, orders, customer.c_custkey == orders.o_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


def customers_without_urgent_orders(spark: SparkSession, folder: str) -> DataFrame:
    customer, orders = read_table(spark, folder, "customer"), read_table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return op.without(customer, orders, customer.c_custkey == orders.o_custkey).select("c_custkey", "c_name", "c_mktsegment")


def revenue_rollup(spark: SparkSession, folder: str) -> DataFrame:
    nations = star(spark, folder).groupBy("r_name", "n_name").agg(F.sum("lines").alias("lines"), F.sum("revenue").alias("revenue"))
    return op.subtotals(nations, ["r_name", "n_name"], lines_and_revenue())


def flag_cube(spark: SparkSession, folder: str) -> DataFrame:
    totals = [F.count("*").alias("lines"), F.sum(exact("l_quantity")).cast("double").alias("quantity")]
    return op.subtotals(read_table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], totals, every=True)


def top_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).select("c_nationkey", "o_orderkey", "o_totalprice")
    return op.top_n(joined, ["c_nationkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def running_value(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    total = op.running_total(events, ["user_id"], [F.asc("ts"), F.asc("event_id")], exact("value"), ranges=F.to_date("ts"))
    return total.select("event_id", "user_id", F.col("running").cast("double").alias("running"))


def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    k = json_number("props", "$.k")
    return read_table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    hours = read_table(spark, folder, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return hours.select(clock(F.col("w.start")).alias("hour"), "event_type", "n")


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    found = op.sessions(with_event_time(read_table(spark, folder, "events")), ["user_id"], "ts", "30 minutes", [F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last")])
    return found.select("user_id", clock(F.col("first")).alias("first"), clock(F.col("last")).alias("last"), "events")


def stream_hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events by hour and type from a stream: the hours that the watermark has closed when the input ends, so without the last ones of hourly_events."""
    counts = streaming.windowed_counts(with_event_time(stream_table(spark, folder, "events")), "event_type")
    return streaming.run_to_table(counts.select(clock(F.col("w.start")).alias("hour"), "event_type", "n"), spark)


def purchase_last_view(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with its user's last view before it."""
    events = read_table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    bought, seen = (events.where(F.col("event_type") == kind).drop("event_type") for kind in ("purchase", "view"))
    at = ["ts", "event_id"]
    found = op.as_of_join(bought, seen, [("user_id", "user_id")], at, at, {"event_id": "view_id", "ts": "view_ts"}, F.to_date)
    return found.select("event_id", "user_id", clock(F.col("ts")).alias("at"), "view_id", clock(F.col("view_ts")).alias("view_at"))


def order_last_urgent(spark: SparkSession, folder: str) -> DataFrame:
    """Each order that isn't urgent with its customer's last urgent order before it."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    at = ["o_orderdate", "o_orderkey"]
    found = op.as_of_join(orders.where(~urgent), orders.where(urgent), [("o_custkey", "o_custkey")], at, at, {"o_orderkey": "urgent_orderkey", "o_totalprice": "urgent_totalprice"}, F.year)
    return found.select("o_orderkey", "o_custkey", "urgent_orderkey", "urgent_totalprice")


def errors_during_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """How many errors of any user fell into each session, for sessions with some."""
    events = with_event_time(read_table(spark, folder, "events"))
    sessions = op.sessions(events, ["user_id"], "ts", "30 minutes", [F.min("ts").alias("first"), F.max("ts").alias("last")]).select("user_id", "first", "last")
    errors = events.where("event_type = 'error'").select(F.unix_micros("ts").alias("at"))
    spans = (F.unix_micros("first"), F.unix_micros("last"))
    pairs = op.interval_join(sessions, errors, spans, (F.col("at"), F.col("at")), 3_600_000_000)
    return pairs.groupBy("user_id", "first").agg(F.count("*").alias("errors")).select("user_id", clock(F.col("first")).alias("first"), "errors")


def overlapping_orders(spark: SparkSession, folder: str) -> DataFrame:
    """By customer, pairs of orders that were open on the same day, from ordering to the last shipment, and the days they share."""
    line, orders = read_table(spark, folder, "lineitem"), read_table(spark, folder, "orders")
    shipped = line.groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("shipped"))
    day = lambda c: F.unix_date(F.to_date(c)).cast("bigint")
    spans = orders.join(shipped, orders.o_orderkey == shipped.l_orderkey).select("o_custkey", "o_orderkey", day("o_orderdate").alias("ordered"), day("shipped").alias("shipped"))
    other = spans.select(*[F.col(c).alias(f"other_{c}") for c in spans.columns])
    pairs = op.interval_join(spans, other, (F.col("ordered"), F.col("shipped")), (F.col("other_ordered"), F.col("other_shipped")), 366, [("o_custkey", "other_o_custkey")]).where("o_orderkey < other_o_orderkey")
    days = F.least("shipped", "other_shipped") - F.greatest("ordered", "other_ordered") + 1
    return pairs.groupBy("o_custkey").agg(F.count("*").alias("pairs"), F.sum(days).alias("days"))


def median_line_price(spark: SparkSession, folder: str) -> DataFrame:
    return op.exact_quantile(read_table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.5, "median")


def stream_views_before_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with each view of its user in the hour before it, from two streams."""
    events = with_event_time(stream_table(spark, folder, "events"))
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    seen = events.where("event_type = 'view'").select(F.col("user_id").alias("viewer"), F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    pairs = streaming.join_in_time(bought, seen, [("user_id", "viewer")], "ts", "view_ts", 3_600)
    seconds = (F.unix_micros("ts") - F.unix_micros("view_ts")) / 1_000_000
    return streaming.run_to_table(pairs.select("user_id", "event_id", "view_id", seconds.alias("seconds")), spark)


def stream_purchases_without_views(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases without a view of their user in the hour before them, from two streams: those that the watermark has passed when the input ends."""
    events = with_event_time(stream_table(spark, folder, "events"))
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    seen = events.where("event_type = 'view'").select(F.col("user_id").alias("viewer"), F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    found = streaming.join_in_time(bought, seen, [("user_id", "viewer")], "ts", "view_ts", 3_600, alone=True).where("view_id IS NULL")
    return streaming.run_to_table(found.select("user_id", "event_id", clock(F.col("ts")).alias("at")), spark)


def view_click_purchase(spark: SparkSession, folder: str) -> DataFrame:
    """Each view with its user's next click, and the next purchase after that, both within a day of the view."""
    events = read_table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    is_a = lambda kind: F.col("event_type") == kind
    found = funnel(events, ["user_id"], "ts", "event_id", is_a("view"), [("click_id", is_a("click")), ("purchase_id", is_a("purchase"))], 86_400)
    return found.select("event_id", "user_id", "click_id", "purchase_id")


def _kept_by_day(found: DataFrame, spark: SparkSession) -> DataFrame:
    """Partial aggregates as they come back from the table by day in which they are kept."""
    path = f"{streaming.shared_folder(spark)}/partials-{uuid.uuid4().hex}"
    partials.store_days(found, path, "day")
    return partials.stored_days(spark, path, found.schema)


def weekly_users(spark: SparkSession, folder: str) -> DataFrame:
    """Different users of each event type in the seven days up to each day, from bitmaps kept by day."""
    events = read_table(spark, folder, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    kept = _kept_by_day(partials.distinct_partials(events, ["event_type", "day"], "user_id"), spark)
    found = partials.count_distinct(partials.last_days(kept, "day", 7), ["event_type", "day"], "users")
    return found.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "users")


def weekly_value_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and 95th percentile of each event type's values in the seven days up to each day, off by 1 % at most, from counts kept by day."""
    events = read_table(spark, folder, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    kept = _kept_by_day(partials.value_partials(events, ["event_type", "day"], "value"), spark)
    found = partials.quantiles(partials.last_days(kept, "day", 7), ["event_type", "day"], {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "rows", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        region_year_revenue, customers_without_orders, orders_without_lines, customers_with_urgent_orders,
        customers_without_urgent_orders, revenue_rollup, flag_cube,
        top_orders, running_value, event_properties, hourly_events, user_sessions, stream_hourly_events,
        purchase_last_view, order_last_urgent, errors_during_sessions, overlapping_orders, median_line_price, stream_views_before_purchases,
        stream_purchases_without_views, view_click_purchase, weekly_users, weekly_value_quantiles,
    )
}

ORACLE_SQL: dict[str, str] = {
    "region_year_revenue": f"SELECT r_name, year(o_orderdate)::BIGINT AS year, count(*) AS lines, {_SQL_REVENUE} AS revenue FROM {_STAR} GROUP BY ALL",
    "customers_without_orders": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "orders_without_lines": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "customers_with_urgent_orders": "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1",
    "customers_without_urgent_orders": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "revenue_rollup": f"SELECT r_name, n_name, count(*) AS lines, {_SQL_REVENUE} AS revenue, grouping(r_name, n_name)::BIGINT AS level FROM {_STAR} GROUP BY ROLLUP (r_name, n_name)",
    "flag_cube": "SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS quantity, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "top_orders": "SELECT c_nationkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY place <= 3",
    "running_value": "SELECT event_id, user_id, (sum(value::DECIMAL(18,4)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS running FROM events",
    "event_properties": "SELECT event_type, count(*) AS events, sum((props->>'$.k')::BIGINT)::BIGINT AS sum_k, max((props->>'$.k')::BIGINT) AS max_k FROM events GROUP BY 1",
    "hourly_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "user_sessions": f"""
{_SQL_SESSIONS}
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS events FROM numbered GROUP BY user_id, k""",
    "stream_hourly_events": """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""",
    "purchase_last_view": """
WITH e AS (SELECT *, CASE WHEN event_type = 'view' THEN event_id END AS view, CASE WHEN event_type = 'view' THEN ts END AS seen FROM events),
f AS (SELECT *, last_value(view IGNORE NULLS) OVER w AS view_id, last_value(seen IGNORE NULLS) OVER w AS view_ts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, view_id, strftime(view_ts, '%Y-%m-%d %H:%M:%S') AS view_at FROM f WHERE event_type = 'purchase'""",
    "order_last_urgent": """
WITH e AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END AS urgent, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END AS price FROM orders),
f AS (SELECT *, last_value(urgent IGNORE NULLS) OVER w AS urgent_orderkey, last_value(price IGNORE NULLS) OVER w AS urgent_totalprice FROM e WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_orderkey, o_custkey, urgent_orderkey, urgent_totalprice FROM f WHERE o_orderpriority <> '1-URGENT'""",
    "errors_during_sessions": f"""
{_SQL_SESSIONS},
spans AS (SELECT user_id, min(ts) AS first, max(ts) AS last FROM numbered GROUP BY user_id, k)
SELECT s.user_id, strftime(first, '%Y-%m-%d %H:%M:%S') AS first, count(*) AS errors FROM spans s JOIN events e ON e.ts BETWEEN first AND last WHERE event_type = 'error' GROUP BY s.user_id, s.first""",
    "overlapping_orders": """
WITH s AS (SELECT o_custkey, o_orderkey, any_value(o_orderdate)::DATE AS a, max(l_shipdate)::DATE AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING a <= b)
SELECT x.o_custkey, count(*) AS pairs, sum(date_diff('day', greatest(x.a, y.a), least(x.b, y.b)) + 1)::BIGINT AS days
FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a <= y.b AND y.a <= x.b GROUP BY 1""",
    "median_line_price": """
WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS rows FROM lineitem)
SELECT l_returnflag, l_linestatus, rows, l_extendedprice AS median FROM r WHERE k = (rows + 1) // 2""",
    "stream_views_before_purchases": """
SELECT p.user_id, p.event_id, v.event_id AS view_id, (epoch_us(p.ts) - epoch_us(v.ts)) / 1000000 AS seconds
FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 1 HOUR WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
    "stream_purchases_without_views": """
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events p WHERE event_type = 'purchase'
AND ts <= (SELECT least(max(ts) FILTER (event_type = 'purchase'), max(ts) FILTER (event_type = 'view')) FROM events) - INTERVAL 10 MINUTE
AND NOT EXISTS (SELECT 1 FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 1 HOUR)""",
    "view_click_purchase": """
WITH e AS (SELECT *, first_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS next_click, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS next_purchase
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT v.event_id, v.user_id, c.event_id AS click_id, p.event_id AS purchase_id FROM e v LEFT JOIN e c ON c.event_id = v.next_click AND c.ts <= v.ts + INTERVAL 1 DAY
LEFT JOIN e p ON p.event_id = c.next_purchase AND p.ts <= v.ts + INTERVAL 1 DAY WHERE v.event_type = 'view'""",
    "weekly_users": """
WITH d AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users FROM events JOIN d ON ts::DATE BETWEEN day - 6 AND day GROUP BY ALL""",
    "weekly_value_quantiles": """
WITH d AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events),
r AS (SELECT event_type, day, value, row_number() OVER (PARTITION BY event_type, day ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type, day) AS rows FROM events JOIN d ON ts::DATE BETWEEN day - 6 AND day),
b AS (SELECT *, CASE WHEN value = 0 THEN 0 ELSE sign(value) * pow(1.01 / 0.99, ceil(ln(abs(value)) / ln(1.01 / 0.99))) * 2 / (1.01 / 0.99 + 1) END AS middle FROM r)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, rows, round(max(middle) FILTER (k = ceil(rows * 0.5)), 6) AS p50, round(max(middle) FILTER (k = ceil(rows * 0.95)), 6) AS p95 FROM b GROUP BY event_type, day, rows""",
}
