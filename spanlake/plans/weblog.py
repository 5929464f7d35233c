"""Access-log queries over events: each event is written as a log line and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlake.operators import weblog as w
from spanlake.plans.registry import query
from spanlake.sources.readers import table
from spanlake.streaming import weblog as streams

# How an event becomes a log line (agents by user, pages by value).
_AGENT = "CASE WHEN user_id % 11 = 0 THEN 'Mozilla/5.0 (compatible) ' WHEN user_id % 7 = 0 THEN 'ExampleBot/2.1' WHEN user_id % 29 = 0 THEN 'Dalvik/2.1.0 (Linux)' WHEN user_id % 31 = 0 THEN 'Mozilla/5.0 (Windows) BingPreview/1.0b' WHEN user_id % 37 = 0 THEN 'Mozilla/5.0 (compatible; X11)' ELSE 'Mozilla/5.0 (X11; Linux)' END"
_URI = "CASE WHEN event_type = 'click' THEN '/app.js' WHEN event_type = 'view' THEN concat('/page/', cast(user_id % 13 AS STRING), '?v=', cast(event_id % 5 AS STRING)) ELSE concat('/', event_type, '/') END"


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ts = F.when(F.col("event_id") % 2 == 0, F.unix_timestamp("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    ip = F.expr("CASE WHEN user_id % 5 = 0 THEN concat('2001:db8:', hex(user_id), ':1::7') ELSE concat('10.', cast(user_id div 256 AS STRING), '.', cast(user_id % 256 AS STRING), '.9') END")
    agents = F.array(F.expr(_AGENT))
    referrer = F.array(F.concat(F.lit("https://ref"), (F.col("user_id") % 4).cast("string"), F.lit(".example/x/y")))
    request = F.struct(F.expr(_URI).alias("uri"), ip.alias("client_ip"), F.create_map(F.lit("User-Agent"), agents, F.lit("Referer"), referrer).alias("headers"))
    line = F.to_json(F.struct(F.lit("handled request").alias("msg"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), ts.alias("ts"), request.alias("request")))
    return e.select("event_id", F.when(F.col("event_id") % 97 == 0, F.lit("{broken")).when(F.col("event_id") % 89 == 0, F.lit("not json")).otherwise(line).alias("value"))


_SQL = f"""
WITH r AS (
  SELECT event_id, event_type, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, ts - INTERVAL 7 HOUR AS local_ts, {_URI.replace('STRING', 'VARCHAR')} AS uri,
         user_id % 11 = 0 OR user_id % 7 = 0 OR user_id % 29 = 0 OR user_id % 31 = 0 AS bot, event_type = 'click' AS asset,
         CASE WHEN user_id % 5 = 0 THEN '2001:db8:' || upper(to_hex(user_id)) || '::/48' ELSE '10.' || (user_id // 256) || '.' || (user_id % 256) || '.0/24' END AS net,
         'ref' || (user_id % 4) || '.example' AS referrer_host, strftime(local_ts, '%Y-%m-%d') AS day
  FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0),
v AS (SELECT * FROM r WHERE NOT bot AND NOT asset)"""


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return w.requests(log_lines(spark, sf))


@query(_SQL + " SELECT count(*) AS lines, count(DISTINCT net) AS networks, min(s) AS first_s, max(s) AS last_s FROM r")
def src23_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark, sf)
    return r.agg(F.count("*").alias("lines"), F.countDistinct("net").alias("networks"), F.min(F.unix_timestamp("at")).alias("first_s"), F.max(F.unix_timestamp("at")).alias("last_s"))


@query(_SQL + " SELECT bot, asset, count(*) AS n FROM r GROUP BY bot, asset")
def flt20_bots(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf).groupBy("bot", "asset").agg(F.count("*").alias("n"))


@query(_SQL + " SELECT net, count(*) AS n FROM r GROUP BY net")
def str24_network(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf).groupBy("net").agg(F.count("*").alias("n"))


@query(_SQL + " SELECT count(*) FILTER (WHERE NOT bot AND NOT asset) AS views, count(DISTINCT net) FILTER (WHERE NOT bot AND NOT asset) AS networks, count(*) FILTER (WHERE bot) AS bots FROM r")
def agg15_views(spark: SparkSession, sf: str) -> DataFrame:
    return w.totals(_requests(spark, sf))


@query(_SQL + ", c AS (SELECT string_split(uri, '?')[1] AS page, count(*) AS n, min(s) AS f FROM v GROUP BY 1) SELECT page, n FROM c ORDER BY n DESC, f, page LIMIT 12")
def agg16_top_pages(spark: SparkSession, sf: str) -> DataFrame:
    return w.top(w.views(_requests(spark, sf)).withColumn("s", F.unix_timestamp("at")), "page", 12, "s").select("page", "n")


@query(_SQL + ", c AS (SELECT referrer_host, count(*) AS n, min(s) AS f FROM v GROUP BY 1) SELECT referrer_host, n FROM c ORDER BY n DESC, f, referrer_host LIMIT 10")
def top03_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Top referrers; ties keep the order of appearance."""
    return w.top(w.views(_requests(spark, sf)).withColumn("s", F.unix_timestamp("at")), "referrer_host", 10, "s").select("referrer_host", "n")


@query(_SQL + " SELECT day, count(*) AS views, count(DISTINCT net) AS networks FROM v GROUP BY day")
def agg17_daily(spark: SparkSession, sf: str) -> DataFrame:
    return w.daily(w.views(_requests(spark, sf))).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "views", "networks")


@query(_SQL + ", d AS (SELECT net, count(DISTINCT day) AS days FROM v GROUP BY net) SELECT count(*) AS networks, count(*) FILTER (WHERE days > 1) AS on_two_days, count(*) FILTER (WHERE days > 2) AS on_three_days FROM d")
def agg18_returning(spark: SparkSession, sf: str) -> DataFrame:
    return w.returning(w.views(_requests(spark, sf)))


@query("SELECT date_trunc('hour', ts) AS began, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stm06_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly windows by type, the batch form of the stream."""
    return streams.event_windows(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM k GROUP BY user_id, k.n""")
def stm06_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(table(spark, sf, "events"))
