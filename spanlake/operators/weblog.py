"""Access logs: lines to page views, and their rollups.  Works on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanlake.functions.dates import local_day, mixed_instant
from spanlake.functions.urls import network

LINE = "msg string, status int, ts string, request struct<uri:string,client_ip:string,headers:map<string,array<string>>>"
# Pieces of agents that are machines, and endings of files that are no pages.
BOTS = ("bot", "crawl", "spider", "slurp", "curl/", "wget", "python-requests", "headless", "monitoring", "uptime", "scanner", "bingpreview", "facebookexternalhit", "go-http-client", "dalvik/")
ASSETS = (".css", ".js", ".woff2", ".jpg", ".png", ".svg", ".ico", ".xml", ".txt")


def is_bot(agent: Column, bots: tuple[str, ...] = BOTS) -> Column:
    """A machine by a piece of its name, or an agent that is a bare browser version and ``(compatible)``."""
    return _is_machine(F.lower(F.coalesce(agent, F.lit(""))), bots)


def _is_machine(low: Column, bots: tuple[str, ...] = BOTS) -> Column:
    begin, end = "mozilla/", " (compatible)"
    bare = F.rtrim(low)
    version = F.substring(bare, F.lit(len(begin) + 1), F.length(bare) - len(begin) - len(end))
    out = bare.startswith(begin) & bare.endswith(end) & (version != "") & (F.translate(version, "0123456789.", "") == "")
    for b in bots:
        out = out | F.contains(low, F.lit(b))
    return out


def is_asset(uri: Column, endings: tuple[str, ...] = ASSETS) -> Column:
    """By the ending of the address as it stands, query included."""
    out = F.lit(False)
    for e in endings:
        out = out | uri.endswith(e)
    return out


def requests(lines: DataFrame, line_col: str = "value", message: str = "handled request") -> DataFrame:
    """(at, day, status, uri, page, agent, net, referrer_host, bot, asset) of the well-formed lines.

    A line is parsed once: exploding the parsed record keeps the optimizer from
    repeating the parse in each column and filter.  Instants are read after that, so
    filters on bots and assets come first.
    """
    line = F.trim(F.col(line_col))
    parsed = lines.where(line.startswith("{")).select(F.inline(F.array(F.from_json(line, LINE)))).where(F.col("msg") == message)
    headers = F.col("request.headers")
    agent = F.array_join(headers["User-Agent"], " ")
    referrer = F.coalesce(F.get(headers["Referer"], F.lit(0)), F.lit(""))
    uri = F.col("request.uri")
    # the agent is compared with many pieces: lower-cased once, for the same reason
    parsed = parsed.select("*", F.explode(F.array(F.lower(F.coalesce(agent, F.lit(""))))).alias("low"))
    slim = parsed.select(
        "ts", "status", uri.alias("uri"), F.substring_index(uri, "?", 1).alias("page"), agent.alias("agent"), network(F.coalesce("request.client_ip", F.lit(""))).alias("net"),
        F.coalesce(F.get(F.split(referrer, "/"), F.lit(2)), F.lit("")).alias("referrer_host"), _is_machine(F.col("low")).alias("bot"), is_asset(uri).alias("asset"),
    )
    timed = slim.select("*", F.explode(F.array(mixed_instant(F.col("ts")))).alias("at")).where("at is not null")
    return timed.select("at", local_day(F.col("at")).alias("day"), "status", "uri", "page", "agent", "net", "referrer_host", "bot", "asset")


def views(reqs: DataFrame) -> DataFrame:
    return reqs.where(~F.col("bot") & ~F.col("asset"))


def totals(reqs: DataFrame) -> DataFrame:
    """(views, networks, bots) over all requests."""
    page = ~F.col("bot") & ~F.col("asset")
    return reqs.agg(F.count_if(page).alias("views"), F.countDistinct(F.when(page, F.col("net"))).alias("networks"), F.count_if("bot").alias("bots"))


def daily(page_views: DataFrame) -> DataFrame:
    return page_views.groupBy("day").agg(F.count("*").alias("views"), F.countDistinct("net").alias("networks"))


def returning(page_views: DataFrame) -> DataFrame:
    """(networks, on_two_days, on_three_days): networks seen, on more than one and more than two days."""
    days = page_views.groupBy("net").agg(F.countDistinct("day").alias("days"))
    return days.agg(F.count("*").alias("networks"), F.count_if(F.col("days") > 1).alias("on_two_days"), F.count_if(F.col("days") > 2).alias("on_three_days"))


def top(df: DataFrame, key: str, most: int, first_seen: str) -> DataFrame:
    """The most frequent keys; ties keep the order of first appearance."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"), F.min(first_seen).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen", key).limit(most)
