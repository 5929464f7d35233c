"""Parsers of documents that no table holds: records are written in the documents' form, parsed, and compared with the records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanlake.functions import urls
from spanlake.operators import minutes, surveys, web
from spanlake.plans.composite import _HOSTS, _KEY
from spanlake.plans.records import _CAST, _VOTES, _cast, _votes
from spanlake.plans.registry import query
from spanlake.plans.text import _PATH, skipped_sql
from spanlake.sources.readers import table


def _minute_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(meeting, pos, line): one document of minutes for each municipality and year, with all its votes.

    Written by fixed rules from a vote's place k in its meeting: every third is amended
    first, every fourth has no number, every fifth is an adoption of minutes; titles wrap,
    the first member is out of the room for even places, a spare number closes the document.
    """
    roster = table(spark, sf, "rosters")
    members = roster.groupBy("municipality").agg(F.array_sort(F.collect_set("surname")).alias("surnames"))
    against = _cast(spark, sf).where("decision = 'against'").join(roster.select("member_id", "surname"), "member_id").groupBy("vote_id").agg(F.array_sort(F.collect_set("surname")).alias("opposed"))
    v = _votes(spark, sf).join(members, "municipality").join(against, "vote_id", "left").withColumn("meeting", F.concat_ws("|", "municipality", F.date_format("meeting_date", "yyyy")))
    v = v.withColumn("k", F.row_number().over(Window.partitionBy("meeting").orderBy("vote_id")))
    day, first = F.date_format("meeting_date", "yyyy-01-02"), F.element_at("surnames", 1)
    some = lambda condition, *xs: F.when(condition, F.array(*xs)).otherwise(F.array().cast("array<string>"))
    opposed = some(F.size("opposed") > 0, F.concat(F.array_join(F.transform("opposed", lambda s: F.concat(F.lit("Councillor "), s)), ", "), F.lit(" opposed.")))
    result = F.when(F.lower("outcome") == "carried", "CARRIED").when(F.lower("outcome") == "defeated", "(DEFEATED)").otherwise("Main motion, as put, CARRIED UNANIMOUSLY.")
    item = F.concat(
        some(F.col("k") % 2 == 0, F.concat(F.lit("Councillor "), first, F.lit(" left the meeting at 7 pm."))),
        F.array(F.concat(F.col("k"), F.lit(". "), F.coalesce("title", F.lit("Untitled"))), F.lit("and its surroundings – File: 01-02"), F.lit("Report: Clerk"), F.lit("Moved by Councillor A, seconded by Councillor B")),
        F.array(F.concat(F.when(F.col("k") % 5 == 0, "THAT the Council Meeting Minutes stand: ").otherwise("THAT "), F.coalesce("resolution_text", F.lit("it be so"))), F.lit("and that it be reported-"), F.lit("back.")),
        some(F.col("k") % 3 == 0, F.lit("Moved by Councillor C"), F.lit("Amendment CARRIED")), F.array(result), opposed, some(F.col("k") % 4 != 0, F.concat(F.lit("R"), day, F.lit("/"), F.col("k"))),
        some(F.col("k") % 2 == 0, F.concat(F.lit("Councillor "), first, F.lit(" returned to the meeting at 8 pm."))),
    )
    items = v.select("meeting", F.posexplode(item).alias("i", "line"), F.col("k")).select("meeting", (F.col("k") * 100 + F.col("i")).alias("pos"), "line")
    meetings = v.groupBy("meeting").agg(F.first("surnames").alias("surnames"), F.max("k").alias("n"), F.first(day).alias("day"))
    top = F.concat(F.array(F.lit("Document Number: 7"), F.lit("PRESENT:")), F.transform("surnames", lambda s: F.concat(F.lit("Councillor A. "), s)), F.array(F.lit("The meeting was called to order at 6 pm."), F.lit("NEW BUSINESS")))
    heads = meetings.select("meeting", F.posexplode(top).alias("pos", "line"))
    tails = meetings.select("meeting", (F.col("n") + 1).alias("k"), F.posexplode(F.array(F.lit("INQUIRIES"), F.concat(F.lit("R"), "day", F.lit("/999")))).alias("i", "line")).select("meeting", (F.col("k") * 100 + F.col("i")).alias("pos"), "line")
    return heads.unionByName(items).unionByName(tails)


_MINUTES = f"""
v AS ({_VOTES}), a AS (SELECT vote_id, count(DISTINCT surname) AS n FROM ({_CAST}) JOIN rosters USING (member_id) WHERE decision = 'against' GROUP BY 1),
k AS (SELECT v.*, municipality || '|' || strftime(meeting_date, '%Y') AS meeting, row_number() OVER (PARTITION BY municipality, year(meeting_date) ORDER BY vote_id) AS k, coalesce(a.n, 0)::INT AS opposed
  FROM v LEFT JOIN a USING (vote_id) WHERE municipality IN (SELECT municipality FROM rosters)),
m AS (SELECT *, CASE WHEN k % 4 <> 0 THEN 'R' || strftime(meeting_date, '%Y-01-02') || '/' || k END AS number, coalesce(title, 'Untitled') || ' and its surroundings' AS shown,
  CASE WHEN k % 4 = 0 OR k % 5 = 0 THEN 'procedural' ELSE 'resolution' END AS route FROM k)"""


@query(f"""
WITH {_MINUTES}
SELECT meeting, k::INT AS motion, 'New Business' AS section, shown AS title, number, CASE lower(outcome) WHEN 'carried' THEN 'CARRIED' WHEN 'defeated' THEN 'DEFEATED' ELSE 'CARRIED UNANIMOUSLY' END AS result,
  opposed, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS results, route = 'procedural' AS procedural,
  CASE WHEN k % 5 = 0 THEN 'THAT the Council Meeting Minutes stand: ' ELSE 'THAT ' END || coalesce(resolution_text, 'it be so') || ' and that it be reported-back.' || CASE WHEN k % 3 = 0 THEN ' Moved by Councillor C' ELSE '' END AS body FROM m""")
def ext14_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Motions read back from minutes of several items each."""
    out = minutes.motions(_minute_lines(spark, sf))
    return out.select("meeting", F.col("motion").cast("int").alias("motion"), "section", "title", "number", "result", F.size("opposed").alias("opposed"), "results", "procedural", "body")


@query(f"WITH {_MINUTES} SELECT meeting, number, shown AS title, route FROM m UNION ALL SELECT DISTINCT meeting, 'R' || strftime(meeting_date, '%Y-01-02') || '/999', 'Numbered item with no separate public vote', 'unclaimed' FROM m")
def flt16_routed(spark: SparkSession, sf: str) -> DataFrame:
    """Where each motion, and each number without one, goes."""
    return minutes.routed(_minute_lines(spark, sf))


@query(f"""
WITH {_MINUTES}, o AS (SELECT DISTINCT vote_id, surname FROM ({_CAST}) JOIN rosters USING (member_id) WHERE decision = 'against'),
f AS (SELECT municipality, min(surname) AS surname FROM rosters GROUP BY 1)
SELECT m.meeting, m.k::INT AS motion, r.member_id, CASE WHEN o.surname IS NOT NULL THEN 'against' WHEN m.k % 2 = 0 AND m.k % 4 <> 0 AND r.surname = f.surname THEN 'absent' ELSE 'for' END AS decision
FROM m JOIN rosters r USING (municipality) JOIN f USING (municipality) LEFT JOIN o ON o.vote_id = m.vote_id AND o.surname = r.surname""")
def win10_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A decision for every member and motion: named as opposed, in the room, or out of it (back before the end of a motion without number)."""
    lines = _minute_lines(spark, sf)
    meetings = lines.select("meeting", F.substring_index("meeting", "|", 1).alias("municipality")).distinct()
    members = table(spark, sf, "rosters").join(meetings, "municipality").select("meeting", "surname", "member_id")
    return minutes.decisions(lines, members).select("meeting", F.col("motion").cast("int").alias("motion"), "member_id", "decision")


@query(f"WITH {_MINUTES} SELECT m.meeting, count(DISTINCT surname)::BIGINT AS present FROM m JOIN rosters r USING (municipality) GROUP BY 1")
def ext13_attendance(spark: SparkSession, sf: str) -> DataFrame:
    return minutes.attendance(_minute_lines(spark, sf)).where("present").groupBy("meeting").agg(F.count("*").alias("present"))


@query(f"WITH {_MINUTES} SELECT DISTINCT meeting, 'R' || strftime(meeting_date, '%Y-01-02') || '/999' AS number FROM m")
def jon13_unclaimed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that belong to no motion."""
    return minutes.unclaimed_numbers(_minute_lines(spark, sf))


@query(r"""
WITH d AS (SELECT DISTINCT source_id, retrieved, text FROM source_docs WHERE source_type = 'questionnaire_reply' AND text IS NOT NULL)
SELECT source_id, 'Person ' || source_id AS name, strftime(retrieved, '%Y-%m-%d') AS received, CASE WHEN source_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS replies,
  length('We read: ' || replace(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g')), ' .', '.') || ' And so it stands.')::INT + CASE WHEN source_id % 2 = 0 THEN length('An addition, written later.') + 2 ELSE 0 END AS chars FROM d""")
def ext17_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies read back from one document of name, received line, greeting, body, sign-off and contact lines; every second person writes twice under an alias."""
    docs = table(spark, sf, "source_docs").where("source_type = 'questionnaire_reply' and text is not null").select("source_id", "retrieved", "text").distinct()
    name, twice = F.concat(F.lit("Person "), F.col("source_id").cast("string")), F.col("source_id") % 2 == 0
    alias = F.concat(F.lit("Pers. "), F.col("source_id").cast("string"))
    body = F.concat(F.lit("We read:\n"), F.replace(F.trim(F.regexp_replace("text", r"[\s\x0B]+", " ")), F.lit(" ."), F.lit(".")), F.lit("\nAnd so it stands."))
    day = F.date_format("retrieved", "yyyy-MM-dd")
    doc = F.concat_ws(
        "\n", F.lit("Replies"), F.when(twice, alias).otherwise(name), F.when(twice, F.concat(F.lit("First reply, received "), day)).otherwise(F.concat(F.lit("Received "), day)), F.lit("Good morning Pat,"), F.lit(""), body,
        F.lit("Yours, in good spirits."), name, F.lit("Candidate for council"), F.lit("250-555-0100"), F.lit("-----"), F.when(twice, F.lit("Second reply, received later\nSam:\nAn addition, written later.\nThanks!\nwww.person.example")),
    )
    aliases = docs.where(twice).select(alias.alias("alias"), name.alias("name"))
    out = surveys.replies(docs.select("source_id", doc.alias("doc")), "source_id", "doc", docs.select(name.alias("name")), aliases)
    return out.select("source_id", "name", "received", "replies", F.length("answer").alias("chars"))


_FURNITURE = "(?i)^(?:" + "|".join(web.BOILERPLATE) + ")\\b"


@query(rf"""
WITH d AS (SELECT source_id, any_value(text) AS text, any_value(coalesce(title, '')) AS title FROM source_docs WHERE text IS NOT NULL AND source_type = 'official_statement' GROUP BY 1),
l AS (SELECT source_id, title, trim(regexp_replace(unnest(string_split(replace(replace(replace(text, '&', '+'), '<', '('), '>', ')'), chr(10))), '[\s\x{{00A0}}\x0B]+', ' ', 'g')) AS line FROM d),
k AS (SELECT DISTINCT source_id, line FROM l WHERE length(line) >= 60 AND NOT regexp_matches(line, '{_FURNITURE}'))
SELECT source_id, count(*) AS blocks, sum(length(line))::BIGINT AS chars FROM k GROUP BY 1""")
def ext10_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of pages whose lines are unclosed paragraphs between a menu and a footer."""
    docs = table(spark, sf, "source_docs").where("text is not null and source_type = 'official_statement'").groupBy("source_id").agg(F.first("text").alias("text"), F.first(F.coalesce("title", F.lit(""))).alias("title"))
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("+")), F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")"))
    menu = F.lit("<nav><ul><li>" + "Somewhere else on this site " * 4 + "</ul></nav>")
    html = F.concat(F.lit("<html><title>x</title><body>"), menu, F.lit("<div><p>"), F.replace(safe, F.lit("\n"), F.lit("<p>")), F.lit("</div><footer><p>"), F.lit("All the small print of this site, which is long enough to count. " * 2), F.lit("</footer></body>"))
    pages = web.page_text(docs.select("source_id", html.alias("html")), "source_id", "html")
    blocks = pages.select("source_id", F.explode(F.split("text", "\n\n")).alias("b")).where("b <> ''")
    return blocks.groupBy("source_id").agg(F.count("*").alias("blocks"), F.sum(F.length("b")).alias("chars"))


@query("""
SELECT source_id, list_sort(list_distinct(list(url)))[1] AS first_url, count(DISTINCT url) AS urls FROM source_docs WHERE source_type = 'campaign_site' GROUP BY 1""")
def src12_sitemap(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses read back from a sitemap per source."""
    docs = table(spark, sf, "source_docs").where("source_type = 'campaign_site'").groupBy("source_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform("urls", lambda u: F.concat(F.lit("<url><loc> "), u, F.lit(" </loc></url>"))), ""), F.lit("</urlset>"))
    found = docs.select("source_id", web.sitemap_urls(xml).alias("u"))
    return found.select("source_id", F.get("u", F.lit(0)).alias("first_url"), F.size("u").cast("bigint").alias("urls"))


@query("SELECT source_id, any_value(substring(title || ' ' || url, 1, 200)) AS said FROM source_docs WHERE title IS NOT NULL GROUP BY 1")
def ext05_rich_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text of a nested rich-text tree."""
    docs = table(spark, sf, "source_docs").where("title is not null").groupBy("source_id").agg(F.first("title").alias("title"), F.first("url").alias("url"))
    leaf = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    node = lambda kind, *below: F.struct(F.lit(kind).alias("type"), F.array(*below).alias("content"))
    tree = node("paragraph", leaf(F.concat("title", F.lit(" "))), leaf(F.col("url")))
    for kind in ("item", "list", "item", "list", "item", "list", "doc"):
        tree = node(kind, tree)
    return docs.select("source_id", F.substring(web.rich_text(F.parse_json(F.to_json(tree))), 1, 200).alias("said"))


@query("""
SELECT municipality, CASE office WHEN 'mayor' THEN 'Mayor' WHEN 'council' THEN 'Councillor' ELSE 'Trustee' END AS group_name, full_name AS name, email, phone, CASE WHEN website IS NULL THEN 0 ELSE 1 END AS links, coalesce(len(nomination_docs), 0)::INT AS documents,
  'I am ' || full_name || '.' || chr(10) || chr(10) || 'Item of ' || full_name AS statement FROM candidates""")
def src06_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """People read back from one profile page per municipality: offices as headings, statements that end at the first link, contacts out of links."""
    c = table(spark, sf, "candidates")
    rank = F.when(F.col("office") == "mayor", 1).when(F.col("office") == "council", 2).otherwise(3)
    title = F.when(rank == 1, "Mayor").when(rank == 2, "Councillor").otherwise("Trustee")
    link = lambda address, label: F.when(address.isNotNull(), F.concat(F.lit("<p><a href='"), address, F.lit(f"'>{label}</a></p>")))
    documents = F.array_join(F.transform(F.coalesce("nomination_docs", F.array().cast("array<string>")), lambda d: F.concat(F.lit("<a href='https://x.example/"), F.regexp_replace(d, "[^A-Za-z0-9]", ""), F.lit(".PDF'>Paper</a>"))), " ")
    body = F.concat_ws(
        "", F.lit("<section><h3>"), "full_name", F.lit("</h3><p>I am "), "full_name", F.lit(".<ul><li>Item of <b>"), "full_name", F.lit("</b></ul>"), link(F.concat(F.lit("mailto:"), "email"), "Write"), F.when(F.col("email").isNull(), "<h4>Notes</h4>"), F.lit("<p>Not said</p>"),
        link(F.concat(F.lit("tel:"), "phone"), "Call"), link(F.col("website"), "Site"), F.lit("<h4>More</h4><p>Nor this</p>"), documents, F.lit("</section>"),
    )
    offices = c.groupBy("municipality", rank.alias("r"), title.alias("t")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", body.alias("b")))), lambda x: x["b"]), "").alias("people"))
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("<h2>"), "t", F.lit("</h2><p>All of them</p>"), "people").alias("h")))), lambda x: x["h"]), "")
    html = offices.groupBy("municipality").agg(F.concat(F.lit("<body><h1>People</h1>"), page, F.lit("</body>")).alias("html"))
    found = web.profiles(web.page_events(html, "municipality", "html"), "municipality")
    return found.select("municipality", "group_name", "name", "email", "phone", F.size("links").alias("links"), F.size("documents").alias("documents"), "statement")


_KEYED = _KEY.format("url")


@query(f"""
WITH d AS (SELECT DISTINCT {_HOSTS.format('url')} AS site, url FROM source_docs WHERE source_type = 'campaign_site' AND NOT {skipped_sql('url')}),
k AS (SELECT site, {_KEYED} AS page, (length(regexp_replace({_PATH.format('url')}, '/+$', '')) - length(replace(regexp_replace({_PATH.format('url')}, '/+$', ''), '/', '')))::INT AS depth, url FROM d),
o AS (SELECT site, page, depth, url, row_number() OVER (PARTITION BY site, page ORDER BY depth, url) AS r FROM k)
SELECT site, page, url, depth, row_number() OVER (PARTITION BY site ORDER BY depth, url) AS rank FROM o WHERE r = 1""")
def src12_sitemap_index(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each site by way of an index of two sitemaps, shallow ones first; sites by an odd hash have one sitemap and no index."""
    docs = table(spark, sf, "source_docs").where("source_type = 'campaign_site'").select(urls.host(F.col("url")).alias("site"), "url").distinct()
    part = F.pmod(F.xxhash64("url"), F.lit(2))
    flat = F.pmod(F.xxhash64("site"), F.lit(2)) == 1
    at = lambda k: F.concat(F.lit("https://"), "site", F.lit("/map"), k.cast("string"), F.lit(".xml"))
    entry = lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))
    maps = docs.groupBy("site", F.when(flat, 0).otherwise(part).alias("k")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.array_sort(F.collect_list("url")), entry), ""), F.lit("</urlset>")).alias("xml"))
    index = docs.where(~flat).select("site").distinct().select("site", F.concat(F.lit("https://"), "site", F.lit("/index.xml")).alias("at"), F.concat(F.lit("<sitemapindex>"), entry(at(F.lit(0))), entry(at(F.lit(1))), F.lit("</sitemapindex>")).alias("xml"))
    stray = index.select("site", F.concat(F.lit("https://"), "site", F.lit("/stray.xml")).alias("at"), F.concat(F.lit("<urlset>"), entry(F.concat(F.lit("https://"), "site", F.lit("/stray"))), F.lit("</urlset>")).alias("xml"))
    landed = maps.select("site", at(F.col("k")).alias("at"), "xml").unionByName(index).unionByName(stray)
    return web.sitemap_pages(landed, "site", "at", "xml").select("site", "page", "url", "depth", F.col("rank").cast("bigint").alias("rank"))
