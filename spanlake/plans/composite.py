"""The published queries: issue pages, people, search, comparison, councils and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanlake.functions import text as tx, urls
from spanlake.operators import ordering, records, web
from spanlake.plans.records import _CAST, _POS, _VOTES, _cast, _positions, _votes
from spanlake.plans.registry import query
from spanlake.plans.text import score_sql, skipped_sql
from spanlake.sources.readers import table

# The topics in their published order with labels, and the searched words.
TOPICS = {"budget": "Budget", "care": "Care", "getting-around": "Getting around", "growth": "Growth", "homes": "Homes", "learning": "Learning", "open-government": "Open government", "safety": "Safety", "shore-and-parks": "Shore and parks", "shops": "Shops"}
OFFICES = ["mayor", "council", "trustee"]
SEARCH = "ice arena ferry"

_TOPICS = "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TOPICS.items()) + ") t(category, label))"
_OFFICE_RANK = "CASE office WHEN 'mayor' THEN 1 WHEN 'council' THEN 2 WHEN 'trustee' THEN 3 ELSE 4 END"


def _topics(spark: SparkSession) -> DataFrame:
    listed = F.array(*(F.struct(F.lit(k).alias("category"), F.lit(v).alias("label")) for k, v in TOPICS.items()))
    return spark.range(1).select(F.inline(listed))


def _spoken(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Statements of known people, once each, with the columns asked for."""
    spoken = table(spark, sf, "positions").where("kind = 'position' and owner_id is not null")
    return spoken.select("position_id", "owner_id", *columns).distinct()


@query(f"""
SELECT t.category, t.label, count(DISTINCT p.owner_id) AS people, count(p.position_id) AS passages FROM {_TOPICS} t LEFT JOIN (SELECT * FROM ({_POS}) WHERE kind = 'position' AND owner_id IS NOT NULL) p USING (category) GROUP BY 1, 2""")
def agg05_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """People and passages per topic, topics without any included."""
    n = _spoken(spark, sf, "category").groupBy("category").agg(F.countDistinct("owner_id").alias("people"), F.count("*").alias("passages"))
    return _topics(spark).join(n, "category", "left").select("category", "label", F.coalesce("people", F.lit(0)).alias("people"), F.coalesce("passages", F.lit(0)).alias("passages"))


@query("""
WITH p AS (SELECT DISTINCT position_id, owner_id, unnest(flashpoints) AS flashpoint FROM positions WHERE owner_id IS NOT NULL)
SELECT flashpoint, count(DISTINCT owner_id) AS people, count(*) AS passages FROM p GROUP BY 1""")
def agg06_flashpoint_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "positions").where("owner_id is not null").select("position_id", "owner_id", F.explode("flashpoints").alias("flashpoint")).distinct()
    return p.groupBy("flashpoint").agg(F.countDistinct("owner_id").alias("people"), F.count("*").alias("passages"))


@query(f"""
WITH p AS (SELECT owner_id, count(*) AS n FROM ({_POS}) WHERE kind = 'position' AND owner_id IS NOT NULL GROUP BY 1), s AS (SELECT DISTINCT owner_id FROM source_docs WHERE owner_id IS NOT NULL)
SELECT count(*) AS people, count(s.owner_id) AS sourced, count(p.owner_id) AS with_passages, coalesce(sum(p.n), 0)::BIGINT AS passages FROM candidates c LEFT JOIN s ON s.owner_id = c.candidate_id LEFT JOIN p ON p.owner_id = c.candidate_id""")
def agg11_headline(spark: SparkSession, sf: str) -> DataFrame:
    """The headline counters."""
    n = _spoken(spark, sf).groupBy(F.col("owner_id").alias("candidate_id")).agg(F.count("*").alias("n"))
    s = table(spark, sf, "source_docs").where("owner_id is not null").select(F.col("owner_id").alias("candidate_id"), F.lit(1).alias("s")).distinct()
    both = table(spark, sf, "candidates").select("candidate_id").join(s, "candidate_id", "left").join(n, "candidate_id", "left")
    return both.agg(F.count("*").alias("people"), F.count("s").alias("sourced"), F.count("n").alias("with_passages"), F.coalesce(F.sum("n"), F.lit(0)).alias("passages"))


@query(f"""
SELECT candidate_id, municipality, {_OFFICE_RANK} AS race, row_number() OVER w AS place, count(*) OVER (PARTITION BY municipality, office) AS people FROM candidates WINDOW w AS (PARTITION BY municipality, office ORDER BY surname, given, candidate_id)""")
def agg09_races(spark: SparkSession, sf: str) -> DataFrame:
    """People in their races, races ranked by office."""
    race = Window.partitionBy("municipality", "office")
    place = F.row_number().over(race.orderBy("surname", "given", "candidate_id")).cast("bigint")
    return table(spark, sf, "candidates").select("candidate_id", "municipality", ordering.rank_in(F.col("office"), OFFICES).cast("int").alias("race"), place.alias("place"), F.count("*").over(race).alias("people"))


@query(f"""
WITH p AS (SELECT DISTINCT owner_id, category FROM ({_POS}) WHERE kind = 'position'), s AS (SELECT DISTINCT owner_id FROM source_docs)
SELECT t.category, c.candidate_id, CASE WHEN p.owner_id IS NOT NULL THEN 'speaks' WHEN s.owner_id IS NOT NULL THEN 'silent' ELSE 'no source' END AS part
FROM {_TOPICS} t CROSS JOIN candidates c LEFT JOIN p ON p.category = t.category AND p.owner_id = c.candidate_id LEFT JOIN s ON s.owner_id = c.candidate_id""")
def jon27_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Every person's part in every topic: speaks, silent though sourced, or without a source."""
    p = _spoken(spark, sf, "category").select(F.col("owner_id").alias("candidate_id"), "category", F.lit(1).alias("p")).distinct()
    s = table(spark, sf, "source_docs").where("owner_id is not null").select(F.col("owner_id").alias("candidate_id"), F.lit(1).alias("s")).distinct()
    people = table(spark, sf, "candidates").select("candidate_id", F.explode(F.array(*(F.lit(t) for t in TOPICS))).alias("category")).join(s, "candidate_id", "left")
    return people.join(p, ["candidate_id", "category"], "left").select("category", "candidate_id", F.when(F.col("p").isNotNull(), "speaks").when(F.col("s").isNotNull(), "silent").otherwise("no source").alias("part"))


@query(f"""
WITH q AS (SELECT owner_id AS member_id, category, count(*) AS quotes FROM ({_POS}) WHERE kind = 'position' AND source_type <> 'questionnaire_reply' GROUP BY 1, 2),
r AS (SELECT owner_id AS member_id, category, count(*) AS replies FROM ({_POS}) WHERE kind = 'position' AND source_type = 'questionnaire_reply' GROUP BY 1, 2),
v AS (SELECT DISTINCT vote_id, unnest(district_categories) AS category FROM ({_VOTES})), b AS (SELECT member_id, category, count(*) AS votes FROM ({_CAST}) JOIN v USING (vote_id) GROUP BY 1, 2),
k AS (SELECT member_id, category FROM q UNION SELECT member_id, category FROM r UNION SELECT member_id, category FROM b)
SELECT k.member_id, k.category, coalesce(quotes, 0) AS quotes, coalesce(replies, 0) AS replies, coalesce(votes, 0) AS votes
FROM k JOIN rosters m ON m.member_id = k.member_id LEFT JOIN q ON q.member_id = k.member_id AND q.category = k.category LEFT JOIN r ON r.member_id = k.member_id AND r.category = k.category LEFT JOIN b ON b.member_id = k.member_id AND b.category = k.category""")
def jon26_issue_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes, replies and votes of each member by topic, rows without any left out; one shuffle on the key by union and sum."""
    spoken = _spoken(spark, sf, "category", "source_type")
    reply = (F.col("source_type") == "questionnaire_reply").cast("long")
    said = spoken.select(F.col("owner_id").alias("member_id"), "category", (1 - reply).alias("quotes"), reply.alias("replies"), F.lit(0).cast("long").alias("votes"))
    topics = _votes(spark, sf).select("vote_id", F.explode(F.array_distinct("district_categories")).alias("category"))
    cast = _cast(spark, sf).join(topics, "vote_id").select("member_id", "category", F.lit(0).cast("long").alias("quotes"), F.lit(0).cast("long").alias("replies"), F.lit(1).cast("long").alias("votes"))
    all_ = said.unionByName(cast).groupBy("member_id", "category").agg(F.sum("quotes").alias("quotes"), F.sum("replies").alias("replies"), F.sum("votes").alias("votes"))
    return all_.join(table(spark, sf, "rosters").select("member_id"), "member_id", "left_semi")


@query(f"WITH v AS ({_VOTES}) SELECT c.member_id, c.vote_id, c.decision, v.title, CASE WHEN v.minutes_url IS NULL THEN 'without minutes' ELSE '' END AS note FROM ({_CAST}) c JOIN v USING (vote_id) JOIN rosters USING (member_id)")
def jon25_votes_naming(spark: SparkSession, sf: str) -> DataFrame:
    """Every vote that names a member, as it is shown beside them."""
    v = _votes(spark, sf).select("vote_id", "title", F.when(F.col("minutes_url").isNull(), "without minutes").otherwise("").alias("note"))
    return _cast(spark, sf).join(v, "vote_id").join(table(spark, sf, "rosters").select("member_id"), "member_id", "left_semi").select("member_id", "vote_id", "decision", "title", "note")


_TERMS = [t for t in SEARCH.split() if len(t) >= 2]
_HITS = " + ".join(f"CAST(contains(lower(quote), '{t}') AS INT)" for t in _TERMS)
_SEARCHED = f"""
WITH p AS (SELECT position_id, owner_id, quote, 10 * ({_HITS}) + CASE WHEN source_type = 'official_statement' THEN 1 ELSE 0 END AS score, ({_HITS}) AS hits FROM ({_POS}))"""


def _search(spark: SparkSession, sf: str) -> DataFrame:
    terms = tx.search_tokens(F.lit(SEARCH))
    p = _positions(spark, sf, "owner_id", "quote", "source_type").withColumn("score", tx.search_score(F.col("quote"), terms, F.col("source_type") == "official_statement"))
    return p.where("score >= 10")


@query(_SEARCHED + " SELECT position_id, score FROM p WHERE hits > 0 ORDER BY score DESC, position_id LIMIT 120")
def top02_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 120 best passages for a search; ties by position."""
    return _search(spark, sf).orderBy(F.desc("score"), "position_id").limit(120).select("position_id", F.col("score").cast("int").alias("score"))


@query(_SEARCHED + ", t AS (SELECT * FROM p WHERE hits > 0 ORDER BY score DESC, position_id LIMIT 120) SELECT count(*) AS shown, count(DISTINCT owner_id) AS people, (SELECT count(*) FROM p WHERE hits > 0) AS found FROM t")
def qry06_search(spark: SparkSession, sf: str) -> DataFrame:
    """Counts beside a search result."""
    hits = _search(spark, sf)
    shown = hits.orderBy(F.desc("score"), "position_id").limit(120).agg(F.count("*").alias("shown"), F.countDistinct("owner_id").alias("people"))
    return shown.withColumn("found", F.lit(0).cast("bigint")).unionByName(hits.agg(F.lit(0).cast("bigint").alias("shown"), F.lit(0).cast("bigint").alias("people"), F.count("*").alias("found"))).agg(F.sum("shown").alias("shown"), F.sum("people").alias("people"), F.sum("found").alias("found"))


_PIVOT = ", ".join(f"count(*) FILTER (WHERE category = '{t}') AS \"{t}\"" for t in TOPICS)


@query(f"SELECT owner_id, {_PIVOT} FROM ({_POS}) WHERE kind = 'position' AND owner_id IS NOT NULL GROUP BY 1")
def qry07_compare_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """People against topics."""
    return _spoken(spark, sf, "category").groupBy("owner_id").agg(*(F.count_if(F.col("category") == t).alias(t) for t in TOPICS))


@query(f"""
SELECT position_id, owner_id, category, row_number() OVER (PARTITION BY owner_id, category ORDER BY CASE WHEN source_type = 'official_statement' THEN 0 ELSE 1 END, -length(quote), position_id) AS place
FROM ({_POS}) WHERE kind = 'position' AND owner_id IS NOT NULL""")
def ext25_compare_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Passages by person and topic with their rank."""
    order = Window.partitionBy("owner_id", "category").orderBy(F.when(F.col("source_type") == "official_statement", 0).otherwise(1), -F.col("n"), "position_id")
    return _spoken(spark, sf, "category", "source_type", F.length("quote").alias("n")).select("position_id", "owner_id", "category", F.row_number().over(order).cast("bigint").alias("place"))


@query(f"""
WITH p AS ({_POS}) SELECT p.position_id, p.kind, p.category, coalesce(t.label, p.category) AS label, c.full_name AS name, coalesce(c.incumbent, false) AS incumbent
FROM p LEFT JOIN {_TOPICS} t USING (category) LEFT JOIN candidates c ON c.candidate_id = p.owner_id""")
def ext24_search_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The slim rows that a search serves from; the quote is attached last."""
    people = table(spark, sf, "candidates").select(F.col("candidate_id").alias("owner_id"), F.col("full_name").alias("name"), "incumbent")
    rows = _positions(spark, sf, "owner_id", "kind", "category")
    both = rows.join(F.broadcast(_topics(spark)), "category", "left").join(people, "owner_id", "left")
    return both.select("position_id", "kind", "category", F.coalesce("label", "category").alias("label"), "name", F.coalesce("incumbent", F.lit(False)).alias("incumbent"))


@query(f"""
WITH p AS (SELECT c.municipality, c.office, p.category, p.owner_id, p.position_id FROM ({_POS}) p JOIN candidates c ON c.candidate_id = p.owner_id WHERE p.kind = 'position'),
r AS (SELECT municipality, office, count(*) AS in_race FROM candidates GROUP BY 1, 2)
SELECT category, municipality, office, count(DISTINCT owner_id) AS speakers, in_race, count(*) AS passages FROM p JOIN r USING (municipality, office) GROUP BY ALL""")
def qry01_issue_page(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers of each race on each topic, out of how many."""
    people = table(spark, sf, "candidates").select(F.col("candidate_id").alias("owner_id"), "municipality", "office")
    races = people.groupBy("municipality", "office").agg(F.count("*").alias("in_race"))
    said = _spoken(spark, sf, "category").join(people, "owner_id").groupBy("category", "municipality", "office").agg(F.countDistinct("owner_id").alias("speakers"), F.count("*").alias("passages"))
    return said.join(races, ["municipality", "office"]).select("category", "municipality", "office", "speakers", "in_race", "passages")


@query(f"""
WITH n AS (SELECT t.category, count(DISTINCT p.owner_id) AS people FROM {_TOPICS} t LEFT JOIN (SELECT * FROM ({_POS}) WHERE kind = 'position') p USING (category) GROUP BY 1)
SELECT n.category, people, row_number() OVER (ORDER BY people DESC, label) AS place FROM n JOIN {_TOPICS} t USING (category)""")
def qry02_issue_index(spark: SparkSession, sf: str) -> DataFrame:
    """Topics by coverage, then label."""
    return agg05_coverage(spark, sf).select("category", "people", F.row_number().over(Window.orderBy(F.desc("people"), "label")).cast("bigint").alias("place"))


@query(f"""
SELECT c.candidate_id, t.category FROM candidates c CROSS JOIN {_TOPICS} t WHERE NOT EXISTS (SELECT 1 FROM positions p WHERE p.owner_id = c.candidate_id AND p.category = t.category AND p.kind = 'position')""")
def qry03_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    """Topics that a person says nothing on."""
    all_ = table(spark, sf, "candidates").select("candidate_id", F.explode(F.array(*(F.lit(t) for t in TOPICS))).alias("category"))
    return all_.join(_spoken(spark, sf, "category").select(F.col("owner_id").alias("candidate_id"), "category").distinct(), ["candidate_id", "category"], "left_anti")


@query(f"""
SELECT c.candidate_id, count(DISTINCT p.category) AS topics FROM candidates c LEFT JOIN (SELECT * FROM ({_POS}) WHERE kind = 'position') p ON p.owner_id = c.candidate_id
WHERE contains(lower(c.full_name), 'a') GROUP BY 1 HAVING count(*) FILTER (WHERE p.category = 'homes') > 0""")
def flt22_people_filter(spark: SparkSession, sf: str) -> DataFrame:
    """People by part of a name and a topic they speak on."""
    said = _spoken(spark, sf, "category").groupBy(F.col("owner_id").alias("candidate_id")).agg(F.collect_set("category").alias("c"))
    people = table(spark, sf, "candidates").where(F.contains(F.lower("full_name"), F.lit("a")))
    return people.join(said, "candidate_id").where(F.array_contains("c", "homes")).select("candidate_id", F.size("c").cast("bigint").alias("topics"))


@query("""
WITH p AS (SELECT DISTINCT owner_id, position_id, unnest(flashpoints) AS f FROM positions WHERE owner_id IS NOT NULL), t AS (SELECT owner_id, count(DISTINCT position_id) AS all_passages FROM (SELECT DISTINCT owner_id, position_id FROM positions WHERE owner_id IS NOT NULL) GROUP BY 1)
SELECT p.f AS flashpoint, p.owner_id, count(*) AS hits, all_passages FROM p JOIN t USING (owner_id) GROUP BY 1, 2, 4""")
def qry05_flashpoint_page(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "positions").where("owner_id is not null")
    total = p.select("owner_id", "position_id").distinct().groupBy("owner_id").agg(F.count("*").alias("all_passages"))
    hits = p.select("owner_id", "position_id", F.explode("flashpoints").alias("flashpoint")).distinct().groupBy("flashpoint", "owner_id").agg(F.count("*").alias("hits"))
    return hits.join(total, "owner_id").select("flashpoint", "owner_id", "hits", "all_passages")


@query(f"""
WITH s AS (SELECT owner_id AS member_id, count(*) AS said FROM ({_POS}) WHERE kind = 'position' GROUP BY 1), b AS (SELECT member_id, count(*) AS voted, count(*) FILTER (WHERE decision = 'against') AS against FROM ({_CAST}) GROUP BY 1)
SELECT m.member_id, coalesce(said, 0) AS said, coalesce(voted, 0) AS voted, coalesce(against, 0) AS against FROM rosters m LEFT JOIN s USING (member_id) LEFT JOIN b USING (member_id)""")
def agg22_member_cards(spark: SparkSession, sf: str) -> DataFrame:
    """What each member said and how often they voted."""
    said = _spoken(spark, sf).groupBy(F.col("owner_id").alias("member_id")).agg(F.count("*").alias("said"))
    cast = _cast(spark, sf).groupBy("member_id").agg(F.count("*").alias("voted"), F.count_if(F.col("decision") == "against").alias("against"))
    both = table(spark, sf, "rosters").select("member_id").join(said, "member_id", "left").join(cast, "member_id", "left")
    return both.select("member_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("said", "voted", "against")))


@query(f"""
WITH b AS (SELECT member_id, count(*) AS votes FROM ({_CAST}) GROUP BY 1)
SELECT member_id, row_number() OVER (PARTITION BY municipality ORDER BY CASE WHEN office = 'mayor' THEN 0 ELSE 1 END, coalesce(votes, 0) DESC, member_id) AS place FROM rosters LEFT JOIN b USING (member_id)""")
def srt05_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a council: mayor first, then by votes."""
    votes = _cast(spark, sf).groupBy("member_id").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("municipality").orderBy(F.when(F.col("office") == "mayor", 0).otherwise(1), F.coalesce("votes", F.lit(0)).desc(), "member_id")
    return table(spark, sf, "rosters").join(votes, "member_id", "left").select("member_id", F.row_number().over(order).cast("bigint").alias("place"))


@query(f"WITH v AS ({_VOTES}) SELECT vote_id, row_number() OVER (ORDER BY meeting_date, municipality, item_number NULLS FIRST, vote_id) AS place FROM v")
def srt02_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Published order of votes; item numbers sort as text."""
    votes = _votes(spark, sf).select("vote_id", "meeting_date", "municipality", "item_number")
    return ordering.global_rank(votes, ["meeting_date", "municipality", "item_number", "vote_id"], "place").select("vote_id", "place")


@query("SELECT candidate_id, row_number() OVER (PARTITION BY municipality ORDER BY lower(surname), lower(given), candidate_id) AS place FROM candidates")
def srt07_locale_sort(spark: SparkSession, sf: str) -> DataFrame:
    """People in a reader's order, by a collation that ignores case and accents."""
    order = Window.partitionBy("municipality").orderBy(ordering.locale_key(F.col("surname")), ordering.locale_key(F.col("given")), "candidate_id")
    return table(spark, sf, "candidates").select("candidate_id", F.row_number().over(order).cast("bigint").alias("place"))


_HOSTS = "regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '')"
_KEY = _HOSTS + " || '/' || regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '^/+|/+$', '', 'g')"


@query(f"""
WITH d AS (SELECT source_id, any_value(url) AS url, any_value(coalesce(title, '')) AS title FROM source_docs WHERE source_type = 'campaign_site' GROUP BY 1),
s AS (SELECT source_id, {_HOSTS.format('url')} AS site, {_KEY.format('url')} AS page,
  {score_sql("lower(url || ' ' || title)")} AS score
  FROM d WHERE NOT {skipped_sql("url")}),
o AS (SELECT *, row_number() OVER (PARTITION BY site, page ORDER BY score DESC, source_id) AS r FROM s),
b AS (SELECT source_id, site, score, row_number() OVER (PARTITION BY site ORDER BY score DESC, source_id) AS rank FROM o WHERE r = 1)
SELECT source_id, site, score, rank FROM b WHERE rank <= 12""")
def top01_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """The 12 best pages of each site, one spelling per page."""
    docs = table(spark, sf, "source_docs").where("source_type = 'campaign_site'").groupBy("source_id").agg(F.first("url").alias("url"), F.first(F.coalesce("title", F.lit(""))).alias("title"))
    best = web.frontier(docs.withColumn("site", urls.host(F.col("url"))), "site", "url", "url", "title", "source_id")
    return best.select("source_id", "site", "score", F.col("rank").cast("bigint").alias("rank"))


@query("""
WITH r AS (SELECT owner_id, count(DISTINCT source_id) AS replies FROM source_docs WHERE source_type = 'questionnaire_reply' AND owner_id IS NOT NULL GROUP BY 1)
SELECT municipality, office, count(*) AS asked, count(r.owner_id) AS answered, coalesce(sum(replies), 0)::BIGINT AS replies FROM candidates c LEFT JOIN r ON r.owner_id = c.candidate_id GROUP BY 1, 2""")
def agg10_questionnaires(spark: SparkSession, sf: str) -> DataFrame:
    """Asked and answered by race."""
    r = table(spark, sf, "source_docs").where("source_type = 'questionnaire_reply' and owner_id is not null").groupBy(F.col("owner_id").alias("candidate_id")).agg(F.countDistinct("source_id").alias("replies"))
    return table(spark, sf, "candidates").join(r, "candidate_id", "left").groupBy("municipality", "office").agg(F.count("*").alias("asked"), F.count("replies").alias("answered"), F.coalesce(F.sum("replies"), F.lit(0)).alias("replies"))


@query("SELECT candidate_id FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM source_docs s WHERE s.owner_id = c.candidate_id AND s.source_type = 'questionnaire_reply')")
def jon22_non_responders(spark: SparkSession, sf: str) -> DataFrame:
    answered = table(spark, sf, "source_docs").where("source_type = 'questionnaire_reply'").select(F.col("owner_id").alias("candidate_id"))
    return table(spark, sf, "candidates").select("candidate_id").join(answered, "candidate_id", "left_anti")


@query(f"""
WITH v AS ({_VOTES}) SELECT vote_id, CASE WHEN meeting_date >= DATE '2024-09-01' THEN 'upcoming' ELSE 'past' END AS side, min(meeting_date) FILTER (WHERE meeting_date >= DATE '2024-09-01') OVER (PARTITION BY municipality)::VARCHAR AS next_meeting FROM v""")
def flt24_upcoming(spark: SparkSession, sf: str) -> DataFrame:
    """Meetings before and after a day, with each municipality's next one."""
    today = F.lit("2024-09-01").cast("date")
    coming = F.when(F.col("meeting_date") >= today, F.col("meeting_date"))
    return _votes(spark, sf).select("vote_id", F.when(coming.isNotNull(), "upcoming").otherwise("past").alias("side"), F.date_format(F.min(coming).over(Window.partitionBy("municipality")), "yyyy-MM-dd").alias("next_meeting"))


@query("SELECT c.candidate_id, c.full_name || CASE WHEN m.member_id IS NOT NULL THEN ' (member)' ELSE '' END || CASE WHEN coalesce(c.incumbent, false) THEN ' (incumbent)' ELSE '' END AS line FROM candidates c LEFT JOIN rosters m ON m.member_id = c.candidate_id")
def hlp11_person_line(spark: SparkSession, sf: str) -> DataFrame:
    """A person's line with their tags."""
    seated = table(spark, sf, "rosters").select(F.col("member_id").alias("candidate_id"), F.lit(" (member)").alias("m"))
    both = table(spark, sf, "candidates").join(seated, "candidate_id", "left")
    return both.select("candidate_id", F.concat("full_name", F.coalesce("m", F.lit("")), F.when(F.coalesce("incumbent", F.lit(False)), " (incumbent)").otherwise("")).alias("line"))
