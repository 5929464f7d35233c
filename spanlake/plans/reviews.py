"""Voices, exclusions, reviews and the smaller published lists, on cases planted by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanlake.functions import dates, text as tx, urls
from spanlake.operators import checks, ordering, records, reviews, web
from spanlake.operators.tagging import TAXONOMY
from spanlake.plans.composite import OFFICES, TOPICS
from spanlake.plans.records import _CAST, _VOTES, HINTS, _cast, _positions, _votes
from spanlake.plans.registry import query
from spanlake.sources import sinks
from spanlake.sources.readers import table


def _voiced(spark: SparkSession, sf: str) -> DataFrame:
    """Passages with a beginning by position_id % 7: praise, a narrator, an introduction, a plain quotation, or none."""
    people = table(spark, sf, "candidates").select(F.col("candidate_id").alias("owner_id"), "full_name", F.substring_index("full_name", " ", 1).alias("first_name"))
    p = _positions(spark, sf, "owner_id", "quote").join(people, "owner_id").withColumn("k", F.col("position_id") % 7)
    begin = (
        F.when(F.col("k") == 0, F.concat(F.lit("“"), "full_name", F.lit(" listens.” "))).when(F.col("k") == 1, F.concat(F.lit("I’ve  known them for years; "), "first_name", F.lit("’s record speaks. ")))
        .when(F.col("k") == 2, F.concat(F.lit('"I have met many. My name is '), "first_name", F.lit(', and '), "full_name", F.lit(' it is." '))).when(F.col("k") == 3, F.lit("« Zzz » ")).otherwise("")
    )
    return p.withColumn("quote", F.concat(begin, "quote"))


@query("SELECT DISTINCT position_id, position_id % 7 IN (0, 1) AS other FROM positions p JOIN candidates c ON c.candidate_id = p.owner_id")
def flt05_other_voice(spark: SparkSession, sf: str) -> DataFrame:
    """Passages in which somebody else speaks of the person."""
    return _voiced(spark, sf).select("position_id", reviews.other_voice(F.col("quote"), F.col("full_name")).alias("other")).distinct()


def _beginnings(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed exclusions: the beginnings of every 25th passage, and one of each of their owners that none has."""
    some = _positions(spark, sf, "owner_id", "quote").where("owner_id is not null and position_id % 25 = 0")
    cut = some.select("owner_id", F.substring(tx.collapse(F.col("quote")), F.lit(1), (F.lit(12) + F.col("position_id") % 3 * 6).cast("int")).alias("starts_with"))
    return cut.unionByName(some.select("owner_id", F.lit("zz no such beginning").alias("starts_with"))).distinct()


_TIDY = "trim(regexp_replace(quote, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))"
_STARTS = f"""
p AS (SELECT DISTINCT position_id, owner_id, {_TIDY} AS q FROM positions WHERE owner_id IS NOT NULL),
x AS (SELECT DISTINCT owner_id, substring(q, 1, (12 + position_id % 3 * 6)::INT) AS s FROM p WHERE position_id % 25 = 0 UNION SELECT DISTINCT owner_id, 'zz no such beginning' FROM p WHERE position_id % 25 = 0)"""


@query(f"WITH {_STARTS} SELECT position_id, (SELECT max(s) FROM x WHERE x.owner_id = p.owner_id AND starts_with(p.q, x.s)) AS excluded_by FROM p")
def flt06_excluded(spark: SparkSession, sf: str) -> DataFrame:
    """Passages that a reviewed beginning takes out, met by owner and cut length."""
    p = _positions(spark, sf, "owner_id", "quote").where("owner_id is not null")
    return reviews.excluded(p, _beginnings(spark, sf), "owner_id", "quote").select("position_id", "excluded_by").distinct()


@query(f"WITH {_STARTS} SELECT owner_id, s AS starts_with FROM x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.owner_id = x.owner_id AND starts_with(p.q, x.s))")
def flt07_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed beginnings that match nothing any more."""
    return reviews.stale(_positions(spark, sf, "owner_id", "quote").where("owner_id is not null"), _beginnings(spark, sf), "owner_id", "quote")


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    """A review of every vote, with one fault by the last digit of its place; the places 20, 40, ... are reviewed twice."""
    v = ordering.global_rank(_votes(spark, sf).select("vote_id", "title", "municipality"), ["vote_id"], "k").withColumn("d", F.col("k") % 10)
    first = table(spark, sf, "rosters").groupBy("municipality").agg(F.min("surname").alias("surname"))
    v = v.join(F.broadcast(first), "municipality", "left")
    d = F.col("d")
    row = v.select(
        F.when(d == 1, F.concat(F.lit("gone-"), "vote_id")).otherwise(F.col("vote_id")).alias("vote_id"), F.when(d == 2, "pending").when(d == 3, "draft").otherwise("approved").alias("status"),
        F.when(d == 4, F.array(F.lit("weather"))).when(d == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("budget"))).alias("issues"),
        F.when(d == 6, F.lit("TODO")).when(d == 7, F.concat(F.coalesce("surname", F.lit("nobody")), F.lit("'s plan"))).when(d == 8, F.repeat(F.lit("long "), F.lit(60))).otherwise("A plain summary.").alias("summary"),
        F.when(d == 9, F.create_map(F.lit("Nobody Here"), F.lit("maybe"))).when(F.col("surname").isNotNull(), F.create_map("surname", F.lit("for"))).alias("votes"), "k",
    )
    return row.drop("k").unionByName(row.where("k % 20 = 0").drop("k"))


@query(f"""
WITH v AS ({_VOTES}), f AS (SELECT municipality, min(surname) AS surname FROM rosters GROUP BY 1), k AS (SELECT vote_id, municipality, row_number() OVER (ORDER BY vote_id) AS k FROM v),
r AS (SELECT k.*, k % 10 AS d, f.surname FROM k LEFT JOIN f USING (municipality))
SELECT 'gone-' || vote_id AS vote_id, 'no_such_vote' AS problem FROM r WHERE d = 1 UNION SELECT vote_id, 'bad_status' FROM r WHERE d = 2 UNION SELECT vote_id, 'unknown_issue' FROM r WHERE d = 4 UNION SELECT vote_id, 'no_issue' FROM r WHERE d = 5
UNION SELECT vote_id, 'placeholder' FROM r WHERE d = 6 UNION SELECT vote_id, 'names_a_person' FROM r WHERE d = 7 AND surname IS NOT NULL UNION SELECT vote_id, 'too_long' FROM r WHERE d = 8
UNION SELECT vote_id, unnest(['unknown_member', 'unknown_decision']) FROM r WHERE d = 9 UNION SELECT vote_id, 'reviewed_twice' FROM r WHERE k % 20 = 0""")
def dq09_review_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule that a review breaks, as one list to be empty before publishing."""
    return reviews.review_problems(_reviews(spark, sf), _votes(spark, sf), table(spark, sf, "rosters"), list(TOPICS))


@query(f"""
WITH v AS ({_VOTES}), k AS (SELECT vote_id, title, outcome, row_number() OVER (ORDER BY vote_id) AS k FROM v)
SELECT vote_id, coalesce(title, '') AS title, k % 20 = 0 AS twice FROM k WHERE k % 10 NOT IN (1, 2, 3)""")
def jon18_reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Approved reviews with their votes; those of votes that are gone drop out."""
    approved = _reviews(spark, sf).where("status = 'approved'").groupBy("vote_id").agg(F.count("*").alias("n"))
    return _votes(spark, sf).select("vote_id", F.coalesce("title", F.lit("")).alias("title")).join(approved, "vote_id").select("vote_id", "title", (F.col("n") > 1).alias("twice"))


@query(f"""
WITH s AS (SELECT DISTINCT position_id, owner_id AS member_id, category FROM positions WHERE kind = 'position' AND owner_id IS NOT NULL),
t AS (SELECT DISTINCT vote_id, unnest(district_categories) AS c FROM ({_VOTES})), h AS (SELECT DISTINCT vote_id, unnest(CASE c {" ".join(f"WHEN '{k}' THEN {v!r}" for k, v in HINTS.items())} ELSE [] END) AS category FROM t),
b AS (SELECT member_id, category, string_agg(vote_id || '=' || decision, ',' ORDER BY vote_id) AS votes FROM ({_CAST}) JOIN h USING (vote_id) GROUP BY 1, 2),
q AS (SELECT member_id, category, string_agg(position_id::VARCHAR, ',' ORDER BY position_id) AS promises FROM s GROUP BY 1, 2)
SELECT coalesce(q.member_id, b.member_id) AS member_id, coalesce(q.category, b.category) AS category, coalesce(promises, '') AS promises, coalesce(votes, '') AS votes
FROM q FULL JOIN b ON b.member_id = q.member_id AND b.category = q.category WHERE coalesce(q.member_id, b.member_id) IN (SELECT member_id FROM rosters)""")
def qry08_promises_and_votes(spark: SparkSession, sf: str) -> DataFrame:
    """What a member said beside how they voted, by issue; one shuffle by union."""
    said = table(spark, sf, "positions").where("kind = 'position' and owner_id is not null").select(F.col("owner_id").alias("member_id"), "category", F.struct(F.col("position_id").alias("p"), F.lit(None).cast("struct<vote_id:string,decision:string>").alias("v")).alias("x")).distinct()
    topics = _votes(spark, sf).select("vote_id", F.explode(records.hinted(F.col("district_categories"), HINTS)).alias("category"))
    voted = _cast(spark, sf).join(topics, "vote_id").select("member_id", "category", F.struct(F.lit(None).cast("bigint").alias("p"), F.struct("vote_id", "decision").alias("v")).alias("x"))
    members = table(spark, sf, "rosters").select("member_id")
    both = said.unionByName(voted).join(F.broadcast(members), "member_id", "left_semi").groupBy("member_id", "category").agg(F.array_sort(F.collect_list("x.p")).alias("p"), F.array_sort(F.collect_list("x.v")).alias("v"))
    return both.select("member_id", "category", F.array_join(F.col("p").cast("array<string>"), ",").alias("promises"), F.array_join(F.transform("v", lambda v: F.concat_ws("=", v["vote_id"], v["decision"])), ",").alias("votes"))


@query("""
WITH a AS (SELECT DISTINCT owner_id FROM source_docs WHERE source_type = 'questionnaire_reply'), c AS (SELECT municipality, contains(lower(full_name), 'el') AS hit, a.owner_id IS NOT NULL AS answered FROM candidates LEFT JOIN a ON a.owner_id = candidate_id),
n AS (SELECT municipality, count(*) FILTER (WHERE hit AND answered) AS answered, count(*) FILTER (WHERE hit AND NOT answered) AS silent FROM c GROUP BY 1)
SELECT municipality, answered, silent, CASE WHEN answered + silent = 0 THEN 'nobody by that name' WHEN silent = 0 THEN 'all answered' WHEN answered = 0 THEN 'none answered' ELSE 'some answered' END AS message FROM n""")
def flt23_answer_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search by part of a name among those who answered and those who did not, with its message."""
    answered = table(spark, sf, "source_docs").where("source_type = 'questionnaire_reply'").select(F.col("owner_id").alias("candidate_id"), F.lit(True).alias("answered")).distinct()
    c = table(spark, sf, "candidates").select("candidate_id", "municipality", F.contains(F.lower("full_name"), F.lit("el")).alias("hit")).join(answered, "candidate_id", "left")
    n = c.groupBy("municipality").agg(F.count_if(F.col("hit") & F.col("answered").isNotNull()).alias("answered"), F.count_if(F.col("hit") & F.col("answered").isNull()).alias("silent"))
    message = F.when(F.col("answered") + F.col("silent") == 0, "nobody by that name").when(F.col("silent") == 0, "all answered").when(F.col("answered") == 0, "none answered").otherwise("some answered")
    return n.withColumn("message", message)


@query("""
WITH k AS (SELECT candidate_id, municipality, CASE office WHEN 'mayor' THEN 1 WHEN 'council' THEN 2 WHEN 'trustee' THEN 3 ELSE 4 END AS race, row_number() OVER (ORDER BY candidate_id) AS k FROM candidates)
SELECT candidate_id, race::INT AS race, row_number() OVER (PARTITION BY municipality, race ORDER BY candidate_id) AS place FROM k WHERE k % 3 = 0""")
def flt25_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    """A kept list of ids, some of them unknown, grouped by race."""
    people = ordering.global_rank(table(spark, sf, "candidates").select("candidate_id", "municipality", "office"), ["candidate_id"], "k")
    kept = people.where("k % 3 = 0").select("candidate_id").unionByName(people.where("k % 3 = 1").select(F.concat(F.lit("gone-"), "candidate_id").alias("candidate_id")))
    race = ordering.rank_in(F.col("office"), OFFICES).cast("int").alias("race")
    known = people.join(kept, "candidate_id", "left_semi").select("candidate_id", "municipality", race)
    return known.select("candidate_id", "race", F.row_number().over(Window.partitionBy("municipality", "race").orderBy("candidate_id")).cast("bigint").alias("place"))


@query(f"""
WITH t AS (SELECT DISTINCT municipality, member_id, surname FROM rosters), v AS (SELECT municipality, member_id, upper(surname) AS spelling FROM t UNION SELECT municipality, member_id, ' ' || lower(surname) || '  ' FROM t),
n AS (SELECT municipality, lower(replace(spelling, ' ', '')) AS key, count(DISTINCT member_id) AS people, min(member_id) AS member_id FROM v GROUP BY 1, 2)
SELECT candidate_id, n.member_id FROM candidates c JOIN n ON n.municipality = c.municipality AND n.key = lower(replace(c.surname, ' ', '')) WHERE people = 1""")
def jon10_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Names met with members through a table of spellings, letter case and blanks aside; ambiguous ones drop out."""
    m = table(spark, sf, "rosters").select("municipality", "member_id", F.explode(F.array(F.upper("surname"), F.concat(F.lit(" "), F.lower("surname"), F.lit("  ")))).alias("spelling"))
    key = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("")))
    one = m.groupBy("municipality", key("spelling").alias("key")).agg(F.countDistinct("member_id").alias("people"), F.min("member_id").alias("member_id")).where("people = 1")
    people = table(spark, sf, "candidates").select("candidate_id", "municipality", key("surname").alias("key"))
    return people.join(one, ["municipality", "key"]).select("candidate_id", "member_id")


@query("""
WITH a AS (SELECT candidate_id, municipality, office, CASE WHEN incumbent THEN 'Old ' || full_name ELSE full_name END AS written, full_name FROM candidates)
SELECT written, municipality, office, min(candidate_id) AS candidate_id FROM a GROUP BY 1, 2, 3 HAVING count(*) = 1""")
def jon21_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Names as written to people, through aliases, within municipality and office."""
    c = table(spark, sf, "candidates").select("candidate_id", "municipality", "office", "full_name", "incumbent")
    written = c.select("municipality", "office", F.when(F.col("incumbent"), F.concat(F.lit("Old "), "full_name")).otherwise(F.col("full_name")).alias("written")).groupBy("municipality", "office", "written").agg(F.count("*").alias("n")).where("n = 1")
    alias = c.where("incumbent").select(F.concat(F.lit("Old "), "full_name").alias("written"), "full_name").distinct()
    named = written.join(alias, "written", "left").withColumn("full_name", F.coalesce("full_name", "written"))
    own = c.where("coalesce(incumbent, false)").unionByName(c.where("not coalesce(incumbent, false)"))
    is_alias = F.col("written").startswith("Old ")
    met = named.join(own.withColumnRenamed("incumbent", "inc"), ["municipality", "office", "full_name"]).where(is_alias == F.coalesce("inc", F.lit(False)))
    return met.select("written", "municipality", "office", "candidate_id")


@query(f"WITH v AS ({_VOTES}) SELECT vote_id, row_number() OVER (ORDER BY meeting_date, vote_id) AS place FROM v")
def srt03_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews by day, then vote."""
    return ordering.global_rank(_votes(spark, sf).select("vote_id", "meeting_date"), ["meeting_date", "vote_id"], "place").select("vote_id", "place")


@query("SELECT vote_id, loaded_at, row_number() OVER (ORDER BY meeting_date, coalesce(item_number, ''), vote_id, loaded_at) AS place FROM (SELECT DISTINCT vote_id, meeting_date, item_number, loaded_at FROM vote_items)")
def srt04_raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered rows by day and item number as text, a missing one first."""
    rows = table(spark, sf, "vote_items").select("vote_id", "meeting_date", F.coalesce("item_number", F.lit("")).alias("item"), "item_number", "loaded_at").distinct()
    return ordering.global_rank(rows, ["meeting_date", "item", "vote_id", "loaded_at"], "place").select("vote_id", "loaded_at", "place")


@query("""
WITH n AS (SELECT c.municipality, c.office, c.candidate_id, count(DISTINCT p.position_id) AS votes FROM candidates c LEFT JOIN positions p ON p.owner_id = c.candidate_id GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY municipality, office ORDER BY votes DESC, candidate_id) AS place FROM n)
SELECT candidate_id, votes, place, place <= CASE office WHEN 'mayor' THEN 1 ELSE 3 END AS elected FROM r""")
def srt06_winners(spark: SparkSession, sf: str) -> DataFrame:
    """Seats by count (here: of passages), within each race."""
    n = table(spark, sf, "positions").groupBy(F.col("owner_id").alias("candidate_id")).agg(F.countDistinct("position_id").alias("votes"))
    c = table(spark, sf, "candidates").select("candidate_id", "municipality", "office").join(n, "candidate_id", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("municipality", "office").orderBy(F.desc("votes"), "candidate_id")).cast("bigint")
    return c.withColumn("place", place).select("candidate_id", "votes", "place", (F.col("place") <= F.when(F.col("office") == "mayor", 1).otherwise(3)).alias("elected"))


@query("""
WITH f AS (SELECT DISTINCT position_id, quote FROM positions WHERE length(quote) > 500), t AS (SELECT position_id FROM f ORDER BY length(quote) DESC, position_id LIMIT 5) SELECT position_id, (SELECT count(*) FROM f) AS flagged FROM t""")
def top04_first_flags(spark: SparkSession, sf: str) -> DataFrame:
    """The first five rows that are flagged, with the number of all."""
    f = _positions(spark, sf, F.length("quote").alias("n")).where("n > 500")
    return f.orderBy(F.desc("n"), "position_id").limit(5).select("position_id").crossJoin(F.broadcast(f.agg(F.count("*").alias("flagged"))))  # a single row


@query(f"""
WITH v AS ({_VOTES}), e AS (SELECT vote_id, unnest(district_categories) AS c, unnest(range(1, len(district_categories) + 1)) AS k FROM v),
h AS (SELECT vote_id, k, unnest(CASE c {" ".join(f"WHEN '{k}' THEN {v!r}" for k, v in HINTS.items())} ELSE [] END) AS issue, unnest(range(1, len(CASE c {" ".join(f"WHEN '{k}' THEN {v!r}" for k, v in HINTS.items())} ELSE [] END) + 1)) AS j FROM e),
f AS (SELECT vote_id, issue, min(k * 100 + j) AS at1 FROM h WHERE issue <> 'care' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vote_id ORDER BY at1) AS n FROM f)
SELECT v.vote_id, coalesce((SELECT string_agg(issue, ',' ORDER BY at1) FROM r WHERE r.vote_id = v.vote_id AND n <= 2), '') AS issues FROM v""")
def top05_two_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Of the proposed issues the allowed ones, at most two."""
    allowed = F.array(*(F.lit(t) for t in TOPICS if t != "care"))
    return _votes(spark, sf).select("vote_id", F.array_join(F.slice(F.array_intersect(records.hinted(F.col("district_categories"), HINTS), allowed), 1, 2), ",").alias("issues"))


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-08 09:00:00' THEN 'early voting opens first' WHEN ts < TIMESTAMP '2024-01-10 20:00:00' THEN 'early voting is open' WHEN ts < TIMESTAMP '2024-01-20 08:00:00' THEN 'between the two' WHEN ts < TIMESTAMP '2024-01-20 20:00:00' THEN 'the day itself' ELSE 'closed' END AS said FROM events")
def dat08_availability(spark: SparkSession, sf: str) -> DataFrame:
    """What is open at an instant, by two schedules."""
    at = lambda x: F.lit(x).cast("timestamp")
    early = dates.phase(F.col("ts"), at("2024-01-08 09:00:00"), at("2024-01-10 20:00:00"))
    day = dates.phase(F.col("ts"), at("2024-01-20 08:00:00"), at("2024-01-20 20:00:00"))
    said = F.when(early == "before", "early voting opens first").when(early == "during", "early voting is open").when(day == "before", "between the two").when(day == "during", "the day itself").otherwise("closed")
    return table(spark, sf, "events").select("event_id", said.alias("said"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS iso, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d') AS there FROM events")
def dat03_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days out of ISO text, and in a named zone."""
    e = table(spark, sf, "events")
    iso = dates.iso_day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", F.date_format(iso, "yyyy-MM-dd").alias("iso"), F.date_format(dates.zone_day(F.col("ts"), "Etc/GMT+8"), "yyyy-MM-dd").alias("there"))


@query("SELECT user_id, CASE WHEN count(*) >= 1000 THEN (count(*) // 1000)::VARCHAR || ',' || lpad((count(*) % 1000)::VARCHAR, 3, '0') ELSE count(*)::VARCHAR END || CASE WHEN count(*) = 1 THEN ' vote' ELSE ' votes' END AS said FROM events GROUP BY 1")
def str27_plural(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", tx.plural(F.col("n"), "vote", "votes").alias("said"))


@query("SELECT DISTINCT source_id, ['jpg', 'png', 'webp', 'gif', 'jpg', 'jpg'][(source_id % 6 + 1)::INT] AS ext FROM source_docs")
def str29_image_extension(spark: SparkSession, sf: str) -> DataFrame:
    """Extensions out of image addresses, jpg where there is none."""
    ending = F.get(F.array(*map(F.lit, (".JPG", ".png?w=1", ".webp#x", ".gif", ".jpeg", ""))), (F.col("source_id") % 6).cast("int"))
    return table(spark, sf, "source_docs").select("source_id", urls.image_extension(F.concat(F.lit("https://x.example/p"), ending)).alias("ext")).distinct()


@query("""SELECT DISTINCT position_id, len(string_split(lower(quote), 'ferry')) - 1 AS marked FROM positions WHERE contains(lower(quote), 'ferry')""")
def str21_highlight(spark: SparkSession, sf: str) -> DataFrame:
    """A quote split around a searched word; every second piece is marked."""
    pieces = F.split(F.lower("quote"), "(?=ferry)|(?<=ferry)")
    marked = F.size(F.filter(pieces, lambda p: p == "ferry")).cast("bigint").alias("marked")
    return table(spark, sf, "positions").where(F.contains(F.lower("quote"), F.lit("ferry"))).select("position_id", marked).distinct()


@query("SELECT json_object('candidate_id', candidate_id, 'office', office, 'surname', surname)::VARCHAR AS value FROM candidates")
def jsn01_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON with sorted keys, nulls kept."""
    return sinks.as_json_lines(table(spark, sf, "candidates").select("surname", "candidate_id", "office"))


@query("SELECT candidate_id, CASE WHEN substring(candidate_id, length(candidate_id), 1) < 'm' THEN 'edited' ELSE surname END AS v FROM candidates")
def stm04_appended(spark: SparkSession, sf: str) -> DataFrame:
    """An append-only update: rows that people edited stay, new keys follow."""
    new = table(spark, sf, "candidates").select("candidate_id", F.col("surname").alias("v"))
    edited = new.where(F.substring("candidate_id", -1, 1) < "m").select("candidate_id", F.lit("edited").alias("v"))
    return sinks.appended(edited, new, "candidate_id", ["candidate_id"])


@query("SELECT category, hue, len(string_split(description, ' ')) AS words FROM (SELECT unnest(['" + "', '".join(TAXONOMY) + "']) AS category, 172 AS hue, 'A short text' AS description)")
def snk02_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """The taxonomy as it is published: descriptions with single blanks, a hue where none is set."""
    rows = spark.range(1).select(F.explode(F.array(*(F.lit(c) for c in TAXONOMY))).alias("category"), F.lit(None).cast("int").alias("hue"), F.lit(" A  short\n text ").alias("description"))
    return rows.select("category", F.coalesce("hue", F.lit(172)).alias("hue"), F.size(F.split(tx.collapse(F.col("description")), " ")).cast("bigint").alias("words"))


@query("SELECT municipality, count(*) AS n, 4::BIGINT AS expected FROM rosters WHERE office = 'council' GROUP BY 1 HAVING count(*) <> 4")
def dq13_seats(spark: SparkSession, sf: str) -> DataFrame:
    """Councils that have more or fewer seats than expected."""
    seats = table(spark, sf, "rosters").where("office = 'council'")
    return checks.wrong_counts(seats, ["municipality"], seats.select("municipality").distinct().withColumn("expected", F.lit(4).cast("bigint")))


_SITE_HOST = "regexp_replace(lower(regexp_extract(website, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '')"


@query(f"""
WITH s AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(e.value, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM (SELECT unnest(map_entries(socials)) AS e FROM candidates WHERE socials IS NOT NULL)),
k AS (SELECT candidate_id, website, row_number() OVER (ORDER BY candidate_id) AS k FROM candidates)
SELECT candidate_id, {_SITE_HOST} AS host FROM k WHERE website IS NOT NULL AND k % 6 <> 0 AND {_SITE_HOST} NOT IN (SELECT host FROM s)""")
def flt12_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Sites to read: there is one, it is not switched off (here: every sixth is), and its host is no social network's."""
    c = table(spark, sf, "candidates")
    social = c.where("socials is not null").select(F.explode("socials").alias("k", "u")).select(urls.host(F.col("u")).alias("host")).distinct()
    off = ordering.global_rank(c.select("candidate_id"), ["candidate_id"], "k").where("k % 6 = 0").select("candidate_id")
    sites = c.where("website is not null").select("candidate_id", urls.host(F.col("website")).alias("host"))
    return sites.join(off, "candidate_id", "left_anti").join(social, "host", "left_anti").select("candidate_id", "host")


@query("SELECT DISTINCT source_id, NOT contains(lower(text), 'cookie') AND len(list_filter(regexp_split_to_array(text, '\\n{2,}'), lambda p: length(trim(p)) >= 120)) > 0 AS has_content FROM source_docs WHERE text IS NOT NULL")
def flt19_has_content(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without the marker of an empty one and with a block of 120 characters."""
    long = F.exists(tx.paragraphs(F.col("text")), lambda p: F.length(p) >= 120)
    return table(spark, sf, "source_docs").where("text is not null").select("source_id", (~F.contains(F.lower("text"), F.lit("cookie")) & long).alias("has_content")).distinct()


@query("SELECT candidate_id, CASE WHEN candidate_id LIKE '%a' THEN 'could not be read' ELSE '' END AS notice FROM candidates")
def hlp07_notices(spark: SparkSession, sf: str) -> DataFrame:
    """People with a hand-kept notice beside them."""
    c = table(spark, sf, "candidates").select("candidate_id")
    notices = c.where(F.col("candidate_id").endswith("a")).select("candidate_id", F.lit("could not be read").alias("notice"))
    return c.join(notices, "candidate_id", "left").select("candidate_id", F.coalesce("notice", F.lit("")).alias("notice"))


@query(f"""
WITH v AS ({_VOTES}) SELECT c.vote_id, c.member_id, CASE c.decision WHEN 'for' THEN 'Voted for' WHEN 'against' THEN 'Voted against' WHEN 'absent' THEN 'Was absent' ELSE 'Did not vote' END AS label,
  CASE WHEN v.minutes_url IS NULL THEN 'not yet adopted' ELSE '' END AS note, len(list_filter(regexp_split_to_array(coalesce(resolution_text, ''), '\\n+'), lambda p: trim(p) <> ''))::INT AS paragraphs FROM ({_CAST}) c JOIN v USING (vote_id)""")
def hlp10_vote_items(spark: SparkSession, sf: str) -> DataFrame:
    """A vote as it is shown beside a member: label, note, paragraphs."""
    d = F.col("decision")
    label = F.when(d == "for", "Voted for").when(d == "against", "Voted against").when(d == "absent", "Was absent").otherwise("Did not vote")
    paragraphs = F.size(F.filter(F.split(F.coalesce("resolution_text", F.lit("")), r"\n+"), lambda p: F.trim(p) != ""))
    v = _votes(spark, sf).select("vote_id", F.when(F.col("minutes_url").isNull(), "not yet adopted").otherwise("").alias("note"), paragraphs.alias("paragraphs"))
    return _cast(spark, sf).join(v, "vote_id").select("vote_id", "member_id", label.alias("label"), "note", "paragraphs")


@query("SELECT candidate_id, office AS read_back FROM candidates")
def str19_office(spark: SparkSession, sf: str) -> DataFrame:
    """Offices out of headings, by how these begin."""
    o = F.col("office")
    heading = F.concat(F.when(o == "mayor", "Candidates for Mayor").when(o == "council", "Council, six seats").otherwise("School Trustee (two)"), F.lit(" – all"))
    t = F.regexp_replace(heading, "^Candidates for ", "")
    office = F.when(t.startswith("Mayor"), "mayor").when(t.startswith("Council"), "council").when(t.startswith("School Trustee"), "trustee")
    return table(spark, sf, "candidates").select("candidate_id", office.alias("read_back"))


@query("SELECT DISTINCT source_id, CASE WHEN source_id % 2 = 0 THEN 'https://video.example/watch?v=x' || source_id ELSE 'https://video.example/watch' END AS page FROM source_docs")
def ext09_video_page(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of embedded videos."""
    i = F.col("source_id").cast("string")
    url = F.when(F.col("source_id") % 2 == 0, F.concat(F.lit("https://video.example/embed/x"), i, F.lit("?autoplay=1#t"))).otherwise(F.lit("https://video.example/watch?list=1"))
    return table(spark, sf, "source_docs").select("source_id", urls.video_page(url).alias("page")).distinct()


@query("SELECT source_id, 2 AS links, any_value(url) || ' ' || any_value(coalesce(title, '')) AS said FROM (SELECT source_id, min(url) AS url, min(title) AS title FROM source_docs GROUP BY 1) GROUP BY 1")
def ext06_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Linked texts collected through a rich-text tree."""
    docs = table(spark, sf, "source_docs").groupBy("source_id").agg(F.min("url").alias("url"), F.min("title").alias("title"))
    mark = lambda kind: F.array(F.struct(F.lit(kind).alias("type"), F.struct(F.lit("x").alias("href")).alias("attrs")))
    leaf = lambda c, kind: F.struct(F.lit("text").alias("type"), c.alias("text"), mark(kind).alias("marks"))
    inner = F.struct(F.lit("item").alias("type"), F.array(leaf(F.lit("plain"), "bold"), leaf(F.coalesce("title", F.lit("")), "link")).alias("content"))
    json = F.concat(F.lit('{"type":"doc","content":[{"type":"p","content":['), F.to_json(leaf(F.col("url"), "link")), F.lit(']},{"type":"list","content":['), F.to_json(inner), F.lit("]}]}"))
    found = docs.select("source_id", web.tree_marks(F.parse_json(json), "link").alias("m"))
    return found.select("source_id", F.size("m").alias("links"), F.array_join("m", " ").alias("said"))


@query("SELECT DISTINCT vote_id, strftime(meeting_date, '%Y-%m-%d') AS day, coalesce(meeting_type, '') AS kind FROM vote_items")
def src15_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Meetings read back from the rows of an HTML table that lists each twice."""
    v = table(spark, sf, "vote_items").select("vote_id", "meeting_date", F.trim(F.coalesce("meeting_type", F.lit(""))).alias("kind"), F.coalesce("meeting_type", F.lit("")).alias("raw")).distinct()
    row = F.concat(F.lit("<tr><td>"), F.date_format("meeting_date", "MMMM d yyyy"), F.lit("</td><td><b>"), "raw", F.lit("</b></td></tr>"))
    html = v.select("vote_id", F.concat(F.lit("<table>"), row, row, F.lit("</table>")).alias("html"), "raw")
    cells = html.select("vote_id", "raw", F.explode(F.array_distinct(web.listing_rows(F.col("html"), r"<tr><td>([^<]+)</td>"))).alias("day"))
    return cells.select("vote_id", F.date_format(dates.parsed_long_date(F.col("day")), "yyyy-MM-dd").alias("day"), F.col("raw").alias("kind")).distinct()
