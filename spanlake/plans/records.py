"""Overlays, votes and checks over candidates, rosters, vote_items, ballots and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanlake.functions.text import fingerprint, normal
from spanlake.operators import checks, dedupe, records
from spanlake.plans.registry import query
from spanlake.sources.readers import table

# Issues hinted at by district categories.
HINTS = {"safety": ["safety", "care"], "budget": ["budget"], "growth": ["homes", "budget"], "learning": ["learning", "care"], "open-government": ["budget", "safety"]}

_CAND = "SELECT * FROM candidates"
_VOTES = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vote_id ORDER BY loaded_at DESC, title) AS rn FROM vote_items) WHERE rn = 1"
_CAST = """SELECT vote_id, member_id, decision FROM (
  SELECT vote_id, member_id, lower(trim(decision)) AS decision, row_number() OVER (PARTITION BY vote_id, member_id ORDER BY recorded_at DESC, lower(trim(decision)) DESC) AS rn
  FROM ballots WHERE member_id IS NOT NULL AND lower(trim(decision)) IN ('for', 'against', 'absent', 'n/a')) WHERE rn = 1"""
_POS = "SELECT DISTINCT position_id, owner_id, kind, category, quote, source_id, source_url, source_type, lang, char_start, char_end FROM positions"


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.latest(table(spark, sf, "vote_items"), ["vote_id"], "loaded_at", "title")


def _cast(spark: SparkSession, sf: str) -> DataFrame:
    return records.ballot_maps(table(spark, sf, "ballots")).select("vote_id", F.explode("members").alias("member_id", "decision"))


def _positions(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Passages once, with the columns asked for: nothing else is read or shuffled."""
    return table(spark, sf, "positions").select("position_id", *columns).distinct()


@query(f"""
WITH s AS (SELECT owner_id, min(url) AS website FROM source_docs WHERE source_type = 'campaign_site' AND owner_id IS NOT NULL GROUP BY owner_id)
SELECT candidate_id, coalesce(c.website, s.website) AS website FROM candidates c LEFT JOIN s ON s.owner_id = c.candidate_id""")
def jon01_fill_null(spark: SparkSession, sf: str) -> DataFrame:
    """Missing websites filled from crawled pages."""
    crawled = table(spark, sf, "source_docs").where("source_type = 'campaign_site' and owner_id is not null").groupBy(F.col("owner_id").alias("candidate_id")).agg(F.min("url").alias("website"))
    return records.fill_nulls(table(spark, sf, "candidates"), crawled, "candidate_id", "website").select("candidate_id", "website")


@query("""
WITH a AS (SELECT DISTINCT owner_id, source_url AS url FROM positions WHERE owner_id IS NOT NULL AND source_url IS NOT NULL),
b AS (SELECT DISTINCT owner_id, url FROM source_docs WHERE owner_id IS NOT NULL)
SELECT owner_id, url FROM a UNION ALL SELECT owner_id, url FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.owner_id = b.owner_id AND a.url = b.url)""")
def jon02_append_new(spark: SparkSession, sf: str) -> DataFrame:
    cited = table(spark, sf, "positions").where("owner_id is not null and source_url is not null").select("owner_id", F.col("source_url").alias("url")).distinct()
    held = table(spark, sf, "source_docs").where("owner_id is not null").select("owner_id", "url").distinct()
    return records.append_new(cited, held, ["owner_id", "url"])


@query("SELECT c.candidate_id, coalesce(m.office, c.office) AS office FROM candidates c LEFT JOIN rosters m ON m.member_id = c.candidate_id")
def jon03_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """Offices as the rosters have them."""
    roster = table(spark, sf, "rosters").select(F.col("member_id").alias("candidate_id"), "office")
    return records.overwrite(table(spark, sf, "candidates"), roster, "candidate_id", "office").select("candidate_id", "office")


@query(f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY owner_id, url ORDER BY loaded_at, source_id) AS rn FROM source_docs WHERE owner_id IS NOT NULL)
SELECT p.position_id, d.source_id FROM ({_POS}) p JOIN d ON d.owner_id = p.owner_id AND d.url = p.source_url AND d.rn = 1""")
def jon05_span_source(spark: SparkSession, sf: str) -> DataFrame:
    """Each passage's source by owner and address, the first loaded."""
    docs = dedupe.first_by(table(spark, sf, "source_docs").where("owner_id is not null"), ["owner_id", "url"], ["loaded_at", "source_id"])
    return _positions(spark, sf, "owner_id", "source_url").withColumnRenamed("source_url", "url").join(docs.select("owner_id", "url", "source_id"), ["owner_id", "url"]).select("position_id", "source_id")


@query("""
WITH e AS (SELECT candidate_id, unnest(map_entries(coalesce(socials, MAP {}::MAP(VARCHAR, VARCHAR)))) AS e FROM candidates),
own AS (SELECT candidate_id, e.key AS k, e.value AS v FROM e),
extra AS (SELECT candidate_id, 'site' AS k, website AS v FROM candidates WHERE website IS NOT NULL UNION ALL SELECT candidate_id, 'video', 'https://video.example/none' FROM candidates)
SELECT candidate_id, k, v FROM own UNION ALL SELECT candidate_id, k, v FROM extra x WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.candidate_id = x.candidate_id AND o.k = x.k)""")
def jon07_map_setdefault(spark: SparkSession, sf: str) -> DataFrame:
    """Social maps with defaults for the keys they lack."""
    extra = F.map_filter(F.create_map(F.lit("site"), F.col("website"), F.lit("video"), F.lit("https://video.example/none")), lambda _, v: v.isNotNull())
    return table(spark, sf, "candidates").select("candidate_id", F.explode(records.set_defaults(F.col("socials"), extra)).alias("k", "v"))


@query("SELECT candidate_id, EXISTS (SELECT 1 FROM rosters r WHERE r.municipality = c.municipality AND upper(r.surname) = upper(c.surname) AND lower(r.given) = lower(c.given)) AS seated FROM candidates c")
def jon08_semi_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Is a person on their municipality's roster, whatever the letter case?"""
    key = lambda: ["municipality", F.upper("surname").alias("s"), F.lower("given").alias("g")]
    roster = table(spark, sf, "rosters").select(*key()).distinct().withColumn("hit", F.lit(True))
    people = table(spark, sf, "candidates").select("candidate_id", *key())
    return people.join(roster, ["municipality", "s", "g"], "left").select("candidate_id", F.coalesce("hit", F.lit(False)).alias("seated"))


@query("""
WITH one AS (SELECT municipality, upper(surname) AS s, count(*) AS n, min(member_id) AS member_id FROM rosters GROUP BY 1, 2 HAVING count(*) = 1)
SELECT c.candidate_id, o.member_id FROM candidates c LEFT JOIN one o ON o.municipality = c.municipality AND o.s = upper(c.surname)""")
def jon09_resolve_surname(spark: SparkSession, sf: str) -> DataFrame:
    """The one member of that surname in the municipality, null if none or several."""
    people = table(spark, sf, "rosters").select("municipality", F.upper("surname").alias("s"), "member_id")
    return records.resolve_one(table(spark, sf, "candidates").select("candidate_id", "municipality", F.upper("surname").alias("s")), people, ["municipality", "s"], "member_id").select("candidate_id", "member_id")


@query(f"""
WITH v AS ({_VOTES}), c AS ({_CAST})
SELECT v.vote_id, r.member_id FROM v JOIN rosters r ON r.municipality = v.municipality
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.vote_id = v.vote_id AND c.member_id = r.member_id)""")
def jon11_missing_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the municipality without a ballot, per vote."""
    due = _votes(spark, sf).select("vote_id", "municipality").join(table(spark, sf, "rosters").select("municipality", "member_id"), "municipality").select("vote_id", "member_id")
    return due.join(_cast(spark, sf), ["vote_id", "member_id"], "left_anti")


@query(f"""
WITH v AS ({_VOTES}), c AS ({_CAST})
SELECT v.vote_id, r.member_id, coalesce(c.decision, 'absent') AS decision FROM v JOIN rosters r ON r.municipality = v.municipality LEFT JOIN c ON c.vote_id = v.vote_id AND c.member_id = r.member_id""")
def jon12_cross_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A decision for every member and vote of a municipality."""
    due = _votes(spark, sf).select("vote_id", "municipality").join(table(spark, sf, "rosters").select("municipality", "member_id"), "municipality")
    return due.join(_cast(spark, sf), ["vote_id", "member_id"], "left").select("vote_id", "member_id", F.coalesce("decision", F.lit("absent")).alias("decision"))


@query("""
WITH d AS (SELECT DISTINCT vote_id, minutes_url FROM vote_items WHERE minutes_url IS NOT NULL), n AS (SELECT minutes_url, count(DISTINCT vote_id) AS votes FROM d GROUP BY 1)
SELECT DISTINCT v.vote_id FROM vote_items v WHERE v.minutes_url IS NULL OR v.minutes_url NOT IN (SELECT minutes_url FROM n WHERE votes > 1)""")
def jon13_unclaimed(spark: SparkSession, sf: str) -> DataFrame:
    """Votes whose minutes no other vote cites."""
    v = table(spark, sf, "vote_items").select("vote_id", "minutes_url").distinct()
    shared = v.where("minutes_url is not null").groupBy("minutes_url").agg(F.countDistinct("vote_id").alias("votes")).where("votes > 1")
    return v.join(shared, "minutes_url", "left_anti").select("vote_id").distinct()


@query("""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), m AS (SELECT DISTINCT strftime(meeting_date, '%Y') AS y FROM vote_items),
h AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'In ([0-9]{4})|[Ss]ince ([0-9]{4})', 0))) AS g FROM d)
SELECT DISTINCT doc_id FROM h JOIN m ON right(g, 4) = y""")
def jon14_contains_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that name a year in which a meeting was held: the phrase is extracted, so the join is by equality."""
    years = table(spark, sf, "vote_items").select(F.date_format("meeting_date", "yyyy").alias("y")).distinct()
    said = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("In [0-9]{4}|[Ss]ince [0-9]{4}"), F.lit(0)))).alias("g"))
    return said.select("doc_id", F.right("g", F.lit(4)).alias("y")).join(years, "y", "left_semi").select("doc_id").distinct()


@query(f"SELECT vote_id FROM ({_VOTES}) v WHERE NOT EXISTS (SELECT 1 FROM ballots b WHERE b.vote_id = v.vote_id AND lower(trim(b.decision)) = 'against')")
def jon15_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Votes without a ballot against."""
    against = table(spark, sf, "ballots").where(records.normal_decision(F.col("decision")) == "against").select("vote_id").distinct()
    return _votes(spark, sf).select("vote_id").join(against, "vote_id", "left_anti")


_HINT = "CASE c " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in HINTS.items()) + " ELSE [] END"


@query(f"""
WITH v AS ({_VOTES}), e AS (SELECT vote_id, unnest(district_categories) AS c, unnest(range(1, len(district_categories) + 1)) AS k FROM v),
h AS (SELECT vote_id, k, unnest({_HINT}) AS issue, unnest(range(1, len({_HINT}) + 1)) AS j FROM e),
f AS (SELECT vote_id, issue, min(k * 100 + j) AS at1 FROM h GROUP BY 1, 2)
SELECT v.vote_id, coalesce((SELECT string_agg(issue, ',' ORDER BY at1) FROM f WHERE f.vote_id = v.vote_id), '') AS issues FROM v""")
def jon16_hint_union(spark: SparkSession, sf: str) -> DataFrame:
    """Issues hinted at by categories, in order, once each."""
    return _votes(spark, sf).select("vote_id", F.array_join(records.hinted(F.col("district_categories"), HINTS), ",").alias("issues"))


@query(f"""
WITH v AS ({_VOTES}), k AS (SELECT vote_id, substring(sha256(vote_id || lower(trim(regexp_replace(title || ' ' || resolution_text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')))), 1, 16) AS key, meeting_date FROM v),
cache AS (SELECT key FROM k WHERE meeting_date < DATE '2024-06-01')
SELECT vote_id, key, key IN (SELECT key FROM cache) AS cached FROM k""")
def jon17_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Content keys of votes against the keys of an earlier run."""
    keys = _votes(spark, sf).select("vote_id", "meeting_date", fingerprint(F.col("vote_id"), normal(F.concat_ws(" ", "title", "resolution_text"))).alias("key"))
    cache = keys.where("meeting_date < date '2024-06-01'").select("key").distinct().withColumn("hit", F.lit(True))
    return keys.join(cache, "key", "left").select("vote_id", "key", F.coalesce("hit", F.lit(False)).alias("cached"))


@query(f"""
WITH c AS ({_CAST}), first AS (SELECT vote_id, min(member_id) AS member_id FROM c GROUP BY 1)
SELECT c.vote_id, c.member_id, CASE WHEN f.member_id IS NOT NULL THEN 'against' ELSE c.decision END AS decision FROM c LEFT JOIN first f USING (vote_id, member_id)""")
def jon19_map_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """A reviewed decision per vote laid over the recorded ones."""
    maps = records.ballot_maps(table(spark, sf, "ballots"))
    reviewed = F.map_from_arrays(F.array(F.array_min(F.map_keys("members"))), F.array(F.lit("against")))
    return maps.select("vote_id", F.explode(records.overlaid(F.col("members"), reviewed)).alias("member_id", "decision"))


@query(f"WITH v AS ({_VOTES}) SELECT municipality, count(*) FILTER (WHERE outcome IS NULL) AS awaiting, count(*) AS votes FROM v GROUP BY municipality")
def jon20_awaiting(spark: SparkSession, sf: str) -> DataFrame:
    return _votes(spark, sf).groupBy("municipality").agg(F.count_if(F.col("outcome").isNull()).alias("awaiting"), F.count("*").alias("votes"))


@query("""
SELECT coalesce(c.candidate_id, r.member_id) AS id, CASE WHEN c.candidate_id IS NULL THEN 'first' ELSE 'second' END AS missing_in FROM candidates c FULL JOIN rosters r ON r.member_id = c.candidate_id
WHERE c.candidate_id IS NULL OR r.member_id IS NULL""")
def jon23_full_check(spark: SparkSession, sf: str) -> DataFrame:
    """People on one list only."""
    return checks.one_sided(table(spark, sf, "candidates").select(F.col("candidate_id").alias("id")), table(spark, sf, "rosters").select(F.col("member_id").alias("id")), "id")


@query(f"""
WITH p AS ({_POS}), a AS (SELECT owner_id, count(*) AS had FROM p GROUP BY 1), b AS (SELECT DISTINCT owner_id FROM p WHERE kind = 'background')
SELECT owner_id, had FROM a WHERE owner_id IS NOT NULL AND owner_id NOT IN (SELECT owner_id FROM b WHERE owner_id IS NOT NULL)""")
def jon29_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Owners with passages before and none in the later snapshot (here: the background ones)."""
    p = _positions(spark, sf, "owner_id", "kind").where("owner_id is not null")
    return records.snapshot_emptied(p, p.where("kind = 'background'"), "owner_id")


_DISP = f"""
WITH v AS ({_VOTES}), b AS (SELECT DISTINCT vote_id, member_id FROM ballots),
u AS (SELECT DISTINCT b.vote_id FROM b LEFT JOIN rosters r ON r.member_id = b.member_id WHERE r.member_id IS NULL),
c AS ({_CAST}), m AS (SELECT DISTINCT v.vote_id FROM v JOIN rosters r ON r.municipality = v.municipality WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.vote_id = v.vote_id AND c.member_id = r.member_id)),
d AS (SELECT v.*, CASE WHEN v.outcome IS NULL THEN 'no_motion' WHEN v.vote_id IN (SELECT vote_id FROM u) THEN 'unknown_name' WHEN v.vote_id IN (SELECT vote_id FROM m) THEN 'missing_member' ELSE 'vote' END AS disposition FROM v)"""


def _disposed(spark: SparkSession, sf: str) -> DataFrame:
    roster = table(spark, sf, "rosters").select("member_id")
    unknown = table(spark, sf, "ballots").select("vote_id", "member_id").distinct().join(roster, "member_id", "left_anti").select("vote_id").distinct().withColumn("u", F.lit(True))
    missing = jon11_missing_members(spark, sf).select("vote_id").distinct().withColumn("m", F.lit(True))
    both = _votes(spark, sf).join(unknown, "vote_id", "left").join(missing, "vote_id", "left")
    where = records.disposition(F.col("outcome").isNull(), F.coalesce("u", F.lit(False)), F.coalesce("m", F.lit(False)))
    return both.withColumn("disposition", where).drop("u", "m")


@query(_DISP + " SELECT vote_id, disposition FROM d")
def flt15_disposition(spark: SparkSession, sf: str) -> DataFrame:
    """Where each row goes, by the first reason that holds."""
    return _disposed(spark, sf).select("vote_id", "disposition")


@query(_DISP + ", bad AS (SELECT DISTINCT municipality, meeting_date FROM d WHERE disposition <> 'vote') SELECT vote_id, (municipality, meeting_date) IN (SELECT (municipality, meeting_date) FROM bad) AS held FROM d")
def flt17_hold_meeting(spark: SparkSession, sf: str) -> DataFrame:
    """All items of a meeting with a problem are held back."""
    d = _disposed(spark, sf)
    bad = d.where("disposition <> 'vote'").select("municipality", "meeting_date").distinct().withColumn("bad", F.lit(True))
    return d.join(bad, ["municipality", "meeting_date"], "left").select("vote_id", F.coalesce("bad", F.lit(False)).alias("held"))


@query(f"WITH v AS ({_VOTES}) SELECT vote_id, meeting_date::VARCHAR AS day FROM v WHERE meeting_date >= DATE '2024-01-01'")
def flt14_since(spark: SparkSession, sf: str) -> DataFrame:
    """Votes since a day; the filter reaches the scan."""
    fresh = table(spark, sf, "vote_items").where("meeting_date >= date '2024-01-01'")
    return dedupe.latest(fresh, ["vote_id"], "loaded_at", "title").select("vote_id", F.date_format("meeting_date", "yyyy-MM-dd").alias("day"))


@query(f"SELECT municipality, office, count(*) AS n, 2::BIGINT AS expected FROM candidates GROUP BY 1, 2 HAVING count(*) <> 2")
def agg01_expected_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Group sizes that are not as expected."""
    people = table(spark, sf, "candidates")
    expected = people.select("municipality", "office").distinct().withColumn("expected", F.lit(2).cast("bigint"))
    return checks.wrong_counts(people, ["municipality", "office"], expected)


@query(f"""
SELECT municipality, count(*) AS people, count(*) FILTER (WHERE incumbent) AS incumbents, count(website) AS with_site, coalesce(sum(len(nomination_docs)), 0)::BIGINT AS documents FROM candidates GROUP BY 1""")
def agg02_report(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "candidates")
    return c.groupBy("municipality").agg(F.count("*").alias("people"), F.count_if("incumbent").alias("incumbents"), F.count("website").alias("with_site"), F.coalesce(F.sum(F.greatest(F.size("nomination_docs"), F.lit(0))), F.lit(0)).alias("documents"))


@query("SELECT municipality, count(*) FILTER (WHERE office = 'mayor') AS mayors, count(*) FILTER (WHERE office = 'council') AS seats FROM rosters GROUP BY 1 HAVING count(*) FILTER (WHERE office = 'mayor') <> 1 OR count(*) FILTER (WHERE office = 'council') <> 5")
def agg12_seats(spark: SparkSession, sf: str) -> DataFrame:
    """Municipalities without one mayor and five seats of council."""
    counts = table(spark, sf, "rosters").groupBy("municipality").agg(F.count_if(F.col("office") == "mayor").alias("mayors"), F.count_if(F.col("office") == "council").alias("seats"))
    return counts.where("mayors <> 1 or seats <> 5")


@query(f"""
WITH c AS ({_CAST}), n AS (SELECT vote_id, count(*) FILTER (WHERE decision = 'for') AS n_for, count(*) FILTER (WHERE decision = 'against') AS n_against FROM c GROUP BY 1), v AS ({_VOTES})
SELECT v.vote_id, n_for, n_against, CASE WHEN lower(outcome) = 'carried' AND n_for <= n_against THEN 'carried_without_majority' WHEN lower(outcome) = 'defeated' AND n_for > n_against THEN 'defeated_with_majority' ELSE '' END AS flags FROM v JOIN n USING (vote_id)""")
def agg13_for_against(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per vote, and outcomes that do not follow from them."""
    n = _cast(spark, sf).groupBy("vote_id").agg(F.count_if(F.col("decision") == "for").alias("n_for"), F.count_if(F.col("decision") == "against").alias("n_against"))
    out = F.lower("outcome")
    marks = checks.flags(carried_without_majority=(out == "carried") & (F.col("n_for") <= F.col("n_against")), defeated_with_majority=(out == "defeated") & (F.col("n_for") > F.col("n_against")))
    return _votes(spark, sf).join(n, "vote_id").select("vote_id", "n_for", "n_against", F.array_join(marks, ",").alias("flags"))


@query(f"""
WITH v AS ({_VOTES}) SELECT municipality, count(*) AS votes, count(*) FILTER (WHERE source_kind = 'minutes') AS from_minutes, count(DISTINCT meeting_date) AS meetings, max(meeting_date)::VARCHAR AS latest FROM v GROUP BY 1""")
def agg14_status(spark: SparkSession, sf: str) -> DataFrame:
    v = _votes(spark, sf)
    return v.groupBy("municipality").agg(F.count("*").alias("votes"), F.count_if(F.col("source_kind") == "minutes").alias("from_minutes"), F.countDistinct("meeting_date").alias("meetings"), F.date_format(F.max("meeting_date"), "yyyy-MM-dd").alias("latest"))


@query("SELECT owner_id, sum(length(text))::BIGINT AS chars, sum(length(text)) < 5000 AS needs_render FROM (SELECT DISTINCT source_id, owner_id, text FROM source_docs WHERE owner_id IS NOT NULL) GROUP BY 1")
def agg19_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Captured text per owner, and who has too little of it."""
    docs = table(spark, sf, "source_docs").where("owner_id is not null").select("source_id", "owner_id", "text").distinct()
    return docs.groupBy("owner_id").agg(F.sum(F.length("text")).alias("chars")).withColumn("needs_render", F.col("chars") < 5000)


@query("SELECT position_id, count(*) AS n FROM positions GROUP BY 1 HAVING count(*) > 1")
def dq02_duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicate_keys(table(spark, sf, "positions"), ["position_id"])


@query(f"""
WITH d AS (SELECT DISTINCT source_id, text FROM source_docs), p AS ({_POS}), j AS (SELECT p.*, d.text FROM p LEFT JOIN d USING (source_id)),
r AS (SELECT position_id, CASE WHEN text IS NULL THEN 'no source' WHEN trim(quote) = '' THEN 'empty' WHEN NOT coalesce(char_start >= 0 AND char_start < char_end AND char_end <= length(text) AND substring(text, char_start + 1, greatest(char_end - char_start, 0)) = quote, false) THEN 'not at its place' END AS reason FROM j)
SELECT position_id, reason FROM r WHERE reason IS NOT NULL""")
def dq03_unverified(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "source_docs").select("source_id", "text").distinct()
    spans = table(spark, sf, "positions").select("position_id", "source_id", "quote", "char_start", "char_end")
    return checks.unverified_spans(spans, docs, "source_id").select("position_id", "reason").distinct()


@query("""SELECT owner_id FROM (SELECT DISTINCT owner_id FROM source_docs WHERE owner_id IS NOT NULL) s WHERE owner_id NOT IN (SELECT owner_id FROM positions WHERE owner_id IS NOT NULL AND category = 'homes')""")
def dq04_untagged(spark: SparkSession, sf: str) -> DataFrame:
    """Owners with sources and no passage on homes."""
    return records.unknown_keys(table(spark, sf, "source_docs"), table(spark, sf, "positions").where("owner_id is not null and category = 'homes'").select("owner_id").distinct(), "owner_id")


@query("SELECT decision, count(*) AS n FROM ballots WHERE decision NOT IN ('for', 'against', 'absent', 'n/a') GROUP BY 1")
def dq10_unknown_decision(spark: SparkSession, sf: str) -> DataFrame:
    return checks.unknown_values(table(spark, sf, "ballots"), "decision", ["for", "against", "absent", "n/a"])


@query("SELECT owner_id FROM source_docs WHERE owner_id IS NOT NULL EXCEPT SELECT member_id FROM rosters")
def set03_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Owners of sources who are no members."""
    docs = table(spark, sf, "source_docs").where("owner_id is not null").select("owner_id")
    return docs.subtract(table(spark, sf, "rosters").select(F.col("member_id").alias("owner_id")))


@query("SELECT 'person' AS kind, municipality, candidate_id AS id FROM candidates UNION ALL SELECT 'member', municipality, member_id FROM rosters")
def set01_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "candidates").select(F.lit("person").alias("kind"), "municipality", F.col("candidate_id").alias("id"))
    return a.unionByName(table(spark, sf, "rosters").select(F.lit("member").alias("kind"), "municipality", F.col("member_id").alias("id")))


@query(f"""
WITH c AS ({_CAST}), called AS (SELECT vote_id, member_id FROM c), here AS (SELECT vote_id, member_id FROM c WHERE decision <> 'absent')
SELECT vote_id, member_id FROM called EXCEPT SELECT vote_id, member_id FROM here""")
def set04_attendance(spark: SparkSession, sf: str) -> DataFrame:
    """Set difference of those called and those present."""
    c = _cast(spark, sf)
    return c.select("vote_id", "member_id").subtract(c.where("decision <> 'absent'").select("vote_id", "member_id"))


@query("SELECT category, count(*) AS n FROM positions WHERE category NOT IN (SELECT unnest(['safety', 'shore-and-parks', 'growth', 'getting-around', 'budget', 'care', 'learning', 'open-government', 'homes', 'shops']) UNION SELECT unnest(['held-office', 'service', 'roots', 'study'])) GROUP BY 1")
def set06_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Categories outside the union of two lists."""
    topics, kinds = ["safety", "shore-and-parks", "growth", "getting-around", "budget", "care", "learning", "open-government", "homes", "shops"], ["held-office", "service", "roots", "study"]
    return checks.unknown_values(table(spark, sf, "positions"), "category", topics + kinds)


@query("""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\\.html|/)$', '')) ORDER BY length(text) DESC, loaded_at, source_id) AS rn FROM source_docs WHERE text IS NOT NULL)
SELECT source_id FROM d WHERE rn = 1""")
def stm03_keep_larger(spark: SparkSession, sf: str) -> DataFrame:
    """Of the captures of one page the one with most text."""
    key = F.lower(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), r"(\.html|/)$", ""))
    docs = table(spark, sf, "source_docs").where("text is not null").withColumn("page", key)
    return dedupe.first_by(docs, ["page"], [F.length("text").desc(), "loaded_at", "source_id"]).select("source_id")


@query("SELECT source_id, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY loaded_at DESC, url) AS rn FROM source_docs) WHERE rn = 1")
def win07_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """One row per source, the last delivered."""
    return dedupe.latest(table(spark, sf, "source_docs"), ["source_id"], "loaded_at", "url").select("source_id", "loaded_at")


@query(f"""
WITH b AS (SELECT member_id, vote_id, recorded_at, lower(trim(decision)) = 'absent' AS out FROM ballots WHERE member_id IS NOT NULL AND decision IS NOT NULL)
SELECT DISTINCT member_id, vote_id, recorded_at, coalesce(last_value(out) OVER (PARTITION BY member_id ORDER BY recorded_at, vote_id, out ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was_out FROM b""")
def win08_room_state(spark: SparkSession, sf: str) -> DataFrame:
    """Was a member away at the ballot before?"""
    b = table(spark, sf, "ballots").where("member_id is not null and decision is not null").withColumn("out", records.normal_decision(F.col("decision")) == "absent")
    before = Window.partitionBy("member_id").orderBy("recorded_at", "vote_id", "out").rowsBetween(Window.unboundedPreceding, -1)
    return b.select("member_id", "vote_id", "recorded_at", F.coalesce(F.last("out").over(before), F.lit(False)).alias("was_out")).distinct()
