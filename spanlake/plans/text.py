"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlake.functions import dates, text as tx, urls
from spanlake.operators import ordering, surveys
from spanlake.plans.registry import query
from spanlake.sources.readers import table


def _people(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "candidates")


_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"SELECT candidate_id, {_SLUG.format('full_name')} AS slug FROM candidates")
def str03_slug(spark: SparkSession, sf: str) -> DataFrame:
    return _people(spark, sf).select("candidate_id", tx.slug(F.col("full_name")).alias("slug"))


@query(f"SELECT candidate_id, concat_ws('-', municipality, office, {_SLUG.format('surname')}, {_SLUG.format('given')}) AS derived FROM candidates")
def str04_person_id(spark: SparkSession, sf: str) -> DataFrame:
    return _people(spark, sf).select("candidate_id", tx.person_id(*(F.col(c) for c in ("municipality", "office", "surname", "given"))).alias("derived"))


def _cap(x: str) -> str:
    return f"upper(substring({x}, 1, 1)) || lower(substring({x}, 2))"


_PART = (
    "CASE WHEN starts_with(p, 'mc') AND length(p) > 2 THEN 'Mc' || upper(substring(p, 3, 1)) || substring(p, 4) "
    "WHEN starts_with(p, 'o''') AND length(p) > 2 THEN 'O''' || upper(substring(p, 3, 1)) || substring(p, 4) ELSE upper(substring(p, 1, 1)) || substring(p, 2) END"
)


@query(f"SELECT candidate_id, array_to_string(list_transform(string_split(lower(surname), '-'), lambda p: {_PART}), '-') AS pretty FROM candidates")
def str01_prettify(spark: SparkSession, sf: str) -> DataFrame:
    return _people(spark, sf).select("candidate_id", tx.pretty_name(F.col("surname")).alias("pretty"))


@query("SELECT candidate_id, trim(string_split(surname || ', ' || given, ',')[1]) AS surname, trim(string_split(surname || ', ' || given, ',')[2]) AS given FROM candidates")
def str02_listing(spark: SparkSession, sf: str) -> DataFrame:
    listing = F.concat_ws(", ", "surname", "given")
    return _people(spark, sf).select("candidate_id", tx.listing_surname(listing).alias("surname"), tx.listing_given(listing).alias("given"))


@query("SELECT DISTINCT source_id, trim(regexp_replace(title, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) AS title FROM source_docs")
def str05_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_docs").select("source_id", tx.collapse(F.col("title")).alias("title")).distinct()


@query("SELECT DISTINCT source_id, coalesce(substring(trim(regexp_replace(title, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')), 1, 120), url) AS title FROM source_docs")
def ext12_title(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of at most 120 characters, the address where there is none."""
    return table(spark, sf, "source_docs").select("source_id", F.coalesce(F.substring(tx.collapse(F.col("title")), 1, 120), "url").alias("title")).distinct()


_HOST = "regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '')"
_PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT DISTINCT url, {_HOST.format('url')} || '/' || regexp_replace(lower({_PATH.format('url')}), '^/+|/+$', '', 'g') AS page_key FROM source_docs")
def str14_page_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_docs").select("url", urls.page_key(F.col("url")).alias("page_key")).distinct()


@query(f"SELECT DISTINCT url, (length(regexp_replace({_PATH.format('url')}, '/+$', '')) - length(replace(regexp_replace({_PATH.format('url')}, '/+$', ''), '/', '')))::INT AS depth FROM source_docs")
def str15_depth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_docs").select("url", urls.depth(F.col("url")).alias("depth")).distinct()


def score_sql(blob: str) -> str:
    """SQL: the weight of the first group of link words that blob holds."""
    return "CASE " + " ".join(f"WHEN regexp_matches({blob}, '{'|'.join(words)}') THEN {weight}" for weight, words in urls.LINK_WORDS) + " ELSE 0 END"


def skipped_sql(url: str) -> str:
    """SQL: is an address none to read?"""
    return f"regexp_matches(lower({url}), '\\.({'|'.join(urls.SKIPPED_FILES)})$|/({'|'.join(urls.SKIPPED_PATHS)})|{'|'.join(urls.SKIPPED_SCHEMES)}')"


@query(f"SELECT DISTINCT url, {score_sql("lower(url || ' ' || coalesce(title, ''))")} AS score FROM source_docs")
def str13_link_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_docs").select("url", urls.link_score(F.col("url"), F.coalesce("title", F.lit(""))).alias("score")).distinct()


@query("SELECT DISTINCT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || substring(url, length(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1) AS target FROM source_docs")
def str16_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    """Each address wrapped five times in a redirect and unwrapped again."""
    wrapped = F.col("url")
    for _ in range(5):
        wrapped = F.concat(F.lit("https://go.example/l.php?u="), F.url_encode(wrapped), F.lit("&h=1"))
    return table(spark, sf, "source_docs").select("url", urls.unwrapped(wrapped).alias("target")).distinct()


@query("SELECT DISTINCT url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '\\.html$', '') AS bare FROM source_docs")
def str28_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Without query, fragment and .html."""
    return table(spark, sf, "source_docs").select("url", urls.without_html(urls.without_query(F.col("url"))).alias("bare")).distinct()


@query(f"SELECT DISTINCT s.source_id, {_HOST.format('s.url')} = {_HOST.format('c.website')} AS same FROM source_docs s JOIN candidates c ON s.owner_id = c.candidate_id WHERE c.website IS NOT NULL")
def flt11_same_host(spark: SparkSession, sf: str) -> DataFrame:
    sites = _people(spark, sf).where("website is not null").select(F.col("candidate_id").alias("owner_id"), "website")
    return table(spark, sf, "source_docs").join(sites, "owner_id").select("source_id", urls.same_host(F.col("url"), F.col("website")).alias("same")).distinct()


@query("SELECT candidate_id, e.key AS network_name, e.value AS url FROM (SELECT candidate_id, unnest(map_entries(socials)) AS e FROM candidates WHERE socials IS NOT NULL)")
def str18_socials(spark: SparkSession, sf: str) -> DataFrame:
    """Social links with the key that their host gives."""
    links = _people(spark, sf).where("socials is not null").select("candidate_id", F.explode("socials").alias("k", "url"))
    return links.select("candidate_id", urls.social_key(F.col("url")).alias("network_name"), "url")


@query("SELECT candidate_id, substring(array_to_string(list_transform(string_split(full_name, ' '), lambda w: upper(substring(w, 1, 1))), ''), 1, 2) AS initials FROM candidates")
def str26_initials(spark: SparkSession, sf: str) -> DataFrame:
    return _people(spark, sf).select("candidate_id", tx.initials(F.col("full_name")).alias("initials"))


@query("SELECT DISTINCT source_id, len(list_filter(list_transform(regexp_split_to_array(text, '\\n{2,}'), lambda p: trim(p)), lambda p: p <> ''))::INT AS paragraphs FROM source_docs WHERE text IS NOT NULL")
def str30_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_docs").where("text is not null").select("source_id", F.size(tx.paragraphs(F.col("text"))).alias("paragraphs")).distinct()


@query("SELECT DISTINCT source_id, len(regexp_extract_all(text, '[a-z][.!?][A-Z][a-z]'))::INT AS glued FROM source_docs WHERE text IS NOT NULL AND regexp_matches(text, '[a-z][.!?][A-Z][a-z]')")
def str31_glued(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "source_docs").where("text is not null").select("source_id", tx.glued_words(F.col("text")).alias("glued"))
    return rows.where("glued > 0").distinct()


@query("SELECT vote_id, array_to_string(list_transform(regexp_extract_all(title, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), '') AS title FROM (SELECT DISTINCT vote_id, title FROM vote_items)")
def str32_title_case(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vote_items").select("vote_id", tx.title_case(F.col("title")).alias("title")).distinct()


@query("SELECT DISTINCT source_id, substring(sha256(url || '::' || text), 1, 16) AS fingerprint FROM source_docs WHERE text IS NOT NULL")
def hsh01_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_docs").where("text is not null").select("source_id", tx.fingerprint(F.col("url"), F.lit("::"), F.col("text")).alias("fingerprint")).distinct()


@query("SELECT DISTINCT position_id, regexp_replace(quote, '[ \\t\\r\\n\\f\\x0B]*\\n[ \\t\\r\\n\\f\\x0B]*', ' ', 'g') AS tidy FROM positions")
def ext20_tidy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "positions").select("position_id", tx.unwrap_lines(F.col("quote")).alias("tidy")).distinct()


@query("""
WITH d AS (SELECT DISTINCT source_id, text FROM source_docs WHERE source_type = 'questionnaire_reply' AND text IS NOT NULL),
l AS (SELECT source_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM d),
n AS (SELECT *, regexp_extract(line, '^([0-9]{1,2})\\.[ \\t]+', 0) AS mark FROM l),
s AS (SELECT *, sum(CASE WHEN mark <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY k) AS seg FROM n)
SELECT source_id, max(CAST(nullif(regexp_extract(mark, '[0-9]+'), '') AS INT)) AS number,
       trim(string_agg(trim(CASE WHEN mark <> '' THEN substring(line, length(mark) + 1) ELSE line END), ' ' ORDER BY k) FILTER (WHERE trim(CASE WHEN mark <> '' THEN substring(line, length(mark) + 1) ELSE line END) <> '')) AS answer
FROM s WHERE seg > 0 GROUP BY source_id, seg""")
def ext19_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered answers of questionnaire replies."""
    docs = table(spark, sf, "source_docs").where("source_type = 'questionnaire_reply' and text is not null").select("source_id", "text").distinct()
    return surveys.numbered_answers(docs, "source_id", "text").select("source_id", "number", "answer")


@query("""
WITH d AS (SELECT DISTINCT source_id, text FROM source_docs WHERE text IS NOT NULL),
l AS (SELECT source_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM d)
SELECT source_id, pos::INT AS pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_start FROM l""")
def win09_offsets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "source_docs").where("text is not null").select("source_id", "text").distinct()
    return surveys.lines_of(docs, "source_id", "text").select("source_id", "pos", "char_start")


@query("""
WITH s AS (SELECT DISTINCT source_id, sent_no, text FROM sentences)
SELECT source_id, sent_no, text, last_value(CASE WHEN ends_with(text, ',') OR ends_with(text, ':') OR sent_no = 0 THEN sent_no END IGNORE NULLS) OVER w AS heading_no, lead(sent_no) OVER w2 AS next_no FROM s
WINDOW w AS (PARTITION BY source_id ORDER BY sent_no, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY source_id ORDER BY sent_no, text NULLS FIRST)""")
def win03_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The last heading-like unit carried along, and the next number."""
    from pyspark.sql import Window

    rows = table(spark, sf, "sentences").select("source_id", "sent_no", "text").distinct()
    heading = F.when(F.col("text").endswith(",") | F.col("text").endswith(":") | (F.col("sent_no") == 0), F.col("sent_no"))
    w = Window.partitionBy("source_id").orderBy("sent_no", "text")
    return rows.select("source_id", "sent_no", "text", F.last(heading, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("heading_no"), F.lead("sent_no").over(w).alias("next_no"))


@query("SELECT DISTINCT vote_id, strftime(meeting_date, '%B %-d, %Y') AS spoken, strftime(strptime(replace(strftime(meeting_date, '%B %-d, %Y'), ',', ''), '%B %-d %Y'), '%Y-%m-%d') AS parsed FROM vote_items")
def dat02_long_date(spark: SparkSession, sf: str) -> DataFrame:
    """Dates in words, and read back."""
    spoken = dates.long_date(F.col("meeting_date"))
    return table(spark, sf, "vote_items").select("vote_id", spoken.alias("spoken"), F.date_format(dates.parsed_long_date(spoken), "yyyy-MM-dd").alias("parsed")).distinct()


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN event_id % 3 = 1 THEN CAST(floor(epoch(ts)) AS BIGINT) ELSE NULL END AS seconds FROM events")
def dat04_mixed_ts(spark: SparkSession, sf: str) -> DataFrame:
    """Instants written as epoch, as ISO text and as neither, read back."""
    epoch, iso = F.unix_timestamp("ts").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    written = F.when(F.col("event_id") % 3 == 0, epoch).when(F.col("event_id") % 3 == 1, iso).otherwise("n/a")
    return table(spark, sf, "events").select("event_id", F.unix_timestamp(dates.mixed_instant(written)).alias("seconds"))


@query("SELECT event_id, strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d') AS day FROM events")
def dat05_local_day(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.date_format(dates.local_day(F.col("ts")), "yyyy-MM-dd").alias("day"))


@query("""
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10 08:00:00' THEN 'before' WHEN ts < TIMESTAMP '2024-01-20 20:00:00' THEN 'during' ELSE 'after' END AS phase,
       (left_s // 86400)::INT AS days, (left_s % 86400 // 3600)::INT AS hours FROM (SELECT *, greatest(0, 1705780800 - CAST(floor(epoch(ts)) AS BIGINT)) AS left_s FROM events)""")
def dat07_phase(spark: SparkSession, sf: str) -> DataFrame:
    begin, end = F.lit("2024-01-10 08:00:00").cast("timestamp"), F.lit("2024-01-20 20:00:00").cast("timestamp")
    left = dates.countdown(F.col("ts"), end)
    return table(spark, sf, "events").select("event_id", dates.phase(F.col("ts"), begin, end).alias("phase"), left["days"].alias("days"), left["hours"].alias("hours"))


@query("SELECT user_id, min(ts) AS next_after FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id")
def jon31_next_after(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each user after an instant."""
    at = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return table(spark, sf, "events").where(F.col("ts") > at).groupBy("user_id").agg(F.min("ts").alias("next_after"))


@query("""
WITH RECURSIVE g AS (SELECT municipality, list_sort(list(candidate_id)) AS a FROM candidates GROUP BY 1),
r AS (
  SELECT municipality, a, len(a) - 1 AS i, 20261017::BIGINT AS s FROM g
  UNION ALL
  SELECT municipality, list_transform(a, lambda x, k: CASE WHEN k = i + 1 THEN a[j + 1] WHEN k = j + 1 THEN a[i + 1] ELSE x END), i - 1, s FROM (
    SELECT municipality, a, i, s, least(floor(s / 4294967295.0 * (i + 1))::BIGINT, i) AS j FROM (
      SELECT municipality, a, i, xor(t, t << 5) & 4294967295 AS s FROM (
        SELECT municipality, a, i, xor(t, floor((CASE WHEN t >= 2147483648 THEN t - 4294967296 ELSE t END) / 131072.0)::BIGINT & 4294967295) AS t FROM (
          SELECT municipality, a, i, xor(s, s << 13) & 4294967295 AS t FROM r WHERE i >= 1)))))
SELECT municipality, unnest(range(0, len(a)))::INT AS place, unnest(a) AS candidate_id FROM r WHERE i <= 0""")
def srt09_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded order of the people of each municipality; the tests hold it against a plain model as well."""
    people = _people(spark, sf).groupBy("municipality").agg(F.array_sort(F.collect_list("candidate_id")).alias("ids"))
    return people.select("municipality", F.posexplode(ordering.seeded_shuffle(F.col("ids"), 20261017)).alias("place", "candidate_id"))


@query("SELECT candidate_id, regexp_replace(lower(strip_accents(full_name)), '[^a-z]', '', 'g') AS letters FROM candidates")
def str20_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Names reduced to plain letters, by a vectorised function (accents and marks go)."""
    import unicodedata

    import pandas as pd

    def plain(names):
        flat = names.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")
        return flat.str.lower().str.replace(r"[^a-z]", "", regex=True)

    plain.__annotations__ = {"names": pd.Series, "return": pd.Series}
    letters = F.pandas_udf(plain, "string")
    return _people(spark, sf).select("candidate_id", letters("full_name").alias("letters"))
