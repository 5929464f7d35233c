"""The pN_ queries over the project's tables, and the SQL that checks some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _source(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/source_docs.parquet")
    return docs.where(F.col("source_type").isin(*kinds)) if kinds else docs


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.llm.sentences import sentences

    docs = _source(spark, sf, "official_statement")
    return sentences(docs, "source_id", "text", "lang", with_text=False).select("source_id", F.col("char_start").cast("bigint"), F.col("char_end").cast("bigint")).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.llm.page_diff import page_lines

    lines = page_lines(_source(spark, sf, "campaign_site"), "source_id", "url", "text")
    return lines.where("furniture").select("source_id", F.col("line_no").cast("bigint")).distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.llm.host_lines import repeated_lines

    lines = repeated_lines(_source(spark, sf, "campaign_site"), "source_id", "url", "text")
    return lines.select("source_id", F.col("line_no").cast("bigint"))


def _both_fields(found, quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """found over quotes by position_id and over texts by source_id, as one result."""
    a = found(quotes, "position_id", "quote").select(F.lit("quote").alias("field_name"), "id_a", "id_b")
    b = found(texts, "source_id", "text").select(F.lit("text").alias("field_name"), "id_a", "id_b")
    return a.unionByName(b)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.llm.canonical import lookalike_pairs

    quotes = spark.read.parquet(f"{sf}/positions.parquet").where(F.col("kind") == "background")
    return _both_fields(lookalike_pairs, quotes, _source(spark, sf, "questionnaire_reply"))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record: the first record that reads the same, and in how many ways it is written."""
    from spanlake.llm.canonical import lookalike_classes

    quotes = spark.read.parquet(f"{sf}/positions.parquet").where(F.col("kind") == "background")

    def of(name: str, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        members = lookalike_classes(df, id_col, text_col)
        per = members.groupBy("class_id").agg(F.min(id_col).alias("first_id"), F.countDistinct("variant").alias("variants"))
        return members.join(per.hint("merge"), "class_id").select(F.lit(name).alias("field_name"), F.col(id_col).alias("record_id"), "first_id", "variants").distinct()

    return of("quote", quotes, "position_id", "quote").unionByName(of("text", _source(spark, sf, "questionnaire_reply"), "source_id", "text"))


def _near(df: DataFrame, id_col: str, text_col: str):
    from spanlake.llm.parity_join import near_duplicates

    return near_duplicates(df, id_col, text_col, threshold=0.7)


def _edited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    spoken = F.col("lang").isin("en", "fr", "de", "es")
    quotes = spark.read.parquet(f"{sf}/positions.parquet").where((F.col("kind") == "position") & spoken)
    return quotes, _source(spark, sf, "official_statement").where(spoken)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.llm.parity_join import expand_pairs

    return _both_fields(lambda df, i, c: expand_pairs(*_near(df, i, c)), *_edited(spark, sf))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record: the first record of its class and of its group, and the number of classes linked to its own."""
    from spanlake.llm.parity_join import groups

    quotes, texts = _edited(spark, sf)
    a = groups(*_near(quotes, "position_id", "quote")).withColumn("field_name", F.lit("quote"))
    b = groups(*_near(texts, "source_id", "text")).withColumn("field_name", F.lit("text"))
    return a.unionByName(b).select("field_name", F.col("id").alias("record_id"), "class_id", "group_id", F.col("links").cast("bigint").alias("linked_classes")).distinct()


def _cut(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.llm.truncation import truncated

    return truncated(_source(spark, sf), "source_id", "text", "url", "lang")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cut(spark, sf).where("truncated").select("source_id").distinct()


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of cut records per host."""
    from spanlake.llm.truncation import truncation_rates

    return truncation_rates(_cut(spark, sf), "source_id")


def _sized(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """documents with their tokens; encoded once and written to the shared folder."""
    from spanlake.llm.tokens import token_counts
    from spanlake.session import checkpointed

    return checkpointed(token_counts(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", keep), spark)


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every text, or piece of a text above the capacity, with its container in each profile."""
    from spanlake.llm.packing import packed

    out = packed(_sized(spark, sf), "doc_id", "tokens", spark.read.parquet(f"{sf}/pack_profiles.parquet"))
    return out.withColumnRenamed("item_id", "doc_id")


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.llm.packing import fill_report

    return fill_report(p7_packed(spark, sf), spark.read.parquet(f"{sf}/pack_profiles.parquet"))


def p7_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What a packing must keep, per profile: capacities, every token once, no needless split."""
    from spanlake.llm.packing import packed, packing_problems

    sized, profiles = _sized(spark, sf), spark.read.parquet(f"{sf}/pack_profiles.parquet")
    return packing_problems(packed(sized, "doc_id", "tokens", profiles), sized, "doc_id", "tokens", profiles)


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from spanlake.llm.mixing import mixed

    targets = spark.read.parquet(f"{sf}/mix_targets.parquet")
    return mixed(_sized(spark, sf, "source"), targets, "doc_id", "source", "tokens"), targets


def p8_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The selected records, one row per use."""
    return _mix(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each source."""
    from spanlake.llm.mixing import reached_shares

    return reached_shares(*_mix(spark, sf), "source", "tokens")


def p8_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What a selection must keep, per source: its share up to a record, and its repeats."""
    from spanlake.llm.mixing import selection_problems

    return selection_problems(*_mix(spark, sf), "doc_id", "source", "tokens")


def _names(spark: SparkSession, sf: str):
    from spanlake.llm.personal_data import learn_names

    people = [spark.read.parquet(f"{sf}/{t}.parquet").select("given", "surname") for t in ("candidates", "rosters")]
    return learn_names(people[0].unionByName(people[1]), "given", "surname")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.llm.personal_data import personal_data

    found = personal_data(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", _names(spark, sf), "lang")
    return found.select("doc_id", F.col("char_start").cast("bigint"), F.col("char_end").cast("bigint"), "pii_kind").distinct()


def p9_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with typed placeholders."""
    from spanlake.llm.personal_data import with_placeholders

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    return with_placeholders(docs, "doc_id", "text", _names(spark, sf), "lang").select("doc_id", "text")


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from spanlake.llm.personal_data import personal_data
    from spanlake.session import checkpointed

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    return docs, checkpointed(personal_data(docs, "doc_id", "text", _names(spark, sf), "lang"), spark)


def p9_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with keyed surrogates."""
    from spanlake.llm.personal_data import with_surrogates

    docs, found = _found(spark, sf)
    return with_surrogates(docs, "doc_id", "text", found, key="spanlake-demo-key")


def p9_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What surrogates must keep, per kind: none shared by two entities, none a real entity, none of another form."""
    from spanlake.llm.personal_data import surrogate_problems, surrogates
    from spanlake.session import checkpointed

    return surrogate_problems(checkpointed(surrogates(_found(spark, sf)[1], "spanlake-demo-key"), spark))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p6_found": p6_found, "p6_rates": p6_rates, "p7_packed": p7_packed, "p7_fill": p7_fill, "p7_problems": p7_problems, "p8_selection": p8_selection, "p8_shares": p8_shares, "p8_problems": p8_problems, "p9_found": p9_found, "p9_placeholders": p9_placeholders, "p9_surrogates": p9_surrogates, "p9_problems": p9_problems}

_BLANKS = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]"

_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"

_EDITED = f"""
rows AS (
  SELECT DISTINCT 'quote' AS field_name, position_id AS id, {_WORDS.format("quote")} AS words FROM positions WHERE kind = 'position' AND lang IN ('en', 'fr', 'de', 'es') AND quote IS NOT NULL
  UNION SELECT DISTINCT 'text', source_id, {_WORDS.format("text")} FROM source_docs WHERE source_type = 'official_statement' AND lang IN ('en', 'fr', 'de', 'es') AND text IS NOT NULL),
each AS (SELECT field_name, id, len(words) AS n, unnest(words) AS word FROM rows),
met AS (SELECT a.field_name, a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS k FROM each a JOIN each b ON a.field_name = b.field_name AND a.word = b.word AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT DISTINCT field_name, id_a, id_b FROM met WHERE k * 10 >= 7 * (na + nb - k))"""

SQL: dict[str, str] = {
    "p4_found": f"WITH {_EDITED} SELECT field_name, id_a, id_b FROM pairs",
    "p4_groups": f"""
WITH RECURSIVE {_EDITED},
worded AS (SELECT field_name, id, list_sort(words)::VARCHAR AS w FROM rows WHERE len(words) > 0),
classes AS (SELECT field_name, w, min(id) AS class_id FROM worded GROUP BY ALL),
member AS (SELECT field_name, id, class_id FROM worded JOIN classes USING (field_name, w)),
link AS (SELECT DISTINCT p.field_name, a.class_id AS u, b.class_id AS v FROM pairs p JOIN member a ON a.field_name = p.field_name AND a.id = p.id_a JOIN member b ON b.field_name = p.field_name AND b.id = p.id_b WHERE a.class_id <> b.class_id),
edge AS (SELECT field_name, u, v FROM link UNION SELECT field_name, v, u FROM link),
reach AS (SELECT field_name, class_id AS u, class_id AS v FROM classes UNION SELECT r.field_name, r.u, e.v FROM reach r JOIN edge e ON e.field_name = r.field_name AND e.u = r.v),
groups AS (SELECT field_name, u, min(v) AS group_id FROM reach GROUP BY ALL),
degree AS (SELECT field_name, u, count(*) AS n FROM edge GROUP BY ALL)
SELECT DISTINCT m.field_name, m.id AS record_id, m.class_id, g.group_id, coalesce(d.n, 0) AS linked_classes
FROM member m JOIN groups g ON g.field_name = m.field_name AND g.u = m.class_id LEFT JOIN degree d ON d.field_name = m.field_name AND d.u = m.class_id
""",
    "p9_problems": """
SELECT pii_kind, 0::BIGINT AS shared, 0::BIGINT AS real, 0::BIGINT AS other_form FROM (VALUES ('email'), ('phone'), ('id_number'), ('address'), ('name')) kinds(pii_kind)""",
    "p7_problems": """
SELECT profile_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS texts, 0::BIGINT AS over_capacity, 0::BIGINT AS lost, 0::BIGINT AS split_needlessly FROM pack_profiles""",
    "p8_problems": """
SELECT source, 0::BIGINT AS off_share, 0::BIGINT AS over_repeats FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text <> '')""",
    "p5_found": rf"""
WITH pages AS (
  SELECT DISTINCT source_id, text,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS host
  FROM source_docs WHERE source_type = 'campaign_site' AND text IS NOT NULL),
lines AS (
  SELECT source_id, host, unnest(string_split(text, chr(10))) AS raw,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
  FROM pages WHERE host <> ''),
normal AS (
  SELECT source_id, host, line_no,
         regexp_replace(lower(trim(regexp_replace(raw, '{_BLANKS}+', ' ', 'g'))), '[0-9]+', '0', 'g') AS line
  FROM lines),
cases AS (
  SELECT n.host, n.line FROM normal n
  JOIN (SELECT host, count(DISTINCT source_id) AS pages FROM pages GROUP BY host) h ON h.host = n.host
  WHERE n.line <> ''
  GROUP BY n.host, n.line, h.pages
  HAVING count(DISTINCT n.source_id) >= 5 AND count(DISTINCT n.source_id) * 5 >= h.pages)
SELECT DISTINCT source_id, CAST(line_no AS BIGINT) AS line_no
FROM normal JOIN cases USING (host, line)
""",
}
