"""Sentences, spans and tagging over source_docs, sentences and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlake.functions.text import drop_heading, normal, opening, overlaps, trim_quote, word_count, word_set
from spanlake.operators import dedupe, spans, tagging
from spanlake.operators.joins import join_large
from spanlake.plans.registry import query
from spanlake.sources.readers import table

# ---- fixed SQL pieces -------------------------------------------------------
_ONE_DOC = "SELECT source_id, any_value(text) AS text, any_value(owner_id) AS owner_id, any_value(lang) AS lang, any_value(source_type) AS source_type FROM source_docs WHERE text IS NOT NULL GROUP BY source_id"
_ONE_POS = "SELECT DISTINCT position_id, owner_id, kind, category, quote, source_id, source_type, lang, char_start, char_end FROM positions"
_PIECES = (
    "SELECT source_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?][\"'')\\]]*[ \\t\\r\\n\\f\\x0B]+)([A-Z0-9\"''(\\[])', '\\1' || chr(57344) || '\\2', 'g'), "
    "'(\\n{2,})', '\\1' || chr(57344), 'g'), chr(57344))) AS piece FROM docs"
)
_TRIMMED = "regexp_replace(regexp_replace(piece, '[\\s\\x{00A0}\\x0B]+$', ''), '^[\\s\\x{00A0}\\x0B]+', '')"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per source_id."""
    docs = table(spark, sf, "source_docs").where("text is not null")
    return dedupe.latest(docs, ["source_id"], "loaded_at", "url")


def _positions(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Passages with the columns asked for; rows delivered again are still there."""
    return table(spark, sf, "positions").select("position_id", *columns)


def _case(pairs: dict[str, tuple[str, ...]], text: str) -> str:
    """SQL: the list of categories by the keyword rule."""
    each = []
    for name, words in pairs.items():
        hits = " + ".join(f"CAST(contains(lower({text}), '{w.replace(chr(39), chr(39) * 2)}') AS INT)" for w in words)
        long = " OR ".join(f"contains(lower({text}), '{w.replace(chr(39), chr(39) * 2)}')" for w in words if " " in w) or "false"
        each.append(f"CASE WHEN ({hits}) >= 2 OR ({long}) THEN '{name}' END")
    return "list_filter([" + ", ".join(each) + "], lambda x: x IS NOT NULL)"


@query(f"""
WITH docs AS ({_ONE_DOC}), pieces AS ({_PIECES}), t AS (SELECT source_id, {_TRIMMED} AS x FROM pieces)
SELECT source_id, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars, CAST(max(length(x)) AS BIGINT) AS longest FROM t WHERE x <> '' GROUP BY source_id""")
def ext01_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments per document before merging."""
    docs = _docs(spark, sf).select("source_id", F.explode(spans.fragments(F.col("text"))).alias("s"))
    size = F.col("s.end") - F.col("s.start")
    return docs.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.max(size).cast("bigint").alias("longest"))


@query(f"""
WITH docs AS ({_ONE_DOC}), numbered AS (
  SELECT source_id, (string_split(regexp_replace(regexp_replace(text, '([.!?]["'')\\]]*[ \\t\\r\\n\\f\\x0B]+)([A-Z0-9"''(\\[])', '\\1' || chr(57344) || '\\2', 'g'), '(\\n{{2,}})', '\\1' || chr(57344), 'g'), chr(57344))) AS ps FROM docs),
pieces AS (SELECT source_id, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS k FROM numbered),
placed AS (SELECT source_id, k, piece, coalesce(sum(length(piece)) OVER (PARTITION BY source_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM pieces),
cut AS (SELECT source_id, k, begun + length(piece) - length(regexp_replace(piece, '^[\\s\\x{{00A0}}\\x0B]+', '')) AS s, length({_TRIMMED}) AS n FROM placed WHERE {_TRIMMED} <> ''),
ranked AS (SELECT source_id, s, s + n AS e, n, row_number() OVER (PARTITION BY source_id ORDER BY k) AS r FROM cut),
grouped AS (SELECT *, sum(CASE WHEN r = 1 OR n >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY r) AS g FROM ranked)
SELECT source_id, CAST(g - 1 AS INT) AS sent_id, CAST(min(s) AS INT) AS char_start, CAST(max(e) AS INT) AS char_end FROM grouped GROUP BY source_id, g""")
def ext01_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with offsets; short fragments folded into the one before."""
    return spans.sentence_rows(_docs(spark, sf), "source_id", "text").drop("text")


@query("""
WITH s AS (SELECT DISTINCT source_id, sent_no FROM sentences), r AS (SELECT *, sent_no - row_number() OVER (PARTITION BY source_id ORDER BY sent_no) AS i FROM s)
SELECT source_id, min(sent_no) AS first, max(sent_no) AS last, count(*) AS length FROM r GROUP BY source_id, i""")
def win01_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Islands of consecutive sentence numbers."""
    return spans.runs(table(spark, sf, "sentences"), ["source_id"], "sent_no")


@query(f"""
WITH d AS ({_ONE_DOC}), p AS ({_ONE_POS})
SELECT position_id, coalesce(char_start >= 0 AND char_start < char_end AND char_end <= length(text) AND substring(text, char_start + 1, greatest(char_end - char_start, 0)) = quote, false) AS verified
FROM p LEFT JOIN d USING (source_id)""")
def flt01_span_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Does each quote stand at its place in its source?"""
    quoted = _positions(spark, sf, "source_id", "quote", "char_start", "char_end")
    joined = join_large(quoted, _docs(spark, sf).select("source_id", "text"), "source_id", "left")
    return joined.select("position_id", spans.verified(F.col("text"), F.col("quote"), F.col("char_start"), F.col("char_end")).alias("verified")).distinct()


_WC = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_](?:[\\p{{L}}\\p{{N}}_''-]*[\\p{{L}}\\p{{N}}_])?'))"


@query(f"SELECT DISTINCT source_id, sent_no, CAST({_WC.format('text')} AS INT) AS words FROM sentences WHERE text IS NOT NULL")
def str06_word_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sentences").where("text is not null").select("source_id", "sent_no", word_count(F.col("text")).alias("words")).distinct()


@query(f"""
WITH d AS ({_ONE_DOC}), p AS ({_ONE_POS}), j AS (
  SELECT position_id, quote, regexp_replace(substring(text, 1, char_start), '[ \\t]+$', '') AS b, regexp_replace(substring(text, char_end + 1), '^[ \\t]+', '') AS a FROM p JOIN d USING (source_id)),
k AS (SELECT position_id, quote, (b = '' OR ends_with(b, chr(10))) AND (a = '' OR starts_with(a, chr(10))) AS standalone FROM j)
SELECT position_id, standalone, {_WC.format('quote')} >= CASE WHEN standalone THEN 8 ELSE 15 END AS long_enough FROM k""")
def flt02_word_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Standalone lines and the word floor of each passage."""
    joined = join_large(_positions(spark, sf, "source_id", "quote", "char_start", "char_end"), _docs(spark, sf).select("source_id", "text"), "source_id")
    flagged = joined.withColumn("standalone", spans.standalone_line(F.col("text"), F.col("char_start"), F.col("char_end")))
    return flagged.select("position_id", "standalone", spans.long_enough(F.col("quote"), F.col("standalone")).alias("long_enough")).distinct()


@query(f"SELECT source_id, sent_no, unnest({_case(tagging.TAXONOMY, 'text')}) AS category FROM (SELECT DISTINCT source_id, sent_no, text FROM sentences WHERE text IS NOT NULL)")
def flt03_keyword_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of each sentence by the keyword rule."""
    rows = table(spark, sf, "sentences").where("text is not null").select("source_id", "sent_no", "text").distinct()
    return tagging.keyword_tagger(rows, "text").select("source_id", "sent_no", "category")


_FLASH = (
    "list_filter(["
    + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(quote), '{p}')" for p in ps) + f" THEN '{f}' END" for f, ps in tagging.FLASHPOINTS.items())
    + "], lambda x: x IS NOT NULL)"
)


@query(f"SELECT position_id, array_to_string({_FLASH}, ',') AS flashpoints FROM ({_ONE_POS})")
def flt04_flashpoint(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf, "quote").select("position_id", F.array_join(tagging.flashpoints_in(F.col("quote")), ",").alias("flashpoints")).distinct()


def tagged_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Statements to sentences, keyword tags, runs and verified spans: the whole tagging path."""
    docs = _docs(spark, sf).where("source_type = 'official_statement'").select("source_id", "text")
    sentences = spans.sentence_rows(docs, "source_id", "text")
    choices = tagging.keyword_tagger(sentences, "text").select("source_id", "category", "sent_id")
    return spans.spans_of_choices(docs, sentences.drop("text"), choices, "source_id", "text")


_SENT = f"""
docs AS (SELECT * FROM ({_ONE_DOC}) WHERE source_type = 'official_statement'), numbered AS (
  SELECT source_id, string_split(regexp_replace(regexp_replace(text, '([.!?]["'')\\]]*[ \\t\\r\\n\\f\\x0B]+)([A-Z0-9"''(\\[])', '\\1' || chr(57344) || '\\2', 'g'), '(\\n{{2,}})', '\\1' || chr(57344), 'g'), chr(57344)) AS ps FROM docs),
pieces AS (SELECT source_id, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS k FROM numbered),
placed AS (SELECT source_id, k, piece, coalesce(sum(length(piece)) OVER (PARTITION BY source_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM pieces),
cut AS (SELECT source_id, k, begun + length(piece) - length(regexp_replace(piece, '^[\\s\\x{{00A0}}\\x0B]+', '')) AS s, length({_TRIMMED}) AS n FROM placed WHERE {_TRIMMED} <> ''),
ranked AS (SELECT source_id, s, s + n AS e, n, row_number() OVER (PARTITION BY source_id ORDER BY k) AS r FROM cut),
grouped AS (SELECT *, sum(CASE WHEN r = 1 OR n >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY r) AS g FROM ranked),
sent AS (SELECT g.source_id, g AS sent_id, CAST(min(s) AS INT) AS s, CAST(max(e) AS INT) AS e FROM grouped g GROUP BY g.source_id, g),
tagged AS (SELECT source_id, sent_id, s, e, unnest({_case(tagging.TAXONOMY, 'substring(text, s + 1, e - s)')}) AS category FROM sent JOIN docs USING (source_id)),
isl AS (SELECT *, sent_id - row_number() OVER (PARTITION BY source_id, category ORDER BY sent_id) AS i FROM tagged),
runs AS (SELECT source_id, category, min(s) AS s, max(e) AS e FROM isl GROUP BY source_id, category, i),
cutout AS (SELECT r.*, substring(text, s + 1, e - s) AS quote, regexp_replace(substring(text, 1, s), '[ \\t]+$', '') AS b, regexp_replace(substring(text, e + 1), '^[ \\t]+', '') AS a FROM runs r JOIN docs USING (source_id)),
good AS (SELECT * FROM cutout WHERE {_WC.format('quote')} >= CASE WHEN (b = '' OR ends_with(b, chr(10))) AND (a = '' OR starts_with(a, chr(10))) THEN 8 ELSE 15 END)"""


@query(f"WITH {_SENT} SELECT source_id, category, CAST(s AS INT) AS char_start, CAST(e AS INT) AS char_end, quote FROM good")
def ext03_spans(spark: SparkSession, sf: str) -> DataFrame:
    return tagged_spans(spark, sf)


@query(f"""WITH {_SENT}, cats AS (SELECT unnest([{", ".join(f"'{c}'" for c in tagging.TAXONOMY)}]) AS category)
SELECT category, count(DISTINCT source_id) AS documents, count(source_id) AS passages FROM cats LEFT JOIN good USING (category) GROUP BY category""")
def ext03_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: coverage per category, categories without a passage included."""
    cats = spark.range(1).select(F.explode(F.array(*(F.lit(c) for c in tagging.TAXONOMY))).alias("category"))
    found = tagged_spans(spark, sf).groupBy("category").agg(F.countDistinct("source_id").alias("documents"), F.count("*").alias("passages"))
    return cats.join(found, "category", "left").select("category", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("passages", F.lit(0)).alias("passages"))


_NORM = "lower(trim(regexp_replace({}, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')))"


@query(f"SELECT owner_id, {_NORM.format('quote')} AS quote_text, count(DISTINCT category) AS spread FROM ({_ONE_POS}) GROUP BY 1, 2")
def agg03_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Categories per normalised quote of an owner."""
    return _positions(spark, sf, "owner_id", "quote", "category").groupBy("owner_id", normal(F.col("quote")).alias("quote_text")).agg(F.countDistinct("category").alias("spread"))


@query("""SELECT DISTINCT position_id, list_sort(list_distinct(regexp_extract_all(lower(quote), '[a-z'']+')))::VARCHAR AS words FROM positions""")
def str07_word_set(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_sort(word_set(F.col("quote")))
    text = F.concat(F.lit("["), F.array_join(F.transform(words, lambda w: F.when(F.contains(w, F.lit("'")), F.concat(F.lit("'"), F.replace(w, F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(w)), ", "), F.lit("]"))
    return _positions(spark, sf, "quote").select("position_id", text.alias("words")).distinct()


@query(f"""
WITH p AS (SELECT position_id, list_distinct(regexp_extract_all(lower(quote), '[a-z'']+')) AS w,
  first_value(list_distinct(regexp_extract_all(lower(quote), '[a-z'']+'))) OVER (PARTITION BY owner_id, category ORDER BY length(quote) DESC, position_id) AS best,
  first_value(position_id) OVER (PARTITION BY owner_id, category ORDER BY length(quote) DESC, position_id) AS best_id
  FROM ({_ONE_POS}) WHERE owner_id IS NOT NULL)
SELECT position_id, best_id, len(w) > 0 AND len(best) > 0 AND len(list_intersect(w, best)) > 0.7 * least(len(w), len(best)) AS overlaps FROM p WHERE position_id <> best_id""")
def str08_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Does a passage share most of the smaller word set with the longest of its owner and category?"""
    p = _positions(spark, sf, "owner_id", "category", "quote").where("owner_id is not null").distinct().select("position_id", "owner_id", "category", word_set(F.col("quote")).alias("w"), F.length("quote").alias("n"))
    best = p.groupBy("owner_id", "category").agg(F.max_by(F.struct(F.col("position_id").alias("best_id"), F.col("w").alias("best")), F.struct("n", (-F.col("position_id")).alias("p"))).alias("b"))
    both = p.join(best, ["owner_id", "category"]).where("position_id <> b.best_id")
    return both.select("position_id", F.col("b.best_id").alias("best_id"), overlaps(F.col("w"), F.col("b.best")).alias("overlaps"))


def _last(x: str, p: str) -> str:
    return f"(CASE WHEN contains({x}, '{p}') THEN length({x}) - strpos(reverse({x}), '{p[::-1]}') - {len(p) - 1} ELSE -1 END)"


@query(f"""
WITH p AS (SELECT position_id, quote, substring(quote, 1, 400) AS w FROM ({_ONE_POS})),
c AS (SELECT *, greatest({_last('w', '. ')}, {_last('w', '! ')}, {_last('w', '? ')}) AS stop FROM p),
d AS (SELECT *, CASE WHEN stop < 133 THEN {_last('w', ' ')} ELSE stop END AS cut FROM c)
SELECT position_id, CASE WHEN length(quote) <= 400 OR cut <= 0 THEN quote ELSE rtrim(substring(quote, 1, cut + 1)) END AS trimmed FROM d""")
def str09_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Passages cut at the last sentence break within 400 characters."""
    return _positions(spark, sf, "quote").distinct().select("position_id", trim_quote(F.col("quote"), 400).alias("trimmed"))


@query(f"""
WITH p AS (SELECT DISTINCT source_id, text FROM source_docs WHERE text IS NOT NULL),
q AS (SELECT source_id, text, regexp_replace(regexp_replace(text, '\\n+[^\\n]{{0,60}}:[ \\t\\r\\n]*$', ''), '[ \\t\\r\\n]+$', '') AS short, regexp_matches(text, '\\n+[^\\n]{{0,60}}:[ \\t\\r\\n]*$') AS ends FROM p)
SELECT source_id, length(CASE WHEN ends AND len(list_filter(regexp_split_to_array(short, '[ \\t\\r\\n\\f\\x0B]+'), lambda x: x <> '')) >= 6 THEN short ELSE text END)::INT AS chars FROM q""")
def str10_dangling_heading(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "source_docs").where("text is not null").select("source_id", "text").distinct()
    return docs.select("source_id", F.length(drop_heading(F.col("text"))).alias("chars"))


@query(f"SELECT position_id, substring({_NORM.format('quote')}, 1, 60) AS opening FROM ({_ONE_POS})")
def str12_opening(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf, "quote").select("position_id", opening(F.col("quote")).alias("opening")).distinct()


@query(f"""
WITH p AS (SELECT DISTINCT position_id, owner_id, category, source_type, quote FROM positions WHERE kind = 'position' AND owner_id IS NOT NULL),
n AS (SELECT *, {_NORM.format('quote')} AS n, list_distinct(regexp_extract_all(lower(quote), '[a-z'']+')) AS w FROM p),
t AS (SELECT owner_id, n, count(DISTINCT category) AS spread FROM n GROUP BY 1, 2),
x AS (SELECT n.*, spread, CASE WHEN source_type = 'official_statement' THEN 0 ELSE 1 END AS o FROM n JOIN t ON t.owner_id = n.owner_id AND t.n = n.n),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_id, category ORDER BY spread, o, -length(quote), position_id) AS k FROM x),
b AS (SELECT owner_id, category, n AS bn, w AS bw FROM r WHERE k = 1),
l AS (SELECT r.* FROM r JOIN b USING (owner_id, category) WHERE k > 1 AND r.n <> bn AND substring(r.n, 1, 60) <> substring(bn, 1, 60) AND NOT (len(w) > 0 AND len(bw) > 0 AND len(list_intersect(w, bw)) > 0.7 * least(len(w), len(bw)))),
s AS (SELECT *, row_number() OVER (PARTITION BY owner_id, category ORDER BY spread, o, -length(quote), position_id) AS m FROM l)
SELECT owner_id, category, position_id, 0 AS kept_no FROM r WHERE k = 1 UNION ALL SELECT owner_id, category, position_id, 1 FROM s WHERE m = 1""")
def win05_prune(spark: SparkSession, sf: str) -> DataFrame:
    """The two best passages per owner and category without overlaps; the tests hold it against a plain model as well."""
    rows = _positions(spark, sf, "owner_id", "kind", "category", "quote", "source_type").where("owner_id is not null and kind = 'position'").distinct()
    return dedupe.pruned(rows, "owner_id", "category", "quote", F.col("source_type") == "official_statement", "position_id")


@query(f"""
WITH p AS (SELECT DISTINCT position_id, owner_id, category, source_type, quote FROM positions WHERE kind = 'position' AND owner_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_id, category ORDER BY CASE WHEN source_type = 'official_statement' THEN 0 ELSE 1 END, -length(quote), position_id) AS rank FROM p)
SELECT owner_id, category, position_id, rank FROM r WHERE rank <= 2""")
def win06_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The cap alone: two passages per owner and category, official and longest first."""
    from pyspark.sql import Window

    rows = _positions(spark, sf, "owner_id", "kind", "category", "source_type", F.length("quote").alias("n")).where("owner_id is not null and kind = 'position'").distinct()
    order = Window.partitionBy("owner_id", "category").orderBy(F.when(F.col("source_type") == "official_statement", 0).otherwise(1), -F.col("n"), "position_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 2").select("owner_id", "category", "position_id", F.col("rank").cast("bigint").alias("rank"))
