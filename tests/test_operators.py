"""Operators on small invented rows and against plain models."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanlake.functions import urls
from spanlake.operators import checks, dedupe, joins, minutes, ordering, records, reviews, spans, surveys, tagging, web, weblog


def test_runs_and_span_checks(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 2, 4, 7, 8)], "k string, i int")
    assert sorted((r["first"], r["last"], r["length"]) for r in spans.runs(df, ["k"], "i").collect()) == [(1, 2, 2), (4, 4, 1), (7, 8, 2)]
    rows = [("x😀abc y", "abc", 2, 5), ("abc", "ab", 0, 3), ("abc", "abc", 0, 9), ("abc", "", 1, 1), (None, "a", 0, 1)]
    got = spark.createDataFrame(rows, "t string, q string, s int, e int").select(spans.verified(F.col("t"), F.col("q"), F.col("s"), F.col("e")).alias("v")).collect()
    assert [r["v"] for r in got] == [True, False, False, False, False]


def test_spans_of_choices_drop_short_runs(spark):
    text = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen. Fifteen sixteen here now today. Short.\n\nA line of exactly eight words stands alone here.\n"
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    sent = spans.sentence_rows(docs, "id", "text", 5)
    choices = spark.createDataFrame([(1, "x", 0), (1, "x", 1), (1, "y", 2), (1, "z", 3), (1, "x", 99)], "id int, category string, sent_id int")
    got = spans.spans_of_choices(docs, sent, choices, "id", "text").collect()
    assert {r["category"] for r in got} == {"x", "z"}
    assert all(text[r["char_start"] : r["char_end"]] == r["quote"] for r in got)


def test_keyword_rule(spark):
    t = {"c": ("bus", "bike", "bike lane")}
    rows = spark.createDataFrame([("business",), ("bus and bike",), ("a BIKE LANE",), (None,)], "x string")
    assert [r[0] for r in rows.select(tagging.keyword_rule(F.col("x"), t["c"])).collect()][:3] == [False, True, True]
    cache = spark.createDataFrame([("k1", "old")], "key string, category string")
    tagged = tagging.incremental(spark.createDataFrame([("k1",), ("k2",)], "key string"), cache, "key", lambda d: d.withColumn("category", F.lit("new")))
    assert sorted(map(tuple, tagged.collect())) == [("k1", "old"), ("k2", "new")]


def test_prune_matches_model(spark):
    rng = random.Random(3)
    words = "parks roads homes levy bus ferry trees pool rink shore".split()
    rows = [(i, f"o{i % 4}", rng.choice("ab"), rng.choice(["official_statement", "campaign_site"]), " ".join(rng.choices(words, k=rng.randint(2, 9)))) for i in range(150)]
    rows += [(200 + i, "o1", "a", "campaign_site", rows[i][4]) for i in range(5)]

    def model(items):
        norm = lambda q: " ".join(q.split()).lower()
        topics = {}
        for _, o, c, _, q in items:
            topics.setdefault((o, norm(q)), set()).add(c)
        out = set()
        for o in {r[1] for r in items}:
            kept = []
            for r in sorted((r for r in items if r[1] == o), key=lambda r: (len(topics[o, norm(r[4])]), r[3] != "official_statement", -len(r[4]), r[0])):
                same = [k for k in kept if k[2] == r[2]]
                w = set(re.findall("[a-z']+", r[4].lower()))
                if len(same) >= 2 or any(norm(k[4])[:60] == norm(r[4])[:60] for k in same):
                    continue
                if any(len(w & set(re.findall("[a-z']+", k[4].lower()))) > 0.7 * min(len(w), len(set(re.findall("[a-z']+", k[4].lower())))) for k in same):
                    continue
                kept.append(r)
            out |= {k[0] for k in kept}
        return out

    df = spark.createDataFrame(rows, "id int, owner string, category string, kind string, quote string")
    got = dedupe.pruned(df, "owner", "category", "quote", F.col("kind") == "official_statement", "id").collect()
    assert {r["id"] for r in got} == model(rows)


def test_shuffle_matches_model(spark):
    def model(items, seed):
        out, s = list(items), seed & 0xFFFFFFFF
        for i in range(len(out) - 1, 0, -1):
            s = (s ^ (s << 13)) & 0xFFFFFFFF
            signed = s - 2**32 if s >= 2**31 else s
            s = (s ^ (signed >> 17)) & 0xFFFFFFFF
            s = (s ^ (s << 5)) & 0xFFFFFFFF
            j = int(s / 0xFFFFFFFF * (i + 1))
            out[i], out[j] = out[j], out[i]
        return out

    for seed in (1, 20261017, 3_000_000_017):
        items = [f"p{i}" for i in range(23)]
        got = spark.range(1).select(ordering.seeded_shuffle(F.array(*map(F.lit, items)), seed)).first()[0]
        assert got == model(items, seed)
    assert spark.range(1).select(ordering.seeded_shuffle(F.array().cast("array<string>"), 1)).first()[0] == []


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "v int, x string")
    assert [(r["v"], r["r"]) for r in ordering.global_rank(df, ["v"], "r").orderBy("v").collect()] == [(i, i + 1) for i in range(101)]


def test_overlays(spark):
    maps = spark.createDataFrame([({"a": "1"}, {"a": "9", "b": "2"}), (None, {"c": "3"})], "m map<string,string>, e map<string,string>")
    assert [r[0] for r in maps.select(records.set_defaults(F.col("m"), F.col("e"))).collect()] == [{"a": "1", "b": "2"}, {"c": "3"}]
    assert maps.select(records.overlaid(F.col("m"), F.col("e"))).first()[0] == {"a": "9", "b": "2"}
    ballots = spark.createDataFrame([("v", "m", "For ", "2024-01-01 00:00:00"), ("v", "m", "against", "2024-01-02 00:00:00"), ("v", "n", None, "2024-01-01 00:00:00")], "vote_id string, member_id string, decision string, recorded_at string")
    assert records.ballot_maps(ballots).first()["members"] == {"m": "against"}
    people = spark.createDataFrame([("x", "S", "1"), ("x", "S", "2"), ("y", "S", "3")], "municipality string, s string, id string")
    asked = spark.createDataFrame([("x", "S"), ("y", "S")], "municipality string, s string")
    assert {r["municipality"]: r["id"] for r in records.resolve_one(asked, people, ["municipality", "s"], "id").collect()} == {"x": None, "y": "3"}


def test_checks_pass_and_fail(spark):
    good = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int")
    bad = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int")
    checks.assert_none(checks.duplicate_keys(good, ["k"]), "ids")
    with pytest.raises(checks.CheckFailed):
        checks.assert_none(checks.duplicate_keys(bad, ["k"]), "ids")
    assert checks.below_floor(good, 2).count() == 0 and checks.below_floor(good, 3).count() == 1
    s = spark.createDataFrame([("Carter, said it", ["Carter"]), ("Lee's plan", ["Lee"]), ("fine", ["Lee"]), ("x" * 221, [])], "t string, s array<string>")
    assert [r[0] for r in s.select(checks.summary_problems(F.col("t"), F.col("s"))).collect()] == [[], ["names_a_person"], [], ["too_long"]]


MINUTES = """PRESENT: Mayor A. Stone
Councillor B. Reed
Councillor C. Hill
ABSENT
Councillor D. Moss
The meeting was called to order
NEW BUSINESS
1. Sea wall – File: 1
Moved by Reed
THAT the wall be re-
built soon
AND THAT it be tall
Moved by Hill
Amendment CARRIED
CARRIED UNANIMOUSLY
Councillor Hill opposed.
R2024-01-02/1
Councillor Reed left the meeting at 7 pm
2. Budget
Moved by Hill
THAT the budget pass
DEFEATED
Councillors Hill and Stone opposed.
R2024-01-02/2
R2024-01-02/9"""


def test_minutes(spark):
    lines = spark.createDataFrame([("m", i, x) for i, x in enumerate(MINUTES.split("\n"))], "meeting string, pos int, line string")
    members = spark.createDataFrame([("Stone", "s"), ("Reed", "r"), ("Hill", "h"), ("Moss", "m")], "surname string, member_id string")
    votes = minutes.motions(lines)
    got = {r["number"]: r for r in votes.collect()}
    assert set(got) == {"R2024-01-02/1", "R2024-01-02/2"}
    one = got["R2024-01-02/1"]
    assert (one["section"], one["title"], one["result"], one["opposed"], one["results"]) == ("New Business", "Sea wall", "CARRIED UNANIMOUSLY", ["Hill"], 2)
    assert one["body"] == "THAT the wall be re-built soon\nAND THAT it be tall Moved by Hill"
    cast = {(r["motion"], r["member_id"]): r["decision"] for r in minutes.decisions(lines, members).collect()}
    assert cast == {(1, "s"): "for", (1, "r"): "for", (1, "h"): "against", (1, "m"): "absent", (2, "s"): "against", (2, "r"): "absent", (2, "h"): "against", (2, "m"): "absent"}
    flagged = {r["motion"]: r["flags"] for r in minutes.consistency(votes, minutes.decisions(lines, members), members).collect()}
    assert flagged == {1: ["unanimous_but_opposed", "several_results"], 2: []}
    assert [r["number"] for r in minutes.unclaimed_numbers(lines).collect()] == ["R2024-01-02/9"]


HARD = """Document Number: 12
PRESENT
Mayor A. Stone Director P. Quill
Councillor B. Reed (joined at 6:05 pm)
ABSENT:
Councillor C. D. Hill*
Councillor E. Vole
CALL TO ORDER
NEW BUSINESS
3. A long title that wraps
over two lines – File: 01-02
Re: Part one of
the long title
Report: Clerk
Moved by Councillor Reed, seconded by Mayor Stone
PURSUANT to the report:
1. Item one be done
2. Item two be put off un-
til May
Continued…
3. A long title that wraps
– Continued
Councillor Stone declared a conflict of interest.
Main motion, as amended, (CARRIED).
R2024-03-04/1
4. Minutes
Moved by Councillor Reed
THAT the Council Meeting Minutes be adopted
CARRIED UNANIMOUSLY
R2024-03-04/2
Moved by Councillor Reed
THAT no number follow
DEFEATED
Mayor Stone and Councillor B. Reed opposed.
5. Next heading
Moved by Reed
THAT items in Closed Session be released
(CARRIED UNANIMOUSLY BY CONSENT)
R2024-03-04/3
Councillor Reed left the meeting at 8 and returned at 9.
6. Without a result
Moved by Reed
THAT nothing come of it
R2024-03-04/4
PUBLIC CLARIFICATION
Moved by Reed
THAT the ferry run
Councillor Reed left the meeting at 9:30 pm.
CARRIED
R2024-03-04/5
Moved by Stone
THAT the meeting adjourn
CARRIED UNANIMOUSLY
R2024-03-04/6
R2024-03-04/7"""


def test_hard_minutes(spark):
    lines = spark.createDataFrame([("m", i, x) for i, x in enumerate(HARD.split("\n"))] + [("n", 0, "Nothing here")], "meeting string, pos int, line string")
    members = spark.createDataFrame([("Stone", "s"), ("Reed", "r"), ("Hill", "h")], "surname string, member_id string")
    votes = minutes.motions(lines)
    got = {r["motion"]: r for r in votes.collect()}
    assert [(got[k]["number"], got[k]["title"], got[k]["result"], got[k]["procedural"]) for k in sorted(got)] == [
        ("R2024-03-04/1", "Part one of the long title", "CARRIED", False), ("R2024-03-04/2", "Minutes", "CARRIED UNANIMOUSLY", True), (None, "Minutes", "DEFEATED", True),
        ("R2024-03-04/3", "Ratify items from the closed session (wording kept closed)", "CARRIED UNANIMOUSLY BY CONSENT", True), ("R2024-03-04/4", "Without a result", None, True),
        ("R2024-03-04/5", "Without a result", "CARRIED", False), ("R2024-03-04/6", "Adjourn the meeting", "CARRIED UNANIMOUSLY", True),
    ]
    assert got[1]["body"] == "PURSUANT to the report:\n1. Item one be done\n2. Item two be put off un-til May" and got[1]["votes"][0]["prefix"] == "Main motion, as amended"
    assert got[1]["notes"] == ["conflict mentioned: Councillor Stone declared a conflict of interest."] and got[3]["opposed"] == ["Stone", "Reed"]
    assert got[1]["section"] == "New Business" and got[6]["section"] == "Public Clarification" and got[6]["notes"] == ["attendance changed: Councillor Reed left the meeting at 9:30 pm."]
    cast = {(r["motion"], r["member_id"]): r["decision"] for r in minutes.decisions(lines, members).collect()}
    assert [cast[k, "r"] for k in (1, 2, 3, 4, 6, 7)] == ["for", "for", "against", "for", "absent", "absent"] and {cast[k, "h"] for k in (1, 2, 3)} == {"absent"}
    assert {r["surname"]: (r["present"], r["note"]) for r in minutes.attendance(lines).collect()} == {"Stone": (True, None), "Reed": (True, "Councillor B. Reed (joined at 6:05 pm)"), "Hill": (False, None), "Vole": (False, None)}
    assert sorted(map(tuple, minutes.problems(lines, members).collect())) == [("m", "not a member: Vole"), ("n", "no list of those present")]
    assert {r["route"]: 1 for r in minutes.routed(lines).collect()}.keys() == {"resolution", "procedural", "unclaimed"}
    assert [r["number"] for r in minutes.unclaimed_numbers(lines).collect()] == ["R2024-03-04/7"]
    many = spark.createDataFrame([(f"S{i}", f"m{i}") for i in range(1500)] + [("Stone", "s")], "surname string, member_id string")
    assert minutes.decisions(lines, many).where("decision = 'for'").count() == 5
    assert minutes.motions(lines.limit(0)).count() == minutes.routed(lines.limit(0)).count() == 0


def test_replies(spark):
    doc = (
        "Answers\r\nAda Low\r\nReceived May 1\r\nHello there,\r\nFirst part.\r\n\r\nMore of it.\r\nSincerely,\r\nAda\r\n-----\r\nSecond reply, received May 3\r\nAn addition.\r\nBo High\r\nreceived May 2\r\n"
        "Thanks for your question about bears and how we live with them.\r\nMine.\r\nBo High\r\nCandidate, council\r\n(250) 555-0101\r\nSy Mid\r\nThird reply,  received June\r\nHi Lindsay thanks for asking, here is a long answer.\r\nAnd more."
    )
    names = spark.createDataFrame([("Ada Low",), ("Bo High",), ("Cy Mid",), ("Di Far",)], "name string")
    aliases = spark.createDataFrame([("Sy Mid", "Cy Mid"), ("Bo High", "Di Far")], "alias string, name string")
    got = surveys.replies(spark.createDataFrame([(1, doc)], "id int, doc string"), "id", "doc", names, aliases)
    assert {r["name"]: (r["received"], r["replies"], r["answer"]) for r in got.collect()} == {
        "Ada Low": ("May 1", 2, "First part.\n\nMore of it.\n\nAn addition."),
        "Bo High": ("May 2", 1, "Thanks for your question about bears and how we live with them.\nMine."),
        "Cy Mid": ("June", 1, "Hi Lindsay thanks for asking, here is a long answer.\nAnd more."),
    }
    assert [r["name"] for r in surveys.non_responders(names, got).collect()] == ["Di Far"]
    said = ["received May 1", "Received  x", "fourth reply, received 2", "fifth reply, received 2", "received", "I received it", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in said], "x string").select(surveys.received_on(F.col("x"))).collect()] == ["May 1", "x", "2", None, None, None, None]
    texts = spark.createDataFrame([("Q1?\nAda Low\n\nAll I say.\nTo you.\n", "Ada Low"), ("none", "Ada Low")], "t string, n string")
    assert [r[0] for r in texts.select(surveys.after_name(F.col("t"), F.col("n"))).collect()] == ["All I say.\nTo you.", None]


def test_html():
    title, blocks, links = web.parse_html(
        "<title> My \n page</title><nav><p>" + "menu " * 20 + "</nav><div>Loose text that is long enough to be its own block in the page, yes.<p>Un<b>clo</b>sed paragraph, long enough to be kept as a block of the page."
        "<p>Unclosed paragraph, long enough to be kept as a block of the page.<p>short<div role=banner><p>" + "banner " * 20 + "</div><a href='/p'>Plan <i>B</i></a></div><footer><p>" + "foot " * 20 + "</p></footer>"
    )
    assert title == "My page" and links == [("/p", "Plan B")]
    assert blocks == ["Unclosed paragraph, long enough to be kept as a block of the page.", "Loose text that is long enough to be its own block in the page, yes."]
    long = "words of a block that is long enough to be kept, and then some more of them"
    _, blocks, _ = web.parse_html(f"<body><p>Outside {long}</p><main><div>Loose {long}</div><h2>Head {long}</h2><p>Inside {long}</main><p>After {long}</body>")
    assert blocks == [f"Head {long}", f"Inside {long}", f"Loose {long}"]
    _, blocks, _ = web.parse_html(f"<div role=main><p>In {long}</div><p>Out {long}")
    assert blocks == [f"In {long}"]
    assert [web.is_boilerplate(x) for x in ("About us", "Aboutness", "©2026", "© 2026", "Read more: x", "follow METER", "")] == [True, False, True, False, True, False, False]
    page = "<h1>Ann</h1><p>Before</p><h2>Candidate  State ment:</h2><p>First part.</p><ul><li>One</li><li><a href=/x>Only a link</a></li></ul><p>Last <b>pa</b>rt.</p>"
    assert web.statement_text(page, "candidate statement") == ["First part.", "One", "Last part."] and web.statement_text(page, "nowhere") == []


def test_weblog(spark):
    line = '{"msg":"handled request","status":200,"ts":%s,"request":{"uri":"%s","client_ip":"%s","headers":{"User-Agent":["%s"],"Referer":["https://r.example/x"]}}}'
    rows = [
        line % ("1704067200.5", "/a?x=1", "10.0.0.9", "Mozilla/5.0 (X11)"), line % ('"2024-01-02T03:00:00Z"', "/a", "10.0.0.77", "Mozilla/5.0 (X11)"), line % ("1704067201", "/x.css", "10.0.0.9", "Mozilla/5.0 (X11)"),
        line % ("1704067201", "/x.css?v=1", "2001:db8:1:2::3", "Mozilla/5.0 (X11)"), line % ("1704067201", "/b", "10.0.0.9", "Mozilla/5.0 (compatible)"), "{broken", "nonsense", "", line % ('"never"', "/a", "1.1.1.1", "x"),
    ]
    reqs = weblog.requests(spark.createDataFrame([(r,) for r in rows], "value string"))
    total = weblog.totals(reqs).first()
    assert (total["views"], total["networks"], total["bots"]) == (3, 2, 1)
    assert {str(r["day"]): r["views"] for r in weblog.daily(weblog.views(reqs)).collect()} == {"2023-12-31": 2, "2024-01-01": 1}
    assert tuple(weblog.returning(weblog.views(reqs)).first()) == (2, 1, 0)


def test_rich_text_has_no_depth(spark):
    leaf = {"type": "text", "text": "deep", "marks": [{"type": "link", "attrs": {"href": "x"}}]}
    trees = [{"type": "doc", "content": [{"type": "text", "text": "a "}, leaf, {"type": "text", "text": " z"}]}, [leaf, leaf], {"type": "doc"}]
    for depth in (5, 6, 60):
        tree = leaf
        for _ in range(depth):
            tree = {"type": "item", "content": [{"type": "text", "text": "-"}, tree]}
        trees.append(tree)
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)] + [(9, None)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", web.rich_text(F.parse_json("t")).alias("x")).collect()}
    assert got == {0: "a deep z", 1: "deepdeep", 2: "", 3: "-" * 5 + "deep", 4: "-" * 6 + "deep", 5: "-" * 60 + "deep", 9: ""}
    assert web.marks_of(trees, "link") == [("deep", {"href": "x"})] * 6
    nested = '{"content": [' * 100_000 + '{"type": "text", "text": "a\\"]}"}' + "]}" * 100_000
    assert web.node_text(web._parsed(nested)) == 'a"]}'


def test_other_voices_and_exclusions(spark):
    rows = [
        ("“Ada Low has heart.”", True), ("I've known Ada Low for years", True), ("I have met people; Ada’s leadership counts", True), ("I have met people", False), ("“We act.” Ada said", False), ('"My name is Ada and Ada Low is who I am"', False),
        ("Ada Low has a plan", False), (None, False), ("", False), ("I have knownAda Low", False),
    ]
    df = spark.createDataFrame([(q,) for q, _ in rows], "q string").withColumn("n", F.lit("Ada Low"))
    assert [r[0] for r in df.select(reviews.other_voice(F.col("q"), F.col("n"))).collect()] == [w for _, w in rows]
    p = spark.createDataFrame([("a", "One  two three"), ("a", "Four"), ("b", "One two"), (None, "One two"), ("a", None)], "owner string, q string")
    x = spark.createDataFrame([("a", "One two"), ("a", "One"), ("b", "Two"), ("c", "x"), ("a", "")], "owner string, starts_with string")
    got = {(r["owner"], r["q"]): r["excluded_by"] for r in reviews.excluded(p, x, "owner", "q").collect()}
    assert got == {("a", "One  two three"): "One two", ("a", "Four"): None, ("b", "One two"): None, (None, "One two"): None, ("a", None): None}
    assert {tuple(r) for r in reviews.stale(p, x.where("starts_with <> ''"), "owner", "q").collect()} == {("b", "Two"), ("c", "x")}
    assert reviews.excluded(p.limit(0), x, "owner", "q").count() == 0 and reviews.excluded(p, x.limit(0), "owner", "q").where("excluded_by is not null").count() == 0


def test_small_sides_are_bounded_by_bytes(spark):
    few = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "k int, t string")
    assert joins.fits(few) and not joins.fits(few, most_rows=49) and not joins.fits(few, most_bytes=40_000)
    wide = few.select("k", F.array_repeat("t", 20).alias("a"))
    assert not joins.fits(wide, most_bytes=500_000) and joins.fits(wide, most_bytes=2_000_000)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(joins.join_small(few, few, ["k"])) and "Broadcast" not in plan(joins.join_small(few, few, ["k"], most_bytes=10)) + plan(joins.join_large(few, few, "k"))
    assert joins.fits(few.limit(0))


def test_redirects_of_any_depth(spark):
    import urllib.parse

    url = "https://X.example/a?fbclid=1&b=2"
    rows = []
    for _ in range(9):
        rows.append((url,))
        url = "https://go.example/l.php?h=1&u=" + urllib.parse.quote(url, safe="")
    rows += [("https://go.example/l.php?u=",), ("https://a.example/?q=l.php",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(urls.unwrapped(F.col("u"))).collect()]
    assert got == ["https://x.example/a?b=2"] * 9 + ["https://go.example/l.php?u=", "https://a.example/?q=l.php", None, ""]


def test_free_slots_are_filled(spark):
    best = spark.createDataFrame([("s", "p1", 1), ("s", "p2", 2), ("t", "q", 1)], "site string, page string, rank int")
    more = spark.createDataFrame([("s", "p2", 1), ("s", "p3", 2), ("s", "p4", 3), ("u", "z", 1)], "site string, page string, rank int")
    assert sorted(map(tuple, web.filled(best, more, "site", "page", "rank", 3).collect())) == [("s", "p1", 1), ("s", "p2", 2), ("s", "p3", 3), ("t", "q", 1), ("u", "z", 1)]
