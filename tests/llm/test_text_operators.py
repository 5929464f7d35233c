"""Sentences, canonical forms, page bodies and host lines."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spanlake.llm import sentences as S
from spanlake.llm.canonical import LOOKALIKES, canonical, canonical_array, expansion, lookalike_classes, lookalike_pairs
from spanlake.llm.host_lines import repeated_lines, without_repeated_lines
from spanlake.llm.page_diff import furniture, line_key, main_body, page_lines, shared_lines
from spanlake.llm.transducer import Transducer


def units(text, lang):
    _, a, b = S.split_batch([text], lang)
    return [text[i:j] for i, j in zip(a, b)]


CASES = [
    ("en", "Dr. Low of St. Ann Clinic met Mr. and Mrs. Reed at 9:30 p.m. They left.", ["Dr. Low of St. Ann Clinic met Mr. and Mrs. Reed at 9:30 p.m.", "They left."]),
    ("en", "It cost $3.5 million, e.g. for pipes (see p. 4, fig. 2). Rule no. 1: wait... and wait.", ["It cost $3.5 million, e.g. for pipes (see p. 4, fig. 2).", "Rule no. 1: wait... and wait."]),
    ("en", 'The sign said "Stop! Think!" and we did. The slogan was "Build it now." Some agreed.', ['The sign said "Stop! Think!" and we did.', 'The slogan was "Build it now."', "Some agreed."]),
    ("en", "We met in May.\n1) First item\n2) Second item\n\n- Jo Reed", ["We met in May.", "First item", "Second item", "Jo Reed"]),
    ("en", "A line that goes\non here. Next one without a blank.Then this", ["A line that goes\non here.", "Next one without a blank.", "Then this"]),
    ("en", "So it goes. 'FIX IT!' WROTE MR. LOW ON ELM ST. AND THIRD AVE. BEFORE NOON. The end.", ["So it goes.", "'FIX IT!' WROTE MR. LOW ON ELM ST. AND THIRD AVE. BEFORE NOON.", "The end."]),
    ("fr", "ON ATTEND... ET ON ATTEND. Il dit : Enfin ! » Qui va là ?", ["ON ATTEND... ET ON ATTEND.", "Il dit : Enfin ! »", "Qui va là ?"]),
    ("de", "Am 3. Mai tagte der Rat bis 21.30 Uhr. Das kostet ca. 3.000 Euro usw., doch wir zahlen. „Ist das gut?“, fragte sie.", ["Am 3. Mai tagte der Rat bis 21.30 Uhr.", "Das kostet ca. 3.000 Euro usw., doch wir zahlen.", "„Ist das gut?“, fragte sie."]),
    ("fr", "J.-P. Roy a dit : « Enfin ! » On attend... et on attend. M.\nRoy part.", ["J.-P. Roy a dit : « Enfin ! »", "On attend... et on attend.", "M.\nRoy part."]),
    ("es", "La empresa de EE. UU. dejó la plaza. ¡Bien! —¿Es justo? —preguntó ella.", ["La empresa de EE. UU. dejó la plaza.", "¡Bien!", "—¿Es justo? —preguntó ella."]),
    ("es", "ESPERAMOS... Y SEGUIMOS AQUÍ. Fin.", ["ESPERAMOS... Y SEGUIMOS AQUÍ.", "Fin."]),
    ("ru", "С 2021 г. мы ждём. Это 3 млн руб., т. е. мало. «Нужно ждать», — говорят.", ["С 2021 г. мы ждём.", "Это 3 млн руб., т. е. мало.", "«Нужно ждать», — говорят."]),
    ("el", "Ποιος πληρώνει; Ο κ. Νίκος, π.χ. για το έργο.", ["Ποιος πληρώνει;", "Ο κ. Νίκος, π.χ. για το έργο."]),
    ("zh", "他问：“这公平吗？”然后沉默了。费用升到8.10亿元！“请等。”她说。", ["他问：“这公平吗？”然后沉默了。", "费用升到8.10亿元！", "“请等。”她说。"]),
    ("ja", "「まず待って。」と言いました。だれが払う？", ["「まず待って。」と言いました。", "だれが払う？"]),
    ("th", "มีคน 362 คนที่นี่ เราควรรอ", ["มีคน 362 คนที่นี่", "เราควรรอ"]),
    ("hi", "डॉ. राम ने कहा। कौन देगा?", ["डॉ. राम ने कहा।", "कौन देगा?"]),
    ("fa", "«نخست ببینید»، او گفت. چه کسی می‌پردازد؟", ["«نخست ببینید»، او گفت.", "چه کسی می‌پردازد؟"]),
]


@pytest.mark.parametrize(("lang", "text", "want"), CASES)
def test_units(lang, text, want):
    assert units(text, lang) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='Mr. ab"“”()1.!?…\n-)A«»。了ก ๆ', max_size=90), max_size=5), st.sampled_from(["en", "de", "zh", "th", ""]), st.integers(1, 9))
def test_chunks_make_no_difference(texts, lang, chunk):
    whole, parts = S.split_batch(texts, lang, 4096), S.split_batch(texts, lang, chunk)
    assert all((x == y).all() for x, y in zip(whole, parts))
    for d, a, b in zip(*whole):
        u = texts[d][a:b]
        assert u and not u[0].isspace() and not u[-1].isspace()
    for d in set(whole[0].tolist()):
        spans = [(a, b) for x, a, b in zip(*whole) if x == d]
        assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))


def test_transducer_composition():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 7, size=(7, 3))
    t = Transducer(0, 3, lambda s, c: (int(table[s, c]), int(s) % 5))
    codes = rng.integers(0, 3, size=300)
    lengths = np.array([0, 17, 200, 0, 83])
    state, want, at = 0, [], 0
    for n in lengths:
        state = 0
        for c in codes[at : at + n]:
            want.append(state % 5)
            state = int(table[state, c])
        at += n
    for chunk in (1, 3, 64, 1000):
        assert t.run(codes, lengths, chunk).tolist() == want


def test_sentence_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n ", None), (4, "Hello.", None), (4, "Hello.", None), (5, "word. " * 30000, "EN-x")]
    df = spark.createDataFrame([r + (0, "x") for r in rows], "id long, body string, tongue string, unit_no int, text string")
    got = S.sentences(df, "id", "body", "tongue").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {4: 2, 5: 30000}
    assert S.sentences(df.limit(0), "id", "body", "tongue").count() == 0


def slow(t):
    return None if t is None else unicodedata.normalize("NFC", "".join(LOOKALIKES.get(chr(x), chr(x)) for c in t for x in expansion(ord(c))))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="eẹ́́̈аｅﬁ​ ᄀ각ｶﾞ", max_size=20)), max_size=12))
def test_canonical_matches_model(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    assert canonical_array(pa.array(texts, pa.string())).to_pylist() == [slow(t) for t in texts]


def test_the_text_form_leaves_words_of_other_scripts():
    same = ["Москва сегодня", "Αθήνα ΑΘΗΝΑ", "оса", "հայ", "한글", "", None, "Καλημέρα kósmos"]
    turned = {"Моscow is nice": "Moscow is nice", "Москвa сегодня": "Москва сегодня", "сосоа is tasty": "cocoa is tasty", "ｆｕｌｌ wіdth": "full width", "Αthens, κόσμoς": "Athens, κόσμος", "Mосква é": "Москва é", "Москваz": "Москваz"}
    assert canonical_array(pa.array([*same, *turned]), text=True).to_pylist() == [*same, *turned.values()]
    keys = canonical_array(pa.array([*same, *turned])).to_pylist()
    assert keys[0] == "Mocквa ceгoдня" and keys[len(same)] == "Moscow is nice"
    # one text form never parts what has one key, as far as the words allow: it is a fixed point
    assert canonical_array(canonical_array(pa.array(list(turned)), text=True), text=True).to_pylist() == list(turned.values())


def test_canonical_pairs(spark):
    rows = [(1, "ﬁne cаfé​"), (2, "fine café"), (3, "Fine café"), (4, "fine cafe"), (5, None), (6, ""), (7, ""), (8, "ｆｉｎｅ café"), (8, "ｆｉｎｅ café"), (9, "fine café"), (10, "x²"), (11, "x2"), (12, "ж" * 200_000)]
    df = spark.createDataFrame([r + ("c",) for r in rows], "id long, t string, canonical_text string")
    got = sorted(map(tuple, lookalike_pairs(df, "id", "t").collect()))
    assert got == [(1, 2), (1, 8), (1, 9), (2, 8), (8, 9)]
    assert lookalike_pairs(df.limit(0), "id", "t").count() == 0
    assert canonical(df, "t").columns == ["id", "t", "canonical_text"]
    classes = {}
    for r in lookalike_classes(df, "id", "t").collect():
        classes.setdefault(r["class_id"], set()).add((r["id"], r["variant"]))
    assert {(a, b) for v in classes.values() for a, x in v for b, y in v if a < b and x != y} == set(got)


def site(n, extra=()):
    rng = random.Random(n)
    words = "levy road pool park bus ferry tree rink hall shore lane desk".split()
    sent = lambda: " ".join(rng.choices(words, k=12)).capitalize() + "."
    page = [f"{n % 12 + 1} May 2024 | {n} min", "Home | About", f"Home › News › Plan {n}", f"Plan {chr(97 + n)}{chr(99 + n)} for the {rng.choice(words)}", " ".join(sent() for _ in range(4)), f"Join {n} neighbours today", " ".join(sent() for _ in range(3)), "* " + sent()[:-1]]
    return "\n".join([*page, "Most read", *(f"Title {rng.choice(words)} {chr(97 + n)}{chr(97 + i)}" for i in range(3)), "Back to top", *extra])


def test_page_furniture(spark):
    rows = [(i, f"https://www.a.example/news/{i:03}", site(i)) for i in range(14)] + [(100, "http://A.example/news/003/?x=1", site(3)), (101, "https://b.example/x", "Home | About\nAlone."), (102, None, "x"), (103, "https://a.example/z", None), (3, "https://www.a.example/news/003", site(3))]
    df = spark.createDataFrame([r + (1, "y", 2) for r in rows], "source long, address string, body string, line_no int, text string, id int")
    got = page_lines(df, "source", "address", "body").collect()
    flagged = {(r["source"], r["line_no"]) for r in got if r["furniture"]}
    for i in [*range(14), 100]:
        assert {n for s, n in flagged if s == i} == {1, 2, 3, 6, 9, 10, 11, 12, 13}, i
    assert not [1 for s, _ in flagged if s in (101, 102, 103)]
    body = {r["source"]: r["main_text"] for r in main_body(df.where("source = 5 or source < 14"), "source", "address", "body").collect()}
    assert body[5].split("\n") == [x for n, x in enumerate(site(5).split("\n"), 1) if n not in {1, 2, 3, 6, 9, 10, 11, 12, 13}]
    assert page_lines(df.limit(0), "source", "address", "body").count() == 0
    # a hot host in blocks gives the same lines
    small = {(r["source"], r["line_no"]) for r in page_lines(df, "source", "address", "body", block_pages=8).collect() if r["furniture"]}
    assert len(small & flagged) > 0.9 * len(flagged)


def test_blocks_of_a_host_give_the_lines_of_the_whole(spark):
    rows = [(i, f"https://a.example/{'news' if i % 3 else 'plans'}/{i:03}", site(i, [f"Side note of part {i // 15} that stands on each of its pages"])) for i in range(60)]
    rows += [(100 + i, "https://a.example/news/007", site(7 + i % 2)) for i in range(30)]  # captures of one path
    rows += [(200 + i, f"https://a.example/news/007/print/{i:02}", site(7)) for i in range(40)]  # copies under other addresses
    df = spark.createDataFrame(rows, "id int, url string, body string")
    whole, cut = ({(r["id"], r["line_no"]) for r in page_lines(df, "id", "url", "body", block_pages=b).collect() if r["furniture"]} for b in (1024, 8))
    assert whole == cut and len({i for i, _ in whole}) == len(rows)


def test_copies_take_no_neighbours_place(spark):
    consent = "We keep small files on your device so that this page works, " * 4 + "as the law of the land asks us to say."
    rows = [(i, f"https://a.example/a/{i:03}", site(3, [consent])) for i in range(40)] + [(100 + i, f"https://a.example/b/{i:03}", site(20 + i, [consent])) for i in range(14)]
    df = spark.createDataFrame(rows, "id int, url string, body string")
    got = {(r["id"], r["line_no"]) for r in page_lines(df, "id", "url", "body").collect() if r["furniture"]}
    assert {(i, n) for i in range(40) for n in (2, 9, 13, 14)} <= got and not [1 for i, n in got if i < 40 and n in (5, 7)]


def test_long_lines_are_looked_up_on_other_hosts(spark):
    legal = "This site is run by friends of the park and pays for itself with what readers give, none of it from parties. " * 2
    own = lambda x: "\n".join(f"{x}{k} " * 60 for k in "pqr")
    rows = [(10 * h + i, f"https://h{h}.example/{i}", f"{own(chr(97 + h) + chr(97 + i))}\n{legal}") for h in range(3) for i in range(8)] + [(99, "https://alone.example/x", f"{own('z')}\n{legal}")]
    df = spark.createDataFrame(rows, "id int, url string, body string")
    got = {(r["id"], r["line_no"]) for r in page_lines(df, "id", "url", "body").collect() if r["furniture"]}
    assert (99, 4) in got and (99, 1) not in got


def test_alignment():
    assert shared_lines(list("abcd"), list("cdab")) == ([0, 1, 2, 3], [2, 3, 0, 1]) or sorted(shared_lines(list("abcd"), list("cdab"))[0]) == [0, 1, 2, 3]
    assert line_key("  12  March 2024 ") == line_key("3 May 2021") == "\x01date"
    assert furniture([], [], []) == []


def test_host_lines_against_brute_force(spark):
    rng = random.Random(5)
    lines = ["Share this 12", "share  THIS 7", "Legal notice", "", "   ", "Unique {}", "About us", "about us"]
    rows = []
    for i in range(90):
        host = rng.choice(["https://www.X.example/", "http://x.example/", "https://y.example:80/", "https://z.example/"])
        rows.append((i if i < 80 else i - 10, host + str(i), "\n".join(rng.choice(lines).format(i) for _ in range(rng.randint(0, 7)))))
    rows += [(200, None, "Legal notice"), (201, "https://x.example/", None)]
    import re

    def norm(x):
        return re.sub("[0-9]+", "0", re.sub(r"\s+", " ", x).strip().lower())

    pages, where = {}, {}
    for i, u, t in rows:
        if u and t is not None:
            h = re.sub("^www[.]", "", re.match("https?://([^/:]+)", u)[1].lower())
            pages.setdefault(h, set()).add(i)
            for n, x in enumerate(t.split("\n"), 1):
                where.setdefault((h, norm(x)), set()).add((i, n))
    want = {p for (h, k), at in where.items() if k and len({i for i, _ in at}) >= 5 and len({i for i, _ in at}) * 5 >= len(pages[h]) for p in at}
    df = spark.createDataFrame([r + (0, "h") for r in rows], "id long, url string, body string, line int, host string")
    assert {(r["id"], r["line_no"]) for r in repeated_lines(df, "id", "url", "body").collect()} == want and want
    left = {(r["id"], r["url"]): r["body"] for r in without_repeated_lines(df, "id", "url", "body").collect()}
    assert len(left) == len({r[:2] for r in rows}) and left[201, "https://x.example/"] is None
    one = next(r for r in rows if r[0] < 70 and any(p[0] == r[0] for p in want) and sum(x[0] == r[0] for x in rows) == 1)
    assert left[one[:2]] == "\n".join(x for n, x in enumerate(one[2].split("\n"), 1) if (one[0], n) not in want)
    assert repeated_lines(df.limit(0), "id", "url", "body").count() == 0
