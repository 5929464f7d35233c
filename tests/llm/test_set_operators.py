"""Near duplicates, truncation, packing, mixing and personal data."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import truncation as T
from spanlake.llm.mixing import mixed, reached_shares, selection_problems
from spanlake.llm.packing import fill_report, packed, packing_problems, vector_best_fit
from spanlake.llm.parity_join import _mix, bit_sketches, expand_pairs, groups, near_duplicates, signatures
from spanlake.llm.personal_data import _LATIN, Finder, NameLexicon, learn_names, normal_entity, personal_data, shape, surrogate, surrogate_problems, surrogates, with_placeholders, with_surrogates


def words(t):
    return frozenset(re.findall(r"[^\W_]+", (t or "").lower()))


def edited(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i and rng.random() < 0.5:
            base = rng.choice(out).split()
            for _ in range(rng.randint(0, max(1, len(base) // 6))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rng.shuffle(base)
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.sample(vocabulary, rng.choice([1, 2, 3, 5, 8, 20, 60, 130]))))
    return out


@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_near_duplicates_against_brute_force(spark, threshold):
    texts = edited(random.Random(threshold), 260) + ["W1 w2, W3!", "w3 w2 w1", "", None, "...", "é ü", "É Ü"]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    df = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "id long, t string, class_id string, size int, words string")
    sets = {i: words(t) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    members, links = near_duplicates(df, "id", "t", threshold)
    assert {tuple(r) for r in expand_pairs(members, links).collect()} == want and len(want) > 100
    group = {r["id"]: r["group_id"] for r in groups(members, links).collect()}
    root = {i: i for i in group}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        root[find(a)] = find(b)
    assert len(set(group.values())) == len({find(i) for i in group})
    assert all(group[a] == group[b] for a, b in want)


@pytest.mark.parametrize("threshold,per_part", [(0.7, 2), (0.7, 3), (0.8, 2)])
def test_signatures_miss_no_pair_and_none_is_empty(threshold, per_part):
    rng = random.Random(per_part)
    sets = set()
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 17, 20, 25, 30, 40, 60, 90, 150] * 4:
        base = {rng.randrange(10**9) for _ in range(n)}
        sets.add(frozenset(base))
        for _ in range(6):
            x = set(base)
            for _ in range(rng.randint(0, max(1, n // 4))):
                if rng.random() < 0.6 and len(x) > 1:
                    x.discard(rng.choice(sorted(x)))
                if rng.random() < 0.6:
                    x.add(rng.randrange(10**9))
            sets.add(frozenset(x))
    sets = sorted(sets, key=sorted)
    size = np.array([len(x) for x in sets])
    hashed = _mix(np.array([w for x in sets for w in sorted(x)], dtype=np.uint64))
    at, sig, gone, level = signatures(hashed, np.repeat(np.arange(len(sets)), size), size, threshold, np.unique(size), per_part)
    held = {}
    for row in zip(at.tolist(), sig.tolist(), gone.tolist(), level.tolist()):
        held.setdefault(row[1], []).append(row)
    met = {(min(a[0], b[0]), max(a[0], b[0])) for rows in held.values() for a, b in itertools.combinations(rows, 2) if a[2] + b[2] <= min(a[3], b[3])}
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}
    assert want <= met and len(want) > 200
    empty = {int(_mix(_mix(np.array([p + (parts << 20)], dtype=np.uint64)))[0].view(np.int64)) for parts in (2**k for k in range(8)) for p in range(parts)}
    few = {a for a, s, _, _ in zip(at.tolist(), sig.tolist(), gone, level) if s in empty}
    assert len(few) * 50 < len(sets)  # only records whose words lie in too few parts


def test_no_side_of_the_signature_join_is_broadcast(spark):
    from pyspark.sql import DataFrame

    from spanlake import session

    plans = []
    real = session.checkpointed
    texts = edited(random.Random(4), 60)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    try:
        session.checkpointed = lambda d, s=None: (plans.append(d._jdf.queryExecution().executedPlan().toString()), real(d, s))[1]
        members, links = near_duplicates(df, "id", "t", 0.7)
        plans.append(links._jdf.queryExecution().executedPlan().toString())
    finally:
        session.checkpointed = real
    assert isinstance(links, DataFrame) and any("MapInArrow" in p and "SortMergeJoin" in p for p in plans)
    assert not any("BroadcastHashJoin" in p for p in plans if "MapInArrow" in p) and "Broadcast" not in plans[-1]


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, t string")
    members, links = near_duplicates(empty, "id", "t")
    assert members.count() == links.count() == expand_pairs(members, links).count() == groups(members, links).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, size=30)).astype(np.uint64) for _ in range(2))
        s = bit_sketches(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2).view(np.uint64)
        assert sum(bin(int(x ^ y)).count("1") for x, y in zip(*s)) <= len(np.setxor1d(a, b))


def letters(rng, n):
    subject = ["The council", "Our library", "A neighbour", "The old pool", "Every household"]
    verb = ["needs", "wants", "should fund", "will repair", "cannot lose"]
    thing = ["the ferry dock", "a new bus route", "the noise bylaw", "shared gardens", "safer crossings"]
    tail = ["before the next winter.", "because delay costs more.", "in the coming year.", "without a higher levy."]
    for _ in range(n):
        text = " ".join(f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)} {rng.choice(tail)}" for _ in range(rng.randint(3, 9)))
        yield text + rng.choice(["", "", f"\n\n- #plan{rng.randint(1, 99)}", "\n\nwww.plan.example", "\n* Fix the dock\n* Plant trees"])


def test_truncation_on_held_out_cuts(spark):
    rng = random.Random(4)
    rows = []
    for i, t in enumerate(letters(rng, 700)):
        cut = i % 5 == 0
        if cut:
            body = t.split("\n")[0]
            n = 160 if i % 2 and len(body) > 161 and body[159] not in ".!? " else rng.randint(60, len(body) - 12)
            while body[n - 1] in ".!? ":
                n -= 1
            t = body[:n] + rng.choice(["", "...", "…"])
        rows.append((i, t, f"https://h{i % 3}.example/{i}", "en", cut))
    rows += [(9001, None, "https://h.example", "en", False), (9002, "", None, None, False), (9003, "x" * 300_000 + " end.", "https://h.example", "en", False)]
    df = spark.createDataFrame([r + (1.0, "h") for r in rows], "id long, t string, url string, lang string, cut boolean, score double, host string")
    got = {r["id"]: r["truncated"] for r in T.truncated(df, "id", "t", "url", "lang").collect()}
    assert 9001 not in got and got[9002] is False
    right = [got[r[0]] == r[4] for r in rows if r[0] < 9000]
    assert sum(right) / len(right) > 0.95
    rates = T.truncation_rates(T.truncated(df, "id", "t", "url", "lang"), "id").collect()
    assert sum(r["records"] for r in rates) == len(got)
    assert T.truncated(df.limit(0), "id", "t", "url", "lang").count() == 0


def test_length_limits_mean_the_same_at_every_size(spark):
    for scale in (1, 10, 100):
        rng = np.random.default_rng(scale)
        n = np.concatenate([rng.normal(1000, 70, 90 * scale).astype(int), np.full(10 * scale, 800)])
        base = spark.createDataFrame([(i, "h", int(x)) for i, x in enumerate(n)], "id long, host string, n int")
        got = {r["n"]: r["same"] for r in T.length_lifts(base).collect()}
        assert {x for x, k in got.items() if k >= 4} == {800}, scale


def test_packing_keeps_every_constraint(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([1, 5, 40, 90, 255, 256, 257, 700, 3000])) for i in range(1500)] + [(5000, 0), (5001, None)]
    df = spark.createDataFrame([r + (7, "x") for r in sizes], "doc long, n long, bin int, item_id string")
    profiles = spark.createDataFrame([(1, "a", 256), (2, "b", 1024)], "profile_id int, profile_name string, capacity_tokens int")
    out = packed(df, "doc", "n", profiles, block_items=400)
    rows = out.collect()
    for p, cap in ((1, 256), (2, 1024)):
        mine = [r for r in rows if r["profile_id"] == p]
        load, docs, pieces = {}, {}, {}
        for r in mine:
            n = r["token_end"] - r["token_start"]
            load[r["container_id"]] = load.get(r["container_id"], 0) + n
            docs[r["container_id"]] = docs.get(r["container_id"], 0) + 1
            pieces.setdefault(r["item_id"], []).append((r["token_start"], r["token_end"]))
        assert max(load.values()) <= cap and max(docs.values()) <= cap // 32
        for i, n in sizes:
            got = sorted(pieces.get(i, []))
            assert (len(got) == 1) == (n is not None and 0 < n <= cap)
            assert sum(b - a for a, b in got) == (n or 0) and all(x[1] == y[0] for x, y in zip(got, got[1:]))
    fill = {r["profile_id"]: r["fill_share"] for r in fill_report(out, profiles).collect()}
    assert min(fill.values()) > 0.9
    assert packed(df.limit(0), "doc", "n", profiles).count() == 0
    with pytest.raises(ValueError):
        packed(df, "doc", "n", profiles.limit(0))


def test_best_fit_rules():
    for rule, most in (("norm", 2), ("dot", 3)):
        bins = vector_best_fit(np.array([60, 50, 40, 30, 20]), 100, 10, 1e4, rule)
        assert np.bincount(bins, weights=[60, 50, 40, 30, 20]).max() <= 100 and len(set(bins)) <= most
    assert len(set(vector_best_fit(np.ones(10, dtype=int), 100, 3, 1e4))) == 4  # the document capacity binds
    assert len(set(vector_best_fit(np.full(10, 10), 100, 50, 250.0))) == 5  # the attention capacity binds


def test_mixing_reaches_shares_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, rng.choices(["big", "mid", "small", "other", None], [60, 20, 8, 10, 2])[0], rng.randint(0, 40)) for i in range(4000)]
    df = spark.createDataFrame([r + (1, 2.0) for r in rows], "doc long, source string, tokens long, copy_no int, finish_time double")
    goals = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)], "source string, target_share double, max_repeats int")
    out = mixed(df, goals, "doc", "source", "tokens")
    picked = out.collect()
    total = {s: sum(r[2] for r in rows if r[1] == s) for s in ("big", "mid", "small")}
    budget = int(min(total["big"] / 0.5, 2 * total["mid"] / 0.3, 3 * total["small"] / 0.2))
    assert budget - 200 <= sum(r["tokens"] for r in picked) <= budget
    uses = {}
    for r in picked:
        uses[r["doc"]] = uses.get(r["doc"], 0) + 1
    most = {"big": 1, "mid": 2, "small": 3}
    source = {r[0]: r[1] for r in rows}
    assert all(n <= most[source[d]] for d, n in uses.items())
    for r in reached_shares(out, goals, "source", "tokens").collect():
        assert abs(r["reached_share"] - r["target_share"]) < 0.005
    # the selection is the beginning of the global order
    everything = mixed(df, goals, "doc", "source", "tokens", budget=10**9).collect()
    order = sorted(everything, key=lambda r: (r["finish_time"], r["source"], r["doc"], r["copy_no"]))
    at, want = 0, set()
    for r in order:
        at += r["tokens"]
        if at > budget:
            break
        want.add((r["doc"], r["copy_no"]))
    assert {(r["doc"], r["copy_no"]) for r in picked} == want
    assert mixed(df.limit(0), goals, "doc", "source", "tokens").count() == 0


NAMES = NameLexicon(("Ada", "Bo", "Una"), ("bren", "tar", "vel"), ("holt", "mere", "wick"), ("smithers",))
FOUND = [
    ("Write to ada.low+x@mail.site.example. Bye", "", [("ada.low+x@mail.site.example", "email")]),
    ("mailto:ADA [at] site [dot] example is quick", "", [("ADA [at] site [dot] example", "email")]),
    ("ask the clerk @ the desk, follow @talk22 for news", "", []),
    ("Call (250) 555-0177 x12 or +44 7700 900668; 555-0131.", "", [("(250) 555-0177 x12", "phone"), ("+44 7700 900668", "phone"), ("555-0131", "phone")]),
    ("Text +1 604 555 0190 528 renters did; +44 7700 900668 94 more, +33 1 99 00 64 64 x5.", "", [("+1 604 555 0190", "phone"), ("+44 7700 900668", "phone"), ("+33 1 99 00 64 64 x5", "phone")]),
    ("I rent at 986 Saller Street. 939 owners. I rent at 12 Ell Rd. 40 more.", "", [("986 Saller Street", "address"), ("12 Ell Rd", "address")]),
    ("电话+１ ２５０ ５５５ ０１２０。", "zh", [("+１ ２５０ ５５５ ０１２０", "phone")]),
    ("Contract 635-471-1713, account 4666 519 2025, parcel identifier is 009-590-676, Tender RFP-2013-347-07", "", []),
    ("Her care card reads 9364-370-686. SIN 071 715 557, Passport QX 232831, licence DL-0268355 was", "", [("9364-370-686", "id_number"), ("071 715 557", "id_number"), ("QX 232831", "id_number"), ("DL-0268355", "id_number")]),
    ("El DNI 00852630-C y Ausweis Nr. L03X94T46 lag", "", [("00852630-C", "id_number"), ("L03X94T46", "id_number")]),
    ("I rent at 3621 Ellen Rd.. Send to Unit 83, 3779 Ell Avenue fell; 114-1496 Oak St. E. until", "", [("3621 Ellen Rd.", "address"), ("Unit 83, 3779 Ell Avenue", "address"), ("114-1496 Oak St. E.", "address")]),
    ("au 202 bis, avenue Corm. En C/ Tarr 123, 2.º B, junto. Wohne Quillweg 36-38.", "", [("202 bis, avenue Corm", "address"), ("C/ Tarr 123, 2.º B", "address"), ("Quillweg 36-38", "address")]),
    ("The corner of Park and 14th Street floods. 314 letters about street trees.", "", []),
    ("Dr. Ada Brenholt met TARMERE, Bo and R. Velwick; Tarholt’s dog.", "", [("Ada Brenholt", "name"), ("TARMERE, Bo", "name"), ("R. Velwick", "name"), ("Tarholt", "name")]),
    ("bo tarwick and Ada van O'Velmere-Brenwick, Smithers", "", [("bo tarwick", "name"), ("Ada van O'Velmere-Brenwick", "name"), ("Smithers", "name")]),
    ("la plaza Tarmere, Brenholt Street, am Velholtplatz, Una vecina", "es", []),
]


@pytest.mark.parametrize(("text", "lang", "want"), FOUND)
def test_found(text, lang, want):
    assert [(text[a:z], k) for a, z, k in Finder(NAMES).find(text, lang)] == want


def test_names_are_learned(spark):
    rows = [(g, f"{s}{m}{e}") for g in ("Ada", "Bo") for s in ("Bren", "Tarn") for m in ("a", "o", "i") for e in ("holt", "mere")] + [(None, None), ("", "")]
    lexicon = learn_names(spark.createDataFrame(rows, "given string, surname string"), "given", "surname")
    assert lexicon.given == ("Ada", "Bo") and lexicon.starts == ("bren", "tarn") and lexicon.ends == ("holt", "mere")
    assert learn_names(spark.createDataFrame([], "g string, s string"), "g", "s") == NameLexicon((), (), (), ())


def test_placeholders_and_surrogates(spark):
    rows = [(1, "Ada Brenholt, 250-555-0177, wrote to Bo Tarwick and to ADA BRENHOLT.", "en"), (2, "Ada Brenholt (ada@x.example) lives at 12 Oak Street.", "en"), (3, None, None), (4, "", "en"), (5, "Nothing here.", "en")]
    df = spark.createDataFrame([r + ("z", 1) for r in rows], "id long, text string, lang string, entity string, char_start int")
    held = {r["id"]: r["text"] for r in with_placeholders(df, "id", "text", NAMES, "lang").collect()}
    assert held[1] == "[NAME_1], [PHONE_1], wrote to [NAME_2] and to [NAME_1]." and held[2] == "[NAME_1] ([EMAIL_1]) lives at [ADDRESS_1]." and held[3] is None and held[4] == ""
    found = personal_data(df, "id", "text", NAMES, "lang").cache()
    table = surrogates(found, "key")
    per = {}
    for r in table.collect():
        per.setdefault((r["pii_kind"], r["normal"]), set()).add(r["surrogate"].lower())
    assert all(len(v) == 1 for v in per.values()) and len(set.union(*per.values())) == len(per)
    out = {r["id"]: r["text"] for r in with_surrogates(df.select("id", "text"), "id", "text", found, "key").collect()}
    assert out[3] is None and out[4] == "" and out[5] == "Nothing here." and "Brenholt" not in out[1] + out[2]
    assert re.search(r"\d{3}-\d{3}-\d{4}", out[1]) and out[2].endswith("Street.")
    first = re.match(r"(\w+ \w+), ", out[1])[1]
    assert out[2].startswith(first) and first.upper() in out[1]
    assert surrogate(b"a", "phone", "250-555-0177") != surrogate(b"b", "phone", "250-555-0177")
    assert normal_entity("email", "a [at] b [dot] c") == "a@b.c" and normal_entity("name", "TARMERE, Bo") == "bo tarmere"
    assert personal_data(df.limit(0), "id", "text", NAMES).count() == 0


def test_surrogates_of_many_names_are_distinct_and_keep_their_parts(spark):
    family = [f"Fam{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{'a' if i % 2 else 'en'}" for i in range(6000)]
    entities = [f"Ada {f}" for f in family] + family + [f"{a}. Tarmere" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    found = spark.createDataFrame([("name", e) for e in entities] + [("phone", f"555-{i:04}") for i in range(3000)], "pii_kind string, entity string")
    got = {r["entity"]: r["surrogate"] for r in surrogates(found, "key").collect()}
    assert len(got) == len({x.lower() for x in got.values()}) == len(entities) + 3000
    assert all(got[f"Ada {f}"].split(" ")[1] == got[f] for f in family)


@pytest.mark.parametrize("label", ["HEALTH CARD", "INSURANCE NUMBER", "CARE CARD", "IDENTITY CARD", "ssn", "Sin", "nie", "CARTE SOLEIL", "passport no.", "FÜHRERSCHEIN", "Sozialversicherungsnummer"])
def test_labels_are_found_in_any_case(label):
    text = f"{label} 071 715 557 y"
    assert [(text[a:z], k) for a, z, k in Finder(NAMES).find(text)] == [("071 715 557", "id_number")]


def test_names_of_several_parts_or_other_letters_are_looked_up():
    names = NameLexicon(("Jean-Luc", "Mary Ann", "Łucja"), (), (), ())
    for name in names.given:
        assert [(a, z) for a, z, _ in Finder(names).find(f"so {name} said")] == [(3, 3 + len(name))]


def test_names_beyond_the_bound_are_found(spark):
    people = spark.createDataFrame([(f"{a}{b}e", f"{b}unt{a.lower()}rk") for a in "BCDFG" for b in ("al", "or", "un")], "given string, surname string")
    rows = [(i, f"so {r['given']} {r['surname'].title()} said; Mc{r['surname'].title()} too") for i, r in enumerate(people.collect())] + [(99, None)]
    docs = spark.createDataFrame(rows, "id int, t string")
    all_, few = (learn_names(people, "given", "surname", most=m) for m in (100, 4))
    assert all_.rest is None and len(few.given) == 4
    want, got = ({tuple(r) for r in personal_data(docs, "id", "t", n).collect()} for n in (all_, few))
    assert want == got and len(want) == 30
    held = with_placeholders(docs, "id", "t", few).collect()
    assert {r["t"] for r in held} == {"so [NAME_1] said; [NAME_2] too", None} and held[0].asDict().keys() == {"id", "t"}


def test_each_capacity_of_packed_decides(spark):
    df = spark.createDataFrame([(i, 100) for i in range(40)], "doc long, n long")
    profiles = spark.createDataFrame([(1, 1000)], "profile_id int, capacity_tokens int")
    free = {"attention_share": 1.0, "documents_per_token": 1.0}
    count = lambda d, **how: packed(d, "doc", "n", profiles, **free | how).select("container_id").distinct().count()
    assert count(df) == 4  # by tokens
    assert count(df, documents_per_token=0.005) == 8  # five documents in each
    assert count(df, attention_share=0.02) == 20  # two texts of 10,000 in each
    # no text is split for its attention: the longest sets the least capacity
    long = df.union(spark.createDataFrame([(99, 600), (100, 2300)], df.schema))
    out = packed(long, "doc", "n", profiles, **free | {"attention_share": 0.02})
    assert out.where("item_id = 99").count() == 1 and out.where("item_id = 100").count() == 3
    problems = packing_problems(out, long, "doc", "n", profiles, **free | {"attention_share": 0.02})
    assert [tuple(r) for r in problems.collect()] == [(1, 42, 0, 0, 0)]
    assert [tuple(r) for r in packing_problems(out, long, "doc", "n", profiles, attention_share=1.0, documents_per_token=0.001).collect()] != [(1, 42, 0, 0, 0)]
    assert [tuple(r) for r in packing_problems(out.where("piece_no <> 1"), long, "doc", "n", profiles, **free).collect()] == [(1, 42, 0, 1, 0)]
    report = fill_report(packed(df, "doc", "n", profiles, **free | {"documents_per_token": 0.005}), profiles, **free | {"documents_per_token": 0.005}).first()
    assert (report["containers"], report["full_of_documents"], report["fill_share"], report["document_share"]) == (8, 8, 0.5, 1.0)


def test_the_selection_is_written_in_its_order(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 1 + i % 7) for i in range(3000)], "doc long, source string, tokens long")
    goals = spark.createDataFrame([("a", 0.75, 2), ("b", 0.25, 1)], "source string, target_share double, max_repeats int")
    whole = mixed(df, goals, "doc", "source", "tokens", bucket_rows=100).collect()
    assert [r["finish_time"] for r in whole] == sorted(r["finish_time"] for r in whole)
    upto = 0
    for r in whole:
        upto += r["tokens"]
        assert r["tokens_upto"] == upto
        if upto > 1000:  # right at any point, not only at the end
            a = sum(x["tokens"] for x in whole if x["source"] == "a" and x["tokens_upto"] <= upto)
            assert abs(a / upto - 0.75) <= 14 / upto
        if upto > 3000:
            break
    part = mixed(df, goals, "doc", "source", "tokens", budget=2000, bucket_rows=100).collect()
    assert [tuple(r) for r in part] == [tuple(r) for r in whole if r["tokens_upto"] <= 2000]
    assert [tuple(r)[1:] for r in selection_problems(mixed(df, goals, "doc", "source", "tokens"), goals, "doc", "source", "tokens").collect()] == [(0, 0)] * 2
    twice = spark.createDataFrame(part + part, spark.createDataFrame(part).schema)
    assert {r["over_repeats"] > 0 for r in selection_problems(twice, goals, "doc", "source", "tokens").collect()} == {True}


def test_surrogates_keep_script_gender_and_form(spark):
    texts = [
        "Mrs. Ada Brenholt and Herr Bo Tarmere met Bo Velwick", "Call +1 250 555 0177 x12 or ADA [at] site [dot] example", "12 Ell Rd., Quillweg 36-38, C/ Tarr 123",
    ]
    found = personal_data(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", NAMES)
    assert {(r["entity"], r["cue"]) for r in found.collect() if r["pii_kind"] == "name"} == {("Ada Brenholt", "f"), ("Bo Tarmere", "m"), ("Bo Velwick", "")}
    more = spark.createDataFrame([("name", e, c) for e, c in (("Иван Петров", "m"), ("Анна Петрова", ""), ("王伟", ""), ("김민수", ""), ("Αθήνα Παππά", ""), ("O'Velmere-McBren", ""), ("TARMERE, Bo", ""), ("مريم", ""))], "pii_kind string, entity string, cue string")
    table = surrogates(found.select("pii_kind", "entity", "cue").union(more), "key")
    got = {r["entity"]: r["surrogate"] for r in table.collect()}
    assert all(shape(a) == shape(b) and a != b for a, b in got.items())
    women, men = _LATIN.feminine, got["Bo Tarmere"].split()[0]
    assert got["Ada Brenholt"].split()[0].endswith(women) and not men.endswith("a")
    assert got["Bo Velwick"].split()[0] == men and got["TARMERE, Bo"] == f"{got['Bo Tarmere'].split()[1].upper()}, {men}"
    assert got["Анна Петрова"].split()[0][-1] in "ая" and got["Анна Петрова"].endswith("ова") and got["Иван Петров"].endswith("ов")
    assert got["O'Velmere-McBren"].startswith("O'") and "-Mc" in got["O'Velmere-McBren"]
    assert got["+1 250 555 0177 x12"].startswith("+1 ") and got["ADA [at] site [dot] example"].endswith(" [dot] example") and got["Quillweg 36-38"].split()[0].endswith("weg") and "Ell" not in got["12 Ell Rd."]
    assert [tuple(r)[1:] for r in surrogate_problems(table).collect()] == [(0, 0, 0)] * 4
    bad = table.withColumn("surrogate", F.when(F.col("pii_kind") == "name", F.lit("Bo Tarmere")).otherwise(F.lit("?")))
    assert {tuple(r)[1] > 0 or tuple(r)[3] > 0 for r in surrogate_problems(bad).collect()} == {True}


def test_a_surrogate_is_no_real_entity(spark):
    fixed = [surrogate(b"key", "phone", f"555-{i:04}") for i in range(40)]
    found = spark.createDataFrame([("phone", e) for e in {*fixed, *(f"555-{i:04}" for i in range(40))}], "pii_kind string, entity string")
    got = {r["entity"]: r["surrogate"] for r in surrogates(found, "key").collect()}
    assert not set(got) & set(got.values()) and len(set(got.values())) == len(got)


def test_the_sample_of_records_never_runs_dry():
    rng = np.random.default_rng(3)
    hashes = rng.integers(-(2**63), 2**63 - 1, size=200_000, dtype=np.int64)
    for total in (1, 10, 12_000, 10**6, 10**12, 10**16):
        bound = T.sample_bound(12_000, total)
        share = min(1.0, 12_000 / total)
        assert -(2**63) <= bound < 2**63 and (bound + 2**63) / 2**64 == pytest.approx(share, rel=1e-6)
        assert abs((hashes <= bound).mean() - share) < 0.01
    assert T.sample_bound(12_000, 10**14) > -(2**63)


def test_fitting_learns_what_tells():
    rng = np.random.default_rng(4)
    rows = [sorted({int(x) for x in rng.integers(10, 60, size=6)} | {1 + i % 2}) for i in range(3000)]
    labels = np.array([i % 2 for i in range(3000)], dtype=float)
    x = T.Hashed.once(np.array([f for r in rows for f in r + r[:1]]), np.array([len(r) + 1 for r in rows]))
    assert x.size.tolist() == [len(r) for r in rows] and x.picked(np.array([7, 2])).flat.tolist() == rows[7] + rows[2]
    model = T.fit(x, labels)
    assert ((model.score(rows) > 0.5) == labels).all() and ((T.held_out_scores(x, labels) > 0.5) == labels).mean() > 0.99
    assert len(model.score([])) == 0


def test_recall_by_kind_on_planted_entities():
    rng = random.Random(12)
    lexicon = NameLexicon(tuple("Ada Bo Una Emil Rosa Ivo Thea Nils".split()), ("bren", "tar", "vel", "ost"), ("holt", "mere", "wick", "berg"), ("smithers",))
    word = lambda n=5: "".join(rng.choice("abdefgiklmnoprstu") for _ in range(n))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    given = lambda: rng.choice(lexicon.given)
    family = lambda: rng.choice(lexicon.starts).title() + word(3) + rng.choice(lexicon.ends)
    make = {
        "email": [lambda: f"{word()}.{word(3)}@{word()}.example", lambda: f"{word()}+{d(2)}@{word(4)}.{word(4)}.org", lambda: f"{word()} [at] {word()} [dot] net", lambda: f"{word()} at {word()} dot example", lambda: f"{word()}(at){word()}.com"],
        "phone": [lambda: f"+1 250 555 0{d(3)}", lambda: f"(604) 555-{d(4)}", lambda: f"778.555.{d(4)}", lambda: f"250-555-{d(4)} ext. {d(2)}", lambda: f"+44 7700 900{d(3)}", lambda: f"+33 1 99 {d(2)} {d(2)} {d(2)}", lambda: f"+49 30 9018{d(2)}", lambda: f"+86 138 {d(4)} {d(4)}"],
        "id_number": [("SIN ", lambda: f"{d(3)} {d(3)} {d(3)}"), ("passport no. ", lambda: f"QX{d(6)}"), ("PHN: ", lambda: f"9{d(3)} {d(3)} {d(3)}"), ("DNI ", lambda: f"{d(8)}-Z"), ("driver's licence ", lambda: f"DL-{d(7)}"), ("身份证号码", lambda: f"1101011990{d(8)}"), ("Sozialversicherungsnummer ", lambda: f"{d(2)} {d(6)} M {d(3)}"[:9]), ("numéro de sécurité sociale : ", lambda: f"2 85 05 {d(2)} {d(3)} {d(3)}")],
        "address": [lambda: f"{d(2)}1 {word().title()} Street", lambda: f"Unit {d(1)}, 1{d(3)} {word().title()} Drive", lambda: f"4{d(2)} {word().title()} Ave. W.", lambda: f"3{d(1)} rue des {word().title()}", lambda: f"Calle {word().title()} 1{d(1)}, 3.º B", lambda: f"{word().title()}straße 1{d(1)}", lambda: f"Am {word().title()} {d(1)}7"],
        "name": [lambda: f"{given()} {family()}", lambda: f"{given()} {rng.choice('ABC')}. {family()}", lambda: f"{rng.choice('ABC')}. {family()}", lambda: f"{family()}, {given()}", lambda: f"{given()} {family()}-{family()}".replace("-", "-"), lambda: family().upper()],
    }
    around = [("They wrote to ", ", and then left."), ("Contact: ", "\n\nThe council met twice."), ("Il a dit ", " hier soir."), ("So war es: ", "; mehr nicht."), ("Antes, ", " y nada más.")]
    finder = Finder(lexicon)
    for kind, forms in make.items():
        hit = total = 0
        for k in range(400):
            form = forms[k % len(forms)]
            label, entity = (form[0], form[1]()) if isinstance(form, tuple) else ("", form())
            before, after = around[k % len(around)]
            text = f"{before}{label}{entity}{after}"
            a = len(before) + len(label)
            hit += (a, a + len(entity), kind) in finder.find(text)
            total += 1
        assert hit >= 0.95 * total, (kind, hit / total)
    plain = ["The bylaw 2019-123456 passed on 12 March 2024 with 45% in favour.", "Account 4666 519 2025 and parcel 009-590-676 were closed.", "Meet at the library on Oak Street; the ferry runs at 7:30.", "Es kamen 1234567 Leute.", "Page 12 of 345, file 98-7654."]
    assert sum(len(finder.find(x)) for x in plain) == 0
