import random

import pytest

from corvane.llm import personal as P

FIRST = ["Mira", "Tomas", "Edda", "Rolf", "Ines", "Joaquim", "Petra", "Ludo"]
LAST = ["Ostrander", "Velmont", "Kiplagat", "Sorensen", "Dahlgren", "Abernathy", "Quist"]


def corpus(n=1500, seed=3):
    """Texts with the kinds they hold, from carriers in two languages and sentences with distractors."""
    r = random.Random(seed)
    plain = ["Batch 4471 0093 1188 was counted in Rotterdam twice.", "The team at Nordwind Systems moved to Bergen.", "Ticket 2024-0031-77 was closed by the desk.", "Worked there from 2019 - 2023 with Python and Kafka.", "The budget of 12 500 000 was approved."]
    name = lambda: f"{r.choice(FIRST)} {r.choice(LAST)}"
    cases = {
        "name": [lambda: f"Spoke with {name()} about the start date.", lambda: f"Laut {name()} lief die Sache gut.", lambda: f"Referee: {name()}"],
        "phone": [lambda: f"Call +62 812 5550 {r.randrange(1000, 9999)} after five.", lambda: f"Call 0049 185 {r.randrange(1000000, 9999999)} after five."],
        "id_number": [lambda: f"Passport number 900-{r.randrange(10, 99)}-{r.randrange(1000, 9999)} was copied.", lambda: f"Passport number QZ {r.randrange(100, 999)} {r.randrange(100, 999)} 17 was copied."],
        "email": [lambda: f"Mail {r.choice(FIRST).lower()}.{r.choice(LAST).lower()}@box.example for more.", lambda: f"Mail {r.choice(FIRST).lower()} dot {r.choice(LAST).lower()} at box dot example for more."],
        "address": [lambda: f"Lives at {r.randrange(2, 99)} Hollow Street, Bergen.", lambda: f"Lives at Eikenrain {r.randrange(2, 99)}, Bergen."],
    }
    rows = []
    for i in range(n):
        kinds = r.sample(sorted(cases), r.choice([0, 0, 1, 1, 2]))
        parts = [r.choice(cases[k])() for k in kinds] + r.sample(plain, 2)
        r.shuffle(parts)
        rows.append((f"r{i}", " ".join(parts), set(kinds)))
    return rows


def taught(spark, rows, people=tuple(f"{a} {b}" for a, b in zip(FIRST[:4], LAST[:4], strict=True))):
    """The texts (id, text, kind) of rows (id, text), and what is accepted in them."""
    texts = spark.createDataFrame([(i, t, "x") for i, t in rows], "id string, text string, kind string")
    known = spark.createDataFrame([(x,) for x in [*people, None]], "p string")
    mentions = P.extract(texts, "text")
    return texts, P.accept(mentions, P.learn(mentions, known))


def kinds(texts, hits):
    got = {}
    for x in P.find(texts.drop("kind"), "text", ["id"], hits).collect():
        got.setdefault(x.id, set()).add(x.kind)
    return got


ODD = {
    "marks": "\ue000 \ue001\ue002 Mail a.b@box.example for more.",
    "project": "Wir treffen uns am Projekt Alpha 12 zur Probe",
    "row": "It shipped 3 releases in a row.",
    "close": "We were 20 percent close, so to say",
    "street": "Lives at 7 hollow street, Bergen.",
    "upper": "SPOKE WITH MIRA OSTRANDER ABOUT THE START DATE.",
    "lower": "laut petra quist lief die sache gut.",
    "within": "Lives at 12 Ostrander Street, Bergen.",
    "wide": "Mail a.b＠box.example for more.",
    "said": "Call zero eight one two five five five zero one after five.",
}


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    every = [(i, t) for i, t, _ in rows] + list(ODD.items()) + [("n", None), ("e", ""), ("copy", rows[0][1])]
    return rows, *taught(spark, every)


def test_finds_unseen_names_and_shapes(spark, learned):
    rows, texts, hits = learned
    got = kinds(texts, hits)
    right = sum(got.get(i, set()) == k for i, _, k in rows)
    assert right / len(rows) > 0.97
    assert "n" not in got and "e" not in got and got.get("copy", set()) == got.get("r0", set())


def test_odd_texts(spark, learned):
    _, texts, hits = learned
    got = {i: k for i, k in kinds(texts, hits).items() if i in ODD}
    assert got == {"marks": {"email"}, "street": {"address"}, "upper": {"name"}, "lower": {"name"}, "within": {"address"}, "wide": {"email"}, "said": {"phone"}}
    out = {x.id: x.text for x in P.redacted(texts, "text", hits).collect()}
    assert out["marks"] == "\ue000 \ue001\ue002 Mail [EMAIL] for more."
    assert out["within"] == "Lives at [ADDRESS], Bergen."
    assert out["upper"] == "SPOKE WITH [NAME] ABOUT THE START DATE."
    assert out["said"] == "Call [PHONE] after five."
    assert out["project"] == ODD["project"]


def test_redaction_keeps_the_rest(spark, learned):
    rows, texts, hits = learned
    out = {x.id: x.text for x in P.redacted(texts, "text", hits).collect()}
    assert out["n"] is None and out["e"] == "" and len(out) == texts.count()
    new = "Spoke with Petra Quist about the start date. Batch 4471 0093 1188 was counted.\nMail a.b@box.example for more.  End"
    assert P.redact(new, [(2, 4, "name"), (16, 17, "email")]) == "Spoke with [NAME] about the start date. Batch 4471 0093 1188 was counted.\nMail [EMAIL] for more.  End"
    for i, t, k in rows[:300]:
        if not k:
            assert out[i] == t


def test_empty_and_long(spark):
    long = ("word " * 40_000) + "9" * 20_000
    texts, hits = taught(spark, [("l", long), ("n", None)])
    assert P.find(texts.drop("kind"), "text", ["id"], hits).count() == 0
    assert {x.id: x.text for x in P.redacted(texts, "text", hits).collect()} == {"l": long, "n": None}
    none = P.extract(texts.limit(0), "text")
    assert none.count() == 0
    assert P.accept(none, P.learn(none, spark.createDataFrame([], "p string"))).count() == 0


def test_hashes_are_the_engines(spark):
    words = ["", "a", "mühlenrain", "\ue000", "x" * 100]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.h for r in df.selectExpr("xxhash64(w) h").collect()] == [P._hash(w) for w in words]


def test_a_lexicon_that_is_not_broadcast_gives_the_same(spark, learned):
    rows, texts, hits = learned
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, again = taught(spark, [(i, t) for i, t, _ in rows] + list(ODD.items()) + [("copy", rows[0][1])])
        key = lambda x: (x.h1, x.h2, sorted((h.kind, h["first"], h["last"]) for h in x.hits))
        assert sorted(map(key, hits.collect())) == sorted(map(key, again.collect()))
        assert sorted(kinds(texts, again)) == sorted(kinds(texts, hits))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_shapes():
    assert P.shape("+62 812 5550 0150") == "+xx xxx xxxx xxxx"
    assert P.shape("0812‑5550‑0150") == "08xx-xxxx-xxxx"
    assert P.shape("QZ 938 002 17") == "AA xxx xxx xx"
    assert [x[2] for x in P.specials("a (at) b.example, Jl. Melati No. 3, 0812 5550 0177")] == ["E", "A", "D"]
    assert [x[3] for x in P.specials("passport Q0896362, QZ 083 678 93, WA 0812 5550 0138")] == ["Axxxxxxx", "AA xxx xxx xx", "08xx xxxx xxxx"]


@pytest.mark.parametrize("text", ["Wohnt Hauptstr. 12 in Bergen", "Bahnhofstr. 5", "Bahnhofstraße n° 5", "Bahnhofstraße no5", "Ringstr. nr. 5", "Write to B.P. 12, Lyon", "Write to BP12", "à l'avenue Foch 12", "Postbus123"])
def test_addresses_the_patterns_match_are_tried(text):
    assert [x[2] for x in P.specials(text)] == ["A"]
    assert P.specials(text)[0][3].split("|")[0].endswith("+")


@pytest.mark.parametrize("text", ["am Projekt Alpha 12", "shipped 3 releases in a row.", "20 percent close,", "Im Ring 24 stehen"])
def test_what_only_looks_like_a_street_is_not_certain(text):
    assert not any(x[3].split("|")[0].endswith("+") for x in P.specials(text))
