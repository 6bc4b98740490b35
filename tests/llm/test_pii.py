import numpy as np

from palimpsest.llm import pii as P

TEXTS = {
    "Reach the executor Brandt Oakhanger\nunder 1-509-555-0171 ext. 90 on weekdays.": [("person_name", "Brandt Oakhanger"), ("phone", "1-509-555-0171 ext. 90")],
    "Copies went to drumgarth15 (at)\nharrowmere.example.org and BRONAGH+FILE0@POST.EXAMPLE yesterday.": [("email", "drumgarth15 (at)\nharrowmere.example.org"), ("email", "BRONAGH+FILE0@POST.EXAMPLE")],
    "Social security no. 00 984 397 296 was entered for Denholm\nPenhalwick in the register.": [("id_number", "00 984 397 296"), ("person_name", "Denholm\nPenhalwick")],
    "The keys are held at 125 Orchard Row, Unit 17, Pellbridge\n00724.": [("address", "125 Orchard Row, Unit 17, Pellbridge\n00724")],
    "Mrs. SKELBROOK, Gisela of 73 Chapel Ave. signed.": [("person_name", "SKELBROOK, Gisela"), ("address", "73 Chapel Ave.")],
    "Écrire à Orlin Kestrelby-Harnwick, 192 bis\nplace de la Halle, 00699 Brèves-sur-Lise.": [("person_name", "Orlin Kestrelby-Harnwick"), ("address", "192 bis\nplace de la Halle, 00699 Brèves-sur-Lise")],
    "Frau Renske A. Oakhanger wohnt Lindenweg 53, 04211 Altenbrück.": [("person_name", "Renske A. Oakhanger"), ("address", "Lindenweg 53, 04211 Altenbrück")],
    "Contact Br​andt Oakhanger ｕｎｄｅｒ ０２０ 7946 0208.": [("person_name", "Br​andt Oakhanger"), ("phone", "０２０ 7946 0208")],
    "Confirmed by Denholm Oakhanger LUNDMOOR22@POST.EXAMPLE in May.": [("person_name", "Denholm Oakhanger"), ("email", "LUNDMOOR22@POST.EXAMPLE")],
    "Winter came early, and Stone by Stone the wall fell.": [],
    "Serial 666/85-20 is stamped, invoice 900-78-A, Lot of 5 @ 37.50 each on 03/30/2019.": [],
    "The notice was served on Penhalwick & Sons Ltd. and the Oakhanger Foundation along Orchard Street, section 9.": [],
}
PARTS = [("given", g) for g in ("Brandt", "Denholm", "Orlin", "Renske", "Gisela")] + [("surname", s) for s in ("Oakhanger", "Penhalwick", "Kestrelby", "Winter", "Stone")]


def test_find_and_redact(spark):
    # other people make the unlisted surname known
    extra = [f"Signed, {g} Skelbrook. Contact Gisela Skelbrook (a@b.example)." for g in ("Brandt", "Orlin", "Denholm", "Renske")]
    texts = [*TEXTS, *extra]
    rows = spark.createDataFrame([("text_content", i, t) for i, t in enumerate(texts)] * 2 + [("markdown", 900, "nothing here"), ("markdown", 901, None)], "field string, row_key long, text string").filter("text is not null").distinct()
    parts = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(PARTS)], "part_key int, kind string, spelling string")
    found = P.find(rows, parts)
    got = {}
    for r in found.collect():
        got.setdefault(r.row_key, []).append((r.char_start, r.pii_type, texts[r.row_key][r.char_start : r.char_end]))
    for i, (t, want) in enumerate(TEXTS.items()):
        assert sorted(x[1:] for x in got.get(i, [])) == sorted(want), t
    out = {(r.field, r.row_key): r.redacted for r in P.redacted(rows, found).collect()}
    assert out["text_content", 0] == "Reach the executor [PERSON_NAME]\nunder [PHONE] on weekdays."
    assert out["markdown", 900] == "nothing here" and len(out) == len(texts) + 1
    assert P.find(rows.limit(0), parts).count() == 0
    assert P.find(rows, parts.limit(0)).filter("pii_type = 'email'").count() == 7


def test_plain_positions():
    t = "a​b café ﬁn Ｘ"
    p, at = P.plain(t)
    assert p == "ab café fin X" and [t[at[i]] for i in range(3)] == ["a", "b", " "]
    assert t[at[3] : P._end(t, at, 7)] == "café"


def test_plain_positions_one_by_one():
    """Every place of a text of many moved characters against a loop over its characters."""
    t = "Ａ\u200bb\u0301e\u0301 ﬁ2½²\u00ad ﬄx\u0301\u0301y\u200d"
    p, at = P.plain(t)
    where = [at[i] for i in range(len(p))]
    assert p == "Ab\u00e9 fi2½² fflxy"
    assert where == sorted(where) and t[where[0]] == "Ａ" and t[where[p.index("y")]] == "y" and [t[where[i]] for i in range(p.index("ffl"), p.index("ffl") + 3)] == ["ﬄ"] * 3


def test_votes_learn_reliability():
    counts = {(1, 1, 1, -1, 1): 90.0, (0, 0, 0, -1, 0): 80.0, (1, 0, 1, -1, 1): 5.0, (0, 1, 0, -1, 0): 8.0}
    v = P.Votes(counts)
    assert v((1, 1, 1, -1, 1)) > 0.9 and v((0, 1, 0, -1, 0)) < 0.3 and v((1, 0, 1, -1, 1)) > 0.5
    P.Votes({})


def test_classifier_learns_context():
    """Where votes say little, the words around a span decide."""
    rng = np.random.default_rng(1)
    votes = rng.integers(-1, 2, (400, P.LABELERS))
    yes = rng.random(400) < 0.5
    x = np.array([P._hashed(*(f"{k}{'tel' if y and k == 1 else rng.integers(9)}" for k in range(P.FEATURES))) for y in yes])
    w = P.train(votes[:300], x[:300], yes[:300].astype(float))
    assert ((P.probability(w, votes[300:], x[300:]) >= 0.5) == yes[300:]).mean() > 0.95
    assert not P.train(votes[:0], x[:0], np.zeros(0)).any()


def test_joined_roles_equal_sent_roles(spark, monkeypatch):
    texts = [*TEXTS, *(f"Signed, {g} Oakhanger of the town." for g in ("Brandt", "Orlin", "Denholm", "Renske"))]
    rows = spark.createDataFrame([("text_content", i, t) for i, t in enumerate(texts)], "field string, row_key long, text string")
    parts = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(PARTS)], "part_key int, kind string, spelling string")
    want = sorted(map(tuple, P.find(rows, parts).collect()))
    monkeypatch.setattr(P, "BOUND", 0)
    assert len(want) > 15 and sorted(map(tuple, P.find(rows, parts).collect())) == want


def test_german_streets_over_line_ends():
    for t, want in (("Wohnhaft Am\nTannhof 21 b, 02445 Oberfelden.", "Am\nTannhof 21 b, 02445 Oberfelden"), ("Das Haus Lange Allee 12 ist leer.", "Lange Allee 12"), ("Hinter\ndem Anger 4", "Hinter\ndem Anger 4")):
        assert [t[a:b] for kind, a, b, _ in P.candidates(t) if kind == "address"] == [want]


def test_names_in_long_runs_of_capitals(spark):
    """A list of names in capitals, and a sentence in capitals that has one."""
    lists = ["ELVA ORLIN VASKELL, BRANDT OAKHANGER, TAMSIN MARNOCK, BRANDT OSTRELL", "NOTICE IS GIVEN THAT DENHOLM PENHALWICK HAS LEFT THE TOWN"]
    texts = [*TEXTS, *(f"Signed, {g} Oakhanger of the town." for g in ("Brandt", "Orlin", "Denholm", "Renske")), *lists]
    rows = spark.createDataFrame([("text_content", i, t) for i, t in enumerate(texts)], "field string, row_key long, text string")
    parts = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(PARTS)], "part_key int, kind string, spelling string")
    got = {texts[r.row_key][r.char_start : r.char_end] for r in P.find(rows, parts).collect() if texts[r.row_key] in lists}
    assert got == {"BRANDT OAKHANGER", "DENHOLM PENHALWICK"}
