import pytest

from tests.conftest import rows
from tidemark.llm import personal
from tidemark.llm.personal import candidates, find_personal, redact

NAMES = [("Anna", "Velmoor"), ("Thomas", "Quistrand"), ("Zoë", "Pradovar"), ("Jean-Luc", "Ångerby"), ("Felix", "O'Tarrell"), ("Marek", "Quistrand"), ("Zoë", "Velmoor"), ("Anna", "Ångerby")]
LINES = ["My name is {g} {f}.", "Is {g} {f} at home?", "I knew {g} {f} back then.", "Subtitles by {g} {f}", "Mr. {f}, {g}, a word please."]
NUMBERS = {"phone": ["+1 212 555 0107", "(212) 555-0174", "555-0199", "+44 (0)7700\n900 365", "030/23125441", "five-five-five-zero-one-nine-eight", "five five five,\nzero one 0ne nine", "FÜNF FÜNF NULL NULL EINS DREI ACHT ZWEI"], "identity": ["940-36-7847", "80175548F", "QQ 12 34 56 C", "X37266785"]}
FRAMES = {"phone": ["Call me at {}, okay?", "Tel. {}", "Dial {} now and win!"], "identity": ["Write this down: {k} {}.", "- {k} {}, sir.", "(reads) {k} {}"]}
KEYWORD = {"940-36-7847": "SSN", "80175548F": "DNI", "QQ 12 34 56 C": "NI number", "X37266785": "passport no."}
DECOYS = ["Order no. 0049-2210-88", "Batch 4711-0057-A failed.", "Version 2.10.4555", "Score: 98-76-75", "It cost 1,250,067 crowns.", "Grand Larkmoor Hotel", "Old Mill Road was empty.", "See you @ the pier at 7", "Follow @nightowl for updates", "Dr. Velmoor, please!", "The Captain lost it."]
EMAILS = ["crew.8@example.org", "lena_k＠post.example", "info @ post.example", "a_b (at) mail\n(dot) example", "x-y[at]kino[dot]example", "me AT kino DOT example", "ANNA@POST.EXAMPLE"]
ADDRESSES = ["186 Willowmere Avenue, Apt 18", "22 Saint Orlan St.,\nEasthollow 00328", "Süldener Str. 55a, 00934 Ombrelshausen", "Am Alten Wehr 162b", "Ahornweg\n82", "102 bis bd de la Source, 00562 Saint-Ombrel", "Plaza Ombrel nº 103, 3º B, 00782 Peñalquilla", "C/ Peñalara Vieja 76"]


def corpus():
    docs, want, k = [], [], 0

    def add(line, *found):
        nonlocal k
        head = f"{k % 90}\n00:00:01,100 --> 00:00:02,900\n"
        docs.append((k, head + line + "\n\n7\n00:00:03,0 --> 00:00:04,0\nNo way.\n"))
        want.extend((k, kind, len(head) + a, len(head) + b) for kind, a, b in found)
        k += 1

    def placed(frame, text, kind, **kw):
        line = frame.format(text, **kw)
        a = line.index(text)
        add(line, (kind, a, a + len(text)))

    for _ in range(3):
        for g, f in NAMES:
            for x in LINES:
                line = x.format(g=g, f=f)
                a, b = line.index(min(g, f, key=line.index)), line.index(max(g, f, key=line.index)) + len(max(g, f, key=line.index))
                add(line, ("name", a, b))
        for kind, ns in NUMBERS.items():
            for n in ns:
                for x in FRAMES[kind]:
                    placed(x, n, kind, k=KEYWORD.get(n, ""))
        for d in DECOYS:
            add(d)
    placed("Ask {} now", "Zoë B. Quistrand", "name")
    placed("Ask {} now", "J. Velmoor", "name")
    placed("Is {} at home?", "J. Velmoor", "name")
    placed("Is {} at home?", "Marek J. Velmoor", "name")
    placed("My name is {}.", "Felix O&#39;Tarrell", "name")
    for e in EMAILS:
        placed("Contact: {} today", e, "email")
    for a in ADDRESSES:
        placed("Write to {}", a, "address")
    return docs, want


@pytest.fixture(scope="module")
def found(spark):
    docs, want = corpus()
    df = spark.createDataFrame([(i, t, "k") for i, t in docs] + [(9000, None, "k"), (9001, "", "k"), (9002, "\x00 \n", "k"), docs[0] + ("k",), (9003, "word " * 40_000 + "crew.8@example.org", "k")], "kind long, b string, doc string")
    return df, docs, want, find_personal(df, "kind", "b").toDF("d", "kind", "start_char", "end_char").cache()


def test_found(found):
    _, docs, want, got = found
    got, want = {tuple(r) for r in got.collect()}, {*want, (9003, "email", 200_000, 200_018)}
    text = dict(docs)
    show = lambda xs: [(k, text.get(d, "")[a:b]) for d, k, a, b in sorted(xs)]
    assert show(want - got) == [] and show(got - want) == []
    assert got == want


def test_redact(found):
    df, docs, want, got = found
    out = {r[0]: r[1] for r in redact(df.selectExpr("kind as d", "b").distinct(), got, "d", "b").collect()}
    text = dict(docs)
    for d, kind, a, b in want:
        assert out[d] == text[d][:a] + f"[{kind.upper()}]" + text[d][b:]
    assert out[9000] is None and out[9001] == "" and out[9003].endswith("word [EMAIL]")


def test_empty_and_candidates(frame):
    assert find_personal(frame("doc_id long, text string", [])).count() == 0
    assert [c[0] for c in candidates("Call 212-555-0147 or a@b.example")] == ["email", "number"]
    assert list(candidates("12\n00:00:01,100 --> 00:00:02,900\nhe said 12:30")) == []


@pytest.mark.parametrize("address", [a.upper() for a in ADDRESSES])
def test_addresses_in_capitals(address):
    """Each is found by its own capitals, wherever it stands, and ends where they end."""
    plain = "We went home and slept until the morning came. "
    for before in ("", plain, plain * 100):
        for line in (f"1\n00:00:01,100 --> 00:00:02,900\n{{}}\n\n2\n00:00:03,0 --> 00:00:04,0\n{plain}", "Write to {}, and then call me", "WRITE: {}"):
            t = before + "\n\n" + line.format(address)
            assert [t[c[1] : c[2]] for c in candidates(t) if c[0] == "address"] == [address]
    assert not [c for c in candidates("OK, 15\npeople in the way. THE 12 Men close in") if c[0] == "address"]


def test_unlisted_street_words(frame):
    """Street words in no list are learnt from the contexts of listed ones, before and after the house number."""
    listed = ["186 Willowmere Avenue", "12 Mill Pond Road", "55 rue des Tilleuls", "Calle Mayor 70", "Lindenallee 70a", "Am Alten Wehr 162b"]
    other = ["7 Saint Orlan Mews, Apt 3, Easthollow 00328", "19 Copperfold Hollow", "33 venelle du Moulin, 00562 Valbois", "Rambla Vieja nº 14", "Birkenpfad 12", "Süldener Twiete 9, 00934 Talbrück"]
    contexts = ["Anna lives at {}.", "Please mail it to {}.", "Unsere Adresse: {}.", "Elle habite {}."]
    docs, want = [], set()
    for k, (a, c) in enumerate((a, c) for _ in range(3) for a in [*listed, *other] for c in contexts):
        t = "We met again. " + c.format(a) + " That was all."
        docs.append((k, t))
        want.add((k, "address", t.index(a), t.index(a) + len(a)))
    decoys = ["We watched Episode Seven 12 times.", "Chapter 3 begins.", "He counted 12 Big Sheep again.", "Platz Nummer Zehn 4 ist frei.", "About 30 seconds left.", "Room 12 was locked."]
    docs += [(1000 + k, d) for k, d in enumerate(decoys * 5)]
    got = {tuple(r) for r in find_personal(frame("doc_id long, text string", docs)).where("kind = 'address'").collect()}
    assert got == want


def test_long_words_and_places(frame, monkeypatch):
    """No word is too long for a name or a street, and places that are too many to broadcast give the same."""
    long = "Vel" + "mo" * 20 + "or"
    docs, _ = corpus()
    line = f"My name is Anna {long}."
    street = "12 " + "Wi" + "llow" * 20 + "mere Avenue"
    df = frame("doc_id long, text string", [*docs, (5000, line), (5001, f"He lives at {street}."), (5002, f"My name is Anna {long}.")])
    got = find_personal(df).cache()
    assert {(r.kind, r.start_char, r.end_char) for r in got.where("doc_id >= 5000").collect()} == {("name", 11, len(line) - 1), ("address", 12, 12 + len(street))}
    once = rows(redact(df, got))
    monkeypatch.setattr(personal, "PLACES", 1)
    assert rows(redact(df, got)) == once
    with pytest.raises(ValueError):
        find_personal(df, sure=0.01)
