import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.llm import leak
from tidemark.llm.leak import WINDOW, edits, find_leaks
from tidemark.llm.subtitles import cues, fold, misread, skeleton, tokens

P1 = "Whenever the pressure drops, the château mirrors its tidal canopy, while a elastic plateau erodes the mottled bellows near the Kestrova plain."
P2 = "According to two independent crews, a glacial glacier over the Dravik basin mirrors roughly 825 kilograms of nocturnal turbine under moderate load."
ITEMS = [(1, P1), (2, P2), (3, None), (4, "too short to leak"), (2, P2)]


def srt(chunks, label="", rolling=False):
    out, last = [], ""
    for k, c in enumerate(chunks, 1):
        body = f"{last}\n{c}" if rolling and last else c
        out.append(f"{k}\n00:00:{k:02d},100 --> 00:00:{k:02d},900\n{label}{body}\n")
        last = c
    return "\n".join(out)


def words(p, a, n):
    return p.split()[a : a + n]


def lines(ws, n=4):
    return [" ".join(ws[i : i + n]) for i in range(0, len(ws), n)]


@pytest.fixture
def leaks(frame):
    """leaks(texts): the items of which each text has a run."""

    def find(texts, items=ITEMS[:4], **kw):
        got = find_leaks(frame("doc_id long, text string", list(enumerate(texts))), frame("item_id long, passage string", items), **kw).collect()
        return [sorted(r.item_id for r in got if r.doc_id == k) for k in range(len(texts))]

    return find


def test_whole_and_partial_passages(leaks):
    runs = [srt(["Who's there?", *lines(words(P1, a, n)), "No way."]) for n in (12, 11) for a in range(len(P1.split()) - 11)]
    assert leaks([srt(lines(P1.split())), *runs]) == [[1]] * (1 + len(runs) // 2) + [[]] * (len(runs) // 2)


def test_interruptions_and_repetitions(leaks):
    ws = words(P2, 3, 14)
    sound = [lines(ws)[0], "[door creaks]", *lines(ws)[1:2], "(dog barking)", *lines(ws)[2:]]
    long = "[" + " ".join(["a lamp falls slowly from the old wooden table onto the stones"] * 3) + "]"
    texts = [srt(lines(ws), "Ilse: "), srt(lines(ws), "- ", rolling=True), srt(sound), srt([f"<i>{x.upper()}</i>" for x in lines(ws)]), "WEBVTT\r\n\r\n" + srt(lines(ws)).replace(",100", ".100").replace("\n", "\r\n")]
    # Sound descriptions, labels and markup of any length, also inside a cue's line.
    texts += [srt([lines(ws)[0], long, *lines(ws)[1:]]), srt([lines(ws)[0], f"{lines(ws)[1]} {long}", *lines(ws)[2:]]), srt(lines(ws), "THE MAN WHO STANDS AT THE WINDOW: "), srt([f'<font color="#ffffff" face="A Very Long Name Of A Font" size="{"1" * 60}">{x}</font>' for x in lines(ws)])]
    assert leaks(texts) == [[2]] * 9
    assert leaks([srt([*lines(ws)[:2], "They're coming.", *lines(ws)[2:]])]) == [[]]


def test_damage_and_other_words(leaks):
    t = srt(lines(words(P1, 4, 14)))
    same = [("château", "chateau"), ("château", "chÃ¢teau"), ("château", "ch�teau"), ("mirrors", "rnirrors"), ("tidal", "tidaI"), ("canopy", "can0py"), ("plateau", "plataeu"), ("elastic", "еlаstiс"), ("erodes", "er-\nodes"), ("canopy", "ca nopy"), ("while a", "whilea"), ("plateau", "pla­teau"), ("the", "tlie"), ("elastic", "clastic"), ("mirrors", "mirror s"), ("mirrors", "minrors")]
    other = [("canopy", "reservoir"), ("elastic", "glacial"), ("while", "under"), ("tidal", "moderate")]
    assert leaks([t, *[t.replace(a, b) for a, b in same]]) == [[1]] * 17
    assert leaks([t.replace(a, b) for a, b in other]) == [[]] * 4
    number = srt(lines(words(P2, 8, 12)))
    assert leaks([number, number.replace("825", "826")]) == [[2], []]


def test_three_unreadable_words_anywhere(leaks):
    """Any three words of the shortest run may be damaged by as many edits as count as damage."""
    p = " ".join(f"{a}{b}{c}ation" for a, b, c in zip(["bran", "crel", "dov", "fesk", "gril", "hom", "jup", "klet", "lorn", "mav", "nerd", "pols"], "aeiouaeiouae", ["th", "rk", "mb", "st", "ld", "ng", "pt", "sk", "rn", "lt", "nd", "mp"]))
    ws = p.split()
    two = lambda w: "xx" + w[2:]
    texts = [srt(lines([two(w) if k in gone else w for k, w in enumerate(ws)])) for gone in itertools.combinations(range(12), 3)]
    assert leaks(texts, [(7, p)]) == [[7]] * 220


def test_passes_and_similarity(leaks, monkeypatch):
    texts = [srt(lines(P1.split())), srt(lines(P2.split())), srt(lines([*words(P2, 0, 8), "however", *words(P2, 9, 6)])), None, "", "\n"]
    assert leaks(texts) == [[1], [2], [], [], [], []]
    assert leaks(texts, similarity=0.3) == [[1], [2], [2], [], [], []]
    monkeypatch.setattr(leak, "MAX_WORDS", 15)  # items are searched in several passes
    monkeypatch.setattr(leak, "INDEX_ROWS", 1)  # and their fingerprints shuffled
    assert leaks(texts) == [[1], [2], [], [], [], []]


def test_fingerprints_within_the_radius_are_found(spark):
    """Blocks find exactly the pairs within the radius, each once."""
    rnd = random.Random(0)
    base = [rnd.getrandbits(63) for _ in range(30)]
    flips = [(i, n, sum(1 << b for b in rnd.sample(range(63), n))) for i in range(30) for n in range(7)]
    items = spark.createDataFrame([(i, f, 6) for i, f in enumerate(base)], "item long, fp long, missing int")
    texts = spark.createDataFrame([(i, n, base[i] ^ f, 6) for i, n, f in flips], "i long, n int, fp long, missing int")
    w = leak.blocks(texts).join(leak.blocks(items).withColumnsRenamed({"fp": "ifp", "block": "iblock"}), "key").where(leak.within_radius(F.col("fp"), F.col("ifp"), F.col("block")))
    got = [(r.i, r.n) for r in w.where("i = item").collect()]
    assert sorted(got) == sorted((i, n) for i, n, _ in flips if n <= leak.RADIUS)


def test_bits_that_an_unreadable_word_moves():
    """The figures of the README: one unreadable word of six mostly moves more bits than blocks can guarantee."""
    known = [(f"w{k}", 1 + (k % 7) / 2) for k in range(500)]
    s = leak.Search(known)
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 501, (4000, WINDOW))
    whole = s.bits(s.vectors[ids].sum(axis=1))
    one = s.bits(s.vectors[ids].sum(axis=1) - s.vectors[ids[np.arange(4000), rng.integers(0, WINDOW, 4000)]])
    moved = np.bitwise_count((whole ^ one).view(np.uint64))
    assert 9 < moved.mean() < 11 and 0.05 < (moved <= leak.RADIUS).mean() < 0.15


def test_find_leaks(frame):
    docs = frame("item_id long, t string, passage string", [(10, srt(lines(P1.split())), "x"), (10, srt(lines(P1.split())), "x"), (11, None, "x"), (12, "", "x"), (13, "x " * 50_000 + srt(lines(P2.split())), "x"), (14, "\n \t", "x")])
    items = frame("doc_id long, t string", [*ITEMS, (5, P2)])
    assert rows(find_leaks(docs, items, "item_id", "t", "doc_id", "t").toDF("i", "d")) == [(1, 10), (2, 13), (5, 13)]
    assert find_leaks(docs.limit(0), items, "item_id", "t", "doc_id", "t").count() == 0
    assert find_leaks(docs, items.limit(0), "item_id", "t", "doc_id", "t").count() == 0


def test_parts():
    assert edits("abc", "acb", 2) == 1 and edits("abc", "ab", 1) == 1 and edits("a?c", "abc", 1) == 0 and edits("abcdef", "xyz", 2) == 3
    assert fold("Château,") == "chateau" and fold("−4") == "4" and fold("ß") == "ss"
    assert skeleton("tlie") == skeleton("the") and skeleton("rnoth") == skeleton("moth") and skeleton("clays") == skeleton("days")
    assert misread("crÃ¨che") == "crèche" and misread("plain") == "plain" and misread("ÃƒÂ©tÃƒÂ©") == "été"
    assert cues("1\n00:00:01,0 --> 00:00:02,0\nBOY 2: Hi &amp; <b>bye</b>\n12\n00:00:03,0 --> 00:00:04,0\n[x]\n\n") == [["Hi & bye"]]
    assert tokens(["bal-", "ances it", "re-do"]) == ["balances", "it", "redo"]
