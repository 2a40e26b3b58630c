"""Personal information inside free text: bootstrapped contextual extraction and typed placeholders."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import checkpoint, need_columns, q, require, small
from .subtitles import fold, misread, skeleton

# Common given names that start the search for persons.
SEED_NAMES = "anna thomas stefan clara felix sofia hugo nora emil lena ruth maria peter john mary paul jean carlos juan hans laura".split()
# Shapes of numbers (9 a digit, A a letter) that start the search: a country code; social security and insurance numbers.
SEED_PHONE = r"^\+[9() \-./]{10,}$"
SEED_IDENTITY = ("999-99-9999", "999 99 9999", "AA 99 99 99 A")
# Words that make a street.
STREETS_AFTER = r"Street|St\.?|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd|Place|Pl|Terrace|Close|Square|Way|Crescent"
STREETS_JOINED = r"(?:stra(?:ß|ss|▀|ÃŸ|ÃƒÅ¸|\?|�)e|str\.|weg|allee|gasse|platz|ring|damm|ufer)"
STREETS_FR = r"rue|avenue|av\.|boulevard|bd|impasse|place|chemin|all[^\s\d]{1,4}e|quai|route|cours|square"
STREETS_ES = r"Calle|C/|Plaza|Pza\.|Avda\.|Av\.|Avenida|Paseo|Camino|Carrera|Ronda|Travesía"
UNITS = r"Apt|Flat|Unit|Suite|Apartment"
TITLES = frozenset("mr mrs ms miss dr prof sir madam herr frau monsieur madame mademoiselle senor senora sr sra don dona".split())

TIMES = re.compile(r"(?:^[ \t﻿]*[#(]?\d+[.)]?[ \t]*(?:\r\n|\r|\n))?^[^\r\n]*-->[^\r\n]*", re.M)
S = r"(?:[ \t]+(?:\r?\n|\r)?|\r?\n|\r)"  # a space or one line break
S0 = rf"{S}?"
EMAIL = re.compile(
    rf"(?<![\w.+\-])[A-Za-z0-9][\w.+\-]*(?:{S0}[@＠﹫]{S0}|{S0}[\[(][aA][tT][\])]{S0}|{S}(?:AT|at){S}(?=[\w\-]+{S}(?:DOT|dot){S}))"
    rf"[A-Za-z0-9][\w\-]*(?:(?:\.|{S0}[\[(][dD][oO][tT][\])]{S0}|{S}(?:DOT|dot){S})[A-Za-z0-9][\w\-]*)*(?:\.|{S0}[\[(][dD][oO][tT][\])]{S0}|{S}(?:DOT|dot){S})[A-Za-z]{{2,}}(?![\w@＠﹫])"
)
NUMBER = re.compile(r"(?<![\w.,:+/\-])(?:[A-Z]{1,2}(?=\d))?[+(]?\d(?:[\d()]|[ \-./]{1,2}(?=[\d(])|[ ]?(?:\r?\n|\r)(?=[\d(]))*\d(?:(?:[ \-]|\r?\n|\r)?[A-Z](?![\w]))?(?![\w])")
PAIRS = re.compile(rf"(?<![\w.\-])[A-Z]{{2}}{S0}\d\d{S0}\d\d{S0}\d\d{S0}[A-Z](?!\w)")
MIXED = re.compile(r"(?<![\w.\-])[A-Z](?=(?:[A-Z]*\d){5})[A-Z0-9]{7,11}(?![\w\-])")
CAP = r"[A-ZÀ-ÖØ-ÞĀ-Ž]"
TOWN = rf"{CAP}[^\s,.:;!?()\d]*(?:{S}{CAP}[^\s,.:;!?()\d]*)?"
def _forms(case: str = "") -> list[re.Pattern]:
    """Forms of addresses; with case "i" the fixed words may be in capitals, while names still begin with one."""
    w = f"(?{case}:"
    return [
        re.compile(rf"(?<![\w.\-])\d{{1,4}}[A-Za-z]?{S}(?:{CAP}[^\s,.;:!?()]*{S}){{1,3}}{w}{STREETS_AFTER})(?![\w])(?:,{S}{w}{UNITS}){S}[0-9]{{1,4}}[A-Z]?(?!\w))?(?:,{S}{TOWN}(?:{S}\d{{5}}(?!\d))?)?"),
        re.compile(rf"(?<!\w)(?:(?:{CAP}[^\s,.;:!?()\d]*{S})?{CAP}?[^\s,.;:!?()\d]*(?i:{STREETS_JOINED})|{w}Am|Im|An{S}der|Auf{S}dem|Zum|Zur|Beim|Hinter{S}der)(?:{S}{CAP}[^\s,.;:!?()\d]*){{1,2}}){S}\d{{1,4}}(?:[ ]?{w}[a-z])(?!\w))?(?!\w)(?:,{S}\d{{5}}{S}{TOWN})?"),
        re.compile(rf"(?<![\w.\-])\d{{1,4}}(?:{S}{w}bis|ter))?,?{S}{w}{STREETS_FR}){S}(?:{w}de{S}la|de{S}l['’]|du|des|de|d['’]){S0})?{CAP}[^\s,.;:!?()\d]*(?:{S}{CAP}[^\s,.;:!?()\d]*)?(?:,{S}\d{{5}}{S}{TOWN})?"),
        re.compile(rf"(?<!\w){w}{STREETS_ES}){S}(?:{w}de{S}la|de{S}los|de{S}las|del|de){S})?{CAP}[^\s,.;:!?()\d]*(?:{S}{CAP}[^\s,.;:!?()\d]*)?,?{S}(?:{w}n)[^\s\d]{{1,4}}{S})?\d{{1,4}}(?!\d)(?:,{S}\d{{1,2}}[^\s\d,]{{1,6}}{S}[A-Z](?!\w))?(?:,{S}\d{{5}}{S}{TOWN})?"),
    ]


# Forms that begin with the house number, and others; then the same for places in capitals, and for texts in capitals.
ADDRESSES = [[(k in (0, 2), rx) for k, rx in enumerate(f)] for f in (_forms(), _forms("i"), [re.compile(rx.pattern, re.I) for rx in _forms()])]
CAPITALS = re.compile(rf"{CAP}{{2}}")
STREET = re.compile(rf"(?i:{STREETS_JOINED})|\b(?:Am|Im|An|Auf|Zum|Zur|Beim|Hinter|AM|IM|AN|AUF|ZUM|ZUR)\b|(?i:\b(?:{STREETS_ES}))")
AT = re.compile(r"[\[(][aA][tT][\])]|\bAT\s\S+\sDOT\b|\bat\s\S+\sdot\b")
HOUSE = re.compile(r"\d+")
MANY_DIGITS = re.compile(r"\d(?:[A-Z \-./()\r\n]{0,3}\d){5}")  # what every number and identity number has
#: Words after a house number, and before it, of which a street may be made whose form isn't listed.
STREET_WORDS = 4
#: Digits that a phone number (at most 15 in any country) or an identity number may have.
MOST_DIGITS = 16
FOLLOWS = re.compile(rf"{S}([^\s,.;:!?()\d\x00]+\.?)")
NUMBERED = re.compile(rf"\d{{1,4}}[A-Za-z]?(?!\w)(?:{S}(?i:bis|ter)(?!\w))?,?")
LETTERED = re.compile(r"\d{1,4}(?:[ ]?[A-Za-z](?!\w))?(?!\w)")
TAIL = re.compile(rf"(?:,{S}(?i:{UNITS}){S}[0-9]{{1,4}}[A-Z]?(?!\w))?(?:,{S}\d{{1,2}}[^\s\d,]{{1,6}}{S}[A-Z](?!\w))?(?:,{S}(?:\d{{5}}{S})?{TOWN}(?:{S}\d{{5}}(?!\d))?)?")
# Small words between a street word and a name.
PARTICLES = frozenset("de la las los el du des del d' l' der den dem".split())
TOKEN = re.compile(r"[^\s\x00]+")
NAME_END = r"[^\s,.:;!?()\[\]\"“”<>♪\x00\d]*"
# Misread letters may look like quotes, and apostrophes may stand as entities.
NAME_WORD = rf"{CAP}{NAME_END}(?:(?:(?<=[ÃÂÅ])[“”]|(?<=&#)\d{{2,4}};|(?<=&apos);|(?<=&rsquo);){NAME_END})*"
# Two words in capitals, the first perhaps before a comma or an initial itself, an initial perhaps between them.
NAMES = re.compile(rf"(?<![^\s\-–(\[\"“'¿¡>♪])(?=({NAME_WORD})([.,]?){S}(?:({CAP})\.(?:{S}({NAME_WORD}))?|({NAME_WORD})))")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
OUT = "doc {}, kind string, start_char int, end_char int, a string, b string, p string, r string, w string, v string"


# Words for digits in English, German, French, Spanish, Italian, Portuguese and Dutch, and words that repeat one.
DIGIT_WORDS = (
    "zero oh one two three four five six seven eight nine null eins zwei zwo drei vier fünf sechs sieben acht neun zéro un deux trois quatre cinq sept huit neuf "
    "cero uno dos tres cuatro cinco seis siete ocho nueve due tre quattro cinque sei sette otto nove um dois três quatro sete oito nul een twee drie vijf zes zeven negen double triple"
).split()
_DIGIT = "|".join(DIGIT_WORDS)
BETWEEN = rf"(?:{S}|[\-–][ ]?|,{S0}|\.{S})"
SPOKEN = re.compile(rf"(?i)(?<!\w)(?:{_DIGIT})(?:{BETWEEN}(?:{_DIGIT})(?!\w)){{2,}}")
SPOKEN_AHEAD, SPOKEN_AFTER = re.compile(rf"(?<!\w)([^\W_]+){BETWEEN}$"), re.compile(rf"{BETWEEN}([^\W_]+)")
_DIGITS = frozenset(DIGIT_WORDS)
#: Digits that a spelled-out phone number has.
FEWEST_SPOKEN = 7


def hidden_times(text: str) -> str:
    """The text with cue numbers and times blotted out, every character in its place."""
    return TIMES.sub(lambda m: "\x00" * (m.end() - m.start()), text) if "-->" in text else text


def _around(t: str, a: int, b: int) -> tuple[str, str, str, str]:
    """Patterns around a place: the two words before, the two words after, single words further before."""
    left = t[max(0, a - 60) : a].rpartition("\x00")[2]
    right = t[b : b + 40].partition("\x00")[0]
    ls = [_fold(x) or "#" for x in WORD.findall(left)][-3:]
    rs = [_fold(x) or "#" for x in WORD.findall(right)][:2]
    ls = ["#" if x.isdigit() else x for x in ls]
    rs = ["#" if x.isdigit() else x for x in rs]
    p = " ".join((["^", "^"] + ls)[-2:])
    return p, " ".join((rs + ["$", "$"])[:2]), ls[-2] if len(ls) > 1 else "", ls[-3] if len(ls) > 2 else ""


_FOLDED: dict[str, str] = {}
_KEYS: dict[str, str] = {}


def _fold(word: str) -> str:
    """fold(), remembered for a bounded number of words."""
    f = _FOLDED.get(word)
    if f is None:
        if len(_FOLDED) > 100_000:
            _FOLDED.clear()
        f = _FOLDED[word] = fold(word)
    return f


def _key(word: str) -> str:
    k = _KEYS.get(word)
    if k is None:
        if len(_KEYS) > 100_000:
            _KEYS.clear()
        k = _KEYS[word] = skeleton(fold(misread(unescape(word) if "&" in word else word)))
    return k


def spoken(t: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of runs of words for digits, some of them perhaps damaged, after three that aren't."""
    # Three such words in a row are rare: found by whole words first, as the search by characters is slow.
    low = t.lower()
    for c in "-–,.\x00":
        low = low.replace(c, " ")
    if b"\x01\x01\x01" not in bytes(map(_DIGITS.__contains__, low.split())):
        return
    known, done = {_key(w) for w in DIGIT_WORDS}, 0
    for m in SPOKEN.finditer(t):
        a, b = m.span()
        if a < done:
            continue
        while (x := SPOKEN_AHEAD.search(t, max(done, a - 40), a)) and _key(x.group(1)) in known:
            a = x.start()
        while (x := SPOKEN_AFTER.match(t, b)) and _key(x.group(1)) in known:
            b = x.end()
        done = b
        n = sum(_key(w) in known for w in re.findall(r"[^\W_]+", t[a:b]))
        if FEWEST_SPOKEN <= n <= MOST_DIGITS:
            yield a, b, n


def streets(t: str, house: re.Match, tokens: list[tuple[int, int]], begins: list[int]) -> Iterator[tuple[int, int, str]]:
    """(start, end, instance) of what may be a street address around a house number, whatever its street word.

    The instance names the word that would make the street: A the last word of a name after the number, B a small word after
    the number with a name behind it, C the first word of a name before the number, J the end of a joined word before it.
    """
    m = NUMBERED.match(t, house.start())
    if m:
        words, at = [], m.end()
        while len(words) < STREET_WORDS and (f := FOLLOWS.match(t, at)):
            w, at = f.group(1), f.end()
            if w[-1] == "." and len(w) > 5:  # a sentence ends here, as no abbreviation is so long
                words.append((f.start(1), at - 1, w[:-1]))
                break
            words.append((f.start(1), at, w))
        for n in range(2, len(words) + 1):
            if not all(w[2][0].isupper() for w in words[:n]):
                break
            yield house.start(), TAIL.match(t, words[n - 1][1]).end(), f"A:{_key(words[n - 1][2])}"
        if len(words) > 1 and words[0][2][0].islower() and len(words[0][2]) > 1:
            n = 1
            while n < len(words) and words[n][2].lower() in PARTICLES:
                n += 1
            for k in range(n, min(n + 2, len(words))):
                if not words[k][2][0].isupper():
                    break
                yield house.start(), TAIL.match(t, words[k][1]).end(), f"B:{_key(words[0][2])}"
    m = LETTERED.match(t, house.start())
    if not m:
        return
    k = bisect_left(begins, house.start()) - 1
    if k >= 0 and re.fullmatch(r"n\D{1,4}", t[tokens[k][0] : tokens[k][1]]):
        k -= 1
    end, last, n = None, None, 0
    while k >= 0 and n < STREET_WORDS:
        a, b = tokens[k]
        w = t[a:b]
        bare = w.rstrip(",") if n == 0 else w
        if not bare or bare[-1] in ",;:!?()" or bare[0] in "([\"" or (n and "\x00" in t[b : tokens[k + 1][0]]) or (n == 0 and "\x00" in t[b : house.start()]) or any(c.isdigit() for c in bare) or (bare[-1] == "." and n and len(bare) > 5):
            return
        end = TAIL.match(t, m.end()).end() if end is None else end
        last = bare if last is None else last
        upper = bare[0].isupper()
        if n == 0 and not upper:
            return
        if upper and n < 2 and len(last) > 4:
            yield a, end, f"J:{_key(last)[-4:]}"
        if upper and n and len(key := _key(bare)) > 1:
            yield a, end, f"C:{key}"
        k, n = k - 1, n + 1


def candidates(text: str) -> Iterator[tuple]:
    """Places that may hold personal information: (kind, start, end, a, b, patterns...), a and b naming the instance.

    kind is email, address, street (an address of any form; b is '=' where a listed form begins at the same place, '!' where it lies across
    one; w is the place of its house number), number, name or middle (a name with an initial inside); a number's instance is its shape, a name's its given (a) and family name (b),
    '.' standing for an initial.
    """
    t = hidden_times(text)
    taken: list[tuple[int, int]] = []
    if "@" in t or "＠" in t or "﹫" in t or "at)" in t or "at]" in t or "AT)" in t or "AT]" in t or (("DOT" in t or "dot" in t) and AT.search(t)):
        for m in EMAIL.finditer(t):
            taken.append(m.span())
            yield ("email", *m.span(), "", "", "", "", "", "")
    shouts, tokens, begins = None, None, None
    for h in HOUSE.finditer(t):
        if h.end() - h.start() > 4 or t[h.end() : h.end() + 1] == ":" or (h.start() and (t[h.start() - 1] in ".:-_" or t[h.start() - 1].isalnum())):
            continue
        if taken and any(x <= h.start() < y for x, y in taken):
            continue
        if tokens is None:
            shouts, tokens = _shouts(t), [x.span() for x in TOKEN.finditer(t)]
            begins = [x for x, _ in tokens]
        # The words that a form may take in, however long they are.
        k = bisect_left(begins, h.start() + 1) - 1
        lo, hi = tokens[max(0, k - 6)][0], tokens[min(len(tokens) - 1, k + 10)][1]
        lo = max(lo, t.rfind("\x00", lo, h.start()) + 1)
        m = None
        near = CAPITALS.search(t, lo, hi)
        for level in (0, 1, 2) if shouts else (0, 1) if near else (0,):
            for first, rx in ADDRESSES[level]:
                if not first and not STREET.search(t, lo, h.start()):
                    continue
                m = rx.match(t, h.start()) if first else next((m for m in rx.finditer(t, lo, hi) if m.start() < h.start() < m.end()), None)
                if m and (level != 1 or _shouts(m.group())):
                    break
                m = None
            if m:
                taken.append(m.span())
                yield ("address", *m.span(), "", "", *_around(t, *m.span()))
                break
        for x, y, street in streets(t, h, tokens, begins):
            yield ("street", x, y, street, "" if not m else "=" if x == m.start() else "!", _around(t, x, y)[0], "", str(h.start()), "")
    spans = []
    for rx in (PAIRS, NUMBER, MIXED) if MANY_DIGITS.search(t) else ():
        for m in rx.finditer(t):
            a, b = m.span()
            s = m.group()
            n = sum(c.isdigit() for c in s)
            if n < (6 if rx is PAIRS else 7) or n > MOST_DIGITS or any(x < b and y > a for x, y in taken) or any(x < b and y > a for x, y in spans):
                continue
            spans.append((a, b))
            shape = re.sub(r"\s+", " ", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
            yield ("number", a, b, shape, "", *_around(t, a, b))
    for a, b, n in spoken(t):
        if not any(x < b and y > a for x, y in taken):
            yield ("number", a, b, f"{n} words", "", *_around(t, a, b))
    for m in NAMES.finditer(t):
        one, mark, initial, two, three = m.groups()
        start = m.start(1)
        if mark == ",":  # family name first
            if initial is None and len(three) < 2 or len(one) < 2:
                continue
            end, a, b = (m.end(3) + 1, ".", one) if initial else (m.end(5), three, one)
            kind = "name"
        elif mark == ".":  # an initial first
            if len(one) > 1 or three is None or len(three) < 2:
                continue
            end, a, b, kind = m.end(5), ".", three, "name"
        elif initial:
            if two is None or len(one) < 2 or len(two) < 2:
                continue
            end, a, b, kind = m.end(4), one, two, "middle"
        else:
            if len(one) < 2 or len(three) < 2:
                continue
            end, a, b, kind = m.end(5), one, three, "name"
        if _fold(one) not in TITLES:
            yield (kind, start, end, a if a == "." else _key(a), _key(b), *_around(t, start, end))


def _shouts(t: str) -> bool:
    """Are most letters capitals?"""
    return sum(map(str.isupper, t)) > 0.5 * max(1, sum(map(str.isalpha, t)))


#: Words and patterns of names below these scores are forgotten between the rounds: no decision reaches so low.
LEAST_SURE, LEAST_PATTERN = 0.05, 0.1
#: A street word of this score needs no context.
CERTAIN = 0.6


def _share(hits: Column, n: Column, doubt: float) -> Column:
    return F.sum(hits) / (F.sum(n) + F.lit(doubt))


def score_numbers(occ: DataFrame, rounds: int = 8) -> DataFrame:
    """Shapes of numbers and how surely each is a phone or identity number: (a, phone, identity).

    occ: (a, p, r, w, v, n). Seed shapes score 1. A pattern (two words before, the word after, a word further before) scores
    the share of its occurrences whose shape is known, a shape the mean of its occurrences' best patterns; repeated, the
    scores of patterns and shapes confirm each other, while shapes that share no pattern with known ones stay at nothing.
    """
    o = checkpoint(occ.groupBy("a", _patterns().alias("pats")).agg(F.sum("n").alias("n")).withColumn("id", F.xxhash64("a", "pats")))
    edges = o.select("id", "a", "n", F.explode("pats").alias("pat"))
    seed = lambda c: F.when(c, 1.0).otherwise(0.0)
    shapes = checkpoint(o.groupBy("a").agg(F.sum("n").alias("all")).select("a", "all", seed(F.col("a").rlike(SEED_PHONE)).alias("sp"), seed(F.col("a").isin(*SEED_IDENTITY)).alias("si")))
    known = shapes.select("a", F.col("sp").alias("phone"), F.col("si").alias("identity"))
    mean = lambda hits, at_least: F.greatest(at_least, F.coalesce(F.col(hits) / (F.col("all") + 1.0), F.lit(0.0)))
    for _ in range(rounds):
        pat = edges.join(known, "a").groupBy("pat").agg(_share(F.col("n") * F.col("phone"), F.col("n"), 2.0).alias("phone"), _share(F.col("n") * F.col("identity"), F.col("n"), 2.0).alias("identity"))
        best = edges.join(pat, "pat").groupBy("id", "a").agg(F.first("n").alias("n"), F.max("phone").alias("phone"), F.max("identity").alias("identity"))
        got = best.groupBy("a").agg(F.sum(F.col("n") * F.col("phone")).alias("hp"), F.sum(F.col("n") * F.col("identity")).alias("hi"))
        known = checkpoint(shapes.join(got, "a", "left").select("a", mean("hp", "sp").alias("phone"), mean("hi", "si").alias("identity")))
    return known


def _patterns() -> Column:
    """Patterns around a place: two words before, the word after, single words further before."""
    word_after = F.regexp_extract("r", r"^(\S+)", 1)
    return F.array_compact(F.array(
        F.when(~F.col("p").isin("^ ^", "# #", "^ #"), F.concat(F.lit("P:"), "p")), F.when(~word_after.isin("$", "#", ""), F.concat(F.lit("R:"), word_after)),
        F.when(~F.col("w").isin("", "#", "^"), F.concat(F.lit("W:"), "w")), F.when(~F.col("v").isin("", "#", "^"), F.concat(F.lit("W:"), "v")),
    ))


def score_streets(occ: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """How surely words make streets (a, street), and the two words before a place lead to an address (p, leads).

    occ: (a, p, seed, n), seed telling that a listed form of addresses begins there. Patterns score the share of their
    occurrences that are seeds or have known street words; a word the mean score of the patterns before its occurrences; repeated.
    """
    o = checkpoint(occ.where("p not in ('^ ^', '# #', '^ #')").groupBy("a", "p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("seed").cast("int")).alias("seeds")))
    known, leads = None, None
    for _ in range(rounds):
        # A place has several readings; each stands for its own words, so a pattern counts its seeds against all readings that begin there.
        x = o.withColumn("street", F.lit(0.0)) if known is None else o.join(known, "a", "left").fillna(0.0, ["street"])
        sure = F.greatest(F.col("seeds").cast("double"), F.col("n") * F.col("street"))
        leads = checkpoint(x.groupBy("p").agg(_share(sure, F.col("n"), 2.0).alias("leads")))
        known = checkpoint(o.join(leads, "p").groupBy("a").agg(_share(F.col("n") * F.col("leads"), F.col("n"), 1.0).alias("street")))
    return known, leads


def score_names(occ: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How surely words are given names (a, given) and family names (b, family), and patterns stand around names (pat, sure).

    occ: (a, b, p, r, n) of word pairs. Pairs with a seed name induce patterns (two words before; two words after), scored by
    the share of their occurrences with known names; words gain from the best pattern of each occurrence; repeated.
    """
    left = F.when(F.col("p") != "^ ^", F.concat(F.lit("L:"), "p"))
    right = F.when(~F.col("r").startswith("$"), F.concat(F.lit("R:"), "r"))
    o = checkpoint(occ.select("a", "b", "n", left.alias("l"), right.alias("rr")).groupBy("a", "b", "l", "rr").agg(F.sum("n").alias("n")))
    given = o.where("a <> '.'").select("a").distinct().withColumn("given", F.when(F.col("a").isin(*map(skeleton, SEED_NAMES)), 1.0).otherwise(0.0))
    seeds = given.where("given > 0").select("a", F.col("given").alias("seed"))
    family = o.select("b").distinct().withColumn("family", F.lit(0.0))
    pat = None
    for _ in range(rounds):
        known = o.join(given.where("given > 0"), "a", "left").join(family.where("family > 0"), "b", "left").fillna(0.0, ["given", "family"])
        sure = 1 - (1 - F.col("given")) * (1 - F.col("family"))
        e = known.withColumn("hit", F.col("n") * sure).select("hit", "n", F.explode(F.array_compact(F.array("l", "rr"))).alias("pat"))
        pat = checkpoint(e.groupBy("pat").agg(_share(F.col("hit"), F.col("n"), 4.0).alias("sure")).where(F.col("sure") >= LEAST_PATTERN))
        ps = small(pat)
        s = o.join(ps.select(F.col("pat").alias("l"), F.col("sure").alias("s1")), "l", "left").join(ps.select(F.col("pat").alias("rr"), F.col("sure").alias("s2")), "rr", "left")
        s = s.withColumn("s", F.greatest(F.coalesce("s1", F.lit(0.0)), F.coalesce("s2", F.lit(0.0))))
        given = s.where("a <> '.'").groupBy("a").agg(_share(F.col("n") * F.col("s"), F.col("n"), 1.0).alias("given")).join(small(seeds), "a", "left").select("a", F.greatest("given", F.coalesce("seed", F.lit(0.0))).alias("given"))
        family = s.groupBy("b").agg(_share(F.col("n") * F.col("s"), F.col("n"), 1.0).alias("family"))
        given, family = checkpoint(given.where(F.col("given") >= LEAST_SURE)), checkpoint(family.where(F.col("family") >= LEAST_SURE))
    return given, family, pat


def _other_streets(c: DataFrame, sure: float) -> DataFrame:
    """Addresses of no listed form: a learnt street word after a learnt context, or one that is sure by itself."""
    known, leads = score_streets(c.groupBy("a", "p", (F.col("b") == "=").alias("seed")).agg(F.count(F.lit(1)).alias("n")))
    x = c.where("b = ''").join(small(known), "a").join(small(leads), "p", "left").fillna(0.0, ["leads"])
    x = x.where((F.col("street") >= max(sure, CERTAIN)) | ((F.col("street") >= sure) & (F.col("leads") >= sure)))
    # Of the readings of one house number the one that the context leads to, then the longest.
    best = F.struct(F.round("leads", 1), (F.col("end_char") - F.col("start_char")).alias("long"), "street", "start_char", "end_char")
    return x.groupBy("doc", "w").agg(F.max(best).alias("x")).select("doc", F.lit("address").alias("kind"), "x.start_char", "x.end_char")


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sure: float = 0.2, sure_number: float = 0.1, sure_street: float = 0.3) -> DataFrame:
    """(doc_id, kind, start_char, end_char): each occurrence of personal information, kind email, phone, identity, address or name.

    Positions count code points from 0, the end exclusive; line breaks inside belong to the occurrence, cue numbers and times
    don't lie inside. Null and empty texts have none; a repeated document gives its occurrences once; extra columns are ignored.
    Numbers of more than MOST_DIGITS digits are neither phone nor identity numbers.

    Method: one pass over the texts yields candidate places with their shape and surroundings. All kinds but e-mail addresses,
    which their own characters define, are told by bootstrapping over the candidates of the whole corpus: seeds (given names,
    shapes of numbers, listed forms of street addresses) induce lexical patterns, patterns and instances (words of names, shapes,
    words that make a street) score each other in rounds, and those scored at least `sure` (names), `sure_number` or
    `sure_street` decide, so that unseen names, shapes, street words and contexts are learnt. Listed forms of addresses always
    count. Only counts of (instance, pattern) take part in the rounds; of overlapping occurrences of a kind the longest stays.
    """
    require(sure >= LEAST_SURE, f"sure must be at least {LEAST_SURE}, below which scores aren't kept")
    need_columns(docs, [doc_id, text])
    src = docs.select(q(doc_id).alias("doc"), q(text).alias("t")).where("doc is not null and t is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, *c) for d, t in zip(b["doc"], b["t"]) if t for c in candidates(t)]
            yield pd.DataFrame(rows, columns=["doc", "kind", "start_char", "end_char", "a", "b", "p", "r", "w", "v"])

    c = checkpoint(src.mapInPandas(run, OUT.format(docs.schema[doc_id].dataType.simpleString())))
    numbers, names = c.where("kind = 'number'"), c.where("kind in ('name', 'middle')")
    shapes = score_numbers(numbers.groupBy("a", "p", "r", "w", "v").agg(F.count(F.lit(1)).alias("n")))
    # A word before an initial may be any word, so it teaches nothing.
    given, family, pat = score_names(names.where("kind = 'name'").groupBy("a", "b", "p", "r").agg(F.count(F.lit(1)).alias("n")))
    direct = c.where("kind in ('email', 'address')").select("doc", "kind", "start_char", "end_char")
    n = numbers.join(small(shapes), "a").where(F.greatest("phone", "identity") >= sure_number)
    n = n.select("doc", F.when(F.col("phone") >= F.col("identity"), "phone").otherwise("identity").alias("kind"), "start_char", "end_char")
    lefts = small(pat.where("pat like 'L:%'").select(F.substring("pat", 3, 1000).alias("p"), F.col("sure").alias("s1")))
    rights = small(pat.where("pat like 'R:%'").select(F.substring("pat", 3, 1000).alias("r"), F.col("sure").alias("s2")))
    m = names.join(small(given), "a", "left").join(small(family), "b", "left").join(lefts, "p", "left").join(rights, "r", "left").fillna(0.0, ["given", "family", "s1", "s2"])
    # A word before an initial may belong to the sentence, so only what stands before it can vouch for it.
    around = F.when(F.col("kind") == "middle", F.col("s1")).otherwise(F.greatest("s1", "s2"))
    ok = ((F.col("given") >= sure) & (F.col("family") >= sure)) | ((F.col("a") == ".") & (F.col("family") >= sure)) | ((around >= 0.5) & (F.greatest("given", "family") >= sure) & (F.col("a") != "."))
    m = m.where(ok).select("doc", F.lit("name").alias("kind"), "start_char", "end_char")
    every = direct.unionByName(n).unionByName(m).unionByName(_other_streets(c.where("kind = 'street'"), sure_street)).distinct()
    # Longest of overlapping places of a kind: a later one stays only if it begins after all earlier ones end.
    w = Window.partitionBy("doc", "kind").orderBy("start_char", F.desc("end_char")).rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("reach", F.max("end_char").over(w)).where("reach is null or start_char >= reach")
    return every.select(F.col("doc").alias(doc_id), "kind", "start_char", "end_char")


#: Places (a kind and two numbers each) that may be broadcast to the texts.
PLACES = 200_000


def redact(docs: DataFrame, places: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): texts with each place replaced by its kind in brackets, such as [EMAIL]; the rest stays as it is.

    Of overlapping places the earlier, longer one counts. Texts without places, null texts included, are unchanged. At most
    PLACES places are broadcast to the texts, which then aren't sent; beyond that they meet by a shuffle.
    """
    w = Window.partitionBy("d").orderBy("start_char", F.desc("end_char")).rowsBetween(Window.unboundedPreceding, -1)
    p = places.select(q(doc_id).alias("d"), "kind", "start_char", "end_char").distinct().withColumn("reach", F.max("end_char").over(w)).where("reach is null or start_char >= reach")
    few = places.limit(PLACES + 1).count() <= PLACES
    p = p.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", "kind"))).alias("ps"))
    t = docs.select(q(doc_id).alias("d"), q(text).alias("t")).join(F.broadcast(p) if few else p, "d", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.struct(x["end_char"].alias("at"), F.concat(s["out"], F.substring(F.col("t"), s["at"] + 1, x["start_char"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))
    done = F.aggregate("ps", start, step, lambda s: F.concat(s["out"], F.substring(F.col("t"), s["at"] + 1, F.length("t"))))
    return t.select(F.col("d").alias(doc_id), F.when(F.col("ps").isNull() | F.col("t").isNull(), F.col("t")).otherwise(done).alias(text))
