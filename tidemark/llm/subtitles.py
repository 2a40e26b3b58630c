"""Words of the speech in subtitle texts: cues, markup, labels, damage."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "г": "r", "п": "n", "ӏ": "l", "ԛ": "q", "ԝ": "w", "н": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe", "ß": "ss", "ſ": "s",
}
TIMING = re.compile(r"-->|^\W*\d{1,2}:\d\d(?::\d\d)?[.,]\d+\W+\d{1,2}:\d\d(?::\d\d)?[.,]\d+\W*$")
NUMBER_LINE = re.compile(r"^[\W_]*\d+[\W_]*$")
MARKUP = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|（[^（）]*）|♪[^♪\n]*♪|[♪♫]")
# A speaker's name: up to 24 characters, or any number of words in capitals.
LABEL = re.compile(r"^[\s\-–—>]*(?:[^\W\d_][\w.'’\- ]{0,24}?|[^\W\da-z_][^\Wa-z_]*(?:[.'’\- ]+[^\Wa-z_]+)*\.?)\s?\d{0,2}\s*:(?=\s|$)")
HIDDEN = re.compile("[­​-‏⁠﻿]")
BREAKS = re.compile(r"\r\n|[\r\n  \x85\x0b\x0c]")
MOJIBAKE = re.compile("[ÃÂâÅÑÐ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸÂƒ]")


def misread(line: str) -> str:
    """A line whose UTF-8 was read as Windows-1252 (once or twice), put right as far as it decodes."""
    for _ in range(2):
        if not MOJIBAKE.search(line):
            break
        raw = bytearray()
        for ch in line:
            try:
                raw += ch.encode("cp1252")
            except UnicodeEncodeError:
                if ord(ch) > 255:
                    return line
                raw.append(ord(ch))
        better = raw.decode("utf-8", "replace")
        if better.count("�") > line.count("�") + 2:
            break
        line = better
    return line


def cues(text: str) -> list[list[str]]:
    """Lines of speech of each cue, without numbers, times, markup, labels and sound descriptions of any length."""
    lines = BREAKS.split(HIDDEN.sub("", text))
    damaged, marked, sounds, escaped = MOJIBAKE.search(text), "<" in text or "{" in text, any(c in text for c in "[(（♪♫"), "&" in text
    out: list[list[str]] = [[]]
    for k, line in enumerate(lines):
        if "-->" in line or (":" in line and TIMING.search(line)):
            out.append([])
            continue
        s = line.strip()
        if not s:
            continue
        if not s[0].isalpha() and NUMBER_LINE.match(s):
            j = k + 1
            while j < len(lines) and not lines[j].strip():
                j += 1
            if j >= len(lines) or TIMING.search(lines[j]):
                continue
        out[-1].append(s)
    done = []
    for cue in out:
        if not cue:
            continue
        ls = [misread(x) for x in cue] if damaged else cue
        if escaped or marked or sounds:
            t = "\n".join(ls)
            if escaped and "&" in t:
                t = html.unescape(html.unescape(t))
            ls = SOUND.sub(" ", MARKUP.sub("", t)).split("\n")
        ls = [LABEL.sub("", x).strip() if ":" in x else x.strip() for x in ls]
        ls = [x for x in ls if x]
        if ls:
            done.append(ls)
    return done


def fold(word: str) -> str:
    """Letters and digits of a word without case and accents; what can't be read stays as '?'."""
    if word.isascii():
        w = word.lower()
        return w if w.isalnum() else re.sub(r"[^a-z0-9?]", "", w).strip("?")
    w = unicodedata.normalize("NFKD", HIDDEN.sub("", word).casefold())
    out = []
    for ch in w:
        if unicodedata.combining(ch):
            continue
        if ch.isascii():
            if ch.isalnum():
                out.append(ch)
            elif ch == "?":
                out.append("?")
        elif ch in LOOKALIKES:
            out.append(LOOKALIKES[ch])
        elif ch.isalpha() or ch in "�÷³▀▄─╔§¶¤":
            out.append("?")
    return "".join(out) if "�" in word else "".join(out).strip("?")


_SHAPES = str.maketrans({"0": "o", "1": "l", "|": "l", "!": "l", "i": "l", "e": "c", "5": "s", "8": "b"})


def skeleton(w: str) -> str:
    """A folded word in which letters that recognition confuses are alike."""
    return w.translate(_SHAPES).replace("rn", "m").replace("rl", "n").replace("vv", "w").replace("h", "ll").replace("cl", "d")


#: Folded words that a worker remembers.
KEPT = 300_000
_FOLDED: dict[str, str] = {}


def folded(word: str) -> str:
    """fold(), remembered for a bounded number of words."""
    f = _FOLDED.get(word)
    if f is None:
        if len(_FOLDED) >= KEPT:
            _FOLDED.clear()
        f = _FOLDED[word] = fold(word)
    return f


def tokens(lines: list[str]) -> list[str]:
    """Folded words of a cue's lines; a word parted at a line's end by a hyphen is one word."""
    out: list[str] = []
    joined = False
    for line in lines:
        ws = line.split()
        for k, w in enumerate(ws):
            f = folded(w)
            if not f or f == "?":
                if k:
                    joined = False
                continue
            if joined and k == 0 and w[:1].islower():
                out[-1] += f
            else:
                out.append(f)
            joined = False
        joined = bool(ws) and len(ws[-1]) > 1 and ws[-1][-1] in "-‐‑" and ws[-1][-2].isalpha()
    if joined:
        out[-1] += "-"
    return out
