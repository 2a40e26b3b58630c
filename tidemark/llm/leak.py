"""Evaluation texts leaking into training text: SimHash windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import checkpoint, need_columns, q, require, small
from .subtitles import cues, fold, skeleton, tokens

BITS, BLOCKS = 64, 4
#: All fingerprints within this many bits are found: fewer than there are blocks, so one block agrees.
RADIUS = BLOCKS - 1
#: Words of a fingerprinted window, half the words of the shortest run: of two windows side by side one holds at most one of three unreadable words.
WINDOW = 6
#: Words of a run that the search may be unable to read.
UNREAD = 3
#: Different words of items that a worker holds; items with more between them are searched in several passes, each within the bound (unless a single item isn't).
MAX_WORDS = 50_000
#: Rows of the items' fingerprints (four numbers each) that may be broadcast; more are joined by a shuffle.
INDEX_ROWS = 1_000_000


def reach(word: str) -> int:
    """How many edits a damaged word may be away from a word."""
    n = len(word)
    return 0 if n < 3 or any(c.isdigit() for c in word) else 1 if n < 8 else 2


def close(word: str) -> int:
    """The same for the search, which must not take other speech for damaged words; verification is wider."""
    return min(1, reach(word)) if len(word) >= 5 else 0


def edits(a: str, b: str, most: int) -> int:
    """Edits (with exchanges of neighbours; '?' is any letter) between two words, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y and x != "?" and y != "?"))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _drops(w: str, n: int) -> set[str]:
    found = {w}
    for _ in range(n):
        found |= {x[:i] + x[i + 1 :] for x in found for i in range(len(x))}
    return found


class Words:
    """Folded words -> ids of the passages' words that they are, perhaps damaged; 0 if they are none.

    Exact folded words and equal skeletons come first, else the one word within its reach of edits; if several are as near,
    it is none of them for the search, but verification still compares it.
    """

    KEPT = 300_000

    def __init__(self, vocabulary: list[str]):
        self.names = vocabulary  # id - 1 -> folded word
        self.exact = {w: k for k, w in enumerate(vocabulary, 1)}
        self.shape: dict[str, int] = {}
        self.shapes = [skeleton(w) for w in vocabulary]
        self.longest_shape = max(map(len, self.shapes), default=0)
        for k, s in enumerate(self.shapes, 1):
            self.shape[s] = k if s not in self.shape else 0
        self.folded: dict[str, int] = {}
        self.compared: dict[tuple[str, int], bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cuts: dict[str, tuple[str, str] | None] = {}
        self.longest = max(map(len, vocabulary), default=0)
        self.reaches = [reach(w) for w in vocabulary]
        self.near: dict[str, list[int]] = {}
        for k, (w, s) in enumerate(zip(vocabulary, self.shapes), 1):
            if close(w):
                for d in _drops(s, 1):
                    self.near.setdefault(d, []).append(k)

    def of(self, w: str) -> int:
        """Id of a folded word."""
        k = self.exact.get(w)
        if k is not None:
            return k
        s = skeleton(w)
        k = self.shape.get(s)
        if k is not None:
            return k
        if len(w) < 2 or len(s) > self.longest_shape + 1 or w.isdigit():
            return 0
        best, who = 3, 0
        tried = set()
        for d in _drops(s, 1):
            for k in self.near.get(d, ()):
                if k not in tried:
                    tried.add(k)
                    n = edits(s, self.shapes[k - 1], 1)
                    if n <= 1:
                        if n < best:
                            best, who = n, k
                        elif n == best and k != who:
                            who = 0
        return who

    def of_kept(self, w: str) -> int:
        """of(), remembered."""
        k = self.folded.get(w)
        if k is None:
            if len(self.folded) >= self.KEPT:
                self.folded.clear()
            k = self.folded[w] = self.of(w)
        return k

    def cut(self, w: str) -> tuple[str, str] | None:
        """The two words that were run together in w, if there are such."""
        if len(w) < 5 or len(w) > 2 * self.longest:
            return None
        if w not in self.cuts:
            if len(self.cuts) >= self.KEPT:
                self.cuts.clear()
            self.cuts[w] = next(((w[:p], w[p:]) for p in range(1, len(w)) if w[:p] in self.exact and w[p:] in self.exact), None)
        return self.cuts[w]

    def alike(self, a: str, b: str) -> bool:
        """_alike(), remembered."""
        r = self.pairs.get((a, b))
        if r is None:
            if len(self.pairs) >= self.KEPT:
                self.pairs.clear()
            r = self.pairs[a, b] = _alike(a, b)
        return r

    def same(self, w: str, k: int) -> bool:
        """Is the folded word w the word k, perhaps damaged? A word of the passages in its own right is only itself."""
        if self.exact.get(w, k) != k:
            return False
        r = self.compared.get((w, k))
        if r is None:
            if len(self.compared) >= self.KEPT:
                self.compared.clear()
            name, s, most = self.names[k - 1], skeleton(w), self.reaches[k - 1]
            r = w == name or s == self.shapes[k - 1] or (most > 0 and (edits(s, self.shapes[k - 1], most) <= most or edits(w, name, most) <= most))
            self.compared[w, k] = r
        return r


def speech(text: str, words: Words) -> tuple[list[str], list[int]]:
    """Folded words of a text's speech and their ids; words that a cue repeats from the end of the one before count once."""
    ws: list[str] = []
    ids: list[int] = []
    start = 0  # of the last cue
    for lines in cues(text):
        new = tokens(lines)
        if not new:
            continue
        if ws and ws[-1][-1] == "-":  # a word parted between cues
            ws[-1] = ws[-1][:-1]
            whole = words.of(ws[-1] + new[0])
            if whole:
                ws[-1] += new[0]
                ids[-1] = whole
                new = new[1:]
                if not new:
                    continue
        nid = [words.of_kept(w.rstrip("-")) for w in new]
        v, k = new[0], nid[0]
        for m in range(min(len(new), len(ws) - start), 0, -1):
            w = ws[-m]
            if (v == w or (k and k == ids[-m]) or _near(v, w, words)) and all(new[x] == ws[x - m] or (nid[x] and nid[x] == ids[x - m]) or _near(new[x], ws[x - m], words) for x in range(1, m)):
                break
        else:
            m = 0
        start = len(ws) - m
        ws += new[m:]
        ids += nid[m:]
    if ws:
        ws[-1] = ws[-1].rstrip("-") or "?"
    return ws, ids


def _near(v: str, w: str, words: Words) -> bool:
    return (v[0] == w[0] or v[-1] == w[-1] or len(v) >= 5 <= len(w) or abs(len(v) - len(w)) > 2) and words.alike(v, w)


def stretches(ids: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches that may hold a run of `least` words, all but UNREAD of which are readable.

    Words broken in two or run together aren't readable yet; at worst each unreadable place hides two words, or is two places.
    """
    n = least + UNREAD
    known = np.fromiter(ids, np.int64, len(ids)) > 0
    if len(known) <= n:
        if known.sum() >= least - 2 * UNREAD:
            yield 0, len(known)
        return
    c = np.concatenate([[0], np.cumsum(known)])
    at = np.flatnonzero(c[n:] - c[:-n] >= least - 2 * UNREAD)
    if len(at):
        gaps = np.flatnonzero(np.diff(at) > n)
        yield from zip(at[np.append(0, gaps + 1)].tolist(), (at[np.append(gaps, len(at) - 1)] + n).tolist())


def rejoined(ws: list[str], ids: list[int], words: Words) -> tuple[list[str], list[int]]:
    """Words broken in two by damage become one again, two words run together become two, where that gives passages' words."""
    w2: list[str] = []
    i2: list[int] = []
    k, n = 0, len(ws)
    while k < n:
        if k + 1 < n and (ids[k] == 0 or ids[k + 1] == 0 or ws[k] not in words.exact):
            both = ws[k] + ws[k + 1]
            j = words.of_kept(both) if len(both) >= 5 else 0
            # The first part alone may already be near the word (disperse s); then the second must be none in its own right.
            apart = both in words.exact and ids[k + 1] == 0 and ws[k] not in words.exact
            if j and (apart or (ids[k] != j and (ids[k + 1] != j or both in words.exact))):
                w2.append(both)
                i2.append(j)
                k += 2
                continue
        w = ws[k]
        if len(w) >= 5 and (ids[k] == 0 or (w not in words.exact and skeleton(w) not in words.shape)):
            cut = words.cut(w)
            if cut:
                w2 += cut
                i2 += [words.exact[x] for x in cut]
                k += 1
                continue
        w2.append(w)
        i2.append(ids[k])
        k += 1
    return w2, i2


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if a[0] != b[0] and a[-1] != b[-1] and min(len(a), len(b)) < 5:
        return False
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 3:
        return skeleton(a) == skeleton(b)
    s, t = skeleton(a), skeleton(b)
    return s == t or (len(s) > 4 and edits(s, t, 1) <= 1)


class Search(Words):
    """Words with the vectors of their fingerprints."""

    def __init__(self, known: list[tuple[str, float]]):
        super().__init__([w for w, _ in known])
        rng = np.random.default_rng(7)
        # A word's vector is its random signs, weighted by how rare it is among the items; an unreadable word has none.
        self.weight = np.array([0.0, *[x for _, x in known]])
        self.vectors = (np.where(rng.random((len(known) + 1, BITS)) < 0.5, -1.0, 1.0) * self.weight[:, None]).round(3)

    def prints(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of all windows' vectors, and their fingerprints."""
        c = np.cumsum(self.vectors[ids], axis=0)
        s = c[WINDOW - 1 :].copy()
        s[1:] -= c[:-WINDOW]
        return s, self.bits(s)

    @staticmethod
    def bits(sums: np.ndarray) -> np.ndarray:
        return np.packbits(np.round(sums, 3) > 0, axis=1, bitorder="little").view(np.int64).ravel()

    def windows(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, missing, fingerprint) of the windows with at most one unreadable word; missing: its place in the window, WINDOW if there is none."""
        a = np.array(ids, dtype=np.int64)
        if len(a) < WINDOW:
            return
        unread = a == 0
        at = np.flatnonzero(np.convolve(unread, np.ones(WINDOW, int), "valid") <= 1)
        if len(at):
            inside = unread[at[:, None] + np.arange(WINDOW)]
            missing = np.where(inside.any(axis=1), inside.argmax(axis=1), WINDOW)
            first, last = int(at[0]), int(at[-1])
            p = self.prints(a[first : last + WINDOW])[1][at - first]
            yield from zip(at.tolist(), missing.tolist(), p.tolist())

    def item_windows(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """The same of an item's words: every window whole, and with each of its words left out."""
        a = np.array(ids, dtype=np.int64)
        sums, p = self.prints(a)
        yield from zip(range(len(p)), [WINDOW] * len(p), p.tolist())
        for k in range(WINDOW):
            p = self.bits(sums - self.vectors[a[k : k + len(sums)]])
            yield from zip(range(len(p)), [k] * len(p), p.tolist())

    def may_match(self, mine: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
        """Rows of aligned codes in which `least` words in a row are equal or may be damaged: a cheap test before the exact one."""
        may = (np.abs(mine) == item) | ((mine <= 0) & (item > 0))
        c = np.cumsum(np.pad(may, ((0, 0), (1, 0))), axis=1)
        return (c[:, least:] - c[:, :-least] == least).any(axis=1)

    def similarity(self, mine: list[str], item: list[str], shift: int, least: int, shingle: int = 5) -> float:
        """Best weighted share of an item's word shingles, over stretches of `least` words, that the text has in the same places.

        Word k of the text stands against word k + shift of the item. A damaged word is the item's word; a shingle counts with
        the rarity of its words, and is there if all its words are. 1 means that a stretch is there word for word.
        """
        lo, hi = max(0, -shift), min(len(mine), len(item) - shift)
        if hi - lo < least:
            return 0.0
        mine, item = mine[lo:hi], item[lo + shift : hi + shift]
        k = np.array([self.exact[x] for x in item])
        ok = np.array([x == y or self.same(x, int(z)) for x, y, z in zip(mine, item, k)], dtype=float)
        n = min(shingle, least)
        view = np.lib.stride_tricks.sliding_window_view
        weight = view(self.weight[k], n).sum(axis=1)
        found = weight * view(ok, n).min(axis=1)
        whole = np.ones(least - n + 1)
        return float((np.convolve(found, whole, "valid") / np.convolve(weight, whole, "valid")).max())


#: Stands for no word in rows of codes.
NOTHING = 2**30


def item_words(passage: str) -> list[str]:
    return [f for f in (fold(w) for w in passage.split()) if f and f != "?"]


def blocks(df: DataFrame) -> DataFrame:
    """A row for each block of a fingerprint, with the key by which fingerprints meet."""
    parts = [F.struct(F.lit(b).alias("b"), F.shiftrightunsigned("fp", 16 * b).bitwiseAND(F.lit(0xFFFF)).alias("v")) for b in range(BLOCKS)]
    d = df.withColumn("x", F.explode(F.array(*parts)))
    return d.withColumn("key", ((F.col("missing") * BLOCKS + F.col("x.b")) * 65536 + F.col("x.v")).cast("bigint")).withColumn("block", F.col("x.b")).drop("x")


def within_radius(a: Column, b: Column, block: Column) -> Column:
    """Do fingerprints that agree on a block lie within the radius, and on none of the blocks before? So each pair counts once."""
    differ = a.bitwiseXOR(b)
    met = F.bit_count(differ) <= RADIUS
    for k in range(BLOCKS - 1):
        met = met & ((block <= k) | (differ.bitwiseAND(F.lit(0xFFFF << (16 * k))) != 0))
    return met


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", least: int = 12, similarity: float = 1.0) -> DataFrame:
    """(item_id, doc_id): documents whose speech has at least `least` consecutive words of an item's passage, one row per pair.

    Case, punctuation and accents don't count; cue numbers, times, markup, line breaks, labels and sound descriptions don't
    interrupt; words repeated from the cue before count once; damaged words are still those words, other words aren't. Null
    and empty texts and passages shorter than `least` words have no leaks; repeated rows give one row; whole texts are
    searched. similarity: least weighted share of a stretch's five-word shingles; below 1, stretches with other words count too.

    Method: windows of WINDOW words get a SimHash of their words' rarity-weighted signs, in the texts as in the items; windows
    with one unreadable word get that of the other words, as do the items' windows for each word left out. Fingerprints meet by
    equi-joins of their blocks, which find all within RADIUS bits; the exact weighted-shingle similarity of the words around
    them verifies each candidate. Found are all runs with at most UNREAD words that the search can't read (verification
    reads more damage than the search does). Texts are read once and not sent; only windows of the items' words are, with
    their surroundings. Items beyond MAX_WORDS different words are searched in several passes.
    """
    need_columns(docs, [doc_id, text], "documents")
    need_columns(items, [item_id, passage], "items")
    require(least >= 2 * WINDOW, f"least must be at least {2 * WINDOW}")
    spark = docs.sparkSession

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ws = [item_words(p) for p in b["p"]]
            yield pd.DataFrame({"p": b["p"], "ws": ws})[[len(w) >= least for w in ws]]

    every = items.select(q(item_id).alias("i"), q(passage).alias("p")).where("i is not null and p is not null").distinct()
    # Equal passages are one item to the search.
    texts = checkpoint(every.select("p").distinct().mapInPandas(read, "p string, ws array<string>").withColumn("item", F.monotonically_increasing_id()))
    src = docs.select(q(doc_id).alias("d"), q(text).alias("t")).where("d is not null and t is not null")
    part = lambda n: F.pmod(F.xxhash64("item"), F.lit(n))
    count, passes = texts.count(), 1
    while passes < count and texts.select(part(passes).alias("k"), F.explode("ws").alias("w")).groupBy("k").agg(F.count_distinct("w").alias("n")).agg(F.max("n")).first()[0] > MAX_WORDS:
        passes *= 2
    found = None
    for k in range(passes if count else 0):
        some = texts if passes == 1 else texts.where(part(passes) == k)
        got = _search(spark, src, some.select("item", "ws"), least, similarity)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], T.StructType([T.StructField(item_id, items.schema[item_id].dataType), T.StructField(doc_id, docs.schema[doc_id].dataType)]))
    of = texts.select("item", "p").join(every, "p").select("item", "i")
    return found.join(small(of), "item").select(F.col("i").alias(item_id), F.col("d").alias(doc_id)).distinct()


def _search(spark: SparkSession, src: DataFrame, texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """(item, d) of the leaks of some items (item, ws)."""
    total = texts.count()
    counts = texts.select("item", F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    known = spark.sparkContext.broadcast({"words": sorted((r.w, 1.0 + math.log((1 + total) / (1 + r.n))) for r in counts.collect())})
    around = least - WINDOW
    span = WINDOW + 2 * around

    def search() -> Search:
        """Built once in a worker, which keeps the broadcast value."""
        box = known.value
        if "built" not in box:
            box["built"] = Search(box["words"])
        return box["built"]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = search()
        for b in batches:
            rows = [(i, *x) for i, ws in zip(b["item"], b["ws"]) for x in s.item_windows([s.exact[w] for w in ws])]
            yield pd.DataFrame(rows, columns=["item", "place", "missing", "fp"])

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = search()
        for b in batches:
            yield pd.DataFrame({"item": b["item"], "ws": [np.array([s.exact[w] for w in ws], np.int32).tobytes() for ws in b["ws"]]})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = search()
        pad = np.full(around, NOTHING, np.int32)
        for b in batches:
            rows = []
            for d, t in zip(b["d"], b["t"]):
                words, ids = speech(t, s)
                for begin, end in stretches(ids, least):
                    ws, ks = rejoined(words[begin:end], ids[begin:end], s)
                    # Codes: a word as it stands, minus a word that it is near, 0 an unreadable one.
                    code = np.concatenate([pad, np.array([k if k == 0 or w in s.exact else -k for w, k in zip(ws, ks)], np.int32), pad])
                    for at, missing, fp in s.windows(ks):
                        rows.append((d, missing, fp, code[at : at + span].tobytes(), " ".join(ws[max(0, at - around) : at + WINDOW + around])))
            yield pd.DataFrame(rows, columns=["d", "missing", "fp", "code", "near"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = search()
        for b in batches:
            mine = np.frombuffer(b"".join(b["code"]), np.int32).reshape(len(b), span)
            # Codes of the batch's items in one row, each between words that are none.
            k, items = pd.factorize(b["item"])
            codes = [np.frombuffer(x, np.int32) for x in b["ws"].to_numpy()[np.unique(k, return_index=True)[1]]] if len(b) else []
            line = np.concatenate([np.full(span, NOTHING, np.int32), *[y for c in codes for y in (c, np.full(span, NOTHING, np.int32))]])
            begin = np.cumsum([span, *[len(c) + span for c in codes]])[k]
            place = b["place"].to_numpy()
            if similarity < 1:
                some = np.arange(len(b))
            else:
                theirs = line[(begin + place - around)[:, None] + np.arange(span)]
                some = np.flatnonzero(s.may_match(mine, np.where(theirs == NOTHING, -1, theirs), least))
            known, ok = set(), []
            for x, near, item, d in zip(some.tolist(), b["near"].to_numpy()[some], b["item"].to_numpy()[some], b["d"].to_numpy()[some]):
                if (item, d) not in known:
                    at = int((mine[x, :around] != NOTHING).sum())  # the window's place in the words around it
                    if s.similarity(near.split(" "), [s.names[c - 1] for c in codes[k[x]]], int(place[x]) - at, least) >= similarity - 1e-9:
                        known.add((item, d))
                        ok.append(x)
            yield b.iloc[ok][["item", "d"]]

    d = src.schema["d"].dataType.simpleString()
    ix = checkpoint(blocks(texts.mapInPandas(index, "item bigint, place int, missing int, fp bigint")).select("key", "block", F.col("fp").alias("ifp"), "item", "place"))
    w = blocks(src.mapInPandas(windows, f"d {d}, missing int, fp bigint, code binary, near string"))
    w = w.join(small(ix.withColumnRenamed("block", "iblock"), INDEX_ROWS), "key")
    pairs = w.where(within_radius(F.col("fp"), F.col("ifp"), F.col("block"))).select("d", "near", "code", "item", "place")
    codes = checkpoint(texts.mapInPandas(coded, "item bigint, ws binary"))
    return pairs.join(small(codes), "item").select("item", "d", "near", "code", "place", "ws").mapInPandas(verify, f"item bigint, d {d}").distinct()
