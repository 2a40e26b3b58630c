"""Encoding of a corpus with a byte-level BPE vocabulary; merges are found by a segment tree over byte positions."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import need_columns, q

# Fixed value: how byte_bpe_50k cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a task keeps; beyond it the store is emptied, so memory stays bounded.
KEPT = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank (its id) from a file of base64 tokens and ranks."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: repeatedly merge the leftmost pair of least rank until no pair has a rank.

    Leaf i of the segment tree holds the rank of the pair that starts at byte position i (and i itself, so that the least key
    is the leftmost of least rank); a node holds the least of its two children. A merge changes the pairs at the merged token
    and at its left neighbour and ends the pair of its right neighbour: three point updates of logarithmic cost. Live
    neighbours are linked by positions.
    """
    n = len(piece)
    if n == 0:
        return ()
    if n == 1:
        return (ranks[piece],)
    none = 1 << 62
    size = 1
    while size < n:
        size *= 2
    tree = [none] * (2 * size)
    token = [piece[i : i + 1] for i in range(n)]
    after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for v in range(size - 1, 0, -1):
        a, b = tree[2 * v], tree[2 * v + 1]
        tree[v] = a if a < b else b

    def put(i: int, key: int) -> None:
        v = size + i
        if tree[v] == key:
            return
        tree[v] = key
        v >>= 1
        while v:
            a, b = tree[2 * v], tree[2 * v + 1]
            least = a if a < b else b
            if tree[v] == least:
                return
            tree[v] = least
            v >>= 1

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return none
        r = ranks.get(token[i] + token[j])
        return none if r is None else r * n + i

    while tree[1] < none:
        i = tree[1] % n
        j = after[i]
        token[i] += token[j]
        after[i] = after[j]
        if after[j] < n:
            ahead[after[j]] = i
        put(j, none)
        put(i, pair(i))
        if ahead[i] >= 0:
            put(ahead[i], pair(ahead[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i]])
        i = after[i]
    return tuple(out)


class Pieces(dict):
    """Piece -> ids, found when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        ids = self[piece] = encode_piece(piece.encode("utf-8"), self.ranks)
        return ids


def encode(text: str | None, pieces: Pieces, cut) -> list[int]:
    """Ids of a text without special tokens; null and empty texts have none."""
    return list(chain.from_iterable(map(pieces.__getitem__, cut(text)))) if text else []


def encode_corpus(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(id, ids): token ids of each text by the byte-level BPE in the file `vocabulary` (read by the driver), one row per input row.

    Null and empty texts give an empty list, blank texts the ids of their blanks; special tokens' strings are ordinary text.
    Whole texts are encoded, whatever their length; repeated rows give repeated results. There is no shuffle.
    """
    import pyarrow as pa
    import regex

    need_columns(docs, [id_col, text_col])
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # the vocabulary's size is fixed (about 1 MB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        import numpy as np

        pieces, cut = Pieces(ranks.value), regex.compile(pattern).findall
        get = pieces.__getitem__
        for b in batches:
            values, ends = array("i"), np.zeros(len(b) + 1, dtype=np.int64)
            for k, text in enumerate(b.column(1).to_pylist(), 1):
                if text:
                    values.extend(chain.from_iterable(map(get, cut(text))))
                ends[k] = len(values)
            if ends[-1] < 2**31 - 1:
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(values, dtype=np.int32) if len(values) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["id", "ids"])
            else:
                for k in range(len(b)):
                    one = np.frombuffer(values, dtype=np.int32)[ends[k] : ends[k + 1]]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([one], pa.list_(pa.int32()))], names=["id", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(q(id_col).alias("id"), q(text_col).alias("text")).mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids")
