import os
import random

import pytest
import regex

from tests.conftest import rows
from tidemark.llm.tokens import PATTERN, Pieces, encode, encode_corpus, encode_piece, read_ranks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(VOCABULARY)


def slow(piece, ranks):
    """Merge by scanning all pairs each time."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not known:
            return tuple(ranks[p] for p in parts)
        i = min(known)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_pieces_against_plain_scan(ranks):
    rnd = random.Random(0)
    for n in [*range(0, 30), 200]:
        for _ in range(5):
            piece = bytes(rnd.choice(b"abe theing\xc3\xa9\xff  ") for _ in range(n))
            assert encode_piece(piece, ranks) == slow(piece, ranks)


def test_texts_against_a_library(ranks):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcdeéß 漢字\n\t 🙂٣٤　​'sthe ing<|endoftext|>\x00 ") for _ in range(rnd.randint(0, 80))) for _ in range(500)] + ["a" * 20_000, "ab" * 9000, " " * 5000, "<|endoftext|>"]
    pieces, cut = Pieces(ranks), regex.compile(PATTERN).findall
    for t in texts:
        assert encode(t, pieces, cut) == ref.encode_ordinary(t)
        assert ref.decode(encode(t, pieces, cut)) == t


def test_corpus(frame, ranks):
    df = frame("ids long, text string, id string", [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x"), (4, " \n ", "x"), (5, "x" * 100_000, "y")])
    got = rows(encode_corpus(df, VOCABULARY, id_col="ids"))
    assert [(i, len(x)) for i, x in got][:4] == [(1, 2), (1, 2), (2, 0), (3, 0)] and got[5][0] == 5
    assert encode_corpus(df.limit(0), VOCABULARY, id_col="ids").count() == 0
