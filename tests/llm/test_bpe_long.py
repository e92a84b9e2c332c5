"""Long pieces: rounds that merge several pairs give what one merge at a time gives."""

import numpy as np
import pytest

from vistaquad.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.public_vocabulary()[0])


def one_by_one(vocabulary, piece):
    rank = {t: i for i, t in enumerate(vocabulary.tokens)}
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(rank.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)]
        if not found or min(found)[0] == 1 << 40:
            return [rank[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"aeinrst", b"abcdefghijklmnopqrstuvwxyz", bytes(range(256)), b" \n", "é東ö京".encode()])
def test_long_pieces(vocabulary, alphabet):
    rng = np.random.default_rng(len(alphabet))
    for n in (1, 2, 3, 5, 40, 333):
        for _ in range(6):
            piece = bytes(rng.choice(list(alphabet), n).tolist())
            want = one_by_one(vocabulary, piece)
            assert vocabulary.merge_long(piece).tolist() == want == vocabulary.merge_matrix([piece], n)[0].tolist()


def test_ranks_that_merges_undercut():
    """A vocabulary in which a merge makes a pair of lesser rank, so that one round may not merge all."""
    import base64
    import tempfile

    tokens = [bytes([b]) for b in range(256)] + [b"xab", b"aba", b"ab", b"ba", b"abab", b"xaba"]
    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken") as f:
        f.write(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
        f.flush()
        vocabulary = bpe.Vocabulary(f.name)
    rng = np.random.default_rng(9)
    for _ in range(300):
        piece = bytes(rng.choice(list(b"xab"), 30, p=[0.2, 0.4, 0.4]).tolist())
        assert vocabulary.merge_long(piece).tolist() == one_by_one(vocabulary, piece)
