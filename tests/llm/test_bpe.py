import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import bpe
from assay.llm.queries import BYTE_VOCABULARY
from tests.llm.conftest import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    own = bpe.codec(BYTE_VOCABULARY)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_matches_the_library(both):
    own, want = both
    random.seed(4)
    kinds = ["abc d", "éçñü ab", "日本語 한 ", "\x1c\x1d\x85\xa0  a1", "🎉👍🏽 a", "'s't're 12 .,!"]
    texts = ["", "a" * 3000, "".join(random.choice("abcdefgh") for _ in range(4000))]
    texts += ["".join(random.choice(random.choice(kinds)) for _ in range(random.randint(0, 60))) for _ in range(800)]
    for t in texts:
        ids = own.encode(t)
        assert ids == want.encode_ordinary(t), t[:60]
        assert own.decode(ids) == t.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_merges_are_the_lowest_rank_first(both, piece):
    ranks = both[0].ranks
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            break
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert bpe.merge(piece, ranks) == [ranks[p] for p in parts]


def test_odd_rows_and_round_trip(docs, both):
    want = []
    for i, t in ODD:
        ids = both[1].encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.round_trip(docs(ODD), BYTE_VOCABULARY).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    assert bpe.round_trip(docs([]), BYTE_VOCABULARY).collect() == []
    back = bpe.decode(bpe.encode(docs(ODD), BYTE_VOCABULARY), BYTE_VOCABULARY).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t in ODD)
