import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assay.llm import packing
from assay.llm.queries import WORD_VOCABULARY
from tests.llm.conftest import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_bins_hold_what_is_placed(lengths, most):
    packer = packing.Packer(50, most)
    used: dict = {}
    for n in lengths:
        number, at = packer.place(n)
        assert used.get(number, 0) == at
        used[number] = at + n
        assert used[number] <= 50 and packer.n_open <= most
    for number, fill in packer.still_open():
        assert used[number] == fill


def test_best_fit_takes_the_fullest_bin_that_fits():
    packer = packing.Packer(10, 8)
    assert [packer.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    packer = packing.Packer(10, 1)
    assert [packer.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_are_the_tokenizers(text):
    assert packing.word_tokenizer(WORD_VOCABULARY)(text) == library(text)


def library(text):
    own = Tokenizer.from_file(public_tokenizers.path(WORD_VOCABULARY))
    return np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


#: The characters of the tokenizer's own fast path.
LATIN = [chr(i) for i in (*range(9, 14), *range(32, 127), *range(0xA1, 0x130), *range(0x131, 0x180))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(LATIN), max_size=80))
def test_ids_of_latin_texts_are_the_tokenizers(text):
    assert packing._PLAIN.fullmatch(text) or "\xad" in text
    assert packing.word_tokenizer(WORD_VOCABULARY)(text) == library(text)


def test_special_tokens_are_those_of_the_library():
    for text in ("a <|endoftext|> b", "<|startoftext|>", "A <|EndOfText|> B", "x<|endoftext|", "it's we'll 'SAYS'", "é <|endoftext|>"):
        assert packing.word_tokenizer(WORD_VOCABULARY)(text) == library(text)


@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_packer_is_best_fit_by_brute_force(lengths, most):
    packer, open_bins, made = packing.Packer(20, most), {}, 0
    for n in lengths:
        number, at = packer.place(n)
        free = [f for f in open_bins.values() if f >= n]
        if free:
            assert open_bins[number] == min(free) and at == 20 - min(free)
            left = open_bins.pop(number) - n
        else:
            assert (number, at) == (made, 0)
            made, left = made + 1, 20 - n
        if left:
            if len(open_bins) == most:
                # the fullest closes; which of equally full ones is the packer's choice
                fullest = min(open_bins.values())
                still = {b for b, _ in packer.still_open()}
                closed = [b for b in open_bins if b not in still]
                assert len(closed) == 1 and open_bins[closed[0]] == fullest
                del open_bins[closed[0]]
            open_bins[number] = left


def test_few_sequences_are_needed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, WORD_VOCABULARY).select("sequence_id", "length").collect()
    assert len({r.sequence_id for r in got}) <= 1.02 * sum(r.length for r in got) / packing.CAPACITY + 2


def test_odd_rows_are_packed_whole(docs):
    got = packing.pack_documents(docs(ODD), WORD_VOCABULARY).collect()
    tokens = packing.word_tokenizer(WORD_VOCABULARY)
    want = []
    for i, t in ODD:
        raw = tokens(t or "") + bytes(4)
        want += [(str(i), k, k * 2048, len(raw[at : at + 8192]) // 4, zlib.crc32(raw[at : at + 8192])) for k, at in enumerate(range(0, len(raw), 8192))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in places.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack_documents(docs([]), WORD_VOCABULARY).collect() == []


def test_lengths_out_of_range_fail(spark):
    with pytest.raises(Exception, match="can be packed"):
        packing.best_fit(spark.createDataFrame([(1, 5000)], "doc_id long, length long")).collect()
