from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from binsift.llm import bytepairs
from binsift.llm._spark import table
from binsift.llm.queries import QUERIES

#: Blanks, digits, letters of several scripts and of the newest Unicode versions, quotes and marks that the pattern tells apart.
SIGNS = list(" \n\t\x1c\x85　'strevmldXé漢字ß٣9½²-.,#🙂́Ᲊᲊ\U00010d4a\U0001cc00࢏꟎")


@pytest.fixture(scope="module")
def ranks():
    return bytepairs.Ranks.load(chunk=64, overlap=16)


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})


def as_list(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(st.sampled_from(SIGNS), max_size=80), st.text(max_size=40)))
def test_encodes_as_the_library(ranks, library, text):
    assert as_list(bytepairs.Encoder(ranks).encode(text)) == library.encode_ordinary(text)


def test_classes_are_the_librarys_for_every_character(ranks, library):
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    text = "".join(f"{c}a{c} 1{c}" for c in every)
    e = bytepairs.Encoder(ranks)
    e.size = 1 << 40
    assert as_list(e.encode(text)) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(text=st.lists(st.sampled_from(SIGNS + ["    ", "a" * 24, "1234567890" * 2, "\n\n\n\n", "'re"]), min_size=20, max_size=200).map("".join))
def test_chunks_stitched_are_the_pieces_of_the_whole(ranks, text):
    for chunk, overlap in ((16, 8), (40, 4), (16, 0)):
        n = -(-len(text) // chunk)
        words = ranks.words(text)
        ends = [bytepairs.sure_ends(words, text[i * chunk : (i + 1) * chunk + overlap], (i + 1) * chunk >= len(text)) + i * chunk for i in range(n)]
        found = list(bytepairs.stitched(words, text, chunk, ends))
        assert np.concatenate([e for _, e in found]).tolist() == bytepairs.ends_of(words, text).tolist()
        assert [at for at, _ in found] == [0, *(int(e[-1]) for _, e in found)][:-1]


def test_long_texts_in_chunks_equal_the_library(ranks, library, docs):
    rng = random.Random(1)
    texts = ["".join(rng.choices(SIGNS, k=rng.randrange(500))) for _ in range(60)]
    texts += ["a" * 5000, " " * 3000 + "b", "1" * 1000 + " x", "\n" * 700, "it's we're " * 400]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[61]), (7, texts[62]), (7, texts[62]), (None, texts[63])]
    encoded = bytepairs.encode(docs(rows), ranks)
    got = sorted(((r.doc_id is None, r.doc_id or 0), as_list(r.ids)) for r in encoded.collect())
    assert got == sorted(((i is None, i or 0), library.encode_ordinary(t)) for i, t in rows)
    back = sorted(((r.doc_id is None, r.doc_id or 0), bytes(r.decoded)) for r in bytepairs.decode(encoded, ranks).collect())
    assert back == sorted(((i is None, i or 0), t.encode()) for i, t in rows)


def test_a_long_piece_takes_no_square_of_time(ranks, library):
    text = "".join(random.Random(2).choices("abcdefgh", k=300_000))
    assert as_list(bytepairs.Encoder(ranks).encode(text)) == library.encode_ordinary(text)


def test_query_equals_the_library_on_whole_tables(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_byte_level_bpe"](spark, sf).collect()}
    want = {}
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want


def test_defined_cases(spark, docs, clashing, ranks):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "word " * 60_000), (3, "word " * 60_000), (4, "x"), (4, "x")]
    got = bytepairs.round_trip(clashing(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 60_001), (3, 60_001), (4, 1), (4, 1)]
    assert {r.ids_sha256 for r in got if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}
    assert bytepairs.round_trip(docs([])).count() == 0
    assert bytes(bytepairs.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), ranks).first().decoded) == b""
