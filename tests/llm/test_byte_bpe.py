"""op13: the operator against the library on whole texts, and against merges made one by one."""

import hashlib
import re

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import byte_bpe, queries

RANKS = byte_bpe.load_ranks(public_tokenizers.path(queries.BYTE_RANKS))
LIBRARY = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = "/root/testdata/sf0.001"
TEXTS = st.one_of(
    st.text(st.characters(blacklist_categories=["Cs"]), max_size=120),
    st.text("ab'sdt re1 9.,!\n\t  é日٣\x1c\x85", max_size=200),
)


def plain_ids(text):
    """The pair of least rank is merged first, the leftmost of equals, in each match of the pattern."""
    ids = []
    for match in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in match.encode()]
        while len(parts) > 1:
            ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        ids += [RANKS[p] for p in parts]
    return ids


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_give_the_ids_of_the_whole_text(text):
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN, piece=3)
    ids = encoder.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text) and encoder.decode(ids).decode() == text
    assert "".join(byte_bpe.pieces(text, 3)) == text


@settings(max_examples=100, deadline=None)
@given(st.text("the and wórds 12 '.,ing\n", max_size=60))
def test_ids_are_those_of_merges_made_one_by_one(text):
    assert byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode(text).tolist() == plain_ids(text)


def test_long_texts_are_cut_and_long_blanks_are_one_match():
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    prose = "some words, 12 of them don't end\n" * 20_000
    assert encoder.encode(prose).tolist() == LIBRARY.encode_ordinary(prose)
    assert max(map(len, byte_bpe.pieces(prose))) < 60_000
    # The library's pattern fails on such runs; each is one match, less its last character if more follows.
    n = 2_000_000
    want = LIBRARY.encode_ordinary("ab") + LIBRARY._encode_single_piece(" " * (n - 1)) + LIBRARY.encode_ordinary(" cd")
    assert encoder.encode("ab" + " " * n + "cd").tolist() == want
    assert encoder.encode("ab" + "\n" * n).tolist() == LIBRARY.encode_ordinary("ab") + LIBRARY._encode_single_piece("\n" * n)


def test_tables_with_every_oddity(spark):
    rows = [(None, None), (1, None), (2, ""), (2, ""), (3, "<|endoftext|> is plain"), (4, "x" * 200_000), (None, "no id"), (5, "日本語 🎉"), (5, "日本語 🎉")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, ids string, decoded string")
    coded = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.decode_ids(coded, RANKS, public_tokenizers.PATTERN).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    want = sorted(((i, None if t is None else LIBRARY.encode_ordinary(t)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == want
    assert all((r.decoded is None) if r.ids is None else (bytes(r.decoded) == LIBRARY.decode_bytes(r.ids)) for r in got)
    assert byte_bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    # Tokens may end inside a character: decoding is of bytes, not of text.
    half = spark.createDataFrame([(1, LIBRARY.encode_ordinary("🎉")[:1])], "doc_id long, ids array<int>")
    assert bytes(byte_bpe.decode_ids(half, RANKS, public_tokenizers.PATTERN).first().decoded) == "🎉".encode()[: len(LIBRARY.decode_bytes(LIBRARY.encode_ordinary("🎉")[:1]))]


def test_the_query_is_the_library_on_whole_documents(spark):
    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = LIBRARY.encode_ordinary(d.text or ""), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_white_space_is_the_property_of_that_name():
    spaces = {chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and regex.fullmatch(r"\p{White_Space}", chr(c))}
    assert {chr(c) for c in range(0x110000) if re.fullmatch(f"[{byte_bpe._SPACE}]", chr(c))} == spaces


def test_a_token_that_is_not_there_is_an_error(spark):
    wrong = spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="(?i)token|key"):
        byte_bpe.decode_ids(wrong, RANKS, public_tokenizers.PATTERN).collect()
